from tests.test_fixtures import SQUARE, grid
from trilattice.model import from_rows
from trilattice.plans import chains


def test_clean_compare_choose(spark):
    nodes, elements, open_, land = SQUARE
    m = from_rows(spark, [*nodes, (10, 0, 1), (11, 0, 1), (10.5, 1, 1)], [*elements, (5, 6, 7)], open_, land)
    after = chains.clean(m, chains.Recipe("square", trim_rounds=0))
    assert after.elements.count() == 4 and after.nodes.count() == 5
    rows = {r.metric: r for r in chains.compare(m, after).collect()}
    assert len(rows) == 15 and rows["n_disjoint_elems"].delta == -1
    good = from_rows(spark, *grid())
    assert chains.choose({"island": m, "grid": good}) == "grid"
