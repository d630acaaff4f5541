from trilattice.streaming.arrivals import watch
from trilattice.model import from_rows
from tests.test_fixtures import grid


def test_gate_over_arriving_meshes(spark, tmp_path):
    m = from_rows(spark, *grid(), mesh_id="a")
    m.elements.write.parquet(str(tmp_path / "elements"))
    seen = {}
    q = watch(spark, str(tmp_path / "elements"), lambda: m.nodes, lambda: m.boundary, lambda r, i: seen.update({i: r.collect()}), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(seen) == 1 and all(r.passed and r.mesh_id == "a" for r in seen[0]) and len(seen[0]) == 23
