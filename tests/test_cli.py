from tests.test_fixtures import SQUARE, grid
from trilattice import cli
from trilattice.model import from_rows
from trilattice.operators import patches
from trilattice.operators import repair as R
from trilattice.operators import topology as P
from trilattice.sources.mesh_text import read_mesh_text, write_mesh_text


def test_commands(spark, tmp_path, capsys):
    good, bad = str(tmp_path / "g.14"), str(tmp_path / "b.14")
    write_mesh_text(from_rows(spark, *grid()), good)
    nodes, elements, *rest = SQUARE
    write_mesh_text(from_rows(spark, [*nodes, (10, 0, 1), (11, 0, 1), (10.5, 1, 1)], [*elements, (5, 6, 7)], *rest), bad)
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("qa", good) == 0 and run("qa", bad) == 1 and run("check", bad) == 1
    assert run("quality", good, "--least", "alpha_mean=0.5") == 0 and run("quality", good, bad, "--most", "n_components=1") == 1
    out = str(tmp_path / "both.14")
    assert run("combine", good, bad, "--out", out) == 0 and read_mesh_text(spark, out).elements.count() == 23
    assert run("combine", good) == 2 and run("export", good, "--out", tmp_path, "--coriolis") == 0
    assert "grd" in capsys.readouterr().out


def test_patches_and_valence(spark):
    m = from_rows(spark, *grid())
    plan = patches.plan(m, m.elements.where("elem_id in (0, 1, 17)").selectExpr("mesh_id", "elem_id", "'c1' as check"), ring=0).orderBy("patch").collect()
    assert [(r.patch, r.n_seeds, r.n_elements) for r in plan] == [(0, 1, 1), (1, 1, 1), (17, 1, 1)]
    one = patches.plan(m, m.elements.where("elem_id in (0, 1, 17)").selectExpr("mesh_id", "elem_id", "'c1' as check"), ring=2).collect()
    assert len(one) == 1 and (one[0].patch, one[0].n_seeds, one[0]["class"]) == (0, 3, "open")
    import math

    rim = [(math.cos(2 * math.pi * i / 12), math.sin(2 * math.pi * i / 12), 1) for i in range(12)]
    fan = from_rows(spark, [(0, 0, 1), *rim], [(0, 1 + i, 1 + (i + 1) % 12) for i in range(12)])
    eased, n = R.relieve_nodes(fan, 8, 0.0)
    assert n >= 4 and P.valence(eased).where("valence > 8").isEmpty() and eased.elements.count() == 12
