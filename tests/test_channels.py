"""Narrow water, references, summaries and splits on small meshes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilattice.model import BOUNDARY, ELEMENTS, NODES, Mesh, from_rows
from trilattice.operators import boundary as B
from trilattice.operators import channels as C
from trilattice.operators import references as N
from trilattice.operators import repair as R
from trilattice.operators import summary as Y
from trilattice.operators import topology as P
from trilattice.sources.vector import read_points_csv


def strip(spark, cells):
    """A strip of unit squares, two elements each, open at its west end, with a land line all around."""
    nodes = [(i, j, 5.0) for i in range(cells + 1) for j in (0, 1)]
    elements = [e for i in range(cells) for e in ((2 * i, 2 * i + 2, 2 * i + 3), (2 * i, 2 * i + 3, 2 * i + 1))]
    around = [2 * i for i in range(cells + 1)] + [2 * i + 1 for i in range(cells, -1, -1)]
    return from_rows(spark, nodes, elements, [[1, 0]], [(0, around)])


@pytest.mark.parametrize("cells, action, lost", [(7, "delete", [10, 11, 12, 13]), (12, "widen", [])])
def test_a_throat_goes_with_a_small_basin_and_stays_before_a_large_one(spark, cells, action, lost):
    m = strip(spark, cells)
    got = C.throats(m, m.elements.where("elem_id in (8, 9)")).collect()
    assert {r.elem_id: r.action for r in got if r.part == "throat"} == {8: action, 9: action}
    assert sorted(r.elem_id for r in got if r.part == "basin") == lost
    assert C.without_throats(m, C.throats(m, m.elements.where("elem_id in (8, 9)"))).elements.count() == 2 * cells - (2 + len(lost) if lost else 0)


def test_both_banks_of_one_line_make_water_narrow(spark):
    m = strip(spark, 12)
    wide = m.with_(boundary=m.land)
    got = {r.elem_id: r for r in C.under_resolved(wide, 0.1).collect()}
    assert len(got) >= 16 and all(0.9 < r.width < 1.2 for r in got.values() if 4 < r.elem_id < 18)
    one_bank = m.with_(boundary=m.land.where("pos <= 12"))
    assert C.under_resolved(one_bank, 0.1).count() == 0


def test_empty_meshes_have_no_rows(spark):
    m = Mesh(*(spark.createDataFrame([], s) for s in (NODES, ELEMENTS, BOUNDARY)))
    narrow = C.under_resolved(m, 0.5)
    frames = [narrow, C.throats(m, narrow), C.bank_to_bank(m), Y.coordinate_kind(m.nodes), Y.bounding_box(m), Y.incident(m.elements), Y.perpendicularity(m), Y.element_flags(m), Y.boundary_neighbours(m), Y.boundary_edge_places(m)]
    frames += [R.split_edges(m, R.mutual_longest(m)).elements, B.line_samples(m.nodes.withColumn("pos", F.lit(0)), ["mesh_id"], 5.0, 0.0), B.band(m.nodes.selectExpr("mesh_id", "0 as pos", "x", "y", "depth as h"), ["mesh_id"])]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_a_mesh_without_boundary(spark):
    m = from_rows(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1)], [(0, 1, 2)])
    assert C.under_resolved(m, 0.5).count() == 0
    box = Y.bounding_box(m).first()
    assert (box.xmin, box.ymin, box.xmax, box.ymax, box.of_open) == (0, 0, 1, 1, False)
    assert Y.coordinate_kind(m.nodes).first().kind == "lonlat"
    assert [r.action for r in C.throats(m, m.elements).collect()] == ["delete"]


def test_split_edges_keep_area_and_orientation_and_enter_lists(spark):
    m = strip(spark, 3)
    after = R.split_edges(m, spark.createDataFrame([("m", 0, 2), ("m", 5, 7)], "mesh_id string, u long, v long"))
    areas = [r.area for r in P.geometry(after).collect()]
    assert len(areas) == 8 and min(areas) > 0 and math.isclose(sum(areas), 3)
    ring = [r.node_id for r in after.land.orderBy("pos").collect()]
    assert ring == [0, 8, 2, 4, 6, 7, 9, 5, 3, 1]


def test_a_node_listed_twice_has_no_neighbours(spark):
    m = strip(spark, 3)
    got = {r.node_id: (r.prev, r.next, r.listed) for r in Y.boundary_neighbours(m).collect()}
    assert got[0] == (None, None, 2) and got[1] == (None, None, 2) and got[4] == (2, 6, 1)


def test_quantiles_are_those_of_numpy(spark):
    values = [float(v) for v in np.random.default_rng(3).integers(0, 40, 501)] + [7.0] * 300
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 2.0)], "mesh_id string, v double")
    got = {r.mesh_id: r.q for r in Y.quantiles(df, "v", [0.0, 0.05, 0.5, 0.937, 1.0]).collect()}
    assert np.allclose(got["a"], np.quantile(values, [0.0, 0.05, 0.5, 0.937, 1.0])) and got["b"] == [2.0] * 5


def test_long_axis(spark):
    rng = np.random.default_rng(5)
    cloud = rng.normal(size=(200, 2)) @ np.array([[3.0, 1.0], [0.2, 0.5]])
    df = spark.createDataFrame([("c", float(x), float(y)) for x, y in cloud] + [("one", 1.0, 1.0)] + [("flat", float(i), 2.0) for i in range(4)] + [("up", 2.0, float(i)) for i in range(6)], "g string, x double, y double")
    got = {r.g: r.extent for r in Y.long_axis(df, ["g"]).collect()}
    _, vectors = np.linalg.eigh(np.cov(cloud.T))
    along = (cloud - cloud.mean(axis=0)) @ vectors[:, -1]
    assert math.isclose(got["c"], np.ptp(along)) and got["one"] == 0 and math.isclose(got["flat"], 3) and math.isclose(got["up"], 5)


def test_references(spark):
    box = lambda ref: N.reference_box(F.lit(ref), 139.0, 34.0, 140.0, 36.0, 0.1).alias("b")
    got = {ref: spark.range(1).select(box(ref)).first().b for ref in ("A1", "f12", "F12c", "F12-c3", " b2 ", "K1", "A21", "A0", "", "1A", "F12-f1", "F12-c6")}
    near = lambda b, want: np.allclose(tuple(b), want)
    assert near(got["A1"], (139.0, 35.9, 139.1, 36.0)) and near(got["f12"], (139.5, 34.8, 139.6, 34.9)) and near(got["F12c"], (139.5, 34.8, 139.55, 34.85)) and near(got[" b2 "], (139.1, 35.8, 139.2, 35.9))
    assert near(got["F12-c3"], (139.54, 34.84, 139.56, 34.86))
    assert [got[r] for r in ("K1", "A21", "A0", "", "1A", "F12-f1", "F12-c6")] == [None] * 7


def test_labelled_cells(spark):
    cells = N.LabelledCells.over(10.0, 5.0, 7300.0, 95.0, 10.0)
    assert (cells.x0, cells.y0, cells.columns, cells.rows) == (10.0, 100.0, 729, 10)
    df = spark.createDataFrame([(i, 15.0 + 10 * i) for i in (0, 25, 26, 27, 51, 52, 701, 702, 728, 729)], "i int, x double")
    rows = df.select("i", cells.label(F.col("x"), F.lit(93.0)).alias("label")).withColumn("b", cells.region(F.col("label"))).collect()
    assert {r.i: r.label for r in rows} == {0: "A1", 25: "Z1", 26: "AA1", 27: "AB1", 51: "AZ1", 52: "BA1", 701: "ZZ1", 702: "AAA1", 728: "ABA1", 729: None}
    assert all(r.b.xmin == 10.0 + 10 * r.i and r.b.ymax == 100.0 for r in rows if r.label)
    ask = lambda ref: spark.range(1).select(cells.region(F.lit(ref), {"bay": (1, 2, 3, 4)}).alias("b")).first().b
    assert tuple(ask("c4-B2")) == tuple(ask("B2–C4")) == (20.0, 60.0, 40.0, 90.0) and tuple(ask("bay")) == (1, 2, 3, 4)
    assert ask("A11") is None and ask("A1-B2-C3") is None and ask("nowhere") is None


def test_quoted_commas_in_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text('"name",lon,lat\n"Bay, north",139.5,35.25\nplain, 140 ,36\n')
    got = [(r.seq, r.lon, r.lat) for r in read_points_csv(spark, str(tmp_path / "p.csv")).orderBy("seq").collect()]
    assert got == [(0, 139.5, 35.25), (1, 140.0, 36.0)]
