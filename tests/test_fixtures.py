"""Small meshes with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from trilattice.model import from_rows
from trilattice.operators import boundary as B
from trilattice.operators import detect as D
from trilattice.operators import gate as G
from trilattice.operators import rebuild as W
from trilattice.operators import repair as R
from trilattice.operators import spatial as S
from trilattice.operators import topology as P
from trilattice.sources import mesh_text as M
from trilattice.sources import model_files as X
from trilattice.sources import vector as V

S3 = math.sqrt(3) / 2
CORNERS = [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
SQUARE = ([*CORNERS, (0.5, 0.5, 1)], [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)], [[0, 1]], [(0, [1, 2, 3, 0])])


def ids(df, c="elem_id"):
    return sorted(r[c] for r in df.select(c).collect())


def grid():
    nodes = [(1000 * i, 1000 * j, 5) for j in range(4) for i in range(4)]
    elements = []
    for j in range(3):
        for i in range(3):
            a, b, c, d = j * 4 + i, j * 4 + i + 1, j * 4 + i + 5, j * 4 + i + 4
            elements += [(a, b, d), (b, c, d)] if (i, j) == (0, 2) else [(a, b, c), (a, c, d)]
    return nodes, elements, [[4, 8]], [(0, [8, 12, 13, 14, 15, 11, 7, 3, 2, 1, 0, 4])]


def test_square_and_island(spark):
    m = from_rows(spark, *SQUARE)
    assert [r.valence for r in P.valence(m).orderBy("node_id").collect()] == [2, 2, 2, 2, 4]
    r = G.metrics(m).first()
    assert abs(r.alpha_mean - S3) < 1e-7 and abs(r.min_angle_p50_deg - 45) < 1e-9 and (r.n_components, r.max_valence) == (1, 4)
    nodes, elements, *rest = SQUARE
    island = from_rows(spark, [*nodes, (10, 0, 1), (11, 0, 1), (10.5, 1, 1)], [*elements, (5, 6, 7)], *rest)
    labels = P.element_components(island.elements)
    assert ids(D.disjoint(labels)) == ids(D.unreachable(island, labels)) == ids(D.isolated(island)) == [4]
    assert G.thresholds(G.metrics(island), {"alpha_mean": 0.99}, {"n_components": 2}).orderBy("metric").select("passed").collect() == [(False,), (True,)]


def test_empty(spark):
    m = from_rows(spark, [(0, 0, 1)], [])
    r = G.metrics(m).first()
    assert r.n_elements == r.n_components == 0 and all(math.isnan(r[c]) for c in ("alpha_mean", "alpha_p05", "min_angle_p50_deg", "frac_lt_20deg"))
    assert G.thresholds(G.metrics(m), {"alpha_mean": 0.1}).first().passed is False and G.thresholds(G.metrics(m)).collect() == []


def test_thin_chains_fans_and_dead_ends(spark):
    n = 6
    strip = from_rows(spark, [(i, 0, 1) for i in range(n + 1)] + [(i, 1, 1) for i in range(n + 1)], [t for i in range(n) for t in ((i, i + 1, n + 1 + i), (i + 1, n + 2 + i, n + 1 + i))], [], [(0, list(range(n + 1))), (0, list(range(n + 1, 2 * n + 2)))])
    assert len(ids(D.thin(strip))) == 2 * n == len(ids(D.thin_chains(strip, 2 * n))) and not ids(D.thin_chains(strip, 2 * n + 1)) and len(ids(D.thin_chains(strip, 1))) == 2 * n
    for k, want in ((12, [0]), (6, [])):
        rim = [(math.cos(2 * math.pi * i / k), math.sin(2 * math.pi * i / k), 1) for i in range(k)]
        fan = from_rows(spark, [(0, 0, 1), *rim], [(0, 1 + i, 1 + (i + 1) % k) for i in range(k)])
        assert ids(D.overconnected(fan), "node_id") == want
    two = from_rows(spark, [(0, 0, 1), (1, 0, 1), (0.5, 1, 1), (1.5, 1, 1)], [(0, 1, 2), (1, 3, 2)], [], [(0, [0, 1, 3, 2, 0])])
    assert ids(D.dead_ends(two)) == [0, 1]


def test_gate(spark):
    nodes, elements, open_, land = grid()
    m = from_rows(spark, nodes, elements, open_, land)
    report = {r.check: r for r in G.report(m).collect()}
    assert all(r.passed for r in report.values()), [r for r in report.values() if not r.passed]
    assert G.verdict(G.report(m)).first().passed
    assert abs(D.implied_steps(m).agg(F.min("dt")).first()[0] - 1000 / math.sqrt(9.81 * 5)) < 1e-9
    assert B.best_deviation(m).agg(F.max("dev")).first()[0] < 1e-9
    turned = [tuple(reversed(e)) if i == 0 else e for i, e in enumerate(elements)]
    shallow = [(x, y, 1 if i == 5 else z) for i, (x, y, z) in enumerate(nodes)]
    plain = [t for j in range(3) for i in range(3) for t in ((j * 4 + i, j * 4 + i + 1, j * 4 + i + 5), (j * 4 + i, j * 4 + i + 5, j * 4 + i + 4))]
    for args, check in (((nodes, turned, open_, land), "ccw_all_elements"), ((shallow, elements, open_, land), "min_depth_clip"), ((nodes, plain, [[4, 8, 12]], land), "r4_mixed_boundary")):
        assert {r.check for r in G.report(from_rows(spark, *args)).where("not passed").collect()} >= {check}
    bowtie = from_rows(spark, [(0, 0, 5), (1000, 0, 5), (500, 500, 5), (0, 1000, 5), (1000, 1000, 5)], [(0, 1, 2), (2, 4, 3)], [], [(0, [0, 1, 2, 4, 3, 2, 0])])
    got = {r.check: r for r in G.report(bowtie).collect()}
    assert not got["manifold_boundary"].passed and not got["no_isolated_elements"].passed and got["obc_ordering"].skipped


def test_swaps_smoothing_and_refinement(spark):
    bad = from_rows(spark, [(1, 0, 1), (2, 0.5, 1), (1, 1, 1), (0, 0.5, 1)], [(0, 1, 3), (1, 2, 3)], [], [(0, [0, 1, 2, 3])])
    before = P.geometry(bad).agg(F.min("min_angle")).first()[0]
    after, flips = R.swap_until_stable(bad)
    assert flips == 1 and P.geometry(after).agg(F.min("min_angle"), F.min("area")).first()[0] > before
    even = from_rows(spark, [(0, 0, 1), (1, 0, 1), (0.5, S3, 1), (1.5, S3, 1)], [(0, 1, 2), (1, 3, 2)])
    assert R.swap_candidates(even).count() == 0
    nodes = [(0.5 * (k % 3), 0.5 * (k // 3), 1) for k in range(9)]
    nodes[4] = (0.1, 0.1, 1)
    ring = [0, 1, 2, 5, 8, 7, 6, 3]
    sliver = from_rows(spark, nodes, [(4, ring[i], ring[(i + 1) % 8]) for i in range(8)], [], [(0, ring)])
    smooth = R.smooth(sliver, rounds=5)
    moved = smooth.nodes.where("node_id = 4").first()
    assert 0.1 < moved.x < 0.55 and 0.1 < moved.y < 0.55 and not ids(D.pinches(smooth), "node_id")
    assert P.located(smooth).where(D.T.signed_area() <= 0).count() == 0 and smooth.nodes.where("node_id <> 4").exceptAll(sliver.nodes.where("node_id <> 4")).count() == 0
    pair = from_rows(spark, [(0, 0, 1), (2, 0, 2), (1, 1, 3), (1, -0.05, 4)], [(0, 1, 2), (1, 0, 3)], [], [(0, [0, 3, 1, 2])])
    cut = R.bisect_longest(pair, pair.elements.where("elem_id = 1"))
    assert cut.elements.count() == 4 and P.located(cut).where(D.T.signed_area() <= 0).count() == 0 and cut.nodes.where("node_id = 4").first()[2:] == (1.0, 0.0, 1.5)
    wide = R.widen_at_centroid(pair, pair.elements.where("elem_id = 0"))
    assert [tuple(r)[1:] for r in wide.elements.orderBy("elem_id").collect()] == [(0, 1, 0, 3), (1, 0, 1, 4), (2, 1, 2, 4), (3, 2, 0, 4)]


def test_greedy_selection_equals_a_sequential_pass(spark):
    import random

    rng = random.Random(4)
    rows = [("m", u, u + 1, a, b, round(rng.random(), 1)) for u, (a, b) in enumerate((rng.randrange(12), rng.randrange(12, 24)) for _ in range(60))]
    df = spark.createDataFrame(rows, "mesh_id string, u long, v long, first_elem long, last_elem long, gain double")
    used, want = set(), []
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        if r[3] not in used and r[4] not in used:
            used |= {r[3], r[4]}
            want.append(r[1])
    assert sorted(r.u for r in R.select_disjoint(df).collect()) == sorted(want)


def test_weld_combine_and_compact(spark):
    m = from_rows(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1.0000001, 0, 1), (1, 1, 1), (0, 1.0000001, 1), (9, 9, 9)], [(0, 1, 2), (3, 4, 5)], [[0, 1]], [(0, [1, 3, 4])])
    welded = R.weld(m, 1e-3)
    assert [tuple(r)[2:] for r in welded.elements.orderBy("elem_id").collect()] == [(0, 1, 2), (1, 3, 2)] and welded.nodes.count() == 4
    assert [r.node_id for r in welded.land.orderBy("pos").collect()] == [1, 3]
    both = R.combine(G.Mesh(*(d.unionByName(d.withColumn("mesh_id", F.lit("n"))) for d in (m.nodes, m.elements, m.boundary))))
    assert both.elements.count() == 4 and both.nodes.select("node_id").distinct().count() == 14 and both.open.select("seg_id").distinct().count() == 2
    left = R.remove(m, m.elements.where("elem_id = 0"))
    assert [tuple(r)[1:] for r in left.elements.collect()] == [(0, 0, 1, 2)] and left.boundary.count() == 0


def test_gate_in_degrees_and_with_missing_nodes(spark):
    step = 0.01
    nodes = [(139 + i * step, 35 + j * step, 5) for j in range(4) for i in range(4)]
    elements = [t for j in range(3) for i in range(3) for k in [j * 4 + i] for t in (((k, k + 1, k + 5), (k, k + 5, k + 4)))]
    m = from_rows(spark, nodes, elements, [[4, 8]], [(0, [8, 12, 13, 14, 15, 11, 7, 3, 2, 1, 0, 4])])
    flat = G.in_metres(m).nodes.orderBy("node_id").collect()
    assert abs(flat[4].y - flat[0].y - 1111.95) < 0.1 and abs(flat[1].x - flat[0].x - 910.7) < 0.5
    assert G.in_metres(m, "metric").nodes.exceptAll(m.nodes).isEmpty()
    report = {r.check: r for r in G.report(m).collect()}
    assert len(report) == len(G.CHECKS) and report["no_tiny_area"].violations == report["no_duplicate_nodes"].violations == 0
    assert {r.check: r for r in G.report(m, coords="metric").collect()}["no_tiny_area"].violations == 0
    broken = from_rows(spark, nodes, [*elements, (0, 1, 99)], [[4, 8]], [])
    assert [(r.check, r.violations, r.passed) for r in G.report(broken).collect()] == [("node_index_valid", 1, False)]


def test_loops_box_and_gaps(spark):
    out, inn = [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-0.3, -0.3), (0.3, -0.3), (0.3, 0.3), (-0.3, 0.3)]
    elements = [t for i in range(4) for t in ((i, (i + 1) % 4, 4 + i), ((i + 1) % 4, 4 + (i + 1) % 4, 4 + i))]
    ring = from_rows(spark, [(x, y, 1) for x, y in out + inn], elements)
    assert sorted(r["count"] for r in W.loops(ring).groupBy("loop").count().collect()) == [4, 4]
    b = W.classify_by_box(ring, (-1, -1, 1, -1), 0.1).orderBy("kind", "seg_id", "pos").collect()
    assert [(r.kind, r.seg_id, r.ibtype, r.node_id) for r in b] == [("land", 0, 0, i) for i in (2, 3, 0)] + [("land", 1, 0, i) for i in (4, 5, 6, 7)] + [("open", 0, None, i) for i in (0, 1, 2)]
    flags = [True, True, False, True, True, False]
    given = spark.createDataFrame([("a", i, 10 + i, f) for i, f in enumerate(flags)] + [("b", i, 20 + i, True) for i in range(4)], "mesh_id string, pos int, node_id long, is_open boolean")
    split = lambda gap: sorted((r.mesh_id, r.is_open, r.part, [x.node_id for x in sorted(r.ids)]) for r in W.split_rings(given, gap).groupBy("mesh_id", "is_open", "part").agg(F.collect_list(F.struct("pos", "node_id")).alias("ids")).collect())
    assert split(0) == [("a", False, 0, [12, 13]), ("a", False, 1, [15, 10]), ("a", True, 0, [10, 11, 12]), ("a", True, 1, [13, 14, 15]), ("b", True, 0, [20, 21, 22, 23])]
    assert split(1) == [("a", True, 0, [10, 11, 12, 13, 14, 15]), ("b", True, 0, [20, 21, 22, 23])]
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, True, False, False, False])], "k string, pos int, is_open boolean")
    assert [r.is_open for r in B.bridge_gaps(df, ["k"], 1).orderBy("pos").collect()] == [True, True, True, True, True, False, False, False]


def test_loops_that_share_a_node(spark):
    # two triangles that touch in node 2, one of them clockwise, and a square with a hole that touches its rim
    bow = from_rows(spark, [(0, 0, 1), (2, 0, 1), (1, 1, 1), (0, 2, 1), (2, 2, 1)], [(0, 1, 2), (2, 3, 4)])
    rings = lambda m: sorted([x.node_id for x in sorted(r.ids)] for r in W.loops(m).groupBy("loop").agg(F.collect_list(F.struct("pos", "node_id")).alias("ids")).collect())
    assert rings(bow) == [[0, 1, 2], [2, 3, 4]]
    grid = [(i, j, 1) for j in range(4) for i in range(4)]
    whole = [t for j in range(3) for i in range(3) for k in [j * 4 + i] for t in ((k, k + 1, k + 5), (k, k + 5, k + 4))]
    left = [t for t in whole if t not in ((0, 1, 5), (5, 6, 10))]
    found = rings(from_rows(spark, grid, left))
    assert sorted(map(len, found)) == [3, 13] and [5, 6, 10] in found


def test_parts_of_a_cut_triangle():
    at = {"n0": (0.0, 0.0), "n1": (4.0, 0.0), "n2": (0.0, 4.0), "m0": (2.0, 0.0), "m1": (2.0, 2.0), "m2": (0.0, 2.0)}
    area = lambda t: ((at[t[1]][0] - at[t[0]][0]) * (at[t[2]][1] - at[t[0]][1]) - (at[t[2]][0] - at[t[0]][0]) * (at[t[1]][1] - at[t[0]][1])) / 2
    for k in range(8):
        cut = {i for i in range(3) if k >> i & 1}
        parts = R.parts_of(cut)
        assert len(parts) == 1 + len(cut) and all(area(t) > 0 for t in parts) and sum(map(area, parts)) == 8
        assert {c for t in parts for c in t} == {"n0", "n1", "n2", *(f"m{i}" for i in cut)}
    turned = lambda t: min((t[i:] + t[:i] for i in range(3)))
    assert {turned(t) for t in R.parts_of({0, 2})} == {turned(t) for t in (("n0", "m0", "m2"), ("n1", "n2", "m0"), ("n2", "m2", "m0"))}


def test_rivers(spark):
    lon = [139.0, 139.2, 139.4, 139.6, 139.8]
    m = from_rows(spark, [(x, 35, 1) for x in lon] + [(x, 34.5, 1) for x in lon], [], [[5, 6, 7, 8, 9]], [(0, [0, 1, 2, 3, 4])])
    out, done = W.add_rivers(m, [(139.4, 35.05)], 3)
    segments = lambda o: [(r.ibtype, r.ids) for r in o.land.groupBy("seg_id", "ibtype").agg(F.expr("transform(sort_array(collect_list(struct(pos, node_id))), s -> s.node_id)").alias("ids")).orderBy("seg_id").collect()]
    assert done[0]["node_id"] == 2 and segments(out) == [(0, [0]), (21, [1, 2, 3]), (0, [4])]
    assert segments(W.add_rivers(m, [(139.9, 35.0)], 3)[0]) == [(0, [0, 1]), (21, [2, 3, 4])]
    assert W.add_rivers(m, [(150.0, 35.0)], 3, most_metres=10.0)[1][0]["node_id"] is None


def test_files(spark, tmp_path):
    m = from_rows(spark, *grid())
    path = M.write_mesh_text(m, str(tmp_path / "m.14"), "a title")
    back = M.read_mesh_text(spark, path)
    for a, b in ((m.nodes, back.nodes), (m.elements, back.elements), (m.boundary, back.boundary)):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    lines = open(path).read().splitlines()
    (tmp_path / "bad.14").write_text("\n".join([lines[0], "18 17", *lines[2:]]))
    (tmp_path / "short.14").write_text("\n".join(lines[:-3]))
    for bad in ("bad.14", "short.14"):
        with pytest.raises(ValueError):
            M.read_mesh_text(spark, str(tmp_path / bad))
    made = X.export_case(m, str(tmp_path / "case"), "c", sponge=[(0, 10.0, 0.1)], coriolis=m.nodes.select("node_id", F.lit(35.0).alias("cor")))
    assert open(made["obc"]).read().split("\n")[:3] == ["OBC Node Number = 2", "1 5 1", "2 9 1"]
    assert open(made["grd"]).read().splitlines()[:3] == ["Node Number = 16", "Cell Number = 18", "1 1 2 6"] and "NS 5 -9" in open(made["2dm"]).read()
    with pytest.raises(ValueError):
        X.grid_lines(from_rows(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1)], [(0, 2, 1)]))
    (tmp_path / "r.csv").write_text("name,Longitude, LAT\na,139.5,35.1\n\nb,140,34\n")
    assert [tuple(r) for r in V.read_points_csv(spark, str(tmp_path / "r.csv")).orderBy("seq").select("lon", "lat").collect()] == [(139.5, 35.1), (140.0, 34.0)]
    (tmp_path / "l.json").write_text('{"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}}, {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    assert V.read_lines_geojson(spark, str(tmp_path / "l.json")).count() == 6
    seg = spark.createDataFrame([(-1.0, 0.5, 2.0, 0.5), (0.0, 3.0, 1.0, 3.0)], "x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in V.clip_segments(seg, (0, 0, 1, 1)).collect()] == [(0.0, 0.5, 1.0, 0.5)]


def test_references_and_rasters(spark):
    df = spark.createDataFrame([(139.41, 35.89), (139.52, 35.11), (138.0, 35.0)], "lon double, lat double")
    ref = lambda d: [r[0] for r in df.select(S.cell_reference(F.col("lon"), F.col("lat"), 139.4, 34.9, 140.3, 35.9, detail=d)).collect()]
    assert ref("cell") == ["A1", "C16", None] and ref("quadrant")[0] == "A1a" and ref("part")[0] in ("A1-b1", "A1-b2", "A1-a1")
    raster = spark.createDataFrame([(r, c, -float(r * 10 + c)) for r in range(4) for c in range(4)], "row int, col int, z double")
    pts = spark.createDataFrame([(0, 1.5, 1.5), (1, 2.0, 1.5), (2, 9.0, 9.0), (3, 0.0, 0.0)], "k int, x double, y double")
    got = [r.depth for r in S.sample_raster(pts, raster, (0, 0, 1, 1), (4, 4), ["k"]).orderBy("k").collect()]
    assert got == [11.0, 11.5, 0.0, 0.0]
    near = [r.depth for r in S.sample_raster(pts, raster, (0, 0, 1, 1), (4, 4), ["k"], method="nearest").orderBy("k").collect()]
    assert near[0] == 11.0 and near[2] == 0.0
