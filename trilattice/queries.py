"""The mesh queries over the lattice of the orders table, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.functions import units as U
from trilattice.model import LATTICE_SQL, Mesh, lattice
from trilattice.operators import boundary as B
from trilattice.operators import channels as C
from trilattice.operators import detect as D
from trilattice.operators import gate as G
from trilattice.operators import local as E
from trilattice.operators import references as N
from trilattice.operators import repair as R
from trilattice.operators import spatial as S
from trilattice.operators import summary as Y
from trilattice.operators import topology as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(column, name: str | None = None):
    """Six decimals, as both engines round."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def query(sql: str | None = None):
    """Registers a function of a mesh as a query over the lattice, and its SQL after the shared WITH clause."""

    def add(f: Callable[[Mesh], DataFrame]) -> Callable[[Mesh], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lattice(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"{LATTICE_SQL.rstrip()}\n{sql}" if sql.lstrip().upper().startswith("SELECT") else f"{LATTICE_SQL.rstrip()},\n{sql}"
        return f

    return add


# geometry


@query("SELECT elem_id, round(area, 6) AS area, round(least(a0, a1, a2), 6) AS min_angle, round(greatest(a0, a1, a2), 6) AS max_angle FROM geo")
def tri_geometry(m):
    return P.geometry(m).select("elem_id", r6("area"), r6("min_angle"), r6("max_angle"))


@query("SELECT elem_id, round(l01, 6) AS l01, round(l12, 6) AS l12, round(l20, 6) AS l20 FROM geo")
def edge_lengths(m):
    return P.geometry(m).select("elem_id", r6("l01"), r6("l12"), r6("l20"))


@query("SELECT elem_id, round(area, 6) AS area FROM geo")
def signed_area(m):
    return P.located(m).select("elem_id", r6(T.signed_area(), "area"))


@query("SELECT elem_id, round(alpha, 6) AS alpha FROM geo")
def alpha_quality(m):
    return P.geometry(m).select("elem_id", r6("alpha"))


@query("SELECT elem_id, round(least(a0, a1, a2), 6) AS min_angle FROM geo")
def min_interior_angle(m):
    return P.geometry(m).select("elem_id", r6("min_angle"))


@query("SELECT elem_id, round((x0 + x1 + x2) / 3, 6) AS cx, round((y0 + y1 + y2) / 3, 6) AS cy FROM tri")
def element_centroids(m):
    return P.located(m).select("elem_id", r6((F.col("x0") + F.col("x1") + F.col("x2")) / 3, "cx"), r6((F.col("y0") + F.col("y1") + F.col("y2")) / 3, "cy"))


@query("""SELECT elem_id, round(pow(greatest(0, 0.7 - alpha), 2) + pow(greatest(0, 30 - least(a0, a1, a2)), 2) / 100 + pow(greatest(0, greatest(a0, a1, a2) - 130), 2) / 100, 6) AS penalty FROM geo""")
def penalty(m):
    return P.geometry(m).select("elem_id", r6(T.penalty(F.col("alpha"), F.col("min_angle"), F.col("max_angle")), "penalty"))


@query("SELECT elem_id, round(least(l01, l12, l20) / sqrt(9.81 * greatest(d0, d1, d2, 0.1)), 6) AS dt FROM geo")
def implied_dt(m):
    return D.implied_steps(m).select("elem_id", r6("dt"))


@query("SELECT node_id, round(least(3000, greatest(1, (CASE WHEN h > 2 THEN 2 * sqrt(9.81 / h) + sqrt(9.81 * h) ELSE 2 * sqrt(9.81 * 2) END) * 6 / 0.5)), 6) AS size FROM (SELECT node_id, greatest(depth, 1) AS h FROM nodes)")
def courant_size(m):
    return m.nodes.select("node_id", r6(T.courant_size(F.col("depth"), 6.0, 0.5, low=1.0, high=3000.0), "size"))


# topology


@query("SELECT u, v, uses, first_elem, last_elem FROM edges")
def edge_table(m):
    return P.edges(m.elements).drop("mesh_id")


@query("SELECT u, v FROM rim")
def boundary_edges(m):
    return P.rim_edges(m.elements).drop("mesh_id")


@query("SELECT u, v FROM edges")
def unique_edges(m):
    return P.half_edges(m.elements).select("u", "v").distinct()


@query("SELECT node_id, valence FROM valence")
def node_valence(m):
    return P.valence(m).drop("mesh_id")


@query("SELECT a, b FROM dual")
def dual_adjacency(m):
    return P.dual(m.elements).drop("mesh_id")


@query("""SELECT i.u, i.v, round((greatest(abs(p.area), abs(q.area)) - least(abs(p.area), abs(q.area))) / greatest(abs(p.area), abs(q.area), 1e-30), 6) AS change FROM inner_edges i JOIN len p ON p.elem_id = first_elem JOIN len q ON q.elem_id = last_elem""")
def area_change(m):
    return D.area_changes(m).select("u", "v", r6("change"))


@query("""SELECT e.elem_id, count(DISTINCT n.elem_id) AS near FROM elements e JOIN corner c USING (elem_id) JOIN corner d ON d.node_id = c.node_id JOIN corner f ON f.elem_id = d.elem_id JOIN corner n ON n.node_id = f.node_id GROUP BY e.elem_id""")
def kring(m):
    return P.k_ring(m, m.elements, 2).groupBy(F.col("seed").alias("elem_id")).agg(F.count(F.lit(1)).alias("near"))


# detectors


@query("SELECT node_id, valence FROM valence WHERE valence > 5")
def overconnected_nodes(m):
    return D.overconnected(m, 5).drop("mesh_id")


@query("SELECT elem_id FROM elements WHERE n0 IN (FROM listed) AND n1 IN (FROM listed) AND n2 IN (FROM listed)")
def thin_elements(m):
    return D.thin(m).drop("mesh_id")


@query("""steps AS (SELECT least(node_id, nxt) AS u, greatest(node_id, nxt) AS v FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY seg_id ORDER BY pos) AS nxt FROM opened) WHERE nxt IS NOT NULL AND nxt <> node_id)
SELECT a AS elem_id FROM dual GROUP BY a HAVING count(*) = 1 AND NOT EXISTS (SELECT 1 FROM half h JOIN steps s ON s.u = h.u AND s.v = h.v WHERE h.elem_id = a)""")
def dead_end_elements(m):
    return D.dead_ends(m).drop("mesh_id")


@query("SELECT elem_id FROM elements WHERE elem_id NOT IN (SELECT a FROM dual)")
def isolated_elements(m):
    return D.isolated(m).drop("mesh_id")


@query("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM corner)")
def orphan_nodes(m):
    return D.orphans(m).drop("mesh_id")


@query("SELECT node_id, count(*) AS rim_edges FROM (SELECT u AS node_id FROM rim UNION ALL SELECT v FROM rim) GROUP BY node_id HAVING count(*) > 2")
def pinch_nodes(m):
    return D.pinches(m).drop("mesh_id")


@query("SELECT p.node_id AS a, q.node_id AS b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 6) AS dist FROM nodes p JOIN nodes q ON p.node_id < q.node_id AND q.x BETWEEN p.x - 0.75 AND p.x + 0.75 AND q.y BETWEEN p.y - 0.75 AND p.y + 0.75 WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.75")
def duplicate_nodes(m):
    return D.close_pairs(m.nodes, 0.75).select("a", "b", r6("dist"))


@query("SELECT elem_id, round(area, 6) AS area FROM len WHERE abs(area) < 0.4")
def tiny_area(m):
    return P.located(m).withColumn("area", T.signed_area()).where("abs(area) < 0.4").select("elem_id", r6("area"))


@query("SELECT elem_id FROM len WHERE area < 0")
def flipped_elements(m):
    return P.located(m).where(T.signed_area() < 0).select("elem_id")


@query("SELECT node_id, mark FROM marks")
def isonb_marker(m):
    return B.marks(m).drop("mesh_id")


@query("SELECT elem_id, total::BIGINT AS total FROM mark_sums WHERE total > 4")
def r4_elements(m):
    return D.mixed_boundary(m).drop("mesh_id")


@query("SELECT elem_id FROM mark_sums WHERE total = 4 AND elem_id NOT IN (SELECT elem_id FROM half h JOIN open_edges o ON o.u = h.u AND o.v = h.v)")
def fake_open_elements(m):
    return D.fake_open(m).drop("mesh_id")


@query("SELECT node_id FROM open_nodes WHERE node_id NOT IN (FROM rim_nodes)")
def obc_on_boundary(m):
    return D.open_off_rim(m).drop("mesh_id")


@query("SELECT node_id FROM open_nodes WHERE node_id NOT IN (SELECT node_id FROM both_ways WHERE other IN (FROM open_nodes))")
def obc_chain(m):
    return D.open_without(m, True).drop("mesh_id")


@query("SELECT node_id FROM open_nodes WHERE node_id NOT IN (SELECT node_id FROM both_ways WHERE other NOT IN (FROM open_nodes))")
def obc_interior_neighbor(m):
    return D.open_without(m, False).drop("mesh_id")


@query("""SELECT seg_id, pos::INTEGER AS pos, node_id, nxt AS next FROM (SELECT *, lead(node_id) OVER (PARTITION BY seg_id ORDER BY pos) AS nxt FROM opened) WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges WHERE u = least(node_id, nxt) AND v = greatest(node_id, nxt))""")
def obc_ordering(m):
    return B.ordering_breaks(m).drop("mesh_id")


@query("SELECT node_id, round(CASE WHEN tn > 0 THEN tx / tn ELSE 0 END, 6) AS ux, round(CASE WHEN tn > 0 THEN ty / tn ELSE 0 END, 6) AS uy FROM unit")
def boundary_tangents(m):
    return B.tangents(m, m.open).select("node_id", r6("ux"), r6("uy"))


@query("SELECT o.node_id, round(coalesce(min(dev), 1e9), 6) AS dev FROM open_nodes o LEFT JOIN deviations d USING (node_id) GROUP BY o.node_id")
def obc_perpendicularity(m):
    return B.best_deviation(m).select("node_id", r6(F.least(F.col("dev"), F.lit(1e9)), "dev"))


@query("SELECT elem_id, round(least(a0, a1, a2), 6) AS min_angle FROM geo WHERE least(a0, a1, a2) < 30")
def c1_min_angle(m):
    return P.geometry(m).where("min_angle < 30").select("elem_id", r6("min_angle"))


@query("SELECT elem_id, round(greatest(a0, a1, a2), 6) AS max_angle FROM geo WHERE greatest(a0, a1, a2) > 100")
def c2_max_angle(m):
    return P.geometry(m).where("max_angle > 100").select("elem_id", r6("max_angle"))


@query("""SELECT i.first_elem, i.last_elem FROM inner_edges i JOIN len p ON p.elem_id = first_elem JOIN len q ON q.elem_id = last_elem WHERE (greatest(abs(p.area), abs(q.area)) - least(abs(p.area), abs(q.area))) / greatest(abs(p.area), abs(q.area), 1e-30) > 0.5""")
def c4_area_change(m):
    return D.area_changes(m).where("change > 0.5").select("first_elem", "last_elem")


@query("SELECT max(valence) AS max_valence, count(*) FILTER (valence > 8) AS violations FROM valence")
def c5_valence(m):
    return P.valence(m).agg(F.max("valence").alias("max_valence"), F.count(F.when(F.col("valence") > 8, 1)).alias("violations"))


@query("SELECT node_id, round(depth, 6) AS depth FROM nodes WHERE depth < 2")
def min_depth(m):
    return m.nodes.where("depth < 2").select("node_id", r6("depth"))


@query("""opp AS (SELECT elem_id, least(n0, n1) AS u, greatest(n0, n1) AS v, a2 AS deg FROM geo UNION ALL SELECT elem_id, least(n1, n2), greatest(n1, n2), a0 FROM geo UNION ALL SELECT elem_id, least(n2, n0), greatest(n2, n0), a1 FROM geo)
SELECT u, v, round(sum(deg), 6) AS total FROM opp GROUP BY u, v HAVING count(*) = 2 AND sum(deg) > 180.1""")
def local_delaunay(m):
    return D.opposite_angles(m).where("total > 180.1").select("u", "v", r6("total"))


@query("""ranked AS (SELECT elem_id, least(a0, a1, a2) AS low, row_number() OVER (ORDER BY least(a0, a1, a2), elem_id) AS rank FROM geo) SELECT elem_id, rank::INTEGER AS rank, round(low, 6) AS min_angle FROM ranked WHERE rank <= 20""")
def worst_offenders(m):
    return D.worst(P.geometry(m).select("mesh_id", "elem_id", "min_angle"), "min_angle", "elem_id", 20, False).select("elem_id", "rank", r6("min_angle"))


# components


@query("SELECT elem_id, label FROM cc")
def component_labels(m):
    return P.element_components(m.elements).drop("mesh_id")


@query("SELECT label, size FROM sizes")
def component_size_table(m):
    return D.component_sizes(P.element_components(m.elements)).drop("mesh_id")


@query("SELECT elem_id FROM cc WHERE label <> (SELECT label FROM sizes ORDER BY size DESC, label LIMIT 1)")
def disjoint_elements(m):
    return D.disjoint(P.element_components(m.elements)).drop("mesh_id")


@query("SELECT elem_id FROM cc WHERE label NOT IN (SELECT label FROM cc JOIN corner USING (elem_id) WHERE node_id IN (FROM open_nodes))")
def unreachable_elements(m):
    return D.unreachable(m, P.element_components(m.elements)).drop("mesh_id")


@query("""thin AS (SELECT elem_id FROM elements WHERE n0 IN (FROM rim_nodes) AND n1 IN (FROM rim_nodes) AND n2 IN (FROM rim_nodes)),
tdual AS (SELECT a, b FROM dual WHERE a IN (FROM thin) AND b IN (FROM thin)),
tc(elem_id, label) USING KEY (elem_id) AS (SELECT elem_id, elem_id FROM thin UNION SELECT d.b, min(c.label) FROM tc c JOIN tdual d ON d.a = c.elem_id JOIN recurring.tc o ON o.elem_id = d.b WHERE c.label < o.label GROUP BY d.b)
SELECT elem_id FROM tc WHERE label IN (SELECT label FROM tc GROUP BY label HAVING count(*) >= 4)""")
def thin_chains(m):
    rim = P.edge_nodes(P.rim_edges(m.elements)).select("mesh_id", F.lit("land").alias("kind"), F.lit(0).alias("seg_id"), F.lit(0).alias("ibtype"), F.lit(0).alias("pos"), "node_id")
    return D.thin_chains(m.with_(boundary=rim), 4).drop("mesh_id")


# gate and metrics


@query("""SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_elements, 1::BIGINT AS n_open_boundaries, 3::BIGINT AS n_land_boundaries, round(avg(alpha), 6) AS alpha_mean, round(quantile_cont(alpha, 0.05), 6) AS alpha_p05, round(quantile_cont(alpha, 0.5), 6) AS alpha_p50,
round(quantile_cont(least(a0, a1, a2), 0.05), 6) AS min_angle_p05_deg, round(quantile_cont(least(a0, a1, a2), 0.5), 6) AS min_angle_p50_deg, round(avg(CASE WHEN least(a0, a1, a2) < 20 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS frac_lt_20deg, (SELECT max(valence) FROM valence) AS max_valence,
(SELECT count(*) FROM valence WHERE valence > 8) AS n_overconnected, count(*) FILTER (area < 0) AS n_flipped, (SELECT count(*) FROM sizes) AS n_components, (SELECT sum(size) - max(size) FROM sizes)::BIGINT AS n_disjoint_elems FROM geo""")
def mesh_metrics(m):
    g = G.metrics(m)
    return g.select(*(r6(c) if t == "double" else F.col(c) for c, t in g.dtypes if c != "mesh_id"))


@query("""v AS (SELECT avg(alpha) AS a, quantile_cont(least(a0, a1, a2), 0.05) AS b, count(*) FILTER (area < 0)::DOUBLE AS c FROM geo)
SELECT 'alpha_mean' AS metric, round(a, 6) AS value, 0.8::DOUBLE AS "limit", a >= 0.8 AS passed FROM v UNION ALL SELECT 'min_angle_p05_deg', round(b, 6), 30.0, b >= 30 FROM v UNION ALL SELECT 'n_flipped', round(c, 6), 0.0, c <= 0 FROM v""")
def threshold_checks(m):
    return G.thresholds(G.metrics(m), {"alpha_mean": 0.8, "min_angle_p05_deg": 30}, {"n_flipped": 0}).select("metric", r6("value"), "limit", "passed")


GATE_SQL = """found AS (
SELECT 'node_index_valid' AS "check", (SELECT count(DISTINCT node_id) FROM (SELECT node_id FROM corner UNION ALL SELECT node_id FROM boundary) WHERE node_id NOT IN (SELECT node_id FROM nodes)) AS n
UNION ALL SELECT 'ccw_all_elements', (SELECT count(*) FROM len WHERE area < 0)
UNION ALL SELECT 'no_isolated_elements', (SELECT count(*) FROM elements WHERE elem_id NOT IN (SELECT a FROM dual))
UNION ALL SELECT 'r4_mixed_boundary', (SELECT count(*) FROM mark_sums WHERE total > 4)
UNION ALL SELECT 'manifold_boundary', (SELECT count(*) FROM (SELECT node_id FROM (SELECT u AS node_id FROM rim UNION ALL SELECT v FROM rim) GROUP BY node_id HAVING count(*) > 2)) + (SELECT count(*) FROM edges WHERE uses > 2)
UNION ALL SELECT 'no_duplicate_nodes', (SELECT count(*) FROM nodes p JOIN nodes q ON p.node_id < q.node_id AND q.x BETWEEN p.x - 0.001 AND p.x + 0.001 AND q.y BETWEEN p.y - 0.001 AND p.y + 0.001 WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.001)
UNION ALL SELECT 'implied_dt', (SELECT count(*) FROM geo WHERE least(l01, l12, l20) / sqrt(9.81 * greatest(d0, d1, d2, 0.1)) < {dt})
UNION ALL SELECT 'no_orphan_nodes', (SELECT count(*) FROM valence WHERE valence = 0)
UNION ALL SELECT 'no_tiny_area', (SELECT count(*) FROM len WHERE abs(area) < 1e-6)
UNION ALL SELECT 'isbce2_authentic', (SELECT count(*) FROM mark_sums WHERE total = 4 AND elem_id NOT IN (SELECT elem_id FROM half h JOIN open_edges o ON o.u = h.u AND o.v = h.v))
UNION ALL SELECT 'obc_on_boundary', (SELECT count(*) FROM open_nodes WHERE node_id NOT IN (FROM rim_nodes))
UNION ALL SELECT 'obc_chain_adjacency', (SELECT count(*) FROM open_nodes WHERE node_id NOT IN (SELECT node_id FROM both_ways WHERE other IN (FROM open_nodes)))
UNION ALL SELECT 'obc_interior_neighbor', (SELECT count(*) FROM open_nodes WHERE node_id NOT IN (SELECT node_id FROM both_ways WHERE other NOT IN (FROM open_nodes)))
UNION ALL SELECT 'obc_ordering', (SELECT count(*) FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY seg_id ORDER BY pos) AS nxt FROM opened) WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges WHERE u = least(node_id, nxt) AND v = greatest(node_id, nxt)))
UNION ALL SELECT 'obc_perpendicularity', (SELECT count(*) FROM (SELECT o.node_id, coalesce(min(dev), 1e9) AS dev FROM open_nodes o LEFT JOIN deviations d USING (node_id) GROUP BY o.node_id) WHERE dev > 20)
UNION ALL SELECT 'c1_min_angle', (SELECT count(*) FROM geo WHERE least(a0, a1, a2) < 30)
UNION ALL SELECT 'c2_max_angle', (SELECT count(*) FROM geo WHERE greatest(a0, a1, a2) > 130)
UNION ALL SELECT 'c4_area_change', (SELECT count(*) FROM inner_edges i JOIN len p ON p.elem_id = first_elem JOIN len q ON q.elem_id = last_elem WHERE (greatest(abs(p.area), abs(q.area)) - least(abs(p.area), abs(q.area))) / greatest(abs(p.area), abs(q.area), 1e-30) > 0.5)
UNION ALL SELECT 'c5_valence', (SELECT count(*) FROM valence WHERE valence > 8)
UNION ALL SELECT 'single_component', (SELECT sum(size) - max(size) FROM sizes)
UNION ALL SELECT 'obc_reachable', (SELECT count(*) FROM cc WHERE label NOT IN (SELECT label FROM cc JOIN corner USING (elem_id) WHERE node_id IN (FROM open_nodes)))
UNION ALL SELECT 'min_depth_clip', (SELECT count(*) FROM nodes WHERE depth < 2)
UNION ALL SELECT 'delaunay_local', (SELECT count(*) FROM (SELECT u, v FROM (SELECT least(n0, n1) AS u, greatest(n0, n1) AS v, a2 AS deg FROM geo UNION ALL SELECT least(n1, n2), greatest(n1, n2), a0 FROM geo UNION ALL SELECT least(n2, n0), greatest(n2, n0), a1 FROM geo) GROUP BY u, v HAVING count(*) = 2 AND sum(deg) > 180.1)))
SELECT "check", "check" NOT IN ('delaunay_local', 'implied_dt') AS gated, n::BIGINT AS violations, (SELECT count(*) FROM opened) = 0 AND "check" IN ('obc_on_boundary', 'obc_chain_adjacency', 'obc_interior_neighbor', 'obc_ordering', 'obc_perpendicularity', 'obc_reachable') AS skipped,
  "check" IN ('delaunay_local', 'implied_dt') OR n = 0 AS passed FROM found"""


@query(GATE_SQL.format(dt=0.06))
def gate_report(m):
    return G.report(m, {"min_dt": 0.06}, "metric").drop("mesh_id")


def in_degrees(m: Mesh) -> Mesh:
    """The lattice bent a little and laid out in degrees, about a thousandth of one for each step."""
    return m.with_(nodes=m.nodes.select("mesh_id", "node_id", (F.lit(139.0) + F.col("x") / 1000 + F.col("x") * F.col("y") * 1e-8).alias("x"), (F.lit(35.0) + F.col("y") / 1000 + F.col("x") * F.col("x") * 1e-7).alias("y"), "depth"))


@query(GATE_SQL.format(dt=6.0))
def gate_report_lonlat(m):
    return G.report(in_degrees(m), {"min_dt": 6.0}).drop("mesh_id")


#: The nodes of the last query for DuckDB: the lattice in degrees, projected about its mean.
ORACLES["gate_report_lonlat"] = ORACLES["gate_report_lonlat"].replace("WITH RECURSIVE nodes AS (", "WITH RECURSIVE planar AS (").replace("\ntop AS (", """
bent AS (SELECT node_id, 139.0::DOUBLE + x / 1000 + x * y * 1e-8 AS lon, 35.0::DOUBLE + y / 1000 + x * x * 1e-7 AS lat, depth FROM planar),
centre AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM bent),
nodes AS (SELECT node_id, radians(lon - lon0) * 6371000 * cos(radians(lat0)) AS x, radians(lat - lat0) * 6371000 AS y, depth FROM bent, centre),
top AS (""", 1)


# ordered operators


@query("""p AS (SELECT b.kind, seg_id, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM boundary b JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY b.kind, seg_id ORDER BY pos)),
l AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM p),
s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY kind, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN nx IS NULL THEN 1 ELSE greatest(2, ceil(len / 0.4) + 1) END::BIGINT AS n FROM l),
t AS (SELECT *, unnest(range(n)) AS step FROM s)
SELECT kind, seg_id, pos::INTEGER AS pos, step::INTEGER AS step, round(coalesce(x + step / n * (nx - x), x), 6) AS sx, round(coalesce(y + step / n * (ny - y), y), 6) AS sy, round(start + coalesce(step / n * len, 0), 6) AS arc FROM t""")
def polyline_samples(m):
    return B.polyline_samples(m, m.boundary, 0.4).select("kind", "seg_id", "pos", "step", r6("sx"), r6("sy"), r6("arc"))


@query("""f AS (SELECT kind, seg_id, pos, depth >= 15 AS deep FROM boundary JOIN nodes USING (node_id)),
c AS (SELECT *, CASE WHEN deep = lag(deep) OVER (PARTITION BY kind, seg_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY kind, seg_id ORDER BY pos) AS run FROM c)
SELECT kind, seg_id, deep, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, count(*) AS length FROM g GROUP BY kind, seg_id, run, deep""")
def run_lengths(m):
    return B.runs(B.placed(m, m.boundary).withColumn("deep", F.col("depth") >= 15), "deep", ["kind", "seg_id"])


@query("""c AS (SELECT kind, seg_id, pos, x, y, coalesce(lead(x) OVER w, first_value(x) OVER (PARTITION BY kind, seg_id ORDER BY pos)) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER (PARTITION BY kind, seg_id ORDER BY pos)) AS ny FROM boundary JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY kind, seg_id ORDER BY pos))
SELECT kind, seg_id, round(sum(x * ny - nx * y) / 2, 6) AS area FROM c GROUP BY kind, seg_id""")
def ring_area(m):
    return B.ring_areas(B.placed(m, m.boundary), ["kind", "seg_id"]).select("kind", "seg_id", r6("area"))


@query()
def bridged_gaps(m):
    ring = B.placed(m, m.boundary).select("kind", "seg_id", "pos", (F.col("depth") >= 12).alias("is_open"))
    return B.bridge_gaps(ring, ["kind", "seg_id"], 2)


# edits


@query("""hit AS (SELECT *, row_number() OVER (ORDER BY elem_id) - 1 AS k FROM tri WHERE elem_id % 7 = 0), z AS (SELECT (SELECT count(*) FROM nodes) AS np, (SELECT count(*) FROM elements) AS ne, (SELECT count(*) FROM hit) AS nh)
SELECT row_number() OVER (ORDER BY elem_id) - 1 AS elem_id, n0, n1, n2 FROM elements WHERE elem_id % 7 <> 0 UNION ALL SELECT ne - nh + k, n0, n1, np + k FROM hit, z UNION ALL SELECT ne + k, n1, n2, np + k FROM hit, z UNION ALL SELECT ne + nh + k, n2, n0, np + k FROM hit, z""")
def centroid_widen(m):
    return R.widen_at_centroid(m, m.elements.where("elem_id % 7 = 0")).elements.drop("mesh_id")


@query("""used AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS id FROM nodes WHERE node_id IN (SELECT node_id FROM corner)) SELECT id AS node_id, round(x, 6) AS x, round(y, 6) AS y, round(depth, 6) AS depth FROM used""")
def compact_nodes(m):
    return R.compact(m).nodes.select("node_id", r6("x"), r6("y"), r6("depth"))


@query("""kept AS (SELECT * FROM elements WHERE elem_id % 3 <> 0), used AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS id FROM nodes WHERE node_id IN (SELECT n0 FROM kept UNION SELECT n1 FROM kept UNION SELECT n2 FROM kept))
SELECT row_number() OVER (ORDER BY elem_id) - 1 AS elem_id, a.id AS n0, b.id AS n1, c.id AS n2 FROM kept JOIN used a ON a.node_id = n0 JOIN used b ON b.node_id = n1 JOIN used c ON c.node_id = n2""")
def remove_elements(m):
    return R.remove(m, m.elements.where("elem_id % 3 = 0")).elements.drop("mesh_id")


@query("""o AS (SELECT max(node_id) + 1 AS np, (SELECT max(elem_id) + 1 FROM elements) AS ne FROM nodes) SELECT elem_id, n0, n1, n2 FROM elements UNION ALL SELECT elem_id + ne, n0 + np, n1 + np, n2 + np FROM elements, o""")
def disjoint_combine(m):
    again = Mesh(*(d.unionByName(d.withColumn("mesh_id", F.lit("second"))) for d in (m.nodes, m.elements, m.boundary)))
    return R.combine(again).elements.drop("mesh_id")


@query("""means AS (SELECT b.node_id, avg(n.x) AS mx, avg(n.y) AS my FROM both_ways b JOIN nodes n ON n.node_id = b.other GROUP BY b.node_id)
SELECT n.node_id, round(CASE WHEN l.node_id IS NULL AND mx IS NOT NULL THEN 0.5 * x + 0.5 * mx ELSE x END, 6) AS x, round(CASE WHEN l.node_id IS NULL AND my IS NOT NULL THEN 0.5 * y + 0.5 * my ELSE y END, 6) AS y FROM nodes n LEFT JOIN listed l USING (node_id) LEFT JOIN means USING (node_id)""")
def laplacian_step(m):
    return R.laplacian_targets(m).select("node_id", r6("nx", "x"), r6("ny", "y"))


@query("""t AS (SELECT other AS node_id, "by" + sqrt(ex * ex + ey * ey) * CASE WHEN ey * ux - ex * uy >= 0 THEN 1 ELSE -1 END * ux AS ty, bx - sqrt(ex * ex + ey * ey) * CASE WHEN ey * ux - ex * uy >= 0 THEN 1 ELSE -1 END * uy AS tx FROM spokes), a AS (SELECT node_id, avg(tx) AS tx, avg(ty) AS ty FROM t WHERE node_id NOT IN (FROM listed) GROUP BY node_id)
SELECT n.node_id, round(coalesce(0.4 * x + 0.6 * tx, x), 6) AS x, round(coalesce(0.4 * y + 0.6 * ty, y), 6) AS y FROM nodes n LEFT JOIN a USING (node_id)""")
def perp_step(m):
    return R.perpendicular_step(m, 0.6).select("node_id", r6("x"), r6("y"))


SWAP_SQL = """sides AS (SELECT elem_id, least(n0, n1) AS u, greatest(n0, n1) AS v, n2 AS o, least(a0, a1, a2) AS low FROM geo UNION ALL SELECT elem_id, least(n1, n2), greatest(n1, n2), n0, least(a0, a1, a2) FROM geo UNION ALL SELECT elem_id, least(n2, n0), greatest(n2, n0), n1, least(a0, a1, a2) FROM geo),
quads AS (SELECT u, v, min(elem_id) AS first_elem, max(elem_id) AS last_elem, arg_min(o, elem_id) AS k, arg_max(o, elem_id) AS m, min(low) AS before FROM sides GROUP BY u, v HAVING count(*) = 2),
xy AS (SELECT q.*, pu.x AS xu, pu.y AS yu, pv.x AS xv, pv.y AS yv, pk.x AS xk, pk.y AS yk, pm.x AS xm, pm.y AS ym FROM quads q JOIN nodes pu ON pu.node_id = u JOIN nodes pv ON pv.node_id = v JOIN nodes pk ON pk.node_id = k JOIN nodes pm ON pm.node_id = m),
d AS (SELECT *, sqrt((xu - xm) ** 2 + (yu - ym) ** 2) AS um, sqrt((xu - xk) ** 2 + (yu - yk) ** 2) AS uk, sqrt((xv - xm) ** 2 + (yv - ym) ** 2) AS vm, sqrt((xv - xk) ** 2 + (yv - yk) ** 2) AS vk, sqrt((xk - xm) ** 2 + (yk - ym) ** 2) AS km,
  (xm - xu) * (yk - yu) - (ym - yu) * (xk - xu) AS s1, (xk - xv) * (ym - yv) - (yk - yv) * (xm - xv) AS s2 FROM xy),
flips AS (SELECT u, v, first_elem, last_elem, least(
  acos(greatest(-1, least(1, (um * um + uk * uk - km * km) / (2 * um * uk)))), acos(greatest(-1, least(1, (um * um + km * km - uk * uk) / (2 * um * km)))), acos(greatest(-1, least(1, (uk * uk + km * km - um * um) / (2 * uk * km)))),
  acos(greatest(-1, least(1, (vm * vm + vk * vk - km * km) / (2 * vm * vk)))), acos(greatest(-1, least(1, (vm * vm + km * km - vk * vk) / (2 * vm * km)))), acos(greatest(-1, least(1, (vk * vk + km * km - vm * vm) / (2 * vk * km))))) * 180 / pi() - before AS gain
  FROM d WHERE s1 <> 0 AND s2 <> 0)"""


@query(f"{SWAP_SQL} SELECT u, v, round(gain, 6) AS gain FROM flips WHERE gain > 1e-9")
def swap_candidates(m):
    return R.swap_candidates(m).select("u", "v", r6("gain"))


@query(f"""{SWAP_SQL.replace("AS gain", "AS gain, before")}, ok AS (SELECT f.*, q.k, q.m FROM flips f JOIN quads q ON q.u = f.u AND q.v = f.v WHERE f.gain + f.before >= least(f.before, 20) - 1e-9),
g AS (SELECT o.u, o.v, greatest(0, a.valence - 6) + greatest(0, b.valence - 6) + greatest(0, c.valence - 6) + greatest(0, d.valence - 6) - greatest(0, a.valence - 7) - greatest(0, b.valence - 7) - greatest(0, c.valence - 5) - greatest(0, d.valence - 5) AS gain
  FROM ok o JOIN valence a ON a.node_id = o.u JOIN valence b ON b.node_id = o.v JOIN valence c ON c.node_id = o.k JOIN valence d ON d.node_id = o.m) SELECT u, v, gain FROM g WHERE gain > 0""")
def valence_swap_candidates(m):
    return R.valence_swap_candidates(m, 6).select("u", "v", F.col("gain").cast("long").alias("gain"))


@query()
def relieved_nodes(m):
    return R.relieve_nodes(m, 6, most=3)[0].elements.drop("mesh_id")


@query()
def patch_plan(m):
    from trilattice.operators import patches

    found = P.geometry(m).where("min_angle < 24").select("mesh_id", "elem_id", F.lit("c1").alias("check"))
    plan = patches.plan(m, found)
    return plan.select("patch", "class", "checks", "n_seeds", "n_elements", r6("worst_min_angle"), r6("severity"), "rank")


@query()
def swap_selected(m):
    return R.select_disjoint(R.swap_candidates(m)).select("u", "v", "first_elem", "last_elem")


@query()
def swap_and_smooth(m):
    swapped, _ = R.swap_pass(m)
    return R.smooth(swapped, rounds=2).nodes.select("node_id", r6("x"), r6("y"))


@query()
def bisect_longest(m):
    return R.bisect_longest(m, P.geometry(m).where("min_angle < 30")).elements.drop("mesh_id")


@query()
def trimmed_dead_ends(m):
    return R.trim_dead_ends(m).elements.drop("mesh_id")


@query("""big AS (SELECT label FROM sizes WHERE size >= 10 AND label IN (SELECT label FROM cc JOIN corner USING (elem_id) WHERE node_id IN (FROM open_nodes))) SELECT elem_id, n0, n1, n2 FROM elements JOIN cc USING (elem_id) WHERE label IN (FROM big)""")
def keep_components(m):
    return R.keep_components(m, least=10).elements.drop("mesh_id")


@query()
def welded_nodes(m):
    return R.weld(m, 0.55).elements.drop("mesh_id")


# nearest, raster and references


@query("""p AS (SELECT elem_id, (x0 + x1 + x2) / 3 AS x, (y0 + y1 + y2) / 3 AS y FROM tri), s AS (SELECT kind, seg_id, x AS sx, y AS sy FROM boundary JOIN nodes USING (node_id)),
d AS (SELECT elem_id, kind, seg_id, min(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))) AS dist FROM p JOIN s ON sx BETWEEN x - 30 AND x + 30 AND sy BETWEEN y - 30 AND y + 30 WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 30 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY dist, kind, seg_id) AS r FROM d) SELECT elem_id, round(sum(dist), 6) AS width FROM r WHERE r <= 2 GROUP BY elem_id HAVING count(*) = 2""")
def channel_width(m):
    centre = P.located(m).select("elem_id", ((F.col("x0") + F.col("x1") + F.col("x2")) / 3).alias("x"), ((F.col("y0") + F.col("y1") + F.col("y2")) / 3).alias("y"))
    samples = B.placed(m, m.boundary).select("kind", "seg_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return S.two_bank_width(centre, samples, 30.0, ["elem_id"], ["kind", "seg_id"]).select("elem_id", r6("width"))


@query("""dem AS (SELECT (node_id // 50)::INTEGER AS r, (node_id % 50)::INTEGER AS c, 8 - depth AS z FROM nodes), p AS (SELECT node_id, x - 0.3 AS cf, y - 0.3 AS rf, (top // 50 + 1)::INTEGER AS rows FROM nodes, top),
q AS (SELECT *, greatest(0, least(48, floor(cf - 0.5)))::INTEGER AS c0, greatest(0, least(rows - 2, floor(rf - 0.5)))::INTEGER AS r0, cf >= 0 AND cf <= 50 AND rf >= 0 AND rf <= rows AS ok FROM p),
f AS (SELECT *, least(1, greatest(0, cf - 0.5 - c0)) AS fc, least(1, greatest(0, rf - 0.5 - r0)) AS fr FROM q),
z AS (SELECT node_id, CASE WHEN ok THEN coalesce((1 - fr) * ((1 - fc) * a.z + fc * b.z) + fr * ((1 - fc) * e.z + fc * g.z), 0) ELSE 0 END AS z FROM f LEFT JOIN dem a ON a.r = r0 AND a.c = c0 LEFT JOIN dem b ON b.r = r0 AND b.c = c0 + 1 LEFT JOIN dem e ON e.r = r0 + 1 AND e.c = c0 LEFT JOIN dem g ON g.r = r0 + 1 AND g.c = c0 + 1)
SELECT node_id, round(CASE WHEN z >= 0 THEN 0 ELSE -z END, 6) AS depth FROM z""")
def raster_sample(m):
    raster = m.nodes.select(F.floor(F.col("node_id") / 50).cast("int").alias("row"), (F.col("node_id") % 50).cast("int").alias("col"), (F.lit(8) - F.col("depth")).alias("z"))
    rows = m.nodes.agg(F.max("node_id")).first()[0] // 50 + 1
    return S.sample_raster(m.nodes.select("node_id", "x", "y"), raster, (0.3, 0.3, 1.0, 1.0), (rows, 50), ["node_id"]).select("node_id", r6("depth"))


@query("""p AS (SELECT node_id, trunc((x - 3.2) / 2.5)::INTEGER AS c, trunc((78.2 - y) / 2.5)::INTEGER + 1 AS r FROM nodes) SELECT node_id, CASE WHEN c BETWEEN 0 AND 19 AND r BETWEEN 1 AND 30 THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c + 1, 1) || r END AS cell FROM p""")
def cell_reference(m):
    return m.nodes.select("node_id", S.cell_reference(F.col("x"), F.col("y"), 3.2, 3.2, 53.2, 78.2, 2.5).alias("cell"))


@query("""pts(name, lon, lat) AS (VALUES ('a', 10.2, 5.1), ('b', 33.3, 20.2), ('c', 49.9, 1.0)), h AS (SELECT name, node_id, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2)))) AS dist FROM pts, nodes)
SELECT name, arg_min(node_id, dist) AS node_id, round(min(dist), 3) AS dist FROM h GROUP BY name""")
def haversine_snap(m):
    points = m.nodes.sparkSession.createDataFrame([("a", 10.2, 5.1), ("b", 33.3, 20.2), ("c", 49.9, 1.0)], "name string, lon double, lat double")
    return S.snap_to_nodes(points, m.nodes).select("name", "node_id", F.round("dist", 3).alias("dist"))


# units and references


@query("""SELECT node_id, round(1000 / 110574.0::DOUBLE, 9) AS lat_deg, round(1000 / (111320.0::DOUBLE * cos(radians(y / 4))), 9) AS lon_deg, round(1e6 / (6371000.0::DOUBLE * cos(radians(y / 4)) * pi() / 180), 6) AS deg_per_1000_km,
round(111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * (y / 4)) + 1.175::DOUBLE * cos(4 * (y / 4)) - 0.0023::DOUBLE * cos(6 * (y / 4)), 6) AS series FROM nodes""")
def degree_conversions(m):
    lat = F.col("y") / 4
    return m.nodes.select("node_id", F.round(U.latitude_degrees(F.lit(1000.0)), 9).alias("lat_deg"), F.round(U.longitude_degrees(F.lit(1000.0), lat), 9).alias("lon_deg"), r6(F.lit(1e6) * U.degrees_of_metre(lat), "deg_per_1000_km"), r6(U.metres_of_degree(lat), "series"))


@query("SELECT node_id, round(x * cos(radians(12.5)) * 111e3, 3) AS bx, round(y * 111e3, 3) AS \"by\", round(x, 6) AS x, round(y, 6) AS y FROM nodes")
def band_metric(m):
    middle = F.lit(12.5)
    bx, by = U.band_metres(F.col("x"), F.col("y"), middle)
    x, y = U.band_degrees(bx, by, middle)
    return m.nodes.select("node_id", F.round(bx, 3).alias("bx"), F.round(by, 3).alias("by"), r6(x, "x"), r6(y, "y"))


@query("""p AS (SELECT node_id, x, y, trunc((x - 3.2) / 2.5)::INTEGER AS c, trunc((78.2 - y) / 2.5)::INTEGER AS r FROM nodes WHERE x > 3.2 AND y < 78.2), b AS (SELECT *, 3.2 + c * 2.5 AS x0, 78.2 - r * 2.5 AS y1 FROM p WHERE c BETWEEN 0 AND 19 AND r BETWEEN 0 AND 29),
s AS (SELECT *, least(trunc((x - x0) / 2.5 * 5), 4) AS sc, least(trunc((y1 - y) / 2.5 * 5), 4) AS sr FROM b)
SELECT node_id, round(x0 + sc * 0.5, 6) AS xmin, round(y1 - sr * 0.5 - 0.5, 6) AS ymin, round(x0 + sc * 0.5 + 0.5, 6) AS xmax, round(y1 - sr * 0.5, 6) AS ymax FROM s""")
def reference_boxes(m):
    lattice_ = (3.2, 3.2, 53.2, 78.2, 2.5)
    ref = S.cell_reference(F.col("x"), F.col("y"), *lattice_, detail="part")
    found = m.nodes.where((F.col("x") > 3.2) & (F.col("y") < 78.2)).select("node_id", N.reference_box(ref, *lattice_).alias("b")).where("b is not null")
    return found.select("node_id", *(r6(f"b.{c}", c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query("""p AS (SELECT node_id, floor((x - 1) / 1.5)::BIGINT AS i, floor((400 - y) / 1.5)::BIGINT AS j FROM nodes), k AS (SELECT * FROM p WHERE i BETWEEN 0 AND 31 AND j BETWEEN 0 AND 265)
SELECT node_id, CASE WHEN i >= 26 THEN 'A' || chr((65 + i - 26)::INTEGER) ELSE chr((65 + i)::INTEGER) END || (j + 1) AS label, round(1 + least(i, 2) * 1.5::DOUBLE, 6) AS xmin, round(400 - (greatest(j, 3) + 1) * 1.5::DOUBLE, 6) AS ymin, round(1 + (greatest(i, 2) + 1) * 1.5::DOUBLE, 6) AS xmax, round(400 - least(j, 3) * 1.5::DOUBLE, 6) AS ymax FROM k""")
def lattice_labels(m):
    cells = N.LabelledCells(1.0, 400.0, 1.5, 32, 266)
    found = m.nodes.select("node_id", cells.label(F.col("x"), F.col("y")).alias("label")).where("label is not null").withColumn("b", cells.region(F.concat("label", F.lit("-c4"))))
    return found.select("node_id", "label", *(r6(f"b.{c}", c) for c in ("xmin", "ymin", "xmax", "ymax")))


# values of meshes and groups


@query("SELECT CASE WHEN max(abs(x)) <= 360 AND max(abs(y)) <= 90 THEN 'lonlat' ELSE 'metric' END AS kind FROM nodes")
def coordinate_kind(m):
    return Y.coordinate_kind(m.nodes).drop("mesh_id")


@query("SELECT round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax, true AS of_open FROM nodes JOIN open_nodes USING (node_id)")
def bounding_box(m):
    return Y.bounding_box(m).select(r6("xmin"), r6("ymin"), r6("xmax"), r6("ymax"), "of_open")


@query("SELECT node_id, string_agg(elem_id::VARCHAR, ',' ORDER BY elem_id) AS elems FROM corner GROUP BY node_id")
def incident_elements(m):
    return Y.incident(m.elements).select("node_id", F.array_join(F.transform("elems", lambda e: e.cast("string")), ",").alias("elems"))


@query("""g AS (SELECT node_id // 150 AS grp, x, y FROM nodes), s AS (SELECT grp, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM g GROUP BY grp),
t AS (SELECT g.grp, (x - mx) * cos(atan2(2 * b, a - c) / 2) + (y - my) * sin(atan2(2 * b, a - c) / 2) AS p FROM g JOIN s USING (grp)) SELECT grp, round(coalesce(max(p) - min(p), 0), 6) AS extent FROM t GROUP BY grp""")
def principal_extent(m):
    return Y.long_axis(m.nodes.select(F.floor(F.col("node_id") / 150).alias("grp"), "x", "y"), ["grp"]).select("grp", r6("extent"))


@query("""b AS (SELECT node_id, min(dev) AS dev FROM deviations GROUP BY node_id)
SELECT count(*) AS n, round(min(dev), 6) AS least, round(quantile_cont(dev, 0.5), 6) AS p50, round(quantile_cont(dev, 0.95), 6) AS p95, round(max(dev), 6) AS most, round(avg(dev), 6) AS mean FROM b""")
def perp_statistics(m):
    return Y.perpendicularity(m).select("n", r6("least"), r6("p50"), r6("p95"), r6("most"), r6("mean"))


@query("SELECT elem_id FROM geo WHERE alpha < 0.8 OR least(a0, a1, a2) < 35 OR greatest(a0, a1, a2) > 110")
def quality_failures(m):
    return P.geometry(m).where(Y.fails(0.8, 35.0, 110.0)).select("elem_id")


@query("SELECT node_id AS target, coalesce(bool_or(g.alpha >= 0.8 AND least(a0, a1, a2) >= 35), false) AS passed FROM nodes LEFT JOIN geo g ON list_sort([n0, n1, n2]) = [node_id, node_id + 1, node_id + 51] GROUP BY node_id")
def targets_pass(m):
    targets = m.nodes.select("mesh_id", (F.col("node_id") + 51).alias("n0"), F.col("node_id").alias("n1"), (F.col("node_id") + 1).alias("n2"))
    return Y.targets_pass(m, targets, 0.8, 35.0).select(F.col("n1").alias("target"), "passed")


@query("""bad AS (SELECT elem_id FROM geo WHERE least(a0, a1, a2) < 38), bdual AS (SELECT a, b FROM dual WHERE a IN (FROM bad) AND b IN (FROM bad)),
bc(elem_id, label) USING KEY (elem_id) AS (SELECT elem_id, elem_id FROM bad UNION SELECT d.b, min(c.label) FROM bc c JOIN bdual d ON d.a = c.elem_id JOIN recurring.bc o ON o.elem_id = d.b WHERE c.label < o.label GROUP BY d.b)
SELECT label, u, v FROM half JOIN bc USING (elem_id) GROUP BY label, u, v HAVING count(*) = 1""")
def patch_rims(m):
    bad = m.elements.join(P.geometry(m).where("min_angle < 38").select("mesh_id", "elem_id"), ["mesh_id", "elem_id"], "left_semi")
    return Y.patch_rims(bad, P.element_components(bad)).select("label", "u", "v")


@query("""w AS (SELECT node_id, lag(node_id) OVER v AS p, lead(node_id) OVER v AS n FROM boundary WINDOW v AS (PARTITION BY kind, seg_id ORDER BY pos))
SELECT node_id, CASE WHEN count(*) = 1 THEN max(p) END AS prev, CASE WHEN count(*) = 1 THEN max(n) END AS next, count(*) AS listed FROM w GROUP BY node_id""")
def boundary_neighbours(m):
    return Y.boundary_neighbours(m).drop("mesh_id")


@query("""w AS (SELECT kind, seg_id, pos, node_id, lead(node_id) OVER (PARTITION BY kind, seg_id ORDER BY pos) AS n FROM boundary)
SELECT least(node_id, n) AS u, greatest(node_id, n) AS v, kind, seg_id::INTEGER AS seg_id, pos::INTEGER AS pos FROM w WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY least(node_id, n), greatest(node_id, n) ORDER BY kind, seg_id DESC, pos DESC) = 1""")
def boundary_edge_places(m):
    return Y.boundary_edge_places(m).select("u", "v", "kind", "seg_id", "pos")


# lines beside and along boundaries


_BAND_SQL = """a AS (SELECT seg_id, pos, x, y, depth * 1000 AS h FROM opened JOIN nodes USING (node_id)),
b AS (SELECT *, row_number() OVER v - 1 AS k, count(*) OVER (PARTITION BY seg_id) AS n, cos(radians(avg(y) OVER (PARTITION BY seg_id))) AS cw, arg_min(h, pos) OVER (PARTITION BY seg_id) AS h0, arg_max(h, pos) OVER (PARTITION BY seg_id) AS h1 FROM a WINDOW v AS (PARTITION BY seg_id ORDER BY pos)),
c AS (SELECT *, x * cw * 111e3 AS px, y * 111e3 AS py, {offset} AS off0 FROM b), {more}
t AS (SELECT *, coalesce(lead(px) OVER v, px) - coalesce(lag(px) OVER v, px) AS tx, coalesce(lead(py) OVER v, py) - coalesce(lag(py) OVER v, py) AS ty FROM {last} WINDOW v AS (PARTITION BY seg_id ORDER BY pos))
SELECT seg_id, pos::INTEGER AS pos, round({off}, 3) AS "offset", round((px - ty / sqrt(tx * tx + ty * ty) * {off}) / (cw * 111e3), 6) AS bx, round((py + tx / sqrt(tx * tx + ty * ty) * {off}) / 111e3, 6) AS "by" FROM t WHERE k >= 1 AND k < n - 1"""


def _band(m, taper):
    arcs = B.placed(m, m.open).select("mesh_id", "seg_id", "pos", "x", "y", (F.col("depth") * 1000).alias("h"))
    return B.band(arcs, ["mesh_id", "seg_id"], taper=taper).select("seg_id", "pos", F.round("offset", 3).alias("offset"), r6("bx"), r6("by"))


@query(_BAND_SQL.format(offset="1.25 * h0 + (1.25 * h1 - 1.25 * h0) * k / (n - 1)", more="", last="c", off="off0"))
def band_offsets(m):
    return _band(m, "linear-ends")


_AVERAGE = "coalesce((lag({0}) OVER (PARTITION BY seg_id ORDER BY pos) + {0} + lead({0}) OVER (PARTITION BY seg_id ORDER BY pos)) / 3, {0})"


@query(_BAND_SQL.format(offset="1.25 * h", more=f"d AS (SELECT *, {_AVERAGE.format('off0')} AS off1 FROM c), e AS (SELECT *, {_AVERAGE.format('off1')} AS off2 FROM d),", last="e", off="off2"))
def band_offsets_local(m):
    return _band(m, "local")


@query("""k AS (SELECT 180 / (6371000 * pi()) AS la, 180 / (6371000 * pi()) / cos(radians(20)) AS lo),
p AS (SELECT b.kind, seg_id, pos, x, y, depth, lead(x) OVER v AS nx, lead(y) OVER v AS ny, lead(depth) OVER v AS nd, la, lo FROM boundary b JOIN nodes USING (node_id), k WINDOW v AS (PARTITION BY b.kind, seg_id ORDER BY pos)),
q AS (SELECT *, sqrt((nx / lo - x / lo) * (nx / lo - x / lo) + (ny / la - y / la) * (ny / la - y / la)) AS ln FROM p),
l AS (SELECT *, coalesce(sum(ln) OVER (PARTITION BY kind, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(ln) OVER (PARTITION BY kind, seg_id) AS total FROM q),
n AS (SELECT kind, seg_id, max(total) AS total, (floor((max(total) - 180000) / 90000) + 1)::BIGINT AS n FROM l GROUP BY kind, seg_id HAVING max(total) > 180000),
s AS (SELECT kind, seg_id, k, 90000 + k * CASE WHEN n > 1 THEN (total - 180000) / (n - 1) ELSE 0 END AS s FROM (SELECT *, unnest(range(n)) AS k FROM n))
SELECT s.kind, s.seg_id, k, round(x + (s - start) / greatest(ln, 1e-12) * (nx - x), 5) AS x, round(y + (s - start) / greatest(ln, 1e-12) * (ny - y), 5) AS y, round(depth + (s - start) / greatest(ln, 1e-12) * (nd - depth), 4) AS depth FROM s ASOF JOIN (SELECT * FROM l WHERE nx IS NOT NULL) l ON s.kind = l.kind AND s.seg_id = l.seg_id AND s.s >= l.start""")
def spine_samples(m):
    lines = B.placed(m, m.boundary).select("kind", "seg_id", "pos", "x", "y", "depth")
    return B.line_samples(lines, ["kind", "seg_id"], 90_000.0, 20.0).select("kind", "seg_id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("depth", 4).alias("depth"))


# narrow water


def banks(m: Mesh) -> Mesh:
    """The lattice with lines that run east along every sixth row and back two rows farther north, besides its open row."""
    row, column = F.floor(F.col("node_id") / 50), F.col("node_id") % 50
    there = (F.col("node_id") >= 300) & (row % 6).isin(0, 2)
    pos = F.when(row % 6 == 0, column).otherwise(99 - column)
    line = m.nodes.where(there).select("mesh_id", F.lit("land").alias("kind"), F.floor(row / 6).cast("int").alias("seg_id"), F.lit(0).alias("ibtype"), pos.cast("int").alias("pos"), "node_id")
    return m.with_(boundary=m.open.unionByName(line))


_WIDTH_SQL = """lines AS (SELECT 'open' AS kind, seg_id, pos, node_id FROM opened UNION ALL SELECT 'land', (node_id // 50) // 6, CASE WHEN (node_id // 50) % 6 = 0 THEN node_id % 50 ELSE 99 - node_id % 50 END, node_id FROM nodes WHERE node_id >= 300 AND (node_id // 50) % 6 IN (0, 2)),
lp AS (SELECT kind, seg_id, pos, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM lines JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY kind, seg_id ORDER BY pos)), ll AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS ln FROM lp),
la AS (SELECT *, coalesce(sum(ln) OVER (PARTITION BY kind, seg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN nx IS NULL THEN 1 ELSE greatest(2, ceil(ln / 0.5) + 1) END::BIGINT AS n FROM ll), lt AS (SELECT *, unnest(range(n)) AS step FROM la),
smp AS (SELECT kind, seg_id, coalesce(x + step / n * (nx - x), x) AS sx, coalesce(y + step / n * (ny - y), y) AS sy, start + coalesce(step / n * ln, 0) AS arc FROM lt),
cen AS (SELECT elem_id, (x0 + x1 + x2) / 3 AS cx, (y0 + y1 + y2) / 3 AS cy, greatest(least(l01, l12), least(greatest(l01, l12), l20)) AS h FROM len),
seen AS (SELECT *, sqrt((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)) AS dist FROM cen JOIN smp ON sx BETWEEN cx - 3 * h AND cx + 3 * h AND sy BETWEEN cy - 3 * h AND cy + 3 * h), ord AS (SELECT *, row_number() OVER (PARTITION BY elem_id, kind, seg_id ORDER BY dist, arc) AS r FROM seen WHERE dist <= 3 * h),
one AS (SELECT * FROM ord WHERE r = 1), two AS (SELECT o.* FROM ord o JOIN one USING (elem_id, kind, seg_id) WHERE o.r BETWEEN 2 AND 50 AND abs(o.arc - one.arc) >= 4 * one.dist QUALIFY row_number() OVER (PARTITION BY o.elem_id, o.kind, o.seg_id ORDER BY o.r) = 1),
per AS (SELECT one.elem_id, one.kind, one.seg_id, one.h, one.dist AS near, CASE WHEN ((one.sx - one.cx) * (two.sx - one.cx) + (one.sy - one.cy) * (two.sy - one.cy)) / greatest(one.dist * two.dist, 1e-9) < -0.8 THEN one.dist + two.dist END AS same FROM one LEFT JOIN two USING (elem_id, kind, seg_id)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY elem_id ORDER BY near, kind, seg_id) AS r FROM per),
wid AS (SELECT elem_id, h, least(CASE WHEN count(*) FILTER (r <= 2) = 2 THEN sum(near) FILTER (r <= 2) END, min(same)) AS width FROM rnk GROUP BY elem_id, h),
flagged AS (SELECT elem_id, h, width, width / h AS ratio FROM wid WHERE width / h < 3)"""
_PART_SQL = "{0}dual AS (SELECT a, b FROM dual WHERE a IN (FROM {1}) AND b IN (FROM {1})), {0}(elem_id, label) USING KEY (elem_id) AS (SELECT elem_id, elem_id FROM {1} UNION SELECT d.b, min(c.label) FROM {0} c JOIN {0}dual d ON d.a = c.elem_id JOIN recurring.{0} o ON o.elem_id = d.b WHERE c.label < o.label GROUP BY d.b)"


@query(f"{_WIDTH_SQL} SELECT elem_id, round(h, 6) AS h, round(width, 6) AS width, round(ratio, 6) AS ratio FROM flagged")
def under_resolved(m):
    return C.under_resolved(banks(m), 0.5).select("elem_id", r6("h"), r6("width"), r6("ratio"))


@query(f"{_WIDTH_SQL}, hits AS (SELECT elem_id FROM flagged), {_PART_SQL.format('fc', 'hits')} SELECT elem_id FROM fc WHERE label IN (SELECT label FROM fc GROUP BY label HAVING count(*) >= 4)")
def under_resolved_groups(m):
    return C.under_resolved(banks(m), 0.5, least_elements=4).select("elem_id")


@query(f"""{_WIDTH_SQL}, at_open AS (SELECT DISTINCT elem_id FROM corner WHERE node_id IN (FROM open_nodes)), hits AS (SELECT elem_id FROM flagged WHERE elem_id NOT IN (FROM at_open)), rest AS (SELECT elem_id FROM elements WHERE elem_id NOT IN (FROM hits)), {_PART_SQL.format('fc', 'hits')}, {_PART_SQL.format('bc', 'rest')},
body AS (SELECT label, count(*) AS size, count(o.elem_id) AS n_open FROM bc LEFT JOIN at_open o USING (elem_id) GROUP BY label), main AS (SELECT label FROM body WHERE n_open > 0 ORDER BY n_open DESC, label LIMIT 1),
touch AS (SELECT DISTINCT f.label AS cluster, b.label, size, b.label IN (FROM main) AS main FROM dual d JOIN fc f ON f.elem_id = d.a JOIN bc b ON b.elem_id = d.b JOIN body ON body.label = b.label),
beside AS (SELECT cluster, bool_or(main) AS at_main, bool_or(NOT main) AS at_other, bool_or(NOT main AND size >= 6) AS at_large FROM touch GROUP BY cluster),
decided AS (SELECT f.label AS cluster, CASE WHEN count(*) <= 1 THEN 'delete' WHEN coalesce(any_value(at_main AND NOT at_other OR at_large), false) THEN 'widen' ELSE 'delete' END AS action FROM fc f LEFT JOIN beside ON cluster = f.label GROUP BY f.label),
lost AS (SELECT label, min(cluster) AS cluster FROM touch JOIN decided USING (cluster) WHERE NOT main AND size < 6 AND action = 'delete' GROUP BY label)
SELECT elem_id, cluster, 'throat' AS part, action FROM fc JOIN decided ON cluster = label UNION ALL SELECT elem_id, cluster, 'basin', 'delete' FROM bc JOIN lost USING (label)""")
def throats(m):
    b = banks(m)
    return C.throats(b, C.under_resolved(b, 0.5), small=1).drop("mesh_id")


@query("""bank AS (SELECT node_id FROM rim_nodes WHERE node_id NOT IN (FROM open_nodes)) SELECT elem_id FROM elements e WHERE n0 IN (FROM bank) AND n1 IN (FROM bank) AND n2 IN (FROM bank) AND (SELECT count(*) FROM half h JOIN rim USING (u, v) WHERE h.elem_id = e.elem_id) <= 1""")
def bank_to_bank(m):
    return C.bank_to_bank(m).select("elem_id")


@query(f"""steps AS (SELECT least(node_id, nxt) AS u, greatest(node_id, nxt) AS v FROM (SELECT node_id, lead(node_id) OVER (PARTITION BY seg_id ORDER BY pos) AS nxt FROM opened) WHERE nxt IS NOT NULL AND nxt <> node_id), stops AS (SELECT a FROM dual GROUP BY a HAVING count(*) = 1 AND NOT EXISTS (SELECT 1 FROM half h JOIN steps s ON s.u = h.u AND s.v = h.v WHERE h.elem_id = a)),
open_rows AS (SELECT node_id FROM boundary WHERE kind = 'open'), shore AS (SELECT node_id FROM rim_nodes UNION SELECT node_id FROM open_rows), slim AS (SELECT elem_id FROM elements WHERE n0 IN (FROM shore) AND n1 IN (FROM shore) AND n2 IN (FROM shore)), {_PART_SQL.format('sc', 'slim')},
wet AS (SELECT label FROM cc JOIN corner USING (elem_id) WHERE node_id IN (FROM open_nodes))
SELECT elem_id, label <> (SELECT label FROM sizes ORDER BY size DESC, label LIMIT 1) AS disjoint, elem_id IN (FROM stops) AS dead_end, elem_id IN (FROM slim) AS thin, elem_id IN (SELECT elem_id FROM sc WHERE label IN (SELECT label FROM sc GROUP BY label HAVING count(*) >= 3)) AS thin_chain, label NOT IN (FROM wet) AS unreachable, false AS under_resolved FROM cc""")
def element_flags(m):
    rim = P.edge_nodes(P.rim_edges(m.elements)).select("mesh_id", F.lit("land").alias("kind"), F.lit(0).alias("seg_id"), F.lit(0).alias("ibtype"), F.lit(0).alias("pos"), "node_id")
    return Y.element_flags(m.with_(boundary=m.open.unionByName(rim))).drop("mesh_id")


# edge splits


_SPLIT_SQL = """own AS (SELECT elem_id, least(n0, n1) AS u, greatest(n0, n1) AS v, l01 AS ln FROM len UNION ALL SELECT elem_id, least(n1, n2), greatest(n1, n2), l12 FROM len UNION ALL SELECT elem_id, least(n2, n0), greatest(n2, n0), l20 FROM len),
mine AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY elem_id ORDER BY ln DESC, u DESC, v DESC) = 1), votes AS (SELECT u, v, count(*) AS votes FROM mine WHERE ln > 1.4 GROUP BY u, v),
cut AS (SELECT u, v, (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY u, v) AS m FROM votes JOIN edges USING (u, v) WHERE votes = uses)"""


@query(f"""{_SPLIT_SQL}, hit AS (SELECT e.*, m, CASE WHEN least(n0, n1) = c.u AND greatest(n0, n1) = c.v THEN 0 WHEN least(n1, n2) = c.u AND greatest(n1, n2) = c.v THEN 1 ELSE 2 END AS slot, (SELECT max(elem_id) FROM elements) + row_number() OVER (ORDER BY e.elem_id) AS other FROM elements e JOIN half h USING (elem_id) JOIN cut c ON c.u = h.u AND c.v = h.v),
turned AS (SELECT elem_id, other, m, CASE slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS a, CASE slot WHEN 0 THEN n1 WHEN 1 THEN n2 ELSE n0 END AS b, CASE slot WHEN 0 THEN n2 WHEN 1 THEN n0 ELSE n1 END AS c FROM hit)
SELECT elem_id, n0, n1, n2 FROM elements WHERE elem_id NOT IN (SELECT elem_id FROM hit) UNION ALL SELECT elem_id, m, b, c FROM turned UNION ALL SELECT other, m, c, a FROM turned""")
def edge_split(m):
    return R.split_edges(m, R.mutual_longest(m, 1.4)).elements.drop("mesh_id")


@query(f"{_SPLIT_SQL} SELECT node_id, round(x, 6) AS x, round(y, 6) AS y, round(depth, 6) AS depth FROM nodes UNION ALL SELECT m, round((p.x + q.x) / 2, 6), round((p.y + q.y) / 2, 6), round((p.depth + q.depth) / 2, 6) FROM cut JOIN nodes p ON p.node_id = u JOIN nodes q ON q.node_id = v")
def edge_split_nodes(m):
    return R.split_edges(m, R.mutual_longest(m, 1.4)).nodes.select("node_id", r6("x"), r6("y"), r6("depth"))


@query(f"""{_SPLIT_SQL}, w AS (SELECT kind, seg_id, pos, node_id, lead(node_id) OVER (PARTITION BY kind, seg_id ORDER BY pos) AS n FROM boundary), r AS (SELECT kind, seg_id, pos, 0 AS i, node_id FROM w UNION ALL SELECT kind, seg_id, pos, 1, m FROM w JOIN cut ON u = least(node_id, n) AND v = greatest(node_id, n) WHERE n IS NOT NULL)
SELECT kind, seg_id::INTEGER AS seg_id, (row_number() OVER (PARTITION BY kind, seg_id ORDER BY pos, i) - 1)::INTEGER AS pos, node_id FROM r""")
def edge_split_boundary(m):
    return R.split_edges(m, R.mutual_longest(m, 1.4)).boundary.select("kind", "seg_id", "pos", "node_id")


# local edits


_SHAPE_SQL = """{1}l AS (SELECT *, ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2 AS area, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l01, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l12, sqrt((x0 - x2) * (x0 - x2) + (y0 - y2) * (y0 - y2)) AS l20 FROM {0}),
{1}c AS (SELECT *, CASE WHEN l20 * l01 > 0 THEN (l20 * l20 + l01 * l01 - l12 * l12) / (2 * l20 * l01) ELSE 1 END AS c0, CASE WHEN l01 * l12 > 0 THEN (l01 * l01 + l12 * l12 - l20 * l20) / (2 * l01 * l12) ELSE 1 END AS c1, CASE WHEN l12 * l20 > 0 THEN (l12 * l12 + l20 * l20 - l01 * l01) / (2 * l12 * l20) ELSE 1 END AS c2 FROM {1}l),
{1}a AS (SELECT *, degrees(acos(greatest(-1, least(1, c0)))) AS a0, degrees(acos(greatest(-1, least(1, c1)))) AS a1, degrees(acos(greatest(-1, least(1, c2)))) AS a2, 4 * sqrt(3.0::DOUBLE) * abs(area) / (l01 * l01 + l12 * l12 + l20 * l20) AS alpha FROM {1}c),
{1} AS (SELECT *, pow(greatest(0, 0.7 - alpha), 2) + pow(greatest(0, 30 - least(a0, a1, a2)), 2) / 100 + pow(greatest(0, greatest(a0, a1, a2) - 130), 2) / 100 AS pen, least(a0, a1, a2) AS low, (least(a0, a1, a2) < 30)::INT + (greatest(a0, a1, a2) > 130)::INT + (area <= 0)::INT AS misses FROM {1}a)"""


@query(f"""hits AS (SELECT elem_id FROM geo WHERE alpha < 0.75), {_PART_SQL.format('qc', 'hits')}
SELECT elem_id, cluster, size, place FROM (SELECT label AS cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS place FROM qc GROUP BY label HAVING count(*) BETWEEN 2 AND 50) JOIN qc ON label = cluster""")
def failure_clusters(m):
    return E.failure_clusters(m, 2, 50, P.geometry(m).where("alpha < 0.75")).drop("mesh_id")


@query("""pn AS (SELECT node_id FROM (SELECT u AS node_id FROM rim UNION ALL SELECT v FROM rim) GROUP BY node_id HAVING count(*) > 2), pe AS (SELECT u AS node_id, first_elem, last_elem FROM inner_edges UNION ALL SELECT v, first_elem, last_elem FROM inner_edges),
pl AS (SELECT node_id, first_elem AS a, last_elem AS b FROM pe WHERE node_id IN (FROM pn) UNION ALL SELECT node_id, last_elem, first_elem FROM pe WHERE node_id IN (FROM pn)),
pf(node_id, elem_id, label) USING KEY (node_id, elem_id) AS (SELECT node_id, elem_id, elem_id FROM corner WHERE node_id IN (FROM pn) UNION SELECT l.node_id, l.b, min(f.label) FROM pf f JOIN pl l ON l.node_id = f.node_id AND l.a = f.elem_id JOIN recurring.pf o ON o.node_id = l.node_id AND o.elem_id = l.b WHERE f.label < o.label GROUP BY l.node_id, l.b),
ps AS (SELECT node_id, label, count(*) AS size, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) = 1 AS kept FROM pf GROUP BY node_id, label)
SELECT node_id, elem_id, label AS fan, size, kept FROM pf JOIN ps USING (node_id, label)""")
def pinch_fans(m):
    return E.pinch_fans(m).drop("mesh_id")


@query()
def repaired_pinches(m):
    return E.repair_pinches(m)[0].elements.drop("mesh_id")


@query("""safe AS (SELECT DISTINCT elem_id FROM corner WHERE node_id IN (FROM open_nodes)), gone(elem_id, one) USING KEY (elem_id) AS (SELECT elem_id, 1 FROM elements e WHERE elem_id NOT IN (FROM safe) AND (SELECT count(*) FROM dual WHERE a = e.elem_id) <= 1
UNION SELECT c.a, 1 FROM (SELECT DISTINCT d.a FROM gone g JOIN dual d ON d.b = g.elem_id) c JOIN dual t ON t.a = c.a LEFT JOIN recurring.gone r ON r.elem_id = t.b LEFT JOIN recurring.gone s ON s.elem_id = c.a WHERE s.elem_id IS NULL AND c.a NOT IN (FROM safe) GROUP BY c.a HAVING count(*) - count(r.elem_id) <= 1)
SELECT elem_id, n0, n1, n2 FROM elements WHERE elem_id NOT IN (SELECT elem_id FROM gone)""")
def pruned_one_wide(m):
    return E.prune_one_wide(m).elements.drop("mesh_id")


def _ring(m):
    """The lattice's outline as one ring: the open row, then the land lists, a node at its first place; flagged near its west or south end."""
    part = F.when(F.col("kind") == "open", -1).otherwise(F.col("seg_id"))
    first = m.boundary.groupBy("mesh_id", "node_id").agg(F.min(F.struct(part.alias("part"), "pos")).alias("at"))
    low = m.nodes.groupBy("mesh_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    at = first.join(m.nodes, ["mesh_id", "node_id"]).join(low, "mesh_id")
    flag = (F.col("x") <= F.col("x0") + 0.38) | (F.col("y") <= F.col("y0") + 0.38)
    return at.select("mesh_id", (F.col("at.part") * 100_000_000 + F.col("at.pos")).alias("pos"), "node_id", flag.alias("flag"))


_RUN_SQL = """outline AS (SELECT node_id, min(CASE WHEN kind = 'open' THEN -1 ELSE seg_id END * 100000000::BIGINT + pos) AS pos FROM boundary GROUP BY node_id),
ring AS (SELECT node_id, row_number() OVER (ORDER BY pos) - 1 AS spot, count(*) OVER () AS size, x <= (SELECT min(x) FROM nodes) + 0.38 OR y <= (SELECT min(y) FROM nodes) + 0.38 AS flag FROM outline JOIN nodes USING (node_id)),
twice AS (SELECT node_id, spot, size, flag FROM ring UNION ALL SELECT node_id, spot - size, size, flag FROM ring), isl AS (SELECT *, spot - sum(flag::INT) OVER (ORDER BY spot) AS run FROM twice),
runs AS (SELECT run, min(spot) AS a, max(spot) AS b, count(*) AS n FROM isl WHERE flag GROUP BY run, size HAVING max(spot) >= 0 AND max(spot) < size - 1 OR min(spot) >= 0 AND NOT (SELECT bool_or(flag) FROM ring WHERE spot = 0)),
best AS (SELECT run, a FROM runs ORDER BY n DESC, a < 0, a LIMIT 1)"""


@query(f"{_RUN_SQL} SELECT (spot - a)::INTEGER AS pos, node_id FROM isl JOIN best USING (run) WHERE flag")
def open_run(m):
    return E.longest_run(_ring(m)).drop("mesh_id")


@query("""walk AS (SELECT node_id, x, y, row_number() OVER (ORDER BY kind, pos) - 1 AS pos FROM boundary JOIN nodes USING (node_id) WHERE kind = 'open' OR seg_id = 2 AND node_id > 0), tips AS (SELECT arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS "by", max(pos) AS last FROM walk),
far AS (SELECT pos, last, abs((x - ax) * ("by" - ay) - (y - ay) * (bx - ax)) / sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS far FROM walk, tips), crn AS (SELECT pos AS corner FROM far ORDER BY far DESC, pos LIMIT 1)
SELECT 0 AS part, pos::INTEGER AS pos, node_id FROM walk, crn WHERE pos <= corner UNION ALL SELECT 1, (pos - corner)::INTEGER, node_id FROM walk, crn WHERE pos >= corner""")
def corner_parts(m):
    run = m.boundary.where("kind = 'open' or seg_id = 2 and node_id > 0")
    run = run.select("mesh_id", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("kind", "pos")) - 1).cast("int").alias("pos"), "node_id")
    return E.corner_split(m, run, 1.0).drop("mesh_id")


@query(f"""held AS (SELECT node_id FROM rim_nodes UNION SELECT node_id FROM listed), aim AS (SELECT b.node_id, avg(x) AS nx, avg(y) AS ny FROM both_ways b JOIN nodes p ON p.node_id = b.other WHERE b.node_id NOT IN (FROM held) GROUP BY b.node_id),
tried AS (SELECT a.node_id, t.elem_id, CASE WHEN n0 = a.node_id THEN nx ELSE x0 END AS x0, CASE WHEN n0 = a.node_id THEN ny ELSE y0 END AS y0, CASE WHEN n1 = a.node_id THEN nx ELSE x1 END AS x1, CASE WHEN n1 = a.node_id THEN ny ELSE y1 END AS y1, CASE WHEN n2 = a.node_id THEN nx ELSE x2 END AS x2, CASE WHEN n2 = a.node_id THEN ny ELSE y2 END AS y2 FROM aim a JOIN corner c USING (node_id) JOIN tri t ON t.elem_id = c.elem_id),
{_SHAPE_SQL.format('tri', 'was')}, {_SHAPE_SQL.format('tried', 'becomes')}
SELECT node_id, round(any_value(a.nx), 6) AS nx, round(any_value(a.ny), 6) AS ny, round(sum(w.pen), 6) AS before, round(sum(b.pen), 6) AS after FROM becomes b JOIN aim a USING (node_id) JOIN was w ON w.elem_id = b.elem_id GROUP BY node_id HAVING sum(b.pen) + 1e-12 < sum(w.pen) AND min(b.area) > 0""")
def smooth_candidates(m):
    return E.smooth_candidates(m).select("node_id", r6("nx"), r6("ny"), r6("before"), r6("after"))


@query()
def gated_smooth(m):
    return E.gated_smooth(m, 2)[0].nodes.select("node_id", r6("x"), r6("y"))


def _shores(m):
    """Lines beside the lattice's west and east columns, and along every tenth row, with a point for each third row or column."""
    row, column = F.floor(F.col("node_id") / 50), F.col("node_id") % 50
    sides = m.nodes.where(column.isin(0, 49) & (row % 3 == 0)).select("mesh_id", column.alias("line"), row.alias("pos"), (F.col("x") - 0.1).alias("x"), "y")
    rows = m.nodes.where((row % 10 == 5) & (column % 3 == 0)).select("mesh_id", (row + 100).alias("line"), column.alias("pos"), "x", (F.col("y") + 0.15).alias("y"))
    return sides.unionByName(rows)


@query("""shore AS (SELECT node_id % 50 AS line, node_id // 50 AS pos, x - 0.1::DOUBLE AS x, y FROM nodes WHERE node_id % 50 IN (0, 49) AND (node_id // 50) % 3 = 0 UNION ALL SELECT node_id // 50 + 100, node_id % 50, x, y + 0.15::DOUBLE FROM nodes WHERE (node_id // 50) % 10 = 5 AND (node_id % 50) % 3 = 0),
stretch AS (SELECT line, pos, x AS ax, y AS ay, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM shore WINDOW w AS (PARTITION BY line ORDER BY pos)), long AS (SELECT u, v, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS ln FROM rim JOIN nodes p ON p.node_id = u JOIN nodes q ON q.node_id = v),
reach AS (SELECT node_id, x, y, avg(ln) * 0.5 AS reach FROM (SELECT u AS node_id, ln FROM long UNION ALL SELECT v, ln FROM long) JOIN nodes USING (node_id) GROUP BY node_id, x, y),
foot AS (SELECT *, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t FROM reach JOIN stretch ON x >= least(ax, ax + dx) - reach AND x <= greatest(ax, ax + dx) + reach AND y >= least(ay, ay + dy) - reach AND y <= greatest(ay, ay + dy) + reach),
near AS (SELECT *, ax + t * dx AS nx, ay + t * dy AS ny, sqrt((ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y)) AS dist FROM foot)
SELECT node_id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(dist, 6) AS dist FROM near WHERE dist <= reach QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY dist, line, pos) = 1 AND dist > 1e-9""")
def snap_targets(m):
    return E.snap_targets(m, _shores(m)).select("node_id", r6("nx"), r6("ny"), r6("dist"))


@query()
def snapped_rim(m):
    return E.snap_to_lines(m, _shores(m), gate=True)[1].drop("mesh_id")


@query(f"""pair AS (SELECT u, v, p.x AS ux, p.y AS uy, q.x AS vx, q.y AS vy, u IN (FROM rim_nodes) AS ur, v IN (FROM rim_nodes) AS vr, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS ln FROM edges JOIN nodes p ON p.node_id = u JOIN nodes q ON q.node_id = v),
small AS (SELECT u, v, CASE WHEN vr AND NOT ur THEN v ELSE u END AS keep, CASE WHEN ur = vr THEN (ux + vx) / 2 WHEN vr THEN vx ELSE ux END AS nx, CASE WHEN ur = vr THEN (uy + vy) / 2 WHEN vr THEN vy ELSE uy END AS ny FROM pair WHERE ln < 0.9),
about AS (SELECT DISTINCT s.*, c.elem_id FROM (SELECT u AS node_id, * FROM small UNION ALL SELECT v, * FROM small) s JOIN corner c USING (node_id)),
tried AS (SELECT u, v, keep, elem_id, (n0 IN (u, v))::INT + (n1 IN (u, v))::INT + (n2 IN (u, v))::INT AS hit, CASE WHEN n0 IN (u, v) THEN nx ELSE x0 END AS x0, CASE WHEN n0 IN (u, v) THEN ny ELSE y0 END AS y0, CASE WHEN n1 IN (u, v) THEN nx ELSE x1 END AS x1, CASE WHEN n1 IN (u, v) THEN ny ELSE y1 END AS y1, CASE WHEN n2 IN (u, v) THEN nx ELSE x2 END AS x2, CASE WHEN n2 IN (u, v) THEN ny ELSE y2 END AS y2 FROM (SELECT DISTINCT u, v, keep, nx, ny, elem_id FROM about) JOIN tri USING (elem_id)),
{_SHAPE_SQL.format('tri', 'was')}, {_SHAPE_SQL.format('tried', 'becomes')}
SELECT u, v, keep, sum(w.misses)::BIGINT AS before, sum(b.misses) FILTER (hit = 1)::BIGINT AS after FROM becomes b JOIN was w USING (elem_id) GROUP BY u, v, keep HAVING sum(b.misses) FILTER (hit = 1) < sum(w.misses) OR sum(b.misses) FILTER (hit = 1) = sum(w.misses) AND min(b.low) FILTER (hit = 1) > min(w.low) + 0.5""")
def edge_collapses(m):
    return E.collapses(m, 0.9, metric=True).select("u", "v", "keep", "before", "after")


@query()
def collapsed_edges(m):
    return E.collapse_short_edges(m, 0.9, 2)[0].elements.drop("mesh_id")
