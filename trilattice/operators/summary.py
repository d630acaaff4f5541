"""Values of a whole mesh, of groups of points, and of targets named by their corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.model import Mesh
from trilattice.operators import boundary as B
from trilattice.operators import detect as D
from trilattice.operators import topology as P
from trilattice.operators.repair import ranked
from trilattice.operators.topology import MESH


def coordinate_kind(nodes: DataFrame, most_x: float = 360.0, most_y: float = 90.0) -> DataFrame:
    """(mesh_id, kind): lonlat where no coordinate of the mesh passes the bounds of degrees, else metric."""
    fits = (F.max(F.abs("x")) <= most_x) & (F.max(F.abs("y")) <= most_y)
    return nodes.groupBy(MESH).agg(F.when(fits, "lonlat").otherwise("metric").alias("kind"))


def bounding_box(mesh: Mesh) -> DataFrame:
    """(mesh_id, xmin, ymin, xmax, ymax, of_open): the box of the open nodes, or of all nodes in a mesh without any."""
    marked = mesh.nodes.join(mesh.open.select(MESH, "node_id").distinct().withColumn("is_open", F.lit(True)), [MESH, "node_id"], "left")
    pick = lambda f, c: F.coalesce(f(F.when(F.col("is_open"), F.col(c))), f(c))
    return marked.groupBy(MESH).agg(pick(F.min, "x").alias("xmin"), pick(F.min, "y").alias("ymin"), pick(F.max, "x").alias("xmax"), pick(F.max, "y").alias("ymax"), (F.count("is_open") > 0).alias("of_open"))


def incident(elements: DataFrame) -> DataFrame:
    """(mesh_id, node_id, elems): the elements at each used node, in order; as long as its valence."""
    return P.corners(elements).groupBy(MESH, "node_id").agg(F.sort_array(F.collect_list("elem_id")).alias("elems"))


def long_axis(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, extent): the range of points (keys, x, y) along the first principal axis of each group; 0 for one point."""
    shape = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("c"))
    round_ = (F.col("b") == 0) & (F.col("a") <= F.col("c"))
    axis = F.when(round_, F.lit(1.0) * F.pi() / 2).otherwise(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)
    shape = shape.select(*keys, "mx", "my", F.coalesce(axis, F.lit(0.0)).alias("axis"))
    along = (F.col("x") - F.col("mx")) * F.cos("axis") + (F.col("y") - F.col("my")) * F.sin("axis")
    return points.join(shape, keys).groupBy(*keys).agg((F.max(along) - F.min(along)).alias("extent"))


def quantiles(values: DataFrame, column: str, at: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q): exact linear quantiles of the non-null values of each group, an array in the order of `at`.

    Values are ranked in range partitions, so that no reducer holds a group; two rows a quantile are gathered.
    """
    keys = keys or [MESH]
    order = ranked(values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v")), ["v"], "k", keys)
    counts = order.groupBy(*keys).agg(F.max("k").alias("top"))
    spots = F.array(*(F.struct(F.lit(i).alias("i"), (F.col("top") * F.lit(float(q))).alias("spot")) for i, q in enumerate(at)))
    asked = counts.select(*keys, F.inline(spots)).select(*keys, "i", "spot", F.inline(F.array(F.struct(F.floor("spot").alias("k"), F.lit(True).alias("low")), F.struct(F.ceil("spot").alias("k"), F.lit(False).alias("low")))))
    hit = order.join(asked, [*keys, "k"])
    pick = lambda low: F.max(F.when(F.col("low") == low, F.col("v")))
    each = hit.groupBy(*keys, "i", "spot").agg(pick(True).alias("lo"), pick(False).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("spot") - F.floor("spot"))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(at)))).select(*keys, F.array(*(f"q{i}" for i in range(len(at)))).alias("q"))


def perpendicularity(mesh: Mesh) -> DataFrame:
    """(mesh_id, n, least, p50, p95, most, mean) of the best deviation of the open nodes that have one."""
    dev = B.best_deviation(mesh).where(F.col("dev") < float("inf"))
    whole = dev.groupBy(MESH).agg(F.count(F.lit(1)).alias("n"), F.min("dev").alias("least"), F.max("dev").alias("most"), F.avg("dev").alias("mean"))
    return whole.join(quantiles(dev, "dev", [0.5, 0.95]), MESH).select(MESH, "n", "least", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "most", "mean")


def fails(least_alpha: float = 0.95, least_angle: float = 20.0, most_angle: float = 180.0):
    """Whether a row of geometry() misses a target of shape."""
    return (F.col("alpha") < least_alpha) | (F.col("min_angle") < least_angle) | (F.col("max_angle") > most_angle)


def targets_pass(mesh: Mesh, targets: DataFrame, least_alpha: float = 0.95, least_angle: float = 20.0) -> DataFrame:
    """targets (mesh_id, n0, n1, n2) with `passed`: an element with these corners, in any order, exists and is well shaped. An absent one fails."""
    key = F.sort_array(F.array("n0", "n1", "n2"))
    good = P.geometry(mesh).where(~fails(least_alpha, least_angle)).select(MESH, key.alias("__key")).distinct().withColumn("__ok", F.lit(True))
    return targets.withColumn("__key", key).join(good, [MESH, "__key"], "left").withColumn("passed", F.coalesce("__ok", F.lit(False))).drop("__key", "__ok")


def patch_rims(elements: DataFrame, labels: DataFrame) -> DataFrame:
    """(mesh_id, label, u, v): the edges that one element of a patch uses."""
    each = P.half_edges(elements).join(labels, [MESH, "elem_id"])
    return each.groupBy(MESH, "label", "u", "v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def element_flags(mesh: Mesh, narrow: DataFrame | None = None, thin_chain: int = 3) -> DataFrame:
    """(mesh_id, elem_id) of every element with a boolean for each detector; `narrow` holds the under-resolved ones, none if not given."""
    labels = P.element_components(mesh.elements)
    found = {"disjoint": D.disjoint(labels), "dead_end": D.dead_ends(mesh), "thin": D.thin(mesh), "thin_chain": D.thin_chains(mesh, thin_chain), "unreachable": D.unreachable(mesh, labels)}
    if narrow is not None:
        found["under_resolved"] = narrow
    rows = None
    for name, hits in found.items():
        part = hits.select(MESH, "elem_id", F.lit(name).alias("flag"))
        rows = part if rows is None else rows.unionByName(part)
    names = [*found] + ([] if narrow is not None else ["under_resolved"])
    wide = rows.groupBy(MESH, "elem_id").agg(*(F.max(F.col("flag") == n).alias(n) for n in names))
    return mesh.elements.select(MESH, "elem_id").join(wide, [MESH, "elem_id"], "left").select(MESH, "elem_id", *(F.coalesce(n, F.lit(False)).alias(n) for n in names))


def boundary_neighbours(mesh: Mesh) -> DataFrame:
    """(mesh_id, node_id, prev, next, listed) of each listed node: its neighbours along its segment, none where it is listed twice."""
    w = B.along()
    near = mesh.boundary.withColumns({"prev": F.lag("node_id").over(w), "next": F.lead("node_id").over(w)})
    once = lambda c: F.when(F.count(F.lit(1)) == 1, F.max(c)).alias(c)
    return near.groupBy(MESH, "node_id").agg(once("prev"), once("next"), F.count(F.lit(1)).alias("listed"))


def boundary_edge_places(mesh: Mesh) -> DataFrame:
    """(mesh_id, u, v, kind, seg_id, pos, ibtype): where in a list each boundary edge starts; of several the last land, else the last open one."""
    step = B.consecutive(mesh.boundary).where("next is not null").select(MESH, F.least("node_id", "next").alias("u"), F.greatest("node_id", "next").alias("v"), "kind", "seg_id", "pos", "ibtype")
    last = Window.partitionBy(MESH, "u", "v").orderBy("kind", F.desc("seg_id"), F.desc("pos"))
    return step.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
