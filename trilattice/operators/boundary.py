"""Ordered boundary operators: windows over (mesh_id, kind, seg_id) by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.model import Mesh
from trilattice.operators.topology import MESH, edges, neighbours, rim_edges

SEGMENT = [MESH, "kind", "seg_id"]


def along(*keys: str):
    return Window.partitionBy(*(keys or SEGMENT)).orderBy("pos")


def consecutive(boundary: DataFrame) -> DataFrame:
    """boundary with `next`: the following node of its segment, null at the end."""
    return boundary.withColumn("next", F.lead("node_id").over(along()))


def consecutive_edges(boundary: DataFrame) -> DataFrame:
    """Distinct (mesh_id, u, v) between following nodes; a node followed by itself makes none."""
    step = consecutive(boundary).where("next is not null and next <> node_id")
    return step.select(MESH, F.least("node_id", "next").alias("u"), F.greatest("node_id", "next").alias("v")).distinct()


def placed(mesh: Mesh, boundary: DataFrame) -> DataFrame:
    """boundary with x, y and depth of its nodes."""
    return boundary.join(mesh.nodes, [MESH, "node_id"])


def tangents(mesh: Mesh, boundary: DataFrame) -> DataFrame:
    """boundary with the unit tangent (ux, uy): central differences, one-sided at the ends, (0, 0) for a zero one."""
    w = along()
    t = placed(mesh, boundary)
    for c in ("x", "y"):
        t = t.withColumn(f"t{c}", F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)))
    norm = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    unit = lambda c: F.when(norm > 0, F.col(c) / norm).otherwise(F.lit(0.0))
    return t.withColumns({"ux": unit("tx"), "uy": unit("ty")})


def spokes(mesh: Mesh) -> DataFrame:
    """Edges with one end in an open segment: (mesh_id, seg_id, node_id, other) with the edge vector (ex, ey), tangent and ends."""
    t = tangents(mesh, mesh.open).select(MESH, "seg_id", "node_id", "ux", "uy", F.col("x").alias("bx"), F.col("y").alias("by"))
    members = mesh.open.select(MESH, "seg_id", F.col("node_id").alias("other")).distinct()
    far = mesh.nodes.select(MESH, F.col("node_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    out = t.join(neighbours(mesh.elements), [MESH, "node_id"]).join(members, [MESH, "seg_id", "other"], "left_anti").join(far, [MESH, "other"])
    return out.withColumns({"ex": F.col("ox") - F.col("bx"), "ey": F.col("oy") - F.col("by")})


def deviations(mesh: Mesh) -> DataFrame:
    """spokes with `dev`, degrees away from the perpendicular to the tangent."""
    norm = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    cosine = F.abs(F.col("ex") * F.col("ux") + F.col("ey") * F.col("uy")) / F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return spokes(mesh).withColumn("dev", F.lit(90.0) - F.degrees(F.acos(F.least(F.lit(1.0), cosine))))


def best_deviation(mesh: Mesh) -> DataFrame:
    """(mesh_id, node_id, dev) of every open node: its least deviation, infinite without an edge off the boundary."""
    least = deviations(mesh).groupBy(MESH, "node_id").agg(F.min("dev").alias("dev"))
    return mesh.open.select(MESH, "node_id").distinct().join(least, [MESH, "node_id"], "left").select(MESH, "node_id", F.coalesce("dev", F.lit(float("inf"))).alias("dev"))


def marks(mesh: Mesh) -> DataFrame:
    """(mesh_id, node_id, mark): 2 on an open list, else 1 on a rim edge, else 0."""
    rim = rim_edges(mesh.elements).select(MESH, F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("on_rim", F.lit(True))
    opened = mesh.open.select(MESH, "node_id").distinct().withColumn("is_open", F.lit(True))
    joined = mesh.nodes.select(MESH, "node_id").join(opened, [MESH, "node_id"], "left").join(rim, [MESH, "node_id"], "left")
    return joined.select(MESH, "node_id", F.when(F.col("is_open"), 2).when(F.col("on_rim"), 1).otherwise(0).alias("mark"))


def ordering_breaks(mesh: Mesh) -> DataFrame:
    """(mesh_id, seg_id, pos, node_id, next) of following open nodes that share no mesh edge."""
    step = consecutive(mesh.open).where("next is not null").withColumns({"u": F.least("node_id", "next"), "v": F.greatest("node_id", "next")})
    return step.join(edges(mesh.elements).select(MESH, "u", "v"), [MESH, "u", "v"], "left_anti").select(MESH, "seg_id", "pos", "node_id", "next")


def runs(ordered: DataFrame, flag: str, keys: list[str], position: str = "pos") -> DataFrame:
    """(keys, flag, first, last, length) of each stretch of equal flags in order of position."""
    w = Window.partitionBy(*keys).orderBy(position)
    marked = ordered.withColumn("__new", F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*keys, "__run", flag).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def bridge_gaps(ring: DataFrame, keys: list[str], most: int) -> DataFrame:
    """ring (keys, pos, is_open) with short stretches of at most `most` closed nodes between open ones opened.

    The ring is cyclic for the neighbours of its first and last stretch, but a stretch over its start counts as two.
    """
    stretches = runs(ring, "is_open", keys)
    w, whole = Window.partitionBy(*keys).orderBy("first"), Window.partitionBy(*keys)
    first, last = F.min_by("is_open", "first").over(whole), F.max_by("is_open", "first").over(whole)
    near = F.coalesce(F.lag("is_open").over(w), last) & F.coalesce(F.lead("is_open").over(w), first)
    judged = stretches.withColumn("bridge", ~F.col("is_open") & (F.col("length") <= most) & near & (F.count(F.lit(1)).over(whole) > 1)).where("bridge").select(*keys, "first", "last")
    hit = ring.join(judged, keys).where("pos between first and last").select(*keys, "pos").distinct().withColumn("bridged", F.lit(True))
    return ring.join(hit, [*keys, "pos"], "left").withColumn("is_open", F.col("is_open") | F.coalesce("bridged", F.lit(False))).drop("bridged")


def ring_areas(ring: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area): signed shoelace area of closed rings (keys, pos, x, y)."""
    w, whole = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys)
    nx, ny = F.coalesce(F.lead("x").over(w), F.min_by("x", "pos").over(whole)), F.coalesce(F.lead("y").over(w), F.min_by("y", "pos").over(whole))
    return ring.withColumn("__c", F.col("x") * ny - nx * F.col("y")).groupBy(*keys).agg((F.sum("__c") / 2).alias("area"))


def polyline_samples(mesh: Mesh, boundary: DataFrame, spacing: float) -> DataFrame:
    """(mesh_id, kind, seg_id, pos, step, sx, sy, arc): n = ceil(length / spacing) + 1 >= 2 points at i / n of each edge, i < n, then the last node."""
    w = along()
    p = placed(mesh, boundary).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    p = p.withColumn("len", T.distance((F.col("x"), F.col("y")), (F.col("nx"), F.col("ny"))))
    p = p.withColumn("start", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    p = p.withColumn("n", F.when(F.col("nx").isNull(), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("len") / spacing) + 1)).cast("int"))
    p = p.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("step") / F.col("n")
    along_ = lambda a, b: F.coalesce(F.col(a) + t * (F.col(b) - F.col(a)), F.col(a))
    return p.select(*SEGMENT, "pos", "step", along_("x", "nx").alias("sx"), along_("y", "ny").alias("sy"), (F.col("start") + F.coalesce(t * F.col("len"), F.lit(0.0))).alias("arc"))


def line_samples(points: DataFrame, keys: list[str], spacing: float, latitude: float, radius: float = 6_371_000.0) -> DataFrame:
    """(keys, k, x, y, depth): even samples along lines (keys, pos, x, y, depth) in degrees, about `spacing` metres apart, one spacing left free at either end.

    A line of two spacings or less has none. Each edge makes the samples that fall on it, so that no line is gathered
    beyond its window.
    """
    lat = F.lit(180.0 / (radius * 3.141592653589793))
    lon = lat / F.greatest(F.cos(F.radians(F.lit(latitude))), F.lit(1e-6))
    w, whole = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys)
    p = points.withColumns({f"n{c}": F.lead(c).over(w) for c in ("x", "y", "depth")})
    p = p.withColumn("len", T.distance((F.col("x") / lon, F.col("y") / lat), (F.col("nx") / lon, F.col("ny") / lat)))
    p = p.withColumn("start", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("len").over(whole)).withColumn("final", F.lead("nx").over(w).isNull())
    p = p.where(F.col("nx").isNotNull() & (F.col("total") > 2 * spacing))
    last = F.col("total") - spacing
    p = p.withColumn("n", F.floor((last - spacing) / spacing) + 1)
    gap = F.when(F.col("n") > 1, (last - spacing) / (F.col("n") - 1)).otherwise(F.lit(spacing))
    p = p.withColumn("gap", gap).withColumns({"low": F.greatest(F.lit(0), F.floor((F.col("start") - spacing) / F.col("gap"))), "high": F.least(F.col("n") - 1, F.ceil((F.col("start") + F.col("len") - spacing) / F.col("gap")))})
    s = p.where("low <= high").withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("s", F.lit(spacing) + F.col("k") * F.col("gap"))
    s = s.where((F.col("s") >= F.col("start")) & ((F.col("s") < F.col("start") + F.col("len")) | F.col("final")))
    t = (F.col("s") - F.col("start")) / F.greatest(F.col("len"), F.lit(1e-12))
    return s.select(*keys, "k", *((F.col(c) + t * (F.col(f"n{c}") - F.col(c))).alias(c) for c in ("x", "y", "depth")))


def band(arcs: DataFrame, keys: list[str], factor: float = 1.25, skip: int = 1, passes: int = 2, taper: str = "linear-ends", metres: float = 111e3) -> DataFrame:
    """(keys, pos, offset, x, y): a line left of arcs (keys, pos, x, y, h) in degrees, `factor` times h metres off, without `skip` nodes at each end.

    With "linear-ends" the offsets run evenly from the first to the last; with "local" they follow h, averaged over
    three nodes `passes` times, the ends fixed. Arcs of fewer than three nodes, or with no node left, have no line.
    """
    if taper not in ("linear-ends", "local"):
        raise ValueError(f"taper {taper!r} is neither 'linear-ends' nor 'local'")
    w, whole = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys)
    p = arcs.withColumns({"at": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole), "cosw": F.cos(F.radians(F.avg("y").over(whole)))})
    p = p.where((F.col("n") >= 3) & (F.lit(2 * skip) < F.col("n") - 1)).withColumns({"px": F.col("x") * F.col("cosw") * metres, "py": F.col("y") * metres})
    if taper == "linear-ends":
        first, last = F.min_by("h", "at").over(whole) * factor, F.max_by("h", "at").over(whole) * factor
        p = p.withColumn("offset", first + (last - first) * F.col("at") / (F.col("n") - 1))
    else:
        p = p.withColumn("offset", F.col("h") * factor)
        for _ in range(max(0, passes)):
            p = p.withColumn("offset", F.coalesce((F.lag("offset").over(w) + F.col("offset") + F.lead("offset").over(w)) / 3, F.col("offset")))
    for c in ("x", "y"):
        p = p.withColumn(f"t{c}", F.coalesce(F.lead(f"p{c}").over(w), F.col(f"p{c}")) - F.coalesce(F.lag(f"p{c}").over(w), F.col(f"p{c}")))
    norm = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    x, y = (F.col("px") - F.col("ty") / norm * F.col("offset")) / (F.col("cosw") * metres), (F.col("py") + F.col("tx") / norm * F.col("offset")) / metres
    return p.where((F.col("at") >= skip) & (F.col("at") < F.col("n") - skip)).select(*keys, "pos", "offset", x.alias("bx"), y.alias("by"))
