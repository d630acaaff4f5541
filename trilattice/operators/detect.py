"""Detectors: elements and nodes that break a rule, each as a DataFrame of offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.model import Mesh
from trilattice.operators import boundary as B
from trilattice.operators import topology as P
from trilattice.operators.topology import MESH

#: Limits of the acceptance gate.
LIMITS = {"min_angle": 30.0, "max_angle": 130.0, "area_change": 0.5, "valence": 8, "depth": 2.0, "tiny_area": 1e-6, "perp": 20.0, "delaunay": 180.1, "duplicate": 1e-3, "min_dt": 0.0, "depth_floor": 0.1, "gravity": 9.81}


def dead_ends(mesh: Mesh) -> DataFrame:
    """Elements with one dual link and no edge between following open nodes."""
    degree = P.dual(mesh.elements).groupBy(MESH, F.col("a").alias("elem_id")).agg(F.count(F.lit(1)).alias("degree")).where("degree = 1")
    on_open = P.half_edges(mesh.elements).join(B.consecutive_edges(mesh.open), [MESH, "u", "v"], "left_semi").select(MESH, "elem_id")
    return degree.join(on_open, [MESH, "elem_id"], "left_anti").select(MESH, "elem_id")


def isolated(mesh: Mesh) -> DataFrame:
    """Elements without a dual link; a mesh of one element has none."""
    alone = mesh.elements.select(MESH, "elem_id").join(P.dual(mesh.elements).select(MESH, F.col("a").alias("elem_id")), [MESH, "elem_id"], "left_anti")
    many = mesh.elements.groupBy(MESH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return alone.join(many, MESH, "left_semi")


def thin(mesh: Mesh) -> DataFrame:
    """Elements with all three corners listed on some boundary."""
    listed = mesh.boundary.select(MESH, "node_id").distinct()
    return P.corners(mesh.elements).join(listed, [MESH, "node_id"], "left_semi").groupBy(MESH, "elem_id").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select(MESH, "elem_id")


def thin_chains(mesh: Mesh, least: int) -> DataFrame:
    """Thin elements in a chain of at least `least` of them; all thin ones for least <= 1."""
    own = mesh.elements.join(thin(mesh), [MESH, "elem_id"], "left_semi")
    if least <= 1:
        return own.select(MESH, "elem_id")
    labels = P.element_components(own)
    long = labels.groupBy(MESH, "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return labels.join(long, [MESH, "label"], "left_semi").select(MESH, "elem_id")


def overconnected(mesh: Mesh, cap: int = 8) -> DataFrame:
    """Nodes with more than `cap` elements."""
    return P.valence(mesh).where(F.col("valence") > cap)


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(MESH, "label").agg(F.count(F.lit(1)).alias("size"))


def disjoint(labels: DataFrame) -> DataFrame:
    """Elements outside their mesh's largest component; of equal ones that with the least label counts as largest."""
    order = Window.partitionBy(MESH).orderBy(F.desc("size"), "label")
    others = component_sizes(labels).withColumn("rank", F.row_number().over(order)).where("rank > 1")
    return labels.join(others.select(MESH, "label"), [MESH, "label"], "left_semi").select(MESH, "elem_id")


def unreachable(mesh: Mesh, labels: DataFrame) -> DataFrame:
    """Elements whose component has no open node; none without an open list, all if the list touches no element."""
    at_open = P.corners(mesh.elements).join(mesh.open.select(MESH, "node_id"), [MESH, "node_id"], "left_semi").select(MESH, "elem_id")
    reached = labels.join(at_open, [MESH, "elem_id"], "left_semi").select(MESH, "label").distinct()
    with_open = mesh.open.select(MESH).distinct()
    return labels.join(reached, [MESH, "label"], "left_anti").join(with_open, MESH, "left_semi").select(MESH, "elem_id")


def orphans(mesh: Mesh) -> DataFrame:
    """Nodes of no element."""
    return mesh.nodes.select(MESH, "node_id").join(P.corners(mesh.elements).select(MESH, "node_id"), [MESH, "node_id"], "left_anti")


def pinches(mesh: Mesh) -> DataFrame:
    """Nodes with more than two rim edges."""
    ends = P.rim_edges(mesh.elements).select(MESH, F.explode(F.array("u", "v")).alias("node_id"))
    return ends.groupBy(MESH, "node_id").agg(F.count(F.lit(1)).alias("rim_edges")).where("rim_edges > 2")


def overused_edges(mesh: Mesh) -> DataFrame:
    """Edges of more than two elements."""
    return P.edges(mesh.elements).where("uses > 2").select(MESH, "u", "v", "uses")


def close_pairs(nodes: DataFrame, radius: float) -> DataFrame:
    """(mesh_id, a, b, dist) with a < b: nodes within the radius, by cells of that size.

    Each node is sent to its own cell, and to the four next ones in a half-plane, so that a pair of cells meets once and
    no node joins all nine cells around it.
    """
    own = nodes.select(MESH, "node_id", "x", "y", F.floor(F.col("x") / radius).alias("i"), F.floor(F.col("y") / radius).alias("j"))
    around = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))))
    sent = own.select(MESH, F.col("node_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "i", "j", F.explode(around).alias("o"))
    sent = sent.select(MESH, "q", "qx", "qy", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), ((F.col("o.di") == 0) & (F.col("o.dj") == 0)).alias("same"))
    found = own.join(sent, [MESH, "i", "j"]).where("not same or q < node_id")
    found = found.withColumn("dist", T.distance((F.col("x"), F.col("y")), (F.col("qx"), F.col("qy")))).where((F.col("dist") <= radius) & (F.col("q") != F.col("node_id")))
    return found.select(MESH, F.least("q", "node_id").alias("a"), F.greatest("q", "node_id").alias("b"), "dist")


def mark_sums(mesh: Mesh) -> DataFrame:
    """(mesh_id, elem_id, total): the sum of the markers of the corners."""
    return P.corners(mesh.elements).join(B.marks(mesh), [MESH, "node_id"]).groupBy(MESH, "elem_id").agg(F.sum("mark").alias("total"))


def mixed_boundary(mesh: Mesh) -> DataFrame:
    """Elements whose markers sum to more than 4: open and solid edges meet in one element."""
    return mark_sums(mesh).where("total > 4")


def fake_open(mesh: Mesh) -> DataFrame:
    """Elements whose markers sum to 4 without a rim edge between two open nodes."""
    opened = mesh.open.select(MESH, "node_id").distinct()
    rim = P.rim_edges(mesh.elements)
    both = rim.join(opened.withColumnRenamed("node_id", "u"), [MESH, "u"], "left_semi").join(opened.withColumnRenamed("node_id", "v"), [MESH, "v"], "left_semi")
    true_open = P.half_edges(mesh.elements).join(both, [MESH, "u", "v"], "left_semi").select(MESH, "elem_id")
    return mark_sums(mesh).where("total = 4").join(true_open, [MESH, "elem_id"], "left_anti").select(MESH, "elem_id")


def open_off_rim(mesh: Mesh) -> DataFrame:
    """Open nodes on no rim edge."""
    return mesh.open.select(MESH, "node_id").distinct().join(P.edge_nodes(P.rim_edges(mesh.elements)), [MESH, "node_id"], "left_anti")


def open_without(mesh: Mesh, open_neighbour: bool) -> DataFrame:
    """Open nodes without an open neighbour in the mesh, or without one that is not open."""
    opened = mesh.open.select(MESH, "node_id").distinct()
    near = P.neighbours(mesh.elements).join(opened.withColumnRenamed("node_id", "other"), [MESH, "other"], "left_semi" if open_neighbour else "left_anti")
    return opened.join(near.select(MESH, "node_id"), [MESH, "node_id"], "left_anti")


def area_changes(mesh: Mesh) -> DataFrame:
    """(mesh_id, u, v, first_elem, last_elem, change): relative area step over each inner edge."""
    area = P.located(mesh).select(MESH, "elem_id", F.abs(T.signed_area()).alias("area"))
    pair = P.inner_edges(mesh.elements)
    pair = pair.join(area.select(MESH, F.col("elem_id").alias("first_elem"), F.col("area").alias("p")), [MESH, "first_elem"]).join(area.select(MESH, F.col("elem_id").alias("last_elem"), F.col("area").alias("q")), [MESH, "last_elem"])
    return pair.select(MESH, "u", "v", "first_elem", "last_elem", ((F.greatest("p", "q") - F.least("p", "q")) / F.greatest(F.col("p"), F.col("q"), F.lit(1e-30))).alias("change"))


def opposite_angles(mesh: Mesh) -> DataFrame:
    """(mesh_id, u, v, first_elem, last_elem, total): the sum of the angles opposite each inner edge.

    Each element sends the angle opposite each of its edges to the edge; a grouping by edge sums them, without a join.
    """
    g = P.geometry(mesh)
    opp = lambda a, b, c: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(c).alias("deg"))
    sent = g.select(MESH, "elem_id", F.inline(F.array(opp("n0", "n1", "a2"), opp("n1", "n2", "a0"), opp("n2", "n0", "a1"))))
    return sent.groupBy(MESH, "u", "v").agg(F.count(F.lit(1)).alias("uses"), F.min("elem_id").alias("first_elem"), F.max("elem_id").alias("last_elem"), F.sum("deg").alias("total")).where("uses = 2").drop("uses")


def implied_steps(mesh: Mesh) -> DataFrame:
    """(mesh_id, elem_id, dt): shortest edge over the gravity-wave speed at the deepest corner."""
    g = P.geometry(mesh)
    deep = F.greatest(F.col("d0"), F.col("d1"), F.col("d2"), F.lit(LIMITS["depth_floor"]))
    return g.select(MESH, "elem_id", (F.least("l01", "l12", "l20") / F.sqrt(F.lit(LIMITS["gravity"]) * deep)).alias("dt"))


def worst(offenders: DataFrame, value: str, id_: str, n: int = 5, descending: bool = True, keys: tuple[str, ...] = (MESH,)) -> DataFrame:
    """The first n rows of each key by value, ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value) if descending else F.asc(value), id_)
    return offenders.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
