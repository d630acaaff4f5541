"""Corners, edges and adjacency.

Everything starts from one explode of the elements. An edge is a pair u < v within a mesh; grouping by it once gives use
counts, the rim, and the elements on both sides, so that no self-join of elements is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.model import Mesh
from trilattice.operators.graph import connected_components
from trilattice.session import stored

MESH = "mesh_id"


def corners(elements: DataFrame) -> DataFrame:
    """(mesh_id, elem_id, slot, node_id)."""
    return elements.select(MESH, "elem_id", F.posexplode(F.array("n0", "n1", "n2")).alias("slot", "node_id"))


def located(mesh: Mesh, elements: DataFrame | None = None) -> DataFrame:
    """elements with x0..x2, y0..y2 and d0..d2.

    One join of exploded corners with nodes and one regrouping by element, instead of a shuffle of the elements for
    each of three joins.
    """
    elements = mesh.elements if elements is None else elements
    joined = corners(elements).join(mesh.nodes, [MESH, "node_id"])
    pick = lambda c, i: F.max(F.when(F.col("slot") == i, F.col(c)))
    columns = [pick(c, i).alias(f"{n}{i}") for i in range(3) for c, n in (("node_id", "n"), ("x", "x"), ("y", "y"), ("depth", "d"))]
    return joined.groupBy(MESH, "elem_id").agg(*columns)


def measured(g: DataFrame) -> DataFrame:
    """Triangles x0..y2 with area (signed), l01, l12, l20, alpha, the corner angles a0..a2, min_angle and max_angle in degrees."""
    g = g.withColumns({"area": T.signed_area(), "l01": T.distance(T.corner(0), T.corner(1)), "l12": T.distance(T.corner(1), T.corner(2)), "l20": T.distance(T.corner(2), T.corner(0))})
    a, b, c = F.col("l01"), F.col("l12"), F.col("l20")
    g = g.withColumns({"alpha": T.alpha(F.col("area"), a, b, c), "a0": T.angle(b, c, a), "a1": T.angle(c, a, b), "a2": T.angle(a, b, c)})
    return g.withColumns({"min_angle": F.least("a0", "a1", "a2"), "max_angle": F.greatest("a0", "a1", "a2")})


def geometry(mesh: Mesh, elements: DataFrame | None = None) -> DataFrame:
    """located(), measured."""
    return measured(located(mesh, elements))


def half_edges(elements: DataFrame) -> DataFrame:
    """(mesh_id, elem_id, u, v), three per element, u < v but for degenerate edges."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return elements.select(MESH, "elem_id", F.inline(F.array(pair("n0", "n1"), pair("n1", "n2"), pair("n2", "n0"))))


def with_stored_edges(elements: DataFrame) -> DataFrame:
    """elements, whose edge table is stored once for all that asks for it."""
    elements._trilattice_edges = stored(edges(elements), "edges")
    return elements


def edges(elements: DataFrame) -> DataFrame:
    """(mesh_id, u, v, uses, first_elem, last_elem); the elements are those with the least and greatest id at the edge."""
    known = getattr(elements, "_trilattice_edges", None)
    return known if known is not None else half_edges(elements).groupBy(MESH, "u", "v").agg(F.count(F.lit(1)).alias("uses"), F.min("elem_id").alias("first_elem"), F.max("elem_id").alias("last_elem"))


def rim_edges(elements: DataFrame) -> DataFrame:
    """Edges used once: the topological boundary."""
    return edges(elements).where("uses = 1").select(MESH, "u", "v")


def inner_edges(elements: DataFrame) -> DataFrame:
    """Edges used exactly twice, with the two elements."""
    return edges(elements).where("uses = 2").select(MESH, "u", "v", "first_elem", "last_elem")


def edge_nodes(edge: DataFrame) -> DataFrame:
    """Distinct (mesh_id, node_id) at the ends of edges."""
    return edge.select(MESH, F.explode(F.array("u", "v")).alias("node_id")).distinct()


def neighbours(elements: DataFrame) -> DataFrame:
    """(mesh_id, node_id, other) for both directions of every distinct edge."""
    e = edges(elements).select(MESH, "u", "v")
    way = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
    return e.select(MESH, F.inline(F.array(way("u", "v"), way("v", "u"))))


def dual(elements: DataFrame) -> DataFrame:
    """(mesh_id, a, b): elements that share an edge, both directions, one row for each shared edge.

    Of an edge with more than two elements only neighbours in order of id are linked.
    """
    next_ = F.lead("elem_id").over(Window.partitionBy(MESH, "u", "v").orderBy("elem_id"))
    pairs = half_edges(elements).withColumn("next", next_).where("next is not null")
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return pairs.select(MESH, F.inline(F.array(way("elem_id", "next"), way("next", "elem_id"))))


def valence(mesh: Mesh) -> DataFrame:
    """(mesh_id, node_id, valence): elements at each node, 0 for unused ones."""
    used = corners(mesh.elements).groupBy(MESH, "node_id").agg(F.count(F.lit(1)).alias("valence"))
    return mesh.nodes.select(MESH, "node_id").join(used, [MESH, "node_id"], "left").select(MESH, "node_id", F.coalesce("valence", F.lit(0)).cast("long").alias("valence"))


def k_ring(mesh: Mesh, seeds: DataFrame, k: int) -> DataFrame:
    """(mesh_id, seed, elem_id): elements within k steps over shared nodes of each seed element."""
    at = corners(mesh.elements).select(MESH, "elem_id", "node_id")
    ring = seeds.select(MESH, F.col("elem_id").alias("seed"), "elem_id")
    for _ in range(k):
        ring = ring.join(at, [MESH, "elem_id"]).select(MESH, "seed", "node_id").distinct().join(at, [MESH, "node_id"]).select(MESH, "seed", "elem_id").distinct()
    return ring


def element_components(elements: DataFrame) -> DataFrame:
    """(mesh_id, elem_id, label): the least element id connected over shared edges within the mesh."""
    kept = stored(elements.select(MESH, "elem_id", "n0", "n1", "n2"), "elements")
    meshes = kept.select(MESH).distinct().count()
    if meshes <= 1:
        # neighbours have close ids, so that ranges of ids are nearly whole parts of the mesh
        parts = connected_components(dual(kept).where("a < b").repartitionByRange("a"), "a", "b")
        return kept.select(MESH, "elem_id").join(parts, F.col("elem_id") == F.col("node"), "left").select(MESH, "elem_id", F.coalesce("component", "elem_id").alias("label"))
    # several meshes: number their elements through one another, least id first within each
    numbered = stored(kept.select(MESH, "elem_id").withColumn("at", F.monotonically_increasing_id()), "numbered")
    one = numbered.select(MESH, F.col("elem_id").alias("a"), F.col("at").alias("at_a"))
    two = numbered.select(MESH, F.col("elem_id").alias("b"), F.col("at").alias("at_b"))
    links = dual(kept).where("a < b").join(one, [MESH, "a"]).join(two, [MESH, "b"])
    parts = connected_components(links.repartitionByRange("at_a"), "at_a", "at_b")
    placed = numbered.join(parts, F.col("at") == F.col("node"), "left").select(MESH, "elem_id", F.coalesce("component", "at").alias("root"))
    named = placed.groupBy("root").agg(F.min("elem_id").alias("label"))
    return placed.join(named, "root").select(MESH, "elem_id", "label")
