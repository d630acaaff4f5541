"""Repair patches: detected elements whose rings overlap belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trilattice.model import Mesh
from trilattice.operators import topology as P
from trilattice.operators.graph import connected_components
from trilattice.operators.topology import MESH
from trilattice.session import stored


def plan(mesh: Mesh, detected: DataFrame, ring: int = 2) -> DataFrame:
    """(mesh_id, patch, class, checks, n_seeds, n_elements, elements, worst_min_angle, severity, rank) of detections (mesh_id, elem_id, check).

    Seeds whose k-rings share an element form a patch, named by its least seed. The class is `open` if the patch touches an
    open node, `bound` if it touches the rim, `micro` for at most two seeds, else `patch`. Severity is the shortfall of the
    least angle below 30 degrees plus ten for each kind of check; ranks follow it, worst first.
    """
    seeds = stored(detected.groupBy(MESH, "elem_id").agg(F.sort_array(F.collect_set("check")).alias("checks")), "seeds")
    rings = stored(P.k_ring(mesh, seeds, ring), "rings")
    # the least seed at each element stands for all seeds there; keys are hashed as ids repeat between meshes
    key = lambda c: F.xxhash64(MESH, c)
    owners = rings.groupBy(MESH, "elem_id").agg(F.min("seed").alias("owner"))
    links = rings.join(owners, [MESH, "elem_id"]).where("seed <> owner").select(key("seed").alias("a"), key("owner").alias("b")).distinct()
    parts = connected_components(links, "a", "b")
    named = seeds.withColumn("key", key("elem_id")).join(parts, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("component", "key"))
    named = stored(named.withColumn("patch", F.min("elem_id").over(Window.partitionBy(MESH, "root"))).select(MESH, F.col("elem_id").alias("seed"), "checks", "patch"), "named")
    elements = rings.join(named.select(MESH, "seed", "patch"), [MESH, "seed"]).select(MESH, "patch", "elem_id").distinct()
    rim = P.edge_nodes(P.rim_edges(mesh.elements)).withColumn("rim", F.lit(True))
    opened = mesh.open.select(MESH, "node_id").distinct().withColumn("opened", F.lit(True))
    nodes = elements.join(P.corners(mesh.elements), [MESH, "elem_id"]).select(MESH, "patch", "node_id").distinct().join(rim, [MESH, "node_id"], "left").join(opened, [MESH, "node_id"], "left")
    touch = nodes.groupBy(MESH, "patch").agg(F.max("rim").alias("rim"), F.max("opened").alias("opened"))
    shape = elements.join(P.geometry(mesh).select(MESH, "elem_id", "min_angle"), [MESH, "elem_id"]).groupBy(MESH, "patch").agg(F.count(F.lit(1)).alias("n_elements"), F.sort_array(F.collect_list("elem_id")).alias("elements"), F.min("min_angle").alias("worst_min_angle"))
    own = named.groupBy(MESH, "patch").agg(F.count(F.lit(1)).alias("n_seeds"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("checks")))).alias("checks"))
    kind = F.when(F.col("opened"), "open").when(F.col("rim"), "bound").when(F.col("n_seeds") <= 2, "micro").otherwise("patch")
    out = own.join(shape, [MESH, "patch"]).join(touch, [MESH, "patch"]).withColumn("class", kind)
    out = out.withColumn("severity", F.greatest(F.lit(0.0), F.lit(30.0) - F.col("worst_min_angle")) + F.size("checks") * 10)
    order = Window.partitionBy(MESH).orderBy(F.desc("severity"), "patch")
    return out.select(MESH, "patch", "class", "checks", "n_seeds", "n_elements", "elements", "worst_min_angle", "severity", F.row_number().over(order).alias("rank"))
