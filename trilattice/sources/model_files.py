"""Input files of the ocean model: connectivity, depth, open boundary, Coriolis and sponge, and the 2dm interchange mesh."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.model import Mesh
from trilattice.operators import detect as D
from trilattice.operators import topology as P
from trilattice.sources.mesh_text import _section, write_file

OPEN_TYPES = range(1, 11)
XY = "%.8f %.8f"


def check_exportable(mesh: Mesh) -> None:
    """Raises ValueError for an element without positive area or a node of no element."""
    flat, loose = P.located(mesh).where(T.signed_area() <= 0).count(), D.orphans(mesh).count()
    if flat or loose:
        raise ValueError(f"{flat} elements do not run counter-clockwise, {loose} nodes belong to no element")


def _lines(mesh: Mesh, rows: list[str]) -> DataFrame:
    return mesh.nodes.sparkSession.createDataFrame([(0, i, v) for i, v in enumerate(rows)], "section int, k long, value string")


def grid_lines(mesh: Mesh) -> DataFrame:
    check_exportable(mesh)
    head = _lines(mesh, [f"Node Number = {mesh.nodes.count()}", f"Cell Number = {mesh.elements.count()}"])
    cells = _section(mesh.elements, 1, F.col("elem_id"), F.format_string("%d %d %d %d", F.col("elem_id") + 1, F.col("n0") + 1, F.col("n1") + 1, F.col("n2") + 1))
    return head.unionByName(cells).unionByName(_section(mesh.nodes, 2, F.col("node_id"), F.format_string(f"%d {XY}", F.col("node_id") + 1, "x", "y")))


def depth_lines(mesh: Mesh) -> DataFrame:
    return _lines(mesh, [f"Node Number = {mesh.nodes.count()}"]).unionByName(_section(mesh.nodes, 1, F.col("node_id"), F.format_string(f"{XY} %.6f", "x", "y", "depth")))


def coriolis_lines(mesh: Mesh, latitude: DataFrame | None = None) -> DataFrame:
    """latitude (node_id, cor), the y of each node if not given; every node needs one."""
    cor = latitude if latitude is not None else mesh.nodes.select("node_id", F.col("y").alias("cor"))
    joined = mesh.nodes.join(cor, "node_id")
    if joined.count() != mesh.nodes.count():
        raise ValueError("the Coriolis column does not match the nodes")
    return _lines(mesh, [f"Node Number = {mesh.nodes.count()}"]).unionByName(_section(joined, 1, F.col("node_id"), F.format_string(f"{XY} %.6f", "x", "y", "cor")))


def open_lines(mesh: Mesh, types: int | list[int] = 1) -> DataFrame:
    """The open nodes in order of segment, each with the type of its segment."""
    rows = mesh.open.orderBy("seg_id", "pos").collect()
    segments = sorted({r.seg_id for r in rows})
    of = dict(zip(segments, [types] * len(segments) if isinstance(types, int) else types))
    if not isinstance(types, int) and len(types) != len(segments):
        raise ValueError(f"{len(types)} types for {len(segments)} open segments")
    if any(t not in OPEN_TYPES for t in of.values()):
        raise ValueError("an open boundary type is outside 1 to 10")
    return _lines(mesh, [f"OBC Node Number = {len(rows)}", *(f"{i} {r.node_id + 1} {of[r.seg_id]}" for i, r in enumerate(rows, 1))])


def sponge_lines(mesh: Mesh, sponge: list[tuple[int, float, float]] = ()) -> DataFrame:
    n = mesh.nodes.count()
    if any(not 0 <= node < n for node, *_ in sponge):
        raise ValueError("a sponge node is out of range")
    return _lines(mesh, [f"Sponge Node Number = {len(sponge)}", *(f"{node + 1} {radius:.4f} {damping:.6f}" for node, radius, damping in sponge)])


def interchange_lines(mesh: Mesh, z: str = "depth") -> DataFrame:
    """The 2dm mesh; nodestrings hold ten ids a line, the last id of a segment negative."""
    if z not in ("depth", "elevation"):
        raise ValueError("z is depth or elevation")
    check_exportable(mesh)
    depth = F.col("depth") if z == "depth" else -F.col("depth")
    cells = _section(mesh.elements, 1, F.col("elem_id"), F.format_string("E3T %d %d %d %d 1", F.col("elem_id") + 1, F.col("n0") + 1, F.col("n1") + 1, F.col("n2") + 1))
    nodes = _section(mesh.nodes, 2, F.col("node_id"), F.format_string(f"ND %d {XY} %.6f", F.col("node_id") + 1, "x", "y", depth))
    last = F.max("pos").over(D.Window.partitionBy("mesh_id", "seg_id"))
    own = mesh.open.withColumn("id", F.when(F.col("pos") == last, -(F.col("node_id") + 1)).otherwise(F.col("node_id") + 1))
    strings = own.groupBy("seg_id", F.floor(F.col("pos") / 10).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    text = F.concat(F.lit("NS "), F.array_join(F.transform("ids", lambda s: s["id"].cast("string")), " "))
    return _lines(mesh, ["MESH2D"]).unionByName(cells).unionByName(nodes).unionByName(_section(strings, 3, F.col("seg_id") * 1_000_000 + F.col("part"), text))


def export_case(mesh: Mesh, folder: str, name: str, types: int | list[int] = 1, coriolis: DataFrame | None = None, sponge: list | None = None, interchange: bool = True, z: str = "depth") -> dict[str, str]:
    """Writes the files of a case and returns their paths by kind."""
    os.makedirs(folder, exist_ok=True)
    made = {"grd": grid_lines(mesh), "dep": depth_lines(mesh), "obc": open_lines(mesh, types)}
    if coriolis is not None:
        made["cor"] = coriolis_lines(mesh, coriolis)
    if sponge is not None:
        made["spg"] = sponge_lines(mesh, sponge)
    if interchange:
        made["2dm"] = interchange_lines(mesh, z)
    return {k: write_file(v, f"{folder}/{name}.2dm" if k == "2dm" else f"{folder}/{name}_{k}.dat") for k, v in made.items()}
