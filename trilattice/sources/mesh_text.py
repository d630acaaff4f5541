"""The sectioned mesh text format: title, counts, nodes, elements, open and land boundary lists; ids are 1-based in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilattice.model import BOUNDARY, Mesh
from trilattice.operators.repair import ranked
from trilattice.operators.topology import MESH
from trilattice.session import stored


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, line from 0, by the offset of each split and the order within it."""
    lines = spark.read.text(path).select(F.lit("").alias("file"), "value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"))
    return ranked(lines, ["block", "at"], "line", ["file"]).select("line", "value")


def _fields(lines: DataFrame, first: int, n: int) -> DataFrame:
    return lines.where((F.col("line") >= first) & (F.col("line") < first + n)).select("line", F.split(F.trim("value"), r"\s+").alias("f"))


def read_mesh_text(spark: SparkSession, path: str, mesh_id: str = "m") -> Mesh:
    """The mesh of a file. Wrong counts, rows that are no nodes or triangles, and a file that ends early raise ValueError.

    Nodes and elements are read by executors; the header and the boundary lists, which grow with the square root of the
    mesh, are parsed on the driver.
    """
    lines = stored(numbered_lines(spark, path), "lines")
    head = {r.line: r.value for r in lines.where("line < 2").collect()}
    try:
        n_elements, n_nodes = map(int, head[1].split()[:2])
    except (KeyError, ValueError) as e:
        raise ValueError(f"{path}: no line of element and node counts") from e
    nodes = _fields(lines, 2, n_nodes).select(F.lit(mesh_id).alias(MESH), (F.expr("try_cast(f[0] as long)") - 1).alias("node_id"), *(F.expr(f"try_cast(get(f, {i}) as double)").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "depth"))))
    elements = _fields(lines, 2 + n_nodes, n_elements).select(F.lit(mesh_id).alias(MESH), (F.expr("try_cast(f[0] as long)") - 1).alias("elem_id"), *((F.expr(f"try_cast(get(f, {i + 2}) as long)") - 1).alias(f"n{i}") for i in range(3)), (F.get("f", F.lit(1)) == "3").alias("is_triangle"))
    good_nodes = nodes.where("node_id is not null and x is not null and y is not null and depth is not null").count()
    good_elements = elements.where("elem_id is not null and n0 is not null and n1 is not null and n2 is not null and is_triangle").count()
    if good_nodes != n_nodes or good_elements != n_elements:
        raise ValueError(f"{path}: {good_nodes} of {n_nodes} nodes and {good_elements} of {n_elements} triangles can be read")
    rest = iter([r.value for r in lines.where(F.col("line") >= 2 + n_nodes + n_elements).orderBy("line").toLocalIterator()])
    rows: list[tuple] = []
    try:
        for kind in ("open", "land"):
            segments, _ = int(next(rest).split()[0]), int(next(rest).split()[0])
            for s in range(segments):
                first = next(rest).split("=")[0].split()
                ibtype = (int(first[1]) if len(first) > 1 else 0) if kind == "land" else None
                rows += [(mesh_id, kind, s, ibtype, p, int(next(rest).split()[0]) - 1) for p in range(int(first[0]))]
    except (StopIteration, IndexError) as e:
        raise ValueError(f"{path}: the boundary lists end early") from e
    return Mesh(nodes, elements.drop("is_triangle"), spark.createDataFrame(rows, BOUNDARY))


def _section(df: DataFrame, section: int, order, line) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("k"), line.alias("value"))


def mesh_text_lines(mesh: Mesh, title: str = "mesh") -> DataFrame:
    """(section, k, value): the lines of the file in that order, for a mesh with dense ids."""
    spark = mesh.nodes.sparkSession
    n, e = mesh.nodes.count(), mesh.elements.count()
    head = [(0, 0, title), (0, 1, f"{e} {n}")]
    tail: list[tuple] = []
    for section, kind, what in ((3, "open", "open boundaries"), (4, "land", "normal flow boundaries")):
        rows = mesh.boundary.where(F.col("kind") == kind).orderBy("seg_id", "pos").collect()
        segments: dict[int, list] = {}
        for r in rows:
            segments.setdefault(r.seg_id, []).append(r)
        lines = [f"{len(segments)} = Number of {what}", f"{len(rows)} = Total number of {kind} boundary nodes"]
        for i, seg in enumerate(segments.values(), 1):
            lines.append(f"{len(seg)}{'' if kind == 'open' else f' {seg[0].ibtype}'} = Number of nodes for {kind} boundary {i}")
            lines += [str(r.node_id + 1) for r in seg]
        tail += [(section, k, x) for k, x in enumerate(lines)]
    out = spark.createDataFrame(head + tail, "section int, k long, value string")
    out = out.unionByName(_section(mesh.nodes, 1, F.col("node_id"), F.format_string("%10d  %.15f  %.15f  %.10e", F.col("node_id") + 1, "x", "y", "depth")))
    return out.unionByName(_section(mesh.elements, 2, F.col("elem_id"), F.format_string("%10d  3  %10d  %10d  %10d", F.col("elem_id") + 1, F.col("n0") + 1, F.col("n1") + 1, F.col("n2") + 1)))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text parts whose concatenation in order of name is the file."""
    lines.orderBy("section", "k").select("value").write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str) -> str:
    """One file on the driver's own disk, streamed partition by partition."""
    with open(path, "w", encoding="utf-8") as f:
        for r in lines.orderBy("section", "k").select("value").toLocalIterator():
            f.write(f"{r.value}\n")
    return path


def write_mesh_text(mesh: Mesh, path: str, title: str = "mesh") -> str:
    return write_file(mesh_text_lines(mesh, title), path)
