"""Graph operators: connected components by local contraction and alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trilattice.session import discard, stored

#: Edges that a task contracts at a time.
STRETCH = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch of edges (u, v) as one star for each of its components: (member, least member)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate(c) for c in zip(*held))
        names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = ends[: len(u)], ends[len(u) :]
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, root[a], low)
            np.minimum.at(after, root[b], low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["u", "v"])

    for b in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
        size += b.num_rows
        if size >= STRETCH:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum of hashes observed while writing it."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
    return out, (seen.get["n"], seen.get["h"])


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v.

    Minima come from partial aggregates and plain equi-joins, so that a hub with a third of all edges
    is never gathered in a list, and AQE may split its side of the join.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the least node reachable.

    Null ends and self-loops name no link and are ignored; repeated and reversed edges count once. An empty
    edge table gives an empty result. Rounds are logarithmic in the longest chain; each is a table in the
    shared folder, of which only the last stays.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    given = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # what a task sees is contracted before anything is shuffled, so that rounds are left for links between tasks alone
    now, seen = _kept(given.mapInArrow(_contracted, "u long, v long"))
    if seen[0]:
        for _ in range(max_rounds):
            after, mark = _kept(_star_round(now))
            discard(now)
            now = after
            if mark == seen:
                break
            seen = mark
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
