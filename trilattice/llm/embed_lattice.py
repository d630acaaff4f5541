"""Embedding near-duplicates by lattice hashing.

In each of several tables a unit vector is projected at random to eight dimensions and decoded to the nearest point of
the E8 lattice, its home cell. It also visits the next nearest cells. Two vectors meet in a table where one is at home and
the other is at home or visits; every meeting is checked by the exact cosine. A pair that meets more than once is
counted once, at its first table and lesser cell, which both ends can tell from their own vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.llm.common import slices, table
from trilattice.operators.graph import connected_components
from trilattice.session import stored

THRESHOLD, TABLES, PROBES, SCALE, SEED, CHUNK = 0.98, 4, 4, 1.3, 8, 2048


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEAREST = _shortest()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers with an even sum."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return out


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by one half in each coordinate."""
    a, b = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _mixed(points: np.ndarray, start: int) -> np.ndarray:
    """A 64-bit hash of twice the coordinates of lattice points (..., 8)."""
    h = np.full(points.shape[:-1], np.uint64(start) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), np.uint64)
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8):
        h = (h ^ whole[..., k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) hashed cells of unit vectors, the home cell first."""
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for t in range(tables):
        project = np.random.default_rng([seed, t, unit.shape[1]]).standard_normal((unit.shape[1], 8)) / scale
        with np.errstate(over="ignore"):
            at = unit @ project
            home = decode_e8(at)
            # distance to a neighbour v is least where its product with the residual is largest
            gain = (at - home) @ NEAREST.T - (NEAREST**2).sum(axis=1) / 2
            near = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            out[:, t] = _mixed(np.concatenate([home[:, None], home[:, None] + NEAREST[near]], axis=1), t * 4096 + unit.shape[1])
    return out


def _vectors(column: pa.Array, wide: bool) -> list[np.ndarray]:
    kind = "<f8" if wide else "<f4"
    return [np.frombuffer(b, kind).astype(np.float64) for b in column.to_pylist()]


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of length one; the largest entry is divided out first, so that no square overflows or vanishes."""
    x = np.array(vectors)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _labelled(hashes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Cells of different labels never meet."""
    with np.errstate(over="ignore"):
        mark = (labels.view(np.uint64) + np.uint64(7)) * np.uint64(0xC4CEB9FE1A85EC53)
        return (hashes ^ mark.reshape(-1, *[1] * (hashes.ndim - 1))) * np.uint64(0x9E3779B97F4A7C15)


def _meetings(settings: dict, wide: bool):
    """Partitions of (node, label, vec) to a row for each node, table and cell."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            nodes, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            vectors = _vectors(b.column(2), wide)
            sizes = np.array([len(v) for v in vectors], np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                found = _labelled(cells(_unit([vectors[i] for i in own]), **settings), labels[own])
                _, tables, many = found.shape
                each = tables * many
                columns = [np.repeat(nodes[own], each), np.tile(np.repeat(np.arange(tables, dtype=np.int32), many), len(own)), np.tile(np.arange(many) == 0, len(own) * tables), found.reshape(-1).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "tab", "home", "cell"])

    return of


def _first_met(a: np.ndarray, b: np.ndarray, tab: int, cell: np.uint64) -> np.ndarray:
    """Which pairs, given by their cells (pairs, tables, 1 + probes), meet here for the first time."""
    new = np.ones(len(a), bool)
    for t in range(tab + 1):
        at_a = (b[:, t] == a[:, t, :1]).any(axis=1)
        at_b = (a[:, t] == b[:, t, :1]).any(axis=1)
        if t < tab:
            new &= ~(at_a | at_b)
        else:
            both = at_a & at_b & (a[:, t, 0] != b[:, t, 0])
            new &= ~both | (np.minimum(a[:, t, 0], b[:, t, 0]) == cell)
    return new


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n points over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _compare(rows: list[tuple], threshold: float, settings: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, weighted links first met here, and a linked node as root, of one block.

    rows: (tab, cell, first, second, chunk, home, node, label, n, vector); chunks `first` and `second` are compared with
    each other, or one with itself. Of two visitors nothing is said here.
    """
    tab, cell, first, second = rows[0][:4]
    chunk, home = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    node, n = np.array([r[6] for r in rows], np.int64), np.array([r[8] for r in rows], np.float64)
    unit = _unit([r[9] for r in rows])
    found = _labelled(cells(unit, **settings), np.array([r[7] for r in rows], np.int64))
    links, ends = np.zeros(len(rows)), []
    left, right = (np.flatnonzero(chunk == first), np.flatnonzero(chunk == second)) if first != second else (np.arange(len(rows)),) * 2
    for k in range(0, len(left), 256):
        own = left[k : k + 256]
        i, j = np.nonzero(unit[own] @ unit[right].T >= threshold)
        i, j = own[i], right[j]
        ok = home[i] | home[j]
        if first == second:
            ok &= i < j
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            new = _first_met(found[a], found[b], tab, np.int64(cell).view(np.uint64))
            links += np.bincount(a[new], n[b[new]], len(rows)) + np.bincount(b[new], n[a[new]], len(rows))
        if len(i):
            root = _components(len(rows), i, j)
            moved = np.flatnonzero(root != np.arange(len(rows)))
            ends.append((moved, root[moved]))
    root = np.arange(len(rows))
    if ends:
        root = _components(len(rows), *(np.concatenate(x) for x in zip(*ends)))
    return node, links, node[root]


def _blocks(threshold: float, settings: dict, wide: bool):
    """Partitions sorted by block to (node, links, root)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def close() -> None:
            if len(rows) > 1:
                node, links, root = _compare(rows, threshold, settings)
                some = (links > 0) | (node != root)
                out.append((node[some], links[some].astype(np.int64), root[some]))
            rows.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "links", "root"])
            out.clear()
            return made

        for b in slices(batches, 1024):
            columns = [b.column(k).to_pylist() for k in range(b.num_columns - 1)] + [_vectors(b.column(b.num_columns - 1), wide)]
            for row in zip(*columns):
                # vectors of one length only: cells of others differ, but for a chance collision of hashes
                key = (*row[:4], len(row[-1]), row[7])
                if key != now:
                    close()
                    now = key
                rows.append(row)
            if sum(len(x[0]) for x in out) > 20_000:
                yield flush()
        close()
        if out:
            yield flush()

    return of


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED, chunk: int = CHUNK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Equal vectors of a label are one node with their number as its weight, so that copies never meet one by one. A cell
    of more than `chunk` nodes is cut into chunks, and each pair of chunks is a task's block of its own: all of
    its links are counted, none is a row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those of a null label, link with
    nothing. Vectors of unlike length never link. component_id is the smallest non-null vec_id of the component;
    kept is false for a null vec_id. Repeated rows link with each other and each give a row. Other columns play no
    part; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    settings = {"tables": tables, "probes": probes, "scale": scale, "seed": seed}
    wide = "double" in vectors.schema[vector].dataType.simpleString()
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = rows.where("sound")
    nodes = stored(good.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            kind = "<f8" if wide else "<f4"
            vec = [np.array(x, kind).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(vec, pa.binary())], ["node", "label", "n", "vec"])

    slim = stored(nodes.select("node", F.xxhash64("label").alias("label"), "n", "vector").mapInArrow(packed, "node long, label long, n long, vec binary"), "lattice-slim")
    meets = stored(slim.select("node", "label", "vec").mapInArrow(_meetings(settings, wide), "node long, tab int, home boolean, cell long"), "lattice-meets")
    crowd = meets.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("many"), F.max("home").alias("lived")).where("many > 1 and lived").select("tab", "cell", F.ceil(F.col("many") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = (
        meets.join(crowd, ["tab", "cell"])
        .withColumn("chunk", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("tab", "cell", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "chunk", "home", "node")
    )
    given = spread.join(slim, "node").select("tab", "cell", "first", "second", "chunk", "home", "node", "label", "n", "vec")
    block = ["tab", "cell", "first", "second"]
    found = stored(given.repartition(*block).sortWithinPartitions(*block, "label", F.length("vec")).mapInArrow(_blocks(threshold, settings, wide), "node long, links long, root long"), "lattice-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "root"), "node", "root").withColumnRenamed("component", "root")
    placed = stored(nodes.join(links, "node", "left").join(parts, "node", "left").select("node", "label", "vector", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "lattice-placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("label", "vector", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embedding_lattice(spark, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every vector of the table."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
