"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through sharded BK-trees.

Fingerprints within `radius` bits agree on at least `blocks - radius` of `blocks` bit blocks, so each pair of
them shares a shard keyed by some choice of that many blocks. A shard is one BK-tree: children hang at their
integer distance to the parent, and a probe follows only edges within the radius. Trees travel to tasks by the
shuffle rather than by a driver broadcast, which would gather the fingerprints of all documents in one process.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trilattice.llm.common import byte_texts, quoted, slices, table, word_blocks
from trilattice.operators.graph import connected_components
from trilattice.session import discard, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RADIUS, SHINGLE, SEED, BLOCKS, SHARD_ROWS = 4, 4, 42, 6, 20_000


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is set if set in over half the shingle hashes.

    No words: zero. Fewer words than a shingle: the one hash of them all.
    """
    hash64 = xxhash.xxh64_intdigest
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.translate(LOWER)):
        words = carry + words
        if len(words) >= shingle:
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-1].tolist()]
            hashes = [hash64(text[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
            counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(hashes)
            carry = words[-(shingle - 1) :] if shingle > 1 else []
        else:
            carry = words
    if not total and carry:
        return hash64(b" ".join(carry), seed)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long. A null text is an empty one."""
    schema = docs.select(key).schema.add("fp", "long", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(of, schema)


class BKTree:
    """A Burkhard-Keller tree of distinct codes that forgets what was found.

    `live` counts the unfound codes below a node, so that a probe skips exhausted subtrees: a tight cluster of n
    codes costs about n steps, not n squared, when its members are found one from another.
    """

    def __init__(self, codes: list[int]):
        self.codes, self.up, self.live = codes, [-1] * len(codes), [1] * len(codes)
        self.found = [False] * len(codes)
        self.children: list[dict[int, int]] = [{} for _ in codes]
        for i in range(1, len(codes)):
            at, code = 0, codes[i]
            while True:
                self.live[at] += 1
                d = (codes[at] ^ code).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d], self.up[i] = i, at
                    break
                at = below

    def take(self, i: int) -> None:
        self.found[i] = True
        while i >= 0:
            self.live[i] -= 1
            i = self.up[i]

    def probe(self, code: int, radius: int) -> list[int]:
        """Unfound codes within the radius."""
        out, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.live[at]:
                continue
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius and not self.found[at]:
                out.append(at)
            stack += [c for x, c in self.children[at].items() if d - radius <= x <= d + radius]
        return out

    def links(self, radius: int) -> list[tuple[int, int]]:
        """A spanning star of each component of the codes: (member, first member)."""
        out = []
        for seed in range(len(self.codes)):
            if self.found[seed]:
                continue
            self.take(seed)
            queue = [seed]
            while queue:
                for i in self.probe(self.codes[queue.pop()], radius):
                    self.take(i)
                    queue.append(i)
                    out.append((self.codes[i], self.codes[seed]))
        return out


def _block_spans(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _shard_keys(fp: str, radius: int, blocks: int):
    """An array of one shard key for each choice of blocks that a linked pair may agree on."""
    spans, keys = _block_spans(blocks), []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for i in chosen:
            at, width = spans[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def _signed(codes: list[int]) -> pa.Array:
    return pa.array([x if x < 1 << 63 else x - (1 << 64) for x in codes], pa.int64())


def _tree_links(radius: int):
    """Partitions of (shard, fp) sorted by shard to links (a, b): one tree for each shard."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def close(held: list[int]) -> None:
            if len(held) > 1:
                out.extend(BKTree(held).links(radius))

        def flush() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            keys, codes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    close(held)
                    key, held = int(keys[a]), []
                held += codes[a:b].view(np.uint64).tolist()
            if len(out) > 50_000:
                yield flush()
        close(held)
        if out:
            yield flush()

    return of


def sharded_links(spread: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(a, b): links that connect the distinct rows (shard, fp) of spread as all pairs of a shard within the radius would.

    Shards are counted first, with partial sums. One beyond `shard_rows` codes is dealt into chunks by a hash of the code
    before any tree is built, and each pair of its chunks is a tree and a task's group of its own, so that no task streams
    or holds more than two chunks however many codes agree on a shard.
    """
    sizes = spread.groupBy("shard").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > shard_rows)
    crowded = stored(sizes.select("shard", F.ceil(F.col("many") / shard_rows).cast("int").alias("chunks")), "simhash-crowded")
    groups = spread.select("shard", "fp")
    if not crowded.isEmpty():
        mine = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
        dealt = spread.join(crowded, "shard").withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> other")
        cells = dealt.select(F.xxhash64("shard", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("shard"), "fp")
        groups = groups.join(crowded, "shard", "left_anti").select("shard", "fp").unionByName(cells)
    return groups.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_tree_links(radius), "a long, b long")


def fingerprint_links(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct codes `fp` exactly as all pairs within the radius would."""
    return sharded_links(codes.select("fp", F.explode(_shard_keys("fp", radius, blocks)).alias("shard")), radius, shard_rows)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    Equal fingerprints are one node of the graph, whatever their number. component_id is the smallest non-null
    doc_id of the component, null if all are null. Null and empty texts have fingerprint zero and link like
    any other; repeated rows give repeated rows; other columns of docs play no part; an empty table gives an
    empty one.
    """
    prints = stored(fingerprints(docs, text, key, shingle, seed), "simhash-fp")
    nodes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius, blocks, shard_rows), "a", "b")
    marked = stored(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    discard(nodes)
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = marked.join(ids, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(data: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the word shingles of a text in lower case; fewer words than a shingle are one."""
    hash64 = xxhash.xxh64_intdigest
    found, carry, many = [], [], False
    for words in word_blocks(data.translate(LOWER)):
        words = carry + words
        if len(words) >= shingle:
            many = True
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-1].tolist()]
            found.append(np.unique(np.array([hash64(text[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)))
            carry = words[-(shingle - 1) :] if shingle > 1 else []
        else:
            carry = words
    if not many:
        return np.array([hash64(b" ".join(carry), seed)] if carry else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _shards_of(hashes: np.ndarray, bands: int, width: int) -> list[int]:
    """A signed key for each band of `width` least shingle hashes; none for a text without words."""
    if not len(hashes):
        return []
    factors = _multipliers(bands * width)[:, None]
    least = np.full(bands * width, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[None, at : at + 4096] * factors).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(bands, width))]


def _set_code(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _set_mark(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning star (member, first member) of each component of sets of Jaccard similarity at or above the bound.

    The common shingles of one set with all sets not yet reached are counted in one pass over their numbers.
    """
    size = np.array([len(x) for x in sets])
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(inverse, np.cumsum(size)[:-1])
    mine = np.zeros(len(ids), bool)
    live = np.arange(len(sets))
    flat, starts = inverse, np.concatenate([[0], np.cumsum(size)[:-1]])
    out = []
    while len(live) > 1:
        seed, queue = live[0], [live[0]]
        reached = np.zeros(len(sets), bool)
        reached[seed] = True
        while queue:
            keep = ~reached[live]
            live = live[keep]
            if not len(live):
                break
            if not keep.all():
                flat = np.concatenate([own[i] for i in live])
                starts = np.concatenate([[0], np.cumsum(size[live])[:-1]])
            now = queue.pop()
            mine[own[now]] = True
            common = np.add.reduceat(mine[flat], starts, dtype=np.int64)
            mine[own[now]] = False
            hits = live[common >= similarity * (size[now] + size[live] - common)]
            reached[hits] = True
            queue += hits.tolist()
            out += [(int(i), int(seed)) for i in hits]
    return out


def _compared(similarity: float):
    """Partitions of (cell, node, set) sorted by cell and node to verified links (a, b)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, out = None, [], [], []

        def close() -> None:
            if len(nodes) > 1:
                out.extend((nodes[i], nodes[j]) for i, j in _similar(sets, similarity))
            nodes.clear()
            sets.clear()

        def flush() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, 64):
            for cell, node, data in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    close()
                    now = cell
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(data, np.uint64))
            if len(out) > 50_000:
                yield flush()
        close()
        if out:
            yield flush()

    return of


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24, bands: int = 16, width: int = 4, shard_rows: int = SHARD_ROWS, chunk_bytes: int = 8 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, component_id), one row per row of docs: texts linked whose sets of word shingles have a Jaccard similarity at or above the bound.

    Texts of one set are one node. Candidates are SimHash fingerprints of the sets within `radius` bits, found by BK-trees;
    as so wide a radius leaves no block of bits that a pair must share, a tree's shard is a band of least shingle
    hashes. A pair at similarity 0.8 shares no band with probability 2e-4. Only connected candidates travel with their
    sets: each group of them is compared exactly, a group beyond `chunk_bytes` of sets in chunks and pairs of chunks,
    each a task's group of its own.

    Texts without words are equal. component_id is the smallest non-null doc_id of the component, null if all are null.
    Null texts are empty; repeated rows give repeated rows; other columns play no part; an empty table gives an empty one.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = given.select("doc_id").schema.add("mark", "binary", False).add("fp", "long", False).add("bytes", "long", False).add("shards", T.ArrayType(T.LongType(), False), False)

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in byte_texts(b.column(1))]
            columns = [pa.array([_set_mark(x) for x in sets], pa.binary()), _signed([_set_code(x) for x in sets]), pa.array([x.nbytes for x in sets], pa.int64()), pa.array([_shards_of(x, bands, width) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema.names)

    prints = stored(given.mapInArrow(prints_of, schema), "similar-prints")
    grouped = prints.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bytes").alias("bytes"), F.first("shards").alias("shards"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    spread = nodes.select("fp", F.explode("shards").alias("shard")).distinct()
    parts = connected_components(sharded_links(spread, radius, shard_rows), "a", "b")
    placed = nodes.join(parts, nodes.fp == parts.node, "left").select("mark", "least", nodes.node, "bytes", F.coalesce("component", "fp").alias("part"))
    placed = stored(placed, "similar-placed")
    crowds = placed.groupBy("part").agg(F.count(F.lit(1)).alias("many"), F.sum("bytes").alias("all")).where("many > 1").select("part", F.ceil(F.col("all") / chunk_bytes).cast("int").alias("chunks"))
    chosen = placed.join(crowds, "part").select("mark", "least", "node", "part", "chunks").hint("shuffle_hash")
    sets_schema = "node long, part long, chunks int, set binary"

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, shingle) for t in byte_texts(b.column(0))]
            # another text of a repeated id is another node's
            same = pa.array([_set_mark(x) == m for x, m in zip(sets, b.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (2, 3, 4)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "part", "chunks", "set"]).filter(same)

    sets = given.join(chosen, F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "mark", "node", "part", "chunks").mapInArrow(sets_of, sets_schema)
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = sets.withColumn("chunk", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> other or chunks = 1")
    cells = dealt.select(F.xxhash64("part", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), "node", "set")
    links = stored(cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_compared(similarity), "a long, b long"), "similar-links")
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "of")
    rooted = stored(placed.join(joined, placed.node == joined["of"], "left").select("mark", "least", F.coalesce("component", placed.node).alias("root")), "similar-roots")
    for done in (nodes, placed, links):
        discard(done)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "mark").join(rooted.join(ids, "root").select("mark", "component_id"), "mark").select(F.col("doc_id").alias(key), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the component_id that (doc_id, component_id) gives it, all columns as they are, whatever their names.

    Of rows that repeat that doc_id one stays. Rows of a component without any non-null doc_id all stay, as
    nothing tells them apart.
    """
    # the kept ids grow with the corpus, so they are never broadcast; their side of each partition is hashed, and no text is sorted
    kept = stored(found.where("doc_id = component_id or component_id is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).select(F.struct("doc_id").alias("kept"), "times"), "simhash-kept")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.struct(F.col(key).alias("doc_id")).alias("mine"))
    once = rows.join(kept.hint("shuffle_hash"), F.col("mine.doc_id").eqNullSafe(F.col("kept.doc_id")), "left_semi")
    if not kept.where("times > 1 and kept.doc_id is not null").isEmpty():
        once = once.where("mine.doc_id is not null").dropDuplicates(["mine"]).unionByName(once.where("mine.doc_id is null"))
    return once.select("row.*")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs without linked fingerprints: of each component of :func:`near_duplicates` one, by the rules of :func:`one_of_each`."""
    return one_of_each(docs, near_duplicates(docs, **settings))


def keep_distinct(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs without near copies: of each component of :func:`similar_texts` one, by the rules of :func:`one_of_each`."""
    return one_of_each(docs, similar_texts(docs, **settings))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint, component and id of every document of the table."""
    return near_duplicates(table(spark, sf_dir, "documents"))
