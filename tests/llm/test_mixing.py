import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from trilattice.llm import mixing


def plain_targets(sizes, cap=3):
    """Repeated resharing, as the rule reads."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in open_)
        got = {s: left * weight[s] / share for s in open_}
        above = [s for s in open_ if got[s] > cap * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in above}


CASES = [{"a": 100, "b": 10, "c": 900, None: 55}, {"a": 0, "b": 5, "é": 5}, {None: 7}, {"a": 1, "b": 1, "c": 1000, "d": 3, "z": 2}]


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s].target - want[s]) < 1e-6 for s in sizes)
    assert max(r.to for r in got.values()) == 1 << 32


@pytest.mark.parametrize("sequence", ["golden", "corput"])
def test_reads_equal_a_walk_through_the_schedule(spark, sequence):
    rows = [(i if i % 7 else None, " ".join("w" * (i % 13)), ["a", "b", None, "c"][i % 4 if i % 3 else 0], 1) for i in range(120)] + [(1, "x y", "b", 1)] * 2 + [(3, None, "a", 1), (500, "one", "tiny", 1), (501, "w " * 3000, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    block = 16
    got = mixing.mix(docs, block=block, sequence=sequence)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot"]
    got = got.collect()
    assert len(got) == len(rows) and all(m.taken <= 3 * m["size"] for m in got)
    sizes = {}
    for m in got:
        sizes[m.source] = sizes.get(m.source, 0) + m["size"]
    total, wanted = sum(sizes.values()), plain_targets(sizes)
    plan = mixing.allotted(mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")), block)
    number = {r.key: r.source for r in plan.collect()}
    order = sorted(mixing.schedule(plan, total, block, sequence).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in order}) == len(order)
    # words read of each position of a source, slot by slot, and the slot that reads it first
    times, first, seen = {s: [0] * n for s, n in sizes.items()}, {s: {} for s in sizes}, dict.fromkeys(sizes, 0)
    for r in order:
        s = number[r.key]
        assert r.rank == seen[s]
        seen[s] += 1
        for w in range(r.block * block, min(sizes[s], (r.block + 1) * block, r.upto)):
            times[s][w] += 1
            first[s].setdefault(w, r.slot)
    md5 = lambda i: hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
    for s in sizes:
        assert sum(times[s]) == int(wanted[s] + 1e-6) and abs(sum(m.taken for m in got if m.source == s) - wanted[s]) < 1
        at, want = 0, []
        for i, n in sorted(((r[0], len((r[1] or "").split())) for r in rows if r[2] == s), key=lambda x: (md5(x[0]), x[1])):
            want.append((str(i), n, sum(times[s][at : at + n]), min((first[s][w] for w in range(at, at + n) if w in first[s]), default=None)))
            at += n
        key = lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3])
        assert sorted(want, key=key) == sorted(((str(m.doc_id), m["size"], m.taken, m.first_slot) for m in got if m.source == s), key=key)
    copies = mixing.mixed_documents(docs, block=block, sequence=sequence)
    assert copies.columns == docs.columns and copies.where("text is null").isEmpty()
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.mixed_documents(docs.where("text is null")).collect() == []


def test_points_and_small_sources(spark):
    i = [0, 1, 7, (1 << 31) + 5, (1 << 32) + 3, (1 << 40) + 9]
    got = spark.createDataFrame([(x,) for x in i], "i long").select(mixing.point(F.col("i")).alias("p"))
    assert [r.p for r in got.collect()] == [x * mixing.GOLDEN % mixing.MODULUS for x in i]
    docs = spark.createDataFrame([(1, "w " * 40_000, "big"), (2, "one two three", "small")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == [(1, 39_994), (2, 9)]


def test_clashing_columns(spark):
    odd = ["__mix", "__size", "__key", "__copy", "a.b", "row", "times", "of", "size", "key", "k`x"]
    docs = spark.createDataFrame([(i, "w " * (i + 1), "s" if i else None, *[f"{i}-{c}" for c in odd]) for i in range(6)], ["doc_id", "text", "source", *odd])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and not out.isEmpty()


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = [c[0] for c in duck.sql(mixing.ORACLE).description]
    want = sorted(duck.sql(mixing.ORACLE).fetchall(), key=str)
    got = mixing.op5_mixing(spark, sf)
    assert got.columns == names and sorted((tuple(r) for r in got.collect()), key=str) == want
    by = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
    assert all(abs(r.t - r.w) < 1 for r in by)
