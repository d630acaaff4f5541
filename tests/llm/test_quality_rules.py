import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from trilattice.llm import quality_rules as Q
from trilattice.llm.common import training_rows

TEXTS = ["", None, "a", "One two two THREE!! #$% 12\nx | y\nx | y", "É é é|  \n\n", "w " * 300, "no end\\ [b]_` ^"]


def plain(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, n, size = t.split("\n"), max(1, len(words)), max(1, len(t))
    count = lambda f: sum(map(f, t))
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, count(str.isupper) / size, count(lambda c: c in "#$%&*+<=>@[]^_`{}~\\") / size,
        count(lambda c: c in "!?") / n, t.count("|") / n, count(lambda c: c in "0123456789") / size, count(str.isalpha) / size, count(lambda c: c in ".:;") / n, math.log1p(len(lines) if t else 0), 1 - len(set(lines)) / len(lines),
    ]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = Q.with_statistics(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert np.allclose([r[f"__q_{s}"] for s in Q.STATISTICS], plain(TEXTS[r.doc_id])), (r, plain(TEXTS[r.doc_id]))


def test_rules_find_two_kinds():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(Q.STATISTICS)))
    y = 1 - ((x[:, 5] > 0.9) | ((x[:, 2] < 0.2) & (x[:, 0] > 0.5))).astype(int)
    e = Q.fit(x[:2000], y[:2000])
    assert 0 < len(e.rules) < 200 and ((e.scores(x[2000:]) >= 0.3) == y[2000:]).mean() > 0.97
    assert Q.fit(x[:0], y[:0]).rules == [] and Q.fit(x[:9], np.ones(9, int)).scores(x[:1])[0] > 0.9


def test_query_and_its_folds(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op10_quality_rules(spark, sf).collect()
    labels = {k: v for k, v in zip(*pq.read_table(f"{sf}/labels.parquet").select(["doc_id", "quality"]).to_pydict().values())}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    wrong = [r for r in rows if r.held_out and r.doc_id in labels and r.predicted != labels[r.doc_id]]
    assert len(wrong) <= 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("labelled", [True, False])
def test_rows(spark, labelled):
    docs = spark.createDataFrame([(i, "w%d fine words. " % i * (i + 1), 1.0) for i in range(40)] + [(None, None, 2.0), (3, "", 2.0), (3, "", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i > 9), 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").where("true" if labelled else "false")
    e = Q.fit_on(docs, labels)
    got = Q.scored(docs, e)
    assert got.count() == 43 and got.where("score is null").isEmpty()
    kept = Q.without_low_quality(docs, e)
    assert kept.columns == docs.columns and kept.count() == got.where("score >= 0.3").count()
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
    assert Q.scored(docs.where("false"), e).collect() == []


def test_scores_equal_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    e = Q.fit_on(docs, labels)
    rows = docs.select("doc_id", "text").collect() + [(None, t) for t in TEXTS]
    got = Q.scored(spark.createDataFrame(rows, "doc_id long, text string"), e).collect()
    want = []
    for _, text in rows:
        x = dict(zip(Q.STATISTICS, plain(text)))
        z = e.bias + sum(w for rule, w in e.rules if all(x[n] <= bound if at_most else x[n] > bound for n, at_most, bound in rule))
        want.append(1 / (1 + math.exp(-z)))
    assert np.allclose(sorted(r.score for r in got), sorted(want)) and np.allclose(e.scores(np.array([plain(t) for _, t in rows])), want)


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('good words here. ', int(id)) AS text").unionByName(spark.range(3000).selectExpr("cast(7 AS long) AS doc_id", "concat('again ', id) AS text"))
    labels = spark.range(60).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    rows = training_rows(docs, labels, "quality", Q.FOLDS, Q.HELD_OUT, 20).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 20
    assert training_rows(docs, labels, "quality", Q.FOLDS, Q.HELD_OUT, 1000).where("doc_id = 7").count() == (zlib.crc32(b"7") % 5 != 0)
