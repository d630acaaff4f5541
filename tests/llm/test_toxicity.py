import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from trilattice.llm import toxicity as T

CHAIN = T.Chain({"bad": 3.0, "wor*": None} | {"worst": 2.0, "wors*": 1.5, "fine": -1.0}, -2.0, (0.3, -0.4), ((0.5, -0.7), (-0.2, 0.9)), (-3.0, 1.0, 0.5))
CHAIN.features.pop("wor*")


def brute(tokens):
    """Marginals of state 1 over all paths."""
    scorer, n = CHAIN.prepare(), len(tokens)
    total, ones = 0.0, [0.0] * n
    for path in range(1 << n):
        y = [path >> i & 1 for i in range(n)]
        z = CHAIN.start[y[0]] + sum(CHAIN.move[a][b] for a, b in zip(y, y[1:]))
        z += sum(CHAIN.bias + (scorer.weight(t) or 0.0) for t, s in zip(tokens, y) if s)
        total += math.exp(z)
        for i in range(n):
            ones[i] += y[i] * math.exp(z)
    return [x / total for x in ones]


def test_marginals_equal_all_paths():
    rng = random.Random(1)
    for _ in range(60):
        tokens = [rng.choice(["bad", "worst", "worse", "fine", "a", "b", "c"]) for _ in range(rng.randrange(1, 11))]
        want = brute(tokens)
        hits, got = CHAIN.prepare().marginals(tokens)
        assert hits == [i for i, t in enumerate(tokens) if len(t) > 1]
        assert np.allclose(got, [want[i] for i in hits])


def test_spans_and_long_or_empty_texts():
    s = CHAIN.prepare()
    text = "É so BAD bad, worst. " + "ok " * 50 + "bad"
    assert [text[a:b] for a, b, _ in s.spans(text, 0.3)] == ["BAD bad, worst", "bad"]
    assert s.spans("") == [] and 0 < s.score("") < s.score("bad bad") < 1
    assert s.score("x " * 400_000 + "bad bad worst") > 2 * s.score("x")


def texts(n, rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(["zonk", "Yuckyish", "yuckyest,"]))
        yield " ".join(own), int(toxic)


def test_learns_offences_and_their_beginnings():
    rng = random.Random(2)
    chain = T.fit(list(texts(600, rng)))
    s = chain.prepare()
    assert "zonk" in chain.features and any(f.startswith("yuck") for f in chain.features)
    held = list(texts(300, rng))
    assert sum((s.score(t) >= 0.7) != y for t, y in held) <= 3
    assert s.score("a b yuckyous c") > s.score("a b c")
    assert T.fit([]).features == {} and T.fit([("a", 0)]).prepare().score("b") < 0.5


def test_query_and_its_folds(spark):
    sf = "/root/testdata/sf0.01"
    rows = T.op3_toxicity(spark, sf).collect()
    labels = {k: v for k, v in zip(*pq.read_table(f"{sf}/labels.parquet").select(["doc_id", "toxic"]).to_pydict().values())}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    wrong = [r for r in rows if r.held_out and r.doc_id in labels and r.predicted != labels[r.doc_id]]
    assert len(wrong) <= 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("labelled", [True, False])
def test_rows(spark, labelled):
    docs = spark.createDataFrame([(i, t, 1.5) for i, (t, _) in enumerate(texts(60, random.Random(3)))] + [(None, "zonk", 0.0), (7, None, 0.0), (7, None, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(60, random.Random(3)))] + [(None, 1), (3, None)], "doc_id long, toxic int").where("true" if labelled else "false")
    chain = T.fit_on(docs, labels)
    assert T.scored(docs, chain).count() == 63
    assert T.without_toxic(docs, chain).columns == docs.columns
    assert T.scored(docs.where("false"), chain).collect() == [] and T.offending_spans(docs, chain).columns == ["doc_id", "start", "end", "probability"]


def sample_of(spark, rows, labels, most, most_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return T.training_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", T.FOLDS, T.HELD_OUT, most, most_bytes)


def test_long_texts_and_repeated_ids_leave_the_rest_of_the_sample(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % T.FOLDS != T.HELD_OUT]
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    labels, text = [(i, i % 2) for i in ids], lambda i: f"text {i:02}"
    long = [(i, "x " * 4000 if i == order[0] else text(i)) for i in ids]
    assert sample_of(spark, long, labels, 1000, 6400) == [(text(i), i % 2) for i in ids if i != order[0]]
    repeated = [(i, text(i)) for i in ids] + [(order[0], text(order[0])), (order[0], "t")] * 40
    assert sample_of(spark, repeated, labels, 10, 6400) == [(text(i), i % 2) for i in sorted(order[:10])]


def test_one_class_is_said():
    with pytest.warns(UserWarning, match="no two classes"):
        assert T.fit([("a", 0)]).features == {}


def test_document_scores_equal_all_paths(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["bad", "Worst,", "worse", "fine!", "a", "b"]) for _ in range(rng.randrange(0, 10)))) for i in range(40)] + [(90, None), (91, "")]
    got = {r.doc_id: r.score for r in T.scored(spark.createDataFrame(rows, "doc_id long, text string"), CHAIN).collect()}
    for i, text in rows:
        tokens = [t.lower() for t in T.TOKEN.findall(text or "")]
        p = [x for t, x in zip(tokens, brute(tokens)) if len(t) > 1] if tokens else []
        top = min(max([*p, 0.0, 1e-4]), 1 - 1e-4)
        z = CHAIN.curve[0] + CHAIN.curve[1] * math.log(top / (1 - top)) + CHAIN.curve[2] * math.log1p(sum(p))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_fitted_weights_are_the_most_likely():
    windows = {(4, ((0, (0,), 1), (2, (1,), 0))): 5, (3, ((1, (0, 1), 1),)): 3, (4, ()): 6, (2, ((0, (1,), 0),)): 4, (3, ((0, (0,), 0),)): 1}
    ridge = 0.5
    chain = T.fit_chain(windows, ["x", "y"], rounds=4000, rate=0.05, ridge=ridge)

    def likelihood(theta):
        w, bias, start, move = theta[:2], theta[2], theta[3:5], theta[5:].reshape(2, 2)
        out = -ridge / 2 * (theta**2).sum()
        for (n, marks), count in windows.items():
            def value(y):
                own = sum(bias + sum(w[f] for p, fs, _ in marks if p == i for f in fs) for i in range(n) if y[i])
                return start[y[0]] + sum(move[a][b] for a, b in zip(y, y[1:])) + own

            gold = [0] * n
            for p, _, label in marks:
                gold[p] = label
            out += count * (value(gold) - math.log(sum(math.exp(value([k >> i & 1 for i in range(n)])) for k in range(1 << n))))
        return out

    theta = np.array([chain.features["x"], chain.features["y"], chain.bias, *chain.start, *chain.move[0], *chain.move[1]])
    best = likelihood(theta)
    for i in range(len(theta)):
        for step in (0.05, -0.05):
            moved = theta.copy()
            moved[i] += step
            assert likelihood(moved) < best
