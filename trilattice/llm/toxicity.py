"""Toxicity by a linear-chain conditional random field over tokens.

Only documents are labelled, so token labels are derived first: a word or word beginning is an offence if it stands
in toxic documents after many different words and hardly in others. Counting different predecessors rather than
occurrences keeps the words of one much-copied document out. The tokens of toxic documents that carry an offence are
labelled 1, all others 0, and a two-state chain is fitted to them. Forward-backward marginals of a text give its offending
offsets, and a logistic curve over their maximum and sum gives the score of the document.

All that is learnt comes from a bounded sample of labelled training rows; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilattice.llm.common import fold, mapped, slices, table, training_rows

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Bounds of the labelled sample and of the model: documents, their UTF-8 bytes, features.
SAMPLE_DOCS, SAMPLE_BYTES, MAX_FEATURES = 6_000, 48 << 20, 5_000
PREFIXES, LEAST_CONTEXTS, LEAST_ODDS, LEAST_G, WINDOW = (4, 5, 6), 3, 2.5, 25.0, 64
TOKEN = re.compile(r"[^\W\d_]+")
MEMO = 200_000


def features_of(token: str) -> list[str]:
    """A token in lower case and its beginnings, the latter marked by a star."""
    return [token, *(f"{token[:n]}*" for n in PREFIXES if len(token) > n)]


@dataclass
class Chain:
    """Weights of the chain and of the document score; `features` maps a feature to its weight for state 1."""

    features: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: tuple[float, float] = (0.0, 0.0)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def prepare(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Exact forward-backward over the tokens that carry a feature.

    All other tokens have the same two potentials, so that a run of k of them is the k-th power of one 2x2 matrix, taken
    by its eigenvalues.
    """

    def __init__(self, chain: Chain):
        self.chain, self.memo, self.older = chain, {}, {}
        move = np.exp(np.array(chain.move))
        plain = move * np.array([1.0, math.exp(chain.bias)])
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        self.ratio = float(values[1] / values[0])
        back = np.linalg.inv(vectors)
        self.lead, self.rest = np.outer(vectors[:, 0], back[0]).tolist(), np.outer(vectors[:, 1], back[1]).tolist()
        self.move = move.tolist()

    def weight(self, token: str) -> float | None:
        """Summed weights of a token in lower case, None without any feature."""
        found = [w for f in features_of(token) if (w := self.chain.features.get(f)) is not None]
        return sum(found) if found else None

    def power(self, k: int) -> tuple[float, float, float, float]:
        """k steps over plain tokens, but for a factor."""
        r = self.ratio**k
        (a, b), (c, d) = self.lead
        (e, f), (g, h) = self.rest
        return a + r * e, b + r * f, c + r * g, d + r * h

    def marked(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        """Indices of tokens with a feature, and their weights."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        for t in set(tokens):
            if t not in memo:
                memo[t] = older[t] if t in older else self.weight(t)
        hits = [i for i, t in enumerate(tokens) if memo[t] is not None]
        return hits, [memo[tokens[i]] for i in hits]

    def marginals(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        """Indices of tokens with a feature, and the probability of state 1 at each."""
        hits, weights = self.marked(tokens)
        if not hits:
            return [], []
        (m00, m01), (m10, m11) = self.move
        bias = self.chain.bias
        odds = [math.exp(min(bias + w, 50.0)) for w in weights]
        forward = []
        x, y, at = math.exp(self.chain.start[0]), math.exp(self.chain.start[1]), 0
        for n, (i, o) in enumerate(zip(hits, odds)):
            if i > at or n:
                if not n:
                    # the first plain token has the start weights instead of a move
                    y *= math.exp(bias)
                    gap = i - at - 1
                else:
                    gap = i - at
                if gap > 0:
                    a, b, c, d = self.power(gap)
                    x, y = x * a + y * c, x * b + y * d
                x, y = x * m00 + y * m10, (x * m01 + y * m11) * o
            else:
                y *= o
            total = x + y
            x, y = x / total, y / total
            forward.append((x, y))
            at = i + 1
        out = [0.0] * len(hits)
        u = v = 1.0
        last = len(tokens)
        for n in range(len(hits) - 1, -1, -1):
            gap = last - hits[n] - 1
            if gap > 0:
                a, b, c, d = self.power(gap)
                u, v = a * u + b * v, c * u + d * v
            x, y = forward[n]
            out[n] = y * v / (x * u + y * v)
            # what follows as seen from the token before: its potential, then the move into it
            v *= odds[n]
            u, v = m00 * u + m01 * v, m10 * u + m11 * v
            total = u + v
            u, v, last = u / total, v / total, hits[n]
        return hits, out

    def score(self, text: str) -> float:
        """Probability that a document is toxic."""
        _, p = self.marginals([t.lower() for t in TOKEN.findall(text)])
        return curve_at(self.chain.curve, *summary(p))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the offending stretches, in code points; adjacent tokens make one stretch."""
        found = list(TOKEN.finditer(text))
        out: list[list] = []
        before = -2
        for i, p in zip(*self.marginals([m[0].lower() for m in found])):
            if p >= least:
                if i == before + 1:
                    out[-1][1:] = [found[i].end(), max(out[-1][2], p)]
                else:
                    out.append([found[i].start(), found[i].end(), p])
                before = i
        return [tuple(x) for x in out]


def summary(marginals: list[float]) -> tuple[float, float]:
    """Log-odds of the highest marginal and log of one plus their sum."""
    top = min(max(max(marginals, default=0.0), 1e-4), 1 - 1e-4)
    return math.log(top / (1 - top)), math.log1p(sum(marginals))


def curve_at(curve: tuple[float, float, float], top: float, total: float) -> float:
    z = curve[0] + curve[1] * top + curve[2] * total
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Sample:
    """Tokens of the sample as numbers of a vocabulary, which takes a tenth of the strings' memory."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.number: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, int]] = []
        give = self.number.setdefault
        for text, label in rows:
            self.rows.append((np.array([give(t.lower(), len(self.number)) for t in TOKEN.findall(text)], np.int32), int(label > 0)))
        self.words = list(self.number)

    def contexts(self, toxic: int, of: np.ndarray) -> np.ndarray:
        """Distinct (token, token before) of the rows of a class for the tokens marked in `of`, as one sorted number each; before the first stands a token of its own."""
        n, found = len(self.words) + 1, []
        for t, y in self.rows:
            if y == toxic and len(t):
                at = np.flatnonzero(of[t])
                before = np.where(at > 0, t[at - 1], n - 1)
                found.append(np.unique(t[at].astype(np.int64) * n + before))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def tokens(self, toxic: int) -> int:
        return sum(len(t) for t, y in self.rows if y == toxic)


def _context_counts(pairs: np.ndarray, words: list[str], only: dict[str, int] | None = None) -> dict[str, int]:
    """How many different tokens stand before each feature; with `only`, of the features it names."""
    n = len(words) + 1
    token, before = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
    number: dict[str, int] = {}
    rows, owners = [], []
    for t in np.unique(token).tolist():
        for f in features_of(words[t]):
            if only is None or f in only:
                rows.append(number.setdefault(f, len(number)))
                owners.append(t)
    if not number:
        return {}
    # each feature's tokens, joined to the pairs by the token's stretch in the sorted pairs; some features at a time
    owners_, rows_ = np.array(owners, np.int32), np.array(rows, np.int32)
    del owners, rows
    order = np.argsort(rows_, kind="stable")
    owners_, rows_ = owners_[order], rows_[order]
    start, stop = np.searchsorted(token, owners_), np.searchsorted(token, owners_, side="right")
    upto = np.concatenate([[0], np.cumsum(stop - start)])
    counts, a = np.zeros(len(number), np.int64), 0
    while a < len(rows_):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 19), side="right")) - 1)
        b = int(np.searchsorted(rows_, rows_[b - 1], side="right"))
        size = (stop - start)[a:b]
        at = np.repeat(start[a:b] - (upto[a:b] - upto[a]), size) + np.arange(size.sum())
        distinct = np.unique(np.repeat(rows_[a:b], size).astype(np.int64) * n + before[at])
        counts += np.bincount(distinct // n, minlength=len(number))
        a = b
    return {f: int(counts[i]) for f, i in number.items() if counts[i] >= (LEAST_CONTEXTS if only is None else 1)}


def _offences(sample: Sample) -> dict[str, float]:
    """Features of offences with their strength."""
    many = _context_counts(sample.contexts(1, np.ones(len(sample.words), bool)), sample.words)
    carries = np.array([any(f in many for f in features_of(w)) for w in sample.words], bool)
    elsewhere = _context_counts(sample.contexts(0, carries), sample.words, many)
    one, all_ = sample.tokens(1), sample.tokens(1) + sample.tokens(0)
    if not 0 < one < all_:
        return {}
    share, out = one / all_, {}
    for f, a in many.items():
        b = elsewhere.get(f, 0)
        odds = math.log((a + 0.5) / (b + 0.5)) - math.log(share / (1 - share))
        g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if odds >= LEAST_ODDS and g >= LEAST_G:
            out[f] = g
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_FEATURES])


def _windows(sample: Sample, offences: dict[str, float]) -> dict[tuple, int]:
    """Stretches of up to WINDOW tokens as (length, ((position, features, label), ...)), with their number."""
    number = {f: i for i, f in enumerate(offences)}
    own = {i: found for w, i in sample.number.items() if (found := tuple(number[f] for f in features_of(w) if f in number))}
    carries = np.zeros(len(sample.words) + 1, bool)
    carries[list(own)] = True
    out: dict[tuple, int] = defaultdict(int)
    for tokens, toxic in sample.rows:
        for a in range(0, len(tokens), WINDOW):
            part = tokens[a : a + WINDOW]
            out[(len(part), tuple((int(k), own[int(part[k])], toxic) for k in np.flatnonzero(carries[part])))] += 1
    return out


def fit_chain(windows: dict[tuple, int], features: list[str], rounds: int = 80, rate: float = 0.25, ridge: float = 0.02) -> Chain:
    """Maximum likelihood with a ridge, by Adam on forward-backward gradients; equal windows are computed once."""
    n, k = len(windows), len(features)
    keys = list(windows)
    counts = np.array([windows[w] for w in keys], float)
    size = np.array([w[0] for w in keys])
    where = [(r, p, f, y) for r, w in enumerate(keys) for p, own, y in w[1] for f in own]
    row, pos, feat, _ = (np.array(x, np.int64) for x in zip(*where)) if where else (np.zeros(0, np.int64),) * 4
    gold = np.zeros((n, WINDOW), np.int8)
    for r, w in enumerate(keys):
        for p, _, y in w[1]:
            gold[r, p] = y
    real = np.arange(WINDOW)[None] < size[:, None]
    total = counts.sum()
    theta = np.zeros(k + 1 + 2 + 4)
    theta[k] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    true_pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            true_pairs[a, b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b) & real[:, 1:]).sum(axis=1) * counts).sum()
    true_start = np.array([(counts * (gold[:, 0] == s)).sum() for s in (0, 1)])
    for step in range(1, rounds + 1):
        score = np.full((n, WINDOW), theta[k])
        np.add.at(score, (row, pos), theta[feat])
        odds = np.exp(np.clip(score, -30, 30))
        start, move = np.exp(theta[k + 1 : k + 3]), np.exp(theta[k + 3 :].reshape(2, 2))
        alpha, beta = np.zeros((WINDOW, n, 2)), np.ones((WINDOW, n, 2))
        now = np.column_stack([np.full(n, start[0]), start[1] * odds[:, 0]])
        alpha[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            now = alpha[t - 1] @ move
            now[:, 1] *= odds[:, t]
            alpha[t] = np.where(real[:, t, None], now / now.sum(axis=1, keepdims=True), alpha[t - 1])
        pairs = np.zeros((2, 2))
        for t in range(WINDOW - 2, -1, -1):
            after = beta[t + 1] * np.column_stack([np.ones(n), odds[:, t + 1]])
            now = after @ move.T
            beta[t] = np.where(real[:, t + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
            joint = alpha[t][:, :, None] * move[None] * after[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += (joint * (counts * real[:, t + 1])[:, None, None]).sum(axis=0)
        post = alpha * beta
        p = (post[..., 1] / post.sum(axis=2)).T
        off = np.where(real, gold - p, 0) * counts[:, None]
        grad = np.zeros_like(theta)
        np.add.at(grad, feat, off[row, pos])
        grad[k] = off.sum()
        grad[k + 1 : k + 3] = true_start - np.array([(counts * (1 - p[:, 0])).sum(), (counts * p[:, 0]).sum()])
        grad[k + 3 :] = (true_pairs - pairs).ravel()
        grad = grad - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8 * total)
    weights = dict(zip(features, theta[:k].tolist()))
    return Chain(weights, float(theta[k]), tuple(theta[k + 1 : k + 3].tolist()), tuple(map(tuple, theta[k + 3 :].reshape(2, 2).tolist())))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic weights of x (first column ones) by Newton's steps; the first weight is free of the ridge."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, most: int, most_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of the rows of :func:`training_rows`."""
    rows = training_rows(docs, labels, column, folds, held_out, most, most_bytes=most_bytes).collect()
    return [(r["text"], int(r["label"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def fit(sample: list[tuple[str, int]]) -> Chain:
    """The model of (text, toxic) rows. With one class only, every score is its share."""
    share = (sum(y for _, y in sample) + 0.5) / (len(sample) + 1)
    plain = Chain(curve=(math.log(share / (1 - share)), 0.0, 0.0))
    if not sample or len({y for _, y in sample}) < 2:
        warnings.warn(f"the toxicity sample has {len(sample)} texts and no two classes: every score is {share:.3f}", stacklevel=2)
        return plain
    numbers = Sample(sample)
    offences = _offences(numbers)
    if not offences:
        return plain
    chain = fit_chain(_windows(numbers, offences), list(offences))
    scorer = chain.prepare()
    points = np.array([(1.0, *summary(scorer.marginals([numbers.words[i] for i in t])[1])) for t, _ in numbers.rows])
    chain.curve = tuple(_logistic(points, np.array([y for _, y in numbers.rows], float)).tolist())
    return chain


def fit_on(docs: DataFrame, labels: DataFrame) -> Chain:
    """The model of the training rows of `labels` found in docs."""
    return fit(training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_DOCS, SAMPLE_BYTES))


def scored(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores like an empty one, null ids and repeats pass through."""
    schema = docs.select(key).schema.add("score", "double", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = chain.prepare()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t or "") for t in b.column(1).to_pylist()], pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(of, schema)


def offending_spans(docs: DataFrame, chain: Chain, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, probability): a row for each offending stretch, offsets in code points of the whole text."""
    schema = docs.select(key).schema.add("start", "long", False).add("end", "long", False).add("probability", "double", False)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = chain.prepare()
        for b in slices(batches):
            found = [(i, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in scorer.spans(t or "", least)]
            columns = list(zip(*found)) or [()] * 4
            kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "start", "end", "probability"])

    return docs.select(key, text).mapInArrow(of, schema)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are, whatever their names."""
    at = docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = chain.prepare()
        for b in slices(batches):
            yield b.filter(pa.array([scorer.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, of, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document of the table, learnt from the labels outside the held-out fold.

    An empty labels table leaves one score for all; an empty documents table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
