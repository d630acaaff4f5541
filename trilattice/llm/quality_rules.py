"""Quality by a sparse rule ensemble.

Small trees are boosted on statistics of labelled texts; every path from a root is a rule, a conjunction of comparisons.
A lasso logistic regression over the rules keeps few of them, and these are compiled to one Spark column expression.
Statistics, rules and scores are built-in expressions; only fitting, on a bounded sample of statistics, runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilattice.llm.common import WORD, fold, fresh, quoted, table, training_rows

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bounds of the labelled sample, in rows of statistics, and of the ensemble.
SAMPLE_ROWS, TREES, DEPTH, BINS, LEAST_ROWS, PENALTY, MAX_RULES = 20_000, 30, 3, 24, 5, 0.003, 400
STATISTICS = ("log_words", "word_length", "distinct_words", "repeated_words", "upper", "symbols", "bangs", "pipes", "digits", "letters", "ends", "log_lines", "repeated_lines")

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether at most, bound)


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """docs with the statistics as columns of the prefix, which no column of docs may have; a null text counts as empty, for which all are 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumns({f"{prefix}words": F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), f"{prefix}lines": F.split(t, "\n", -1), f"{prefix}size": F.char_length(t)})
    words, lines = F.col(f"{prefix}words"), F.col(f"{prefix}lines")
    n, size = F.size(words), F.greatest(F.col(f"{prefix}size"), F.lit(1)).cast("double")
    many = F.greatest(n, F.lit(1)).cast("double")
    kept = lambda kind: F.char_length(F.regexp_replace(t, f"[^{kind}]+", ""))
    again = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    found = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": (F.char_length(F.concat_ws("", words)) / many),
        "distinct_words": F.size(F.array_distinct(words)) / many,
        "repeated_words": again / many,
        "upper": kept(r"\p{Lu}") / size,
        "symbols": kept(r"#$%&*+<=>@\[\]^_`{}~\\") / size,
        "bangs": kept("!?") / many,
        "pipes": kept("|") / many,
        "digits": kept("0-9") / size,
        "letters": kept(r"\p{L}") / size,
        "ends": kept(".:;") / many,
        "log_lines": F.log1p(F.when(F.col(f"{prefix}size") > 0, F.size(lines)).otherwise(0).cast("double")),
        "repeated_lines": F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }
    # the partition number keeps the optimiser from copying the statistics into every comparison of a later filter
    return parts.select(*quoted(docs.columns), *(c.alias(f"{prefix}{k}") for k, c in found.items()), F.spark_partition_id().alias(f"{prefix}part"))


@dataclass
class Ensemble:
    """bias plus the weights of the rules that hold, through the logistic curve."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self, prefix: str = "__q_") -> Column:
        """The score as an expression over the columns of :func:`with_statistics`."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for name, at_most, bound in rule:
                c = F.col(prefix + name) <= bound if at_most else F.col(prefix + name) > bound
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same for rows of statistics in the order of STATISTICS."""
        z = np.full(len(x), self.bias) + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which rows a rule holds for."""
    out = np.ones(len(x), bool)
    for name, at_most, bound in rule:
        v = x[:, STATISTICS.index(name)]
        out &= v <= bound if at_most else v > bound
    return out


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic: midpoints between distinct quantiles."""
    out = []
    for v in x.T:
        levels = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)))
        out.append(np.unique(np.round((levels[1:] + levels[:-1]) / 2, 6)))
    return out


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, own: np.ndarray, path: Rule, depth: int, rules: list[Rule], step: np.ndarray) -> None:
    """One tree by Newton gains over the bins; records the path of every node and the step at each leaf."""
    if path:
        rules.append(path)
    best = (1e-6, None, None)
    g, h = gradient[own], weight[own]
    whole = g.sum() ** 2 / (h.sum() + 1)
    if depth and len(own) >= 2 * LEAST_ROWS:
        for k, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            c = codes[own, k]
            left_n = np.cumsum(np.bincount(c, minlength=len(bounds) + 1))[:-1]
            left_g, left_h = (np.cumsum(np.bincount(c, v, len(bounds) + 1))[:-1] for v in (g, h))
            gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
            gain[(left_n < LEAST_ROWS) | (len(own) - left_n < LEAST_ROWS)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, i)
    if best[1] is None:
        step[own] = g.sum() / (h.sum() + 1)
        return
    _, k, i = best
    low = codes[own, k] <= i
    for part, at_most in ((own[low], True), (own[~low], False)):
        _grow(x, codes, cuts, gradient, weight, part, (*path, (STATISTICS[k], at_most, float(cuts[k][i]))), depth - 1, rules, step)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n, k = z.shape
    rate = np.full(k, 1.0)
    scale = 4.0 / max(1e-9, np.linalg.eigvalsh((z.T @ z) / n + 1e-9 * np.eye(k))[-1] + 1.0)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        new = v - scale * (z.T @ (p - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - scale * penalty * rate, 0)
        new_b = c - scale * (p - y).mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble of rows of statistics and labels 0 or 1. With one class only, every score is its share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return Ensemble(float(np.log(share / (1 - share))), [])
    cuts = _cuts(x)
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    rules: list[Rule] = []
    score = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(x, codes, cuts, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, rules, step)
        score += 0.3 * step
    # rules that hold for the same rows say the same; the shortest of them stays
    kept: dict[bytes, Rule] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        on = holds(rule, x)
        if 0 < on.sum() < len(y):
            kept.setdefault(np.packbits(on).tobytes(), rule)
    chosen = list(kept.values())[:MAX_RULES]
    if not chosen:
        return Ensemble(float(np.log(share / (1 - share))), [])
    on = np.column_stack([holds(r, x) for r in chosen]).astype(float)
    mean, spread = on.mean(axis=0), np.maximum(on.std(axis=0), 0.05)
    b, w = _lasso((on - mean) / spread, y.astype(float), PENALTY)
    w = w / spread
    return Ensemble(float(b - (w * mean).sum()), [(r, float(v)) for r, v in zip(chosen, w) if v])


def fit_on(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble of the statistics of :func:`training_rows`, of which at most `most` reach the driver."""
    given = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, most, F.min)
    rows = with_statistics(given).select("doc_id", "label", *(f"__q_{s}" for s in STATISTICS)).collect()
    rows = sorted(tuple(r) for r in rows)
    return fit(np.array([r[2:] for r in rows], float).reshape(-1, len(STATISTICS)), np.array([r[1] > 0 for r in rows], int))


def scored(docs: DataFrame, ensemble: Ensemble, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null texts score like empty ones, null ids and repeats pass through."""
    given = docs.select(F.col(key), F.col(text).alias("__q_text"))
    return with_statistics(given, "__q_text").select(key, ensemble.column().alias("score"))


def without_low_quality(docs: DataFrame, ensemble: Ensemble, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score at or above the threshold, all columns as they are, whatever their names."""
    prefix = fresh(docs.columns, "__q_")
    return with_statistics(docs, text, prefix).where((ensemble.column(prefix) >= threshold) & (F.col(f"{prefix}part") >= 0)).select(*quoted(docs.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Score of every document of the table, learnt from the labels outside the held-out fold.

    An empty labels table leaves one score for all; an empty documents table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
