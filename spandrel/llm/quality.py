"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are Spark column expressions over the whole text. Shallow trees on
bootstrap samples of labelled rows give paths; each path is a conjunctive rule
over the statistics. A lasso logistic regression on the rules' truth values
keeps few of them, and these are compiled back into one column expression, so
scoring is a projection without Python or a shuffle.

Labels are learned from at most ``TRAIN_ROWS`` labelled rows of the training
folds; id, language, source and label columns are never inputs.

Defined cases: a null text counts as an empty one and gets a score from its
statistics (all zero) like any other; null ids are kept, held_out false for
them; without usable labels of both kinds the score is the share of positives
seen, or 0.5; equal texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.labels import HELD_OUT, fold_of, training_sample

TRAIN_ROWS = 8000
TREES, DEPTH, LASSO, SEED = 40, 3, 0.002, 7
THRESHOLD = 0.7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\/"
MARKS = "!?"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column; all are defined and finite for every text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per = lambda count, total: count / F.greatest(total, F.lit(1))
    share = lambda chars: per(n - F.length(F.translate(t, chars, "")), n)
    words = F.split(t, " ")
    lines = F.split(t, "\n")
    return {
        "log_length": F.log1p(n.cast("double")),
        "upper": share(UPPER),
        "digit": share(DIGITS),
        "symbol": share(SYMBOLS),
        "mark": share(MARKS),
        "stop": per(n - F.length(F.replace(t, F.lit("."), F.lit(""))), n),
        "comma": per(n - F.length(F.replace(t, F.lit(","), F.lit(""))), n),
        "word_length": per(n, F.size(words)),
        "distinct_words": per(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": per(n, F.size(lines)),
        "bytes": per(F.octet_length(t), n),
    }


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, above, threshold): above means greater than the threshold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & ((stats[name] > at) if above else (stats[name] <= at))
        return out


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], rng: np.random.Generator, depth: int, path: tuple, out: set) -> None:
    """Paths of one tree: the split with the least Gini impurity among a random half of the statistics."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = None
    for j in rng.permutation(len(names))[: max(2, len(names) // 2)]:
        if not len(cuts[j]):
            continue
        slot = np.searchsorted(cuts[j], x[:, j], side="left")
        count = np.cumsum(np.bincount(slot, minlength=len(cuts[j]) + 1))[:-1]
        ones = np.cumsum(np.bincount(slot, weights=y, minlength=len(cuts[j]) + 1))[:-1]
        rest, other = len(y) - count, y.sum() - ones
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = ones * (1 - ones / count) + other * (1 - other / rest)
        impurity[(count < 5) | (rest < 5)] = np.inf
        at = int(np.argmin(impurity))
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0]):
            best = (impurity[at], j, float(cuts[j][at]))
    if best is None:
        return
    _, j, cut = best
    low = x[:, j] <= cut
    for above, side in ((False, low), (True, ~low)):
        step = (*path, (names[j], above, cut))
        out.add(step)
        _grow(x[side], y[side], names, cuts, rng, depth - 1, step, out)


def _truth(x: np.ndarray, names: list[str], path: tuple) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for name, above, cut in path:
        value = x[:, names.index(name)]
        held &= (value > cut) if above else (value <= cut)
    return held


def _lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the logistic loss with an l1 penalty; the intercept is free."""
    n, d = a.shape
    full = np.hstack([np.ones((n, 1)), a])
    w = np.zeros(d + 1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[0] = math.log(rate / (1 - rate))
    v = np.random.default_rng(0).normal(size=d + 1)
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (full.T @ (full @ v)))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -40, 40)))
        new = z - step * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, seed: int = SEED) -> RuleEnsemble:
    """Rule ensemble from a bounded sample held in memory."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        rate = min(max(rate, 0.01), 0.99)
        return RuleEnsemble(math.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64)))[:-1] for j in range(x.shape[1])]
    cuts = [np.unique(np.float64([float(f"{c:.6g}") for c in own])) for own in cuts]
    paths: set = set()
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        _grow(x[rows], y[rows], names, cuts, rng, depth, (), paths)
    kept, seen = [], set()
    for path in sorted(paths, key=lambda p: (len(p), p)):
        truth = _truth(x, names, path)
        mark = truth.tobytes()
        if 3 <= truth.sum() <= len(y) - 3 and mark not in seen:
            seen |= {mark, (~truth).tobytes()}
            kept.append((path, truth))
    if not kept:
        return RuleEnsemble(math.log(y.mean() / (1 - y.mean())))
    a = np.column_stack([truth for _, truth in kept]).astype(float)
    intercept, weights = _lasso_logistic(a, y.astype(float), penalty)
    return RuleEnsemble(intercept, [(Rule(path), float(w)) for (path, _), w in zip(kept, weights) if abs(w) > 1e-3])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    sample = training_sample(docs.select(id_col, text_col), labels, label, train_rows, id_col)
    stats = statistics(F.col(text_col))
    rows = sample.select(F.col("__label"), *[column.cast("double").alias(name) for name, column in stats.items()]).toPandas()
    return fit_rules(rows[list(stats)].to_numpy(dtype=float), rows["__label"].to_numpy(dtype=float), list(stats))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score added.

    The statistics pass through a generator of one row, which keeps filters on
    the score from being pushed into them and computing them once for each rule.
    """
    used = sorted({test[0] for rule, _ in model.rules for test in rule.tests})
    if not used:
        return docs.withColumn(name, model.score({}))
    stats = statistics(F.col(text_col))
    below = docs.select("*", F.inline(F.array(F.struct(*[stats[f].cast("double").alias(f"__{f}") for f in used]))))
    return below.withColumn(name, model.score({f: F.col(f"__{f}") for f in used})).drop(*[f"__{f}" for f in used])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_quality(own, fit_quality(own, labels))
    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
