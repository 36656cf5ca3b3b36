"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic) over all documents. Raking
scales the cells' weights until their token sums have the target shares of each
of the three marginals; a document's probability is its cell's weight, and a
hash of its id decides. The cells are few: one row for each
combination that occurs, at most ``MAX_CELLS`` (more raise an error), so raking
runs on the driver and the weights are broadcast.

``TARGETS`` states the default shares: languages by name (half of all tokens
English), sources and kinds of text by the power ``ALPHA`` of their own token
shares, the usual exponent of temperature sampling, as their names are not known
beforehand. A category without a stated share keeps its own share of the tokens,
and the stated ones divide the rest. ``BUDGET`` is the share of all tokens to
sample; a category that has less than its share of that is kept whole, so a rare
one cannot shrink the sample. Without a budget, the sample is the largest that
meets all targets.

Defined cases: a null source or language is a category of its own; a null text
has no tokens; cells without tokens keep weight 1 before scaling; targets for
categories that do not occur are ignored and the rest normalised; equal ids are
kept or dropped together; an empty table gives an empty result; other columns
pass through (columns named like the added ones are replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")
ALPHA = 0.7
#: Target shares by marginal; None takes the token shares to the power ``ALPHA``.
TARGETS: dict[str, dict[str, float] | None] = {"source": None, "lang": {"en": 0.5, "de": 0.19, "fr": 0.19, "es": 0.12}, "topic": None}
BUDGET = 0.6
# Words of legal notices, in the languages of the corpus.
LEGAL = ("license", "licence", "copyright", "all rights reserved", "lizenz", "urheberrecht", "licencia", "derechos de autor", "droits d'auteur", "terms of use")
SEED = 42
ROUNDS, TOLERANCE = 500, 1e-10
ADDED = ("topic", "tokens", "weight", "probability", "kept")


def token_count(text: Column) -> Column:
    """Runs between spaces and newlines, a null or empty text having none."""
    t = F.coalesce(text, F.lit(""))
    count = lambda mark: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(mark), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(count(" ") + count("\n") + 1).cast("long")


def topic_of(text: Column) -> Column:
    """Kind of text by its surface, the first that fits: a legal notice, table, list, or prose by length.

    A legal notice has one of ``LEGAL`` in a text of less than 1500 characters; a table a tab or upright bar for every 60
    characters; a list ten or more lines of less than 40 characters on average.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    lower = F.lower(F.substring(t, 1, 1500))
    marks = lambda mark: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(mark), F.lit("")))
    legal = F.lit(False)
    for word in LEGAL:
        legal = legal | F.contains(lower, F.lit(word))
    return (
        F.when((n < 1500) & legal, "legal")
        .when((F.contains(t, F.lit("|")) | F.contains(t, F.lit("\t"))) & ((marks("|") + marks("\t")) * 60 >= n), "table")
        .when((n >= 10) & (marks("\n") >= 9) & (n < 40 * (marks("\n") + 1)), "list")
        .when(n < 600, "note")
        .when(n > 6000, "long")
        .otherwise("prose")
    )


def rake(totals: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float | None = None) -> np.ndarray:
    """Cell weights for which the weighted totals have the target shares of every marginal.

    ``codes[d]`` gives each cell's category in marginal d and ``targets[d]`` the shares. With a ``budget``, a share of
    the totals, weights are probabilities: none exceeds 1, which leaves a category short that has too little.
    """
    weights = np.full(len(totals), 1.0 if budget is None else budget)
    grand = totals.sum() * (1.0 if budget is None else budget)
    for _ in range(ROUNDS):
        last = weights
        for code, target in zip(codes, targets):
            now = np.bincount(code, weights=weights * totals, minlength=len(target)) / grand
            factor = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            weights = weights * factor[code]
            if budget is not None:
                weights = np.minimum(weights, 1.0)
        if np.abs(weights - last).max(initial=0.0) < TOLERANCE * weights.max(initial=0.0):
            break
    return weights


def shares(sums: np.ndarray, names: list, given: dict | None) -> np.ndarray:
    """Target shares of one marginal over the categories that have tokens."""
    own = np.where(sums > 0, sums, 0.0).astype(float)
    if own.sum() == 0:
        return own
    own /= own.sum()
    if given is None:
        raw = own**ALPHA
        return raw / raw.sum()
    stated = np.array([float(given.get(n, 0.0)) if n in given and own[i] > 0 else 0.0 for i, n in enumerate(names)])
    other = np.where([n in given for n in names], 0.0, own)
    return stated * (1 - other.sum()) / stated.sum() + other if stated.sum() > 0 else own


def cell_weights(cells: list[tuple], totals: list[int], targets: dict[str, dict | None] | None = None, budget: float | None = BUDGET) -> list[float]:
    """Raked probabilities; without a budget, weights scaled so that the largest is 1."""
    total = np.array(totals, dtype=float)
    if not len(total) or total.sum() == 0:
        return [1.0] * len(total)
    targets = TARGETS if targets is None else targets
    codes, wanted = [], []
    for d, dimension in enumerate(DIMENSIONS):
        names = sorted({c[d] for c in cells}, key=lambda n: (n is None, n or ""))
        place = {n: i for i, n in enumerate(names)}
        code = np.array([place[c[d]] for c in cells])
        sums = np.bincount(code, weights=total, minlength=len(names))
        codes.append(code)
        wanted.append(shares(sums, names, targets.get(dimension)))
    weights = rake(total, codes, wanted, budget)
    live = total > 0
    return [float(w) for w in np.where(live, weights / (weights[live].max() if budget is None else 1.0), 1.0)]


def mixing_probabilities(docs: DataFrame, targets: dict[str, dict | None] | None = None, seed: int = SEED, budget: float | None = BUDGET) -> DataFrame:
    """``docs`` with topic, tokens, weight, probability and kept added."""
    own = docs.drop(*ADDED).withColumns({"topic": topic_of(F.col("text").cast("string")), "tokens": token_count(F.col("text").cast("string"))})
    found = own.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("total")).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of source, language and topic")
    keys = [(r["source"], r["lang"], r["topic"]) for r in found]
    weights = cell_weights(keys, [r["total"] for r in found], targets, budget)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    table = docs.sparkSession.createDataFrame([(*k, w) for k, w in zip(keys, weights)], f"c_source {kinds['source']}, c_lang {kinds['lang']}, c_topic string, weight double")
    match = F.col("source").eqNullSafe(F.col("c_source")) & F.col("lang").eqNullSafe(F.col("c_lang")) & (F.col("topic") == F.col("c_topic"))
    joined = own.join(F.broadcast(table), match, "left").drop("c_source", "c_lang", "c_topic")
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    return joined.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("weight", F.lit(1.0))}).withColumn("kept", draw < F.col("probability"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and kept of every document."""
    return mixing_probabilities(docs.select("doc_id", "text", "source", "lang")).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "topic", "tokens", "probability", "kept")


def mix_documents(docs: DataFrame, targets: dict[str, dict | None] | None = None, seed: int = SEED) -> DataFrame:
    """The documents that the calibrated draw keeps, with the columns of ``docs`` as they were."""
    own = docs.select("doc_id", "text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return mixing_probabilities(own, targets, seed).where("kept").select("__row.*")
