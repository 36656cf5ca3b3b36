"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs (Cyrillic, Greek, full-width and
mathematical letters) to their Latin look-alikes, and digits or signs inside
words to the letters they stand for. The folded lexicon is one automaton; a
match counts if it begins a word. A second automaton has the seed words alone
and runs over a further fold, without accents and with l and i as one letter (1
stands for either): learned terms may differ in just these. A match inside an exception phrase does not count. The score is
a logistic function of the summed weights and of their density by length.

The lexicon has seed words and word prefixes learned from at most
``TRAIN_ROWS`` labelled documents of the training folds; their weights are
log ratios of rates, and the logistic's four coefficients are fitted on the same sample.
Id, language, source and label columns are never inputs of a score.

Defined cases: a null text counts as an empty one, which has no match and gets
the score of one; null ids are kept, held_out false for them; without usable
labels only the seed words count, with fixed coefficients; equal texts get equal
scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.arrow import frugal, map_rows, slices
from spandrel.llm.labels import HELD_OUT, fold_of, training_sample
from spandrel.session import materialize, release

TRAIN_ROWS = 8000
PREFIX = range(3, 10)
SUPPORT, RATIOS = 3, (4.0, 1.5)
THRESHOLD = 0.3

# Seed words, with the weight they have without labels.
SEEDS = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "loser": 3.0, "trash": 3.0, "clown": 3.0}

# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "circus clown", "sore loser", "stupidly simple", "scum line")

# Look-alike letters, in the order of their Latin counterparts below.
LOOK_ALIKES = "аеорсухіјѕԁһкмнтвгɡɑıκνοαειτρυβγ"
LATIN = "aeopcyxijsdhkmhtbrgaikvoaeitpuby"

# Signs that stand for letters inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

WORD = re.compile(r"[^\W\d_]{3,}")
LEETED = re.compile(r"(?<![\w$!])(?:@+(?=[^\W\d_]))?([\w@$!]*[^\W\d_][\w@$!]*)")


def _tables() -> tuple[dict, dict, dict]:
    letters = dict(zip(map(ord, LOOK_ALIKES), LATIN))
    accents = {ord("l"): "i"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            (letters if code > 0x2000 else accents)[code] = plain.replace("l", "i") if code < 0x2000 else plain
    letters |= {code: None for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return letters, {ord(k): v for k, v in LEET.items()}, accents


def fold(text: str | None) -> str:
    """Lower-cased text with look-alikes as Latin letters and stand-in signs inside words as letters."""
    letters, leet, _ = _FOLDS
    folded = (text or "").lower()
    if not folded.isascii():
        folded = folded.translate(letters)
    if any(sign in folded for sign in LEET):
        folded = LEETED.sub(lambda m: " " + m[1].translate(leet) if m[0] != m[1] else m[0].translate(leet), folded)
    return folded


_FOLDS = _tables()


def _merged(folded: str) -> str:
    """A folded text without accents and with l and i as one letter; every character keeps its place."""
    return folded.replace("l", "i") if folded.isascii() else folded.translate(_FOLDS[2])


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    coefficients: tuple[float, float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        """Function from a text to (summed weight, matches, words)."""
        import ahocorasick

        def build(terms: dict[str, float], form):
            automaton = ahocorasick.Automaton()
            for term, weight in terms.items():
                automaton.add_word(form(term), (len(term), weight, None))
            for phrase in self.exceptions:
                automaton.add_word(form(phrase), (len(phrase), 0.0, phrase))
            automaton.make_automaton()
            return automaton

        plain = build(self.weights, str)
        seeds = build({t: w for t, w in self.weights.items() if t in SEEDS} or {"\0": 0.0}, _merged)

        def measure(text: str | None) -> tuple[float, int, int]:
            folded = fold(text)
            hits, free = {}, []
            for automaton, form in ((plain, folded), (seeds, _merged(folded))):
                for end, (size, weight, phrase) in automaton.iter(form):
                    start = end - size + 1
                    if start and form[start - 1].isalpha():
                        continue
                    if phrase is not None:
                        free.append((start, end))
                    else:
                        hits[start] = max(weight, hits.get(start, 0.0))
            reach, counted = -1, []
            spans = iter(sorted(free))
            span = next(spans, None)
            for at, weight in sorted(hits.items()):
                while span is not None and span[0] <= at:
                    reach = max(reach, span[1])
                    span = next(spans, None)
                if at > reach:
                    counted.append(weight)
            return float(sum(counted)), len(counted), folded.count(" ") + folded.count("\n") + 1

        return measure

    def score(self, total: float, matches: int, words: int) -> float:
        x = features(total, matches, words)
        margin = sum(c * v for c, v in zip(self.coefficients, (1.0, *x)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def features(total: float, matches: int, words: int) -> tuple[float, float, float]:
    """Damped sum, damped number and density by length of the matches."""
    return math.log1p(total), math.log1p(matches), math.log1p(100 * total / (words + 20))


def _term_counts(model: ToxicityModel):
    """Rows (term, word, toxic, clean): for each word prefix, documents of either label that hold it.

    Toxic documents that a known term already explains are left out. ``word`` is a
    whole word of a toxic document that begins with the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure, toxic, clean, words = model.matcher(), Counter(), Counter(), Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label and measure(text)[1]:
                    continue
                held = set(WORD.findall(fold(text)))
                (toxic if label else clean).update({w[:k] for w in held for k in PREFIX if len(w) >= k})
                if label:
                    words.update({(w[:k], w) for w in held for k in PREFIX if len(w) >= k})
        rows = [(t, None, toxic[t], clean[t]) for t in toxic.keys() | clean.keys()] + [(t, w, 0, 0) for t, w in words]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 50_000]), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["term", "word", "toxic", "clean"])

    return run


def learn_terms(sample: DataFrame, known: ToxicityModel, least: float) -> dict[str, float]:
    """Word prefixes that mark toxic documents that the known terms miss, with smoothed log ratios of their rates.

    A prefix needs several documents and several distinct words, so that a rare
    word of one copied text is none. All such prefixes count; their number is
    bounded by the words of the sample, at most ``TRAIN_ROWS`` texts.
    """
    counts = sample.select("text", "__label").mapInArrow(frugal(_term_counts(known)), "term string, word string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_distinct("word").alias("words"))
    ratio = F.log((F.col("toxic") + 0.5) / (F.col("t") + 1)) - F.log((F.col("clean") + 0.5) / (F.col("c") + 1))
    size = sample.agg(F.sum("__label").alias("t"), F.sum(1 - F.col("__label")).alias("c")).first()
    scored = counts.withColumns({"t": F.lit(float(size["t"] or 0)), "c": F.lit(float(size["c"] or 0))}).withColumn("ratio", ratio).withColumn("gain", F.col("ratio") * F.col("toxic"))
    found = scored.where((F.col("toxic") >= SUPPORT) & (F.col("words") >= SUPPORT) & (F.col("ratio") >= least)).orderBy(F.desc("gain"), "term").collect()
    chosen: dict[str, float] = {}
    longer: dict[str, float] = {}
    for row in found:
        term, ratio = row["term"], row["ratio"]
        heads = [term[:k] for k in PREFIX if k <= len(term)]
        related = [chosen[t] for t in heads if t in chosen] + [longer[t] for t in (term,) if t in longer]
        if not related or ratio > max(related) + 0.7:
            chosen[term] = ratio
            for t in heads:
                longer[t] = max(ratio, longer.get(t, ratio))
    return chosen


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps for a ridge logistic regression; the intercept is free."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [0.05] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(training_sample(own, labels, label, train_rows).select("doc_id", "text", "__label"), "toxicity")
    model = ToxicityModel(dict(SEEDS), (-4.0, 3.0, 0.5, 0.5))
    for least in RATIOS:
        model.weights = {**learn_terms(sample, model, least), **model.weights}
    rows = measured(sample, model, "__label").select("extra", "total", "matches", "words").collect()
    release(sample)
    y = np.array([r["extra"] for r in rows], dtype=float)
    if len(y) and 0 < y.mean() < 1:
        model.coefficients = _fit_logistic(np.array([features(r["total"], r["matches"], r["words"]) for r in rows]), y)
    return model


def measured(docs: DataFrame, model: ToxicityModel, extra: str | None = None) -> DataFrame:
    """doc_id, total, matches, words, score for each row; ``extra`` is carried as a long."""

    def make():
        measure = model.matcher()

        def work(row):
            total, matches, words = measure(row["text"])
            yield row["doc_id"], total, matches, words, model.score(total, matches, words), row["extra"]

        return work

    own = docs.select("doc_id", "text", (F.col(extra) if extra else F.lit(None)).cast("long").alias("extra"))
    return map_rows(own, make, "doc_id long, total double, matches long, words long, score double, extra long")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches for every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = measured(own, fit_toxicity(own, labels))
    held = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")
