"""Inverted index over sparse vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import materialize

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, size): words of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sized = docs.select(id_col, words.alias("w")).withColumn("size", F.size("w"))
    return sized.select(id_col, "size", F.explode("w").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def _equals(term: str):
    return lambda word: word == term


def bm25(docs: DataFrame, terms: list[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the ``k`` best documents; idf = ln(1 + (N - df + .5) / (df + .5)).

    Only postings of the asked terms are counted, in the scan, without a shuffle
    of words; texts are read once.
    """
    asked = sorted({t.lower() for t in terms})
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = [F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(asked)]
    counted = materialize(docs.select(F.col(id_col), F.explode(F.array(words)).alias("w")).select(id_col, F.size("w").alias("size"), *counts), "bm25")
    totals = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    score = F.lit(0.0)
    for i in range(len(asked)):
        df, n = totals[f"df{i}"], totals["n"]
        tf = F.col(f"tf{i}")
        weight = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        score = score + weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(float(totals["mean"] or 1))))
    return counted.withColumn("score", score).where("score > 0").select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)


def sparse_search(vectors: DataFrame, query: dict[int, float], k: int, id_col: str = "id", entries: str = "entries") -> DataFrame:
    """(id, score): best inner products with rows of array<struct<idx, val>>, through the asked indices alone."""
    table = F.create_map(*[x for i, v in query.items() for x in (F.lit(i), F.lit(float(v)))])
    hits = vectors.select(id_col, F.explode(entries).alias("e")).where(F.col("e.idx").isin(*query))
    return hits.groupBy(id_col).agg(F.sum(F.col("e.val").cast("double") * table[F.col("e.idx")]).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
