"""A stored inverted index over texts or sparse vectors: a search reads the postings of its own terms alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.vector.sparse import K1, B, postings


class TermIndex:
    """Postings (term, id, weight, size) lie in folders by a hash of the term, sorted by it.

    Folders and Parquet's ranges of terms leave only the row groups of the asked terms to be read; the postings of
    a frequent term are split among files. Ids are unique; rows without an id take no part. ``docs`` counts all
    rows, with those that have no terms.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.buckets, self.docs, self.words, schema = spark.read.parquet(f"{path}/totals").first()
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")

    @classmethod
    def of_texts(cls, df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> TermIndex:
        """Over the words of ``text_col`` as ``sparse.postings`` takes them; their counts are the weights."""
        held = df.where(F.col(id_col).isNotNull())
        rows = postings(held, id_col, text_col).select("term", F.col(id_col).alias("id"), F.col("tf").cast("double").alias("weight"), F.col("size").cast("long").alias("size"))
        return cls._write(rows, held, path, buckets)

    @classmethod
    def of_vectors(cls, df: DataFrame, path: str, id_col: str = "id", entries: str = "entries", buckets: int = 64) -> TermIndex:
        """Over rows with array<struct<idx, val>>; an index is a term."""
        held = df.where(F.col(id_col).isNotNull())
        rows = held.select(F.col(id_col).alias("id"), F.size(entries).cast("long").alias("size"), F.explode(entries).alias("e"))
        return cls._write(rows.select(F.col("e.idx").cast("string").alias("term"), "id", F.col("e.val").cast("double").alias("weight"), "size"), held, path, buckets)

    @classmethod
    def _write(cls, rows: DataFrame, held: DataFrame, path: str, buckets: int) -> TermIndex:
        spark = held.sparkSession
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # Rebalancing splits a large folder among tasks and joins small ones.
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/rows")
        words = spark.read.schema(dealt.schema).parquet(f"{path}/rows").agg(F.sum("weight")).first()[0]
        schema = f"term string, id {dealt.schema['id'].dataType.simpleString()}, weight double, size long, bucket int"
        spark.createDataFrame([(buckets, held.count(), float(words or 0.0), schema)], "buckets int, docs long, words double, schema string").coalesce(1).write.parquet(f"{path}/totals")
        return cls(spark, path)

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of ``terms``."""
        near = reduce(lambda x, y: x | y, [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms], F.lit(False))
        return self.rows.where(near & F.col("term").isin(terms)).drop("bucket")

    def bm25(self, terms: list[str], k: int) -> DataFrame:
        """(id, score) of the ``k`` best texts, as ``sparse.bm25`` ranks them."""
        asked = sorted({t.lower() for t in terms})
        found = self.of_terms(asked)
        held = dict(found.groupBy("term").agg(F.count("*")).collect())
        rarity = F.lit(0.0)
        for term, df in held.items():
            rarity = F.when(F.col("term") == term, F.log(F.lit(1 + (self.docs - df + 0.5) / (df + 0.5)))).otherwise(rarity)
        mean = self.words / self.docs if self.words else 1.0
        part = rarity * F.col("weight") * (K1 + 1) / (F.col("weight") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
        return found.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def inner(self, query: dict[int, float], k: int) -> DataFrame:
        """(id, score): the ``k`` best inner products with ``query``, as ``sparse.sparse_search`` ranks them."""
        weight = F.lit(0.0)
        for i, v in query.items():
            weight = F.when(F.col("term") == str(i), F.lit(float(v))).otherwise(weight)
        return self.of_terms([str(i) for i in query]).groupBy("id").agg(F.sum(F.col("weight") * weight).alias("score")).orderBy(F.desc("score"), "id").limit(k)
