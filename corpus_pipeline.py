"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one. All but the last keep the columns
of ``documents``.

Defined cases, for every stage: a null text counts as an empty one (and stays
null where texts are returned); rows with a null id are judged by their text and
never merged with others; repeated rows are judged alike, and one of them stays
in near-dedup; an empty table gives an empty result; other columns, whatever
their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import line_dedup, mixing, packing, quality, simhash
from spandrel.session import materialize, table

#: Documents under this score go; below the classifier's own threshold, so that clean documents stay.
REJECT_BELOW = 0.5


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled training folds of ``docs``."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, name="__score").where(F.col("__score") >= REJECT_BELOW).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes from each document the line blocks that align with an earlier one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each near-duplicate group (five words, similarity 0.8); null ids stay.

    SimHash fingerprints link first, every link is checked on the shingles, and an exact search finds the links over 3 bits.
    """
    return simhash.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the raked probabilities of their source, language and topic."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the fitted classifier, patience diff, or byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's output is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
