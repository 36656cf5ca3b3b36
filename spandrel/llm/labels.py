"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4).cast("long"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` rows of at most ``limit`` labelled training ids, with the label as ``__label``.

    Only ids outside the held-out fold are taken, in the order of a hash of the
    id. ``limit`` bounds the sample and with it what is broadcast to the scan.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__key"), F.col(label).cast("int").alias("__label"))
    usable = known.where(F.col("__key").isNotNull() & F.col("__label").isin(0, 1) & (fold_of(F.col("__key")) != HELD_OUT))
    chosen = usable.groupBy("__key").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__key"), "__key").limit(limit)
    return docs.join(F.broadcast(chosen), docs[id_col].cast("long") == F.col("__key"))
