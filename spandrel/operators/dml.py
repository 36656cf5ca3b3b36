"""Changes to tables as rewrites: every function returns the table's new rows.

``replace_table`` commits them: a new folder is written in full before it takes
the old one's place, so a failed statement leaves the table as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def insert_on_conflict(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO NOTHING, or DO UPDATE with columns over ``t`` (old) and ``s`` (new); keys are unique in ``rows``."""
    if update is None:
        return insert(target, rows.join(target.select(*keys), keys, "left_anti"))
    return merge(target, rows, _keys_equal(keys), [Matched(update)], [NotMatched({c: F.col(f"s.{c}") for c in rows.columns})])


def _keys_equal(keys: list[str]) -> Column:
    test = F.col(f"t.{keys[0]}") == F.col(f"s.{keys[0]}")
    for k in keys[1:]:
        test = test & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    return test


def update(target: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    if where is None:
        return target.withColumns(values)
    return target.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(target: DataFrame, source: DataFrame, on: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE … FROM over aliases ``t`` and ``s``; ``source`` has at most one match a row."""
    return merge(target, source, on, [Matched(values)])


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    return target.alias("t").join(source.alias("s"), on, "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


@dataclass(frozen=True)
class Matched:
    """WHEN MATCHED [AND test] THEN UPDATE SET values, or DELETE without values."""

    values: dict[str, Column] | None = None
    test: Column | None = None


@dataclass(frozen=True)
class NotMatched:
    """WHEN NOT MATCHED [AND test] THEN INSERT values."""

    values: dict[str, Column] = field(default_factory=dict)
    test: Column | None = None


@dataclass(frozen=True)
class NotMatchedBySource:
    """WHEN NOT MATCHED BY SOURCE [AND test] THEN UPDATE SET values, or DELETE without values."""

    values: dict[str, Column] | None = None
    test: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: Column, matched: list[Matched] = (), not_matched: list[NotMatched] = (), by_source: list[NotMatchedBySource] = ()) -> DataFrame:
    """MERGE INTO over aliases ``t`` and ``s``: one full outer join; the first clause that fits a row decides."""
    left = target.withColumn("__t", F.lit(1)).alias("t")
    right = source.withColumn("__s", F.lit(1)).alias("s")
    joined = left.join(right, on, "full" if not_matched else "left")
    in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    clauses = [(in_t & in_s, c) for c in matched] + [(in_t & ~in_s, c) for c in by_source] + [(~in_t & in_s, c) for c in not_matched]
    choice = None
    for i, (kind, clause) in enumerate(clauses):
        test = kind if clause.test is None else kind & F.coalesce(clause.test, F.lit(False))
        choice = F.when(test, F.lit(i)) if choice is None else choice.when(test, F.lit(i))
    chosen = joined.withColumn("__clause", choice if choice is not None else F.lit(None).cast("int"))
    columns = []
    for name in target.columns:
        value = F.col(f"t.{name}")
        made = None
        for i, (_, clause) in enumerate(clauses):
            new = (clause.values or {}).get(name)
            if new is None and isinstance(clause, NotMatched):
                new = F.lit(None)
            if new is not None:
                made = F.when(F.col("__clause") == i, new) if made is None else made.when(F.col("__clause") == i, new)
        columns.append((value if made is None else made.otherwise(value)).cast(target.schema[name].dataType).alias(name))
    gone = [i for i, (_, c) in enumerate(clauses) if not isinstance(c, NotMatched) and c.values is None]
    keep = in_t | F.col("__clause").isNotNull()
    kept = chosen.where(keep if not gone else keep & ~F.coalesce(F.col("__clause").isin(*gone), F.lit(False)))
    return kept.select(*columns)


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, n): constraints that rows break. CHECK passes on NULL; NULL keys are neither repeated nor foreign."""
    found = [df.where(F.col(c).isNull()).select(F.lit(f"not null {c}").alias("rule")) for c in not_null]
    for keys in unique:
        solid = df.where(" and ".join(f"`{k}` is not null" for k in keys))
        found.append(solid.groupBy(*keys).count().where("count > 1").select(F.lit(f"unique {', '.join(keys)}").alias("rule")))
    found += [df.where(~test).select(F.lit(f"check {name}").alias("rule")) for name, test in (checks or {}).items()]
    for c, (parent, key) in (foreign or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(parent.select(F.col(key).alias(c)), c, "left_anti")
        found.append(lost.select(F.lit(f"foreign {c}").alias("rule")))
    if not found:
        return df.limit(0).select(F.lit("").alias("rule"), F.lit(0).cast("long").alias("n"))
    union = found[0]
    for part in found[1:]:
        union = union.union(part)
    return union.groupBy("rule").agg(F.count("*").alias("n"))


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` beside ``path`` and swap folders; ``df`` may read from ``path``."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(fresh)
    jvm = spark.sparkContext._jvm
    where = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = where(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(where(path)):
        fs.rename(where(path), where(old))
    fs.rename(where(fresh), where(path))
    fs.delete(where(old), True)


class MaterializedViews:
    """Views whose rows are stored; ``refresh`` runs the query again and swaps the stored rows."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.queries = spark, folder.rstrip("/"), {}

    def create(self, name: str, sql: str) -> None:
        self.queries[name] = sql
        self.refresh(name)

    def refresh(self, name: str) -> None:
        replace_table(self.spark.sql(self.queries[name]), f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        del self.queries[name]
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
