"""Registration of a query together with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spandrel.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy access to the tables of one folder by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run Spark SQL with ``{name}`` placeholders for tables and given frames."""
        import string

        names = {field for _, field, _, _ in string.Formatter().parse(text) if field}
        bound = {n: frames[n] if n in frames else getattr(self, n) for n in names}
        return self.spark.sql(text, **bound)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None):
        """Decorator: the function gets ``Tables``; ``oracle`` is the SQL DuckDB runs."""

        def keep(make):
            key = name or make.__name__
            self.queries[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
            if oracle:
                self.oracles[key] = oracle
            return make

        return keep
