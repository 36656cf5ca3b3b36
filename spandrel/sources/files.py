"""Import and export of tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.graph.model import PropertyGraph

FORMATS = ("parquet", "csv", "json", "orc", "text")


def copy_to(df: DataFrame, path: str, format: str = "csv", **options) -> None:
    """COPY … TO: options are those of the format (header, sep, nullValue, compression, …)."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    defaults = {"header": "true"} if format == "csv" else {}
    df.write.format(format).options(**{**defaults, **options}).save(path)


def copy_from(spark: SparkSession, path: str, format: str = "csv", schema: str | None = None, **options) -> DataFrame:
    """COPY … FROM; without a schema CSV columns are text."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    reader = spark.read.format(format).options(**{**({"header": "true"} if format == "csv" else {}), **options})
    return (reader.schema(schema) if schema else reader).load(path)


def export_graph(graph: PropertyGraph, path: str, since: int | None = None) -> dict[str, int]:
    """Backup as JSON lines in ``path``/nodes and /edges, with a manifest of counts.

    With ``since`` only rows whose ``version`` is greater are written: an incremental backup.
    """
    counts = {}
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        part = df if since is None else df.where(F.col("version") > since)
        part.write.json(f"{path}/{name}")
        part.sparkSession.createDataFrame([part._jdf.schema().toDDL()], "string").coalesce(1).write.text(f"{path}/{name}_schema")
        counts[name] = part.sparkSession.read.text(f"{path}/{name}").count()
    manifest = graph.nodes.sparkSession.createDataFrame(list(counts.items()), "name string, n long")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return counts


def import_graph(spark: SparkSession, path: str) -> PropertyGraph:
    read = lambda name: spark.read.schema(spark.read.text(f"{path}/{name}_schema").first()[0]).json(f"{path}/{name}")
    return PropertyGraph(read("nodes"), read("edges"))


def apply_increment(graph: PropertyGraph, path: str) -> PropertyGraph:
    """A graph with an incremental backup laid over it: newer rows of an id replace older ones."""
    newer = import_graph(graph.nodes.sparkSession, path)
    over = lambda old, new: old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    return PropertyGraph(over(graph.nodes, newer.nodes), over(graph.edges, newer.edges))


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """(name, expected, found, intact) of each part of a backup."""
    found = [(name, spark.read.text(f"{path}/{name}").count()) for name in ("nodes", "edges")]
    actual = spark.createDataFrame(found, "name string, found long")
    return spark.read.schema("name string, n long").json(f"{path}/manifest").join(actual, "name").select("name", F.col("n").alias("expected"), "found", (F.col("n") == F.col("found")).alias("intact"))
