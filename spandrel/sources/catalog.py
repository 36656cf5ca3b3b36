"""Statistics over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("edge_type").alias("name")).agg(F.count("*").alias("n"))
