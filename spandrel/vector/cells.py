"""A stored approximate index: rows lie in folders by the cell of their nearest centre, and a search reads the cells near its query alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.vector import knn
from spandrel.vector.quantise import SAMPLE_ROWS, kmeans, squared_distances


class CellIndex:
    """Centres come from a bounded sample (``SAMPLE_ROWS``); every row with a vector of their length is written.

    Recall grows with ``probes``; as many probes as cells give the exact answer.
    On vectors without clusters the near rows spread over many cells.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.id_col, self.vector_col = id_col, vector_col
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        self.centres = np.array([r.centre for r in centres], dtype=float)

    @classmethod
    def build(cls, df: DataFrame, path: str, cells: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> CellIndex:
        spark = df.sparkSession
        held = df.where(F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, lambda x: x.isNull() | F.isnan(x)), F.lit(False)))
        sample = held.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).collect()
        if not sample:
            raise ValueError("no vectors")
        width = len(sample[0][0])
        points = np.array([r[0] for r in sample if len(r[0]) == width], dtype=float)
        centres = kmeans(points, min(cells, len(points)))

        halves = (centres**2).sum(axis=1) / 2

        # The square of the vector itself does not change the order of its centres.
        def nearest(vectors: pd.Series) -> pd.Series:
            return pd.Series((halves - np.stack(vectors.to_numpy()).astype(float) @ centres.T).argmin(axis=1))

        cell = F.pandas_udf(nearest, "int", F.PandasUDFType.SCALAR)(F.col(vector_col))
        coded = held.where(F.size(vector_col) == width).withColumn("cell", cell)
        # Rebalancing splits a large cell among tasks and joins small ones.
        coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return cls(spark, path, id_col, vector_col)

    def search(self, query: list[float], k: int, probes: int = 8, metric: str = "euclidean") -> DataFrame:
        """The ``k`` nearest rows of the ``probes`` nearest cells with their exact ``distance``."""
        order = squared_distances(np.asarray([query], dtype=float), self.centres)[0].argsort(kind="stable")
        near = [int(c) for c in order[:probes]]
        return knn.search(self.rows.where(F.col("cell").isin(near)).drop("cell"), query, k, metric, self.id_col, self.vector_col)
