"""Product quantisation for approximate search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.vector.distance import euclidean, literal_vector

SAMPLE_ROWS = 10_000


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each point to each centre."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None], 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """k-means++ start, then Lloyd rounds; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        pick = points[rng.choice(len(points), p=near / near.sum())] if near.sum() > 0 else points[rng.integers(len(points))]
        centres.append(pick)
        near = np.minimum(near, ((points - pick) ** 2).sum(axis=1))
    out = np.array(centres)
    for _ in range(rounds):
        mine = squared_distances(points, out).argmin(axis=1)
        for c in range(k):
            if (mine == c).any():
                out[c] = points[mine == c].mean(axis=0)
    return out


class ProductQuantiser:
    """Segments with a codebook each, fitted on a bounded sample; codes and distance tables are column expressions."""

    def __init__(self, df: DataFrame, vector_col: str = "embedding", segments: int = 8, centroids: int = 16, id_col: str = "vec_id"):
        rows = df.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).collect()
        sample = np.array([r[0] for r in rows], dtype=float)
        self.column, self.width = vector_col, sample.shape[1] // segments
        if sample.shape[1] % segments:
            raise ValueError("the dimension must be a multiple of the segments")
        self.books = [kmeans(sample[:, s * self.width : (s + 1) * self.width], min(centroids, len(sample))) for s in range(segments)]

    def encode(self, df: DataFrame, name: str = "codes") -> DataFrame:
        codes = []
        for s, book in enumerate(self.books):
            part = F.slice(self.column, s * self.width + 1, self.width)
            distances = F.array(*[euclidean(part, literal_vector(c)) for c in book])
            codes.append((F.array_position(distances, F.array_min(distances)) - 1).cast("int"))
        return df.withColumn(name, F.array(*codes))

    def search(self, coded: DataFrame, query: list[float], k: int, rerank: int = 20, id_col: str = "vec_id", codes: str = "codes") -> DataFrame:
        """Table distances first, then exact ones for the best ``k * rerank``."""
        q = np.asarray(query, dtype=float)
        near = F.lit(0.0)
        for s, book in enumerate(self.books):
            table = ((book - q[s * self.width : (s + 1) * self.width]) ** 2).sum(axis=1)
            near = near + F.get(F.array(*map(F.lit, map(float, table))), F.get(codes, F.lit(s)))
        best = coded.withColumn("__near", near).orderBy("__near", id_col).limit(k * rerank)
        return best.withColumn("distance", euclidean(self.column, literal_vector(query))).orderBy("distance", id_col).limit(k).drop("__near")
