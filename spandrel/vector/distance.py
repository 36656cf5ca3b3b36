"""Distances between array columns, in double precision, as built-in expressions.

Arrays of different length give NULL; a zero vector has no cosine (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import FUNCTIONS, col, scalar


def literal_vector(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def _fold(a, b, step) -> Column:
    left, right = col(a).cast("array<double>"), col(b).cast("array<double>")
    total = F.aggregate(F.zip_with(left, right, step), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(left) == F.size(right), total)


@scalar("inner_product")
def dot(a, b) -> Column:
    return _fold(a, b, lambda x, y: x * y)


@scalar("euclidean_distance", "l2_distance", "<->")
def euclidean(a, b) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


@scalar("manhattan_distance", "l1_distance")
def manhattan(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


@scalar("chebyshev_distance")
def chebyshev(a, b) -> Column:
    left, right = col(a).cast("array<double>"), col(b).cast("array<double>")
    return F.when(F.size(left) == F.size(right), F.array_max(F.zip_with(left, right, lambda x, y: F.abs(x - y))))


@scalar()
def vector_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


@scalar()
def vector_dimension(v) -> Column:
    return F.when(col(v).isNotNull(), F.size(col(v)))


def cosine_similarity(a, b) -> Column:
    norms = vector_norm(a) * vector_norm(b)
    return F.when(norms > 0, dot(a, b) / norms)


@scalar("cosine_distance", "<=>")
def cosine(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def negative_dot(a, b) -> Column:
    """Inner product as a distance: smaller is nearer."""
    return -dot(a, b)


FUNCTIONS["<#>"] = dot
METRICS = {"euclidean": euclidean, "cosine": cosine, "inner_product": negative_dot, "manhattan": manhattan, "chebyshev": chebyshev}


@scalar("hamming_distance")
def hamming(a, b) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    both = F.zip_with(col(a).cast("array<long>"), col(b).cast("array<long>"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.when(F.size(col(a)) == F.size(col(b)), F.aggregate(both, F.lit(0).cast("long"), lambda acc, x: acc + x))


def hamming_normalised(a, b, bits: int | None = None) -> Column:
    return hamming(a, b) / (F.lit(float(bits)) if bits else F.size(col(a)) * 64.0)


def binary_jaccard(a, b) -> Column:
    """1 - |and| / |or| over bits; two empty ones are equal."""
    count = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + F.bit_count(x).cast("long"))
    left, right = col(a).cast("array<long>"), col(b).cast("array<long>")
    both, some = count(F.zip_with(left, right, lambda x, y: x.bitwiseAND(y))), count(F.zip_with(left, right, lambda x, y: x.bitwiseOR(y)))
    return F.when(F.size(left) == F.size(right), F.when(some == 0, F.lit(0.0)).otherwise(1 - both / some))


def binarise(v) -> Column:
    """Sign bits of a vector packed into 64-bit words."""
    signs = F.transform(col(v), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    words = F.sequence(F.lit(0), F.floor((F.size(col(v)) - 1) / 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(signs, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(s)))


def max_sim(query, document, cosine_form: bool = False) -> Column:
    """Sum over the query's vectors of the best inner product (or cosine) with the document's vectors."""
    near = cosine_similarity if cosine_form else dot
    best = F.transform(col(query), lambda q: F.array_max(F.transform(col(document), lambda d: near(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


FUNCTIONS["<##>"] = max_sim


def sparse_dot(a, b) -> Column:
    """Inner product of two maps from index to value."""
    return F.aggregate(F.map_keys(col(a)), F.lit(0.0), lambda acc, k: acc + F.try_element_at(col(a), k).cast("double") * F.coalesce(F.try_element_at(col(b), k).cast("double"), F.lit(0.0)))


def sparse_norm(a) -> Column:
    return F.sqrt(F.aggregate(F.map_values(col(a)), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def sparse_cosine(a, b) -> Column:
    norms = sparse_norm(a) * sparse_norm(b)
    return F.when(norms > 0, 1 - sparse_dot(a, b) / norms)


def sparse_euclidean(a, b) -> Column:
    return F.sqrt(F.greatest(F.pow(sparse_norm(a), F.lit(2.0)) + F.pow(sparse_norm(b), F.lit(2.0)) - 2 * sparse_dot(a, b), F.lit(0.0)))
