"""List and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import col, scalar


@scalar("range")
def range_(start, end, step=None) -> Column:
    """Both ends are included; two arguments count down if they must."""
    if step is None:
        return F.sequence(col(start), col(end))
    return F.when(F.signum(col(end) - col(start)) * F.signum(col(step)) >= 0, F.sequence(col(start), col(end), col(step))).otherwise(F.array().cast("array<int>"))


@scalar()
def size(value, kind: str = "list") -> Column:
    """Elements of a list; bytes of a text when ``kind`` is "string"."""
    return F.octet_length(col(value)) if kind == "string" else F.when(col(value).isNotNull(), F.size(col(value)))


@scalar()
def head(items) -> Column:
    return F.get(col(items), F.lit(0))


@scalar()
def tail(items) -> Column:
    return F.when(F.size(col(items)) > 0, F.slice(col(items), F.lit(2), F.greatest(F.size(col(items)), F.lit(1)))).otherwise(col(items))


@scalar()
def last(items) -> Column:
    return F.try_element_at(col(items), F.lit(-1))


@scalar()
def reverse(value) -> Column:
    return F.reverse(col(value))


@scalar()
def array_length(items, dimension: int = 1) -> Column:
    """NULL for an empty list or another dimension than 1."""
    return F.when(F.lit(dimension == 1) & (F.size(col(items)) > 0), F.size(col(items)))


@scalar()
def cardinality(items) -> Column:
    return F.when(col(items).isNotNull(), F.size(col(items)))


@scalar()
def array_append(items, value) -> Column:
    return F.array_append(col(items), col(value))


@scalar()
def array_prepend(value, items) -> Column:
    """The element comes first among the arguments."""
    return F.array_prepend(col(items), col(value))


@scalar()
def array_cat(a, b) -> Column:
    return F.concat(col(a), col(b))


@scalar()
def array_remove(items, value) -> Column:
    return F.filter(col(items), lambda v: ~v.eqNullSafe(col(value)))


@scalar()
def array_replace(items, old, new) -> Column:
    return F.transform(col(items), lambda v: F.when(v.eqNullSafe(col(old)), col(new)).otherwise(v))


@scalar()
def array_position(items, value) -> Column:
    """1-based; NULL if absent."""
    return F.nullif(F.array_position(col(items), col(value)), F.lit(0).cast("long"))


@scalar()
def array_positions(items, value) -> Column:
    return F.array_compact(F.transform(col(items), lambda v, i: F.when(v.eqNullSafe(col(value)), i + 1)))


@scalar()
def unnest(items) -> Column:
    """The first element, in a scalar place; rows come from ``operators.unwind``."""
    return head(items)


@scalar()
def subscript(items, i) -> Column:
    """1-based; out of range gives NULL."""
    return F.try_element_at(col(items), F.nullif(col(i), F.lit(0)))


def slice_(items, start, end) -> Column:
    """Elements from ``start`` (0-based) up to but without ``end``."""
    return F.slice(col(items), col(start) + 1, F.greatest(col(end) - col(start), F.lit(0)))


def comprehension(items, where=None, make=None) -> Column:
    """``[x IN items WHERE where(x) | make(x)]``; a NULL list gives NULL."""
    kept = F.filter(col(items), where) if where else col(items)
    return F.transform(kept, make) if make else kept


def all_(items, test) -> Column:
    return F.forall(col(items), test)


def any_(items, test) -> Column:
    return F.exists(col(items), test)


def none_(items, test) -> Column:
    return ~F.exists(col(items), test)


def single(items, test) -> Column:
    """Exactly one element fits; NULL when a test is NULL and fewer than two fit."""
    hits = F.size(F.filter(col(items), lambda x: F.coalesce(test(x), F.lit(False))))
    unknown = F.exists(col(items), lambda x: test(x).isNull())
    return F.when(col(items).isNull() | (F.coalesce(unknown, F.lit(False)) & (hits <= 1)), F.lit(None).cast("boolean")).otherwise(hits == 1)


def reduce_(start, items, step) -> Column:
    return F.aggregate(col(items), start, step)


def map_projection(source: Column, fields: list[str], **computed) -> Column:
    """``n {.a, .b, k: e}`` as a struct."""
    return F.struct(*[source[f].alias(f) for f in fields], *[col(v).alias(k) for k, v in computed.items()])
