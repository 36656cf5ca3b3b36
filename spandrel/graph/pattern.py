"""Pattern matching: a MATCH clause as joins that keep every variable."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.graph import traverse
from spandrel.graph.model import PropertyGraph


@dataclass(frozen=True)
class Node:
    name: str
    labels: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Hop:
    types: tuple[str, ...] = ()
    direction: str = "out"
    name: str | None = None
    low: int = 1
    high: int | None = 1
    properties: dict = field(default_factory=dict)

    @property
    def single(self) -> bool:
        return self.low == 1 and self.high == 1


def _test(properties: dict) -> Column | None:
    test = None
    for key, value in properties.items():
        one = F.col(key) == F.lit(value)
        test = one if test is None else test & one
    return test


def match(graph: PropertyGraph, elements: list, rows: DataFrame | None = None, distinct: str | None = None) -> DataFrame:
    """Rows of node ids (and edge structs) for a chain Node, Hop, Node, …

    Variables that ``rows`` binds are joined on; one that recurs in the chain must be the same node.
    Variable-length hops reach each node once, at its least depth, and bind
    ``<name>`` to that depth. ``distinct`` "edges" forbids one edge for two
    single hops of the chain, "nodes" one node for two of its variables.
    """
    if distinct == "edges":
        named = [h if isinstance(h, Node) or h.name or not h.single else replace(h, name=f"__hop{i}") for i, h in enumerate(elements)]
        hops = [h.name for h in named[1::2] if h.single]
        found = match(graph, named, rows)
        return differ(found, [f"{h}.id" for h in hops]).drop(*[h for h in hops if h.startswith("__hop")])
    if distinct == "nodes":
        return differ(match(graph, elements, rows), list(dict.fromkeys(e.name for e in elements[::2])))
    first = elements[0]
    now = _ids(graph, first).select(F.col("id").alias(first.name))
    for start, hop, end in zip(elements[::2], elements[1::2], elements[2::2]):
        target = end.name if end.name not in now.columns else f"__{end.name}"
        if hop.single:
            edge = hop.name or f"__e{len(now.columns)}"
            now = traverse.expand(graph, now, start.name, target, hop.direction, list(hop.types) or None, edge, end.labels, _test(end.properties), _test(hop.properties))
            if not hop.name:
                now = now.drop(edge)
        else:
            found = traverse.reach(graph, now.select(F.col(start.name).alias("id")).distinct(), hop.low, hop.high, hop.direction, list(hop.types) or None)
            allowed = _ids(graph, end).select(F.col("id").alias("node")) if end.labels or end.properties else None
            found = found if allowed is None else found.join(allowed, "node", "left_semi")
            depth = hop.name or "__depth"
            now = now.join(found.select(F.col("source").alias("__s"), F.col("node").alias(target), F.col("depth").alias(depth)), F.col(start.name) == F.col("__s")).drop("__s", *([] if hop.name else ["__depth"]))
        if target != end.name:
            now = now.where(F.col(target) == F.col(end.name)).drop(target)
    if rows is None:
        return now
    keys = [c for c in now.columns if c in rows.columns]
    return rows.join(now, keys) if keys else rows.crossJoin(now)


def differ(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which the columns differ pairwise."""
    for i, a in enumerate(columns):
        for b in columns[:i]:
            rows = rows.where(F.col(a) != F.col(b))
    return rows


def _ids(graph: PropertyGraph, node: Node) -> DataFrame:
    return graph.nodes_with(node.labels, _test(node.properties))


def match_all(graph: PropertyGraph, patterns: list[list]) -> DataFrame:
    """Comma-separated patterns, joined on shared variables."""
    rows = None
    for elements in patterns:
        part = match(graph, elements)
        if rows is None:
            rows = part
        else:
            keys = [c for c in part.columns if c in rows.columns]
            rows = rows.join(part, keys) if keys else rows.crossJoin(part)
    return rows


def optional_match(graph: PropertyGraph, rows: DataFrame, elements: list) -> DataFrame:
    """OPTIONAL MATCH: rows without a match keep NULL for the new variables."""
    part = match(graph, elements)
    keys = [c for c in part.columns if c in rows.columns]
    return rows.join(part, keys, "left")


def mandatory_match(graph: PropertyGraph, rows: DataFrame, elements: list) -> DataFrame:
    """MANDATORY MATCH: fails if nothing matches."""
    part = match(graph, elements)
    out = rows.join(part, [c for c in part.columns if c in rows.columns])
    if out.isEmpty():
        raise LookupError("mandatory pattern has no match")
    return out


def exists_pattern(graph: PropertyGraph, rows: DataFrame, elements: list, negate: bool = False) -> DataFrame:
    part = match(graph, elements)
    keys = [c for c in part.columns if c in rows.columns]
    return rows.join(part.select(*keys), keys, "left_anti" if negate else "left_semi")


def count_pattern(graph: PropertyGraph, rows: DataFrame, elements: list, name: str) -> DataFrame:
    part = match(graph, elements)
    keys = [c for c in part.columns if c in rows.columns]
    return rows.join(part.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def comprehension(graph: PropertyGraph, rows: DataFrame, elements: list, make: Column, name: str) -> DataFrame:
    """Pattern comprehension: a sorted list of ``make`` for each row; no match gives an empty list."""
    part = match(graph, elements)
    keys = [c for c in part.columns if c in rows.columns]
    lists = part.groupBy(*keys).agg(F.array_sort(F.collect_list(make)).alias(name))
    return rows.join(lists, keys, "left").withColumn(name, F.coalesce(name, F.array()))
