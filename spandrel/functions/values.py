"""Conversion, spatial, entity and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import col, scalar

EARTH_METRES = 6371000.0
GEOGRAPHIC, GEOGRAPHIC_3D, CARTESIAN, CARTESIAN_3D = 4326, 4979, 7203, 9157


@scalar("toBoolean")
def to_boolean(x, kind: str = "string") -> Column:
    """"true" and "false" in any case, numbers by being non-zero; else NULL."""
    if kind == "number":
        return col(x) != 0
    s = F.lower(F.trim(col(x).cast("string")))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


@scalar("toInteger")
def to_integer(x) -> Column:
    """Truncates toward zero; text that is no number gives NULL."""
    return col(x).try_cast("double").try_cast("bigint")


@scalar("toFloat")
def to_float(x) -> Column:
    return col(x).try_cast("double")


@scalar("toString")
def to_string(x, kind: str = "scalar") -> Column:
    """Lists become ``[a, b]``."""
    if kind == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(col(x), lambda v: v.cast("string")), ", ", "null"), F.lit("]"))
    return col(x).cast("string")


@scalar()
def to_number(s, pattern=None) -> Column:
    """Drops everything but digits, sign and point; parentheses mean negative."""
    bare = F.regexp_replace(col(s), "[^0-9.-]", "").try_cast("double")
    return F.when(F.rlike(col(s), F.lit(r"^\s*\(.*\)\s*$")), -bare).otherwise(bare)


@scalar()
def to_text(x, pattern: str) -> Column:
    """A number right-aligned or zero-filled to the width of the 9s and 0s in ``pattern``."""
    whole, _, part = pattern.partition(".")
    width, decimals = sum(c in "90" for c in whole), sum(c in "90" for c in part)
    body = F.format_string(f"%.{decimals}f", col(x).cast("double"))
    total = width + (decimals + 1 if decimals else 0)
    return F.when(F.length(body) >= total, body).otherwise(F.lpad(body, total, "0" if whole.lstrip(",").startswith("0") else " "))


@scalar()
def point(x=None, y=None, z=None, srid: int | None = None, longitude=None, latitude=None, height=None) -> Column:
    """Struct (x, y, z, srid); latitude and longitude give a geographic point."""
    if longitude is not None:
        srid = srid or (GEOGRAPHIC if height is None else GEOGRAPHIC_3D)
        x, y, z = longitude, latitude, height
    code = srid or (CARTESIAN if z is None else CARTESIAN_3D)
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), (F.lit(None) if z is None else col(z)).cast("double").alias("z"), F.lit(code).alias("srid"))


@scalar("point.distance")
def point_distance(a, b) -> Column:
    """Metres along the sphere for geographic points, Euclidean otherwise; mixed systems give NULL."""
    p, q = col(a), col(b)
    half = lambda m, n: F.pow(F.sin((F.radians(n) - F.radians(m)) / 2), F.lit(2.0))
    h = half(p["y"], q["y"]) + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * half(p["x"], q["x"])
    sphere = F.lit(2 * EARTH_METRES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    square = lambda f: F.pow(F.coalesce(p[f], F.lit(0.0)) - F.coalesce(q[f], F.lit(0.0)), F.lit(2.0))
    flat = F.sqrt(square("x") + square("y") + square("z"))
    return F.when(p["srid"] == q["srid"], F.when(p["srid"].isin(GEOGRAPHIC, GEOGRAPHIC_3D), sphere).otherwise(flat))


@scalar("point.withinBBox")
def point_within_bbox(p, lower_left, upper_right) -> Column:
    """Bounds are included; mixed systems give NULL."""
    at, low, high = col(p), col(lower_left), col(upper_right)
    return F.when((at["srid"] == low["srid"]) & (at["srid"] == high["srid"]), at["x"].between(low["x"], high["x"]) & at["y"].between(low["y"], high["y"]))


# Entities are structs: nodes (id, labels, properties), edges (id, edge_type, src, dst, properties), paths (nodes, edges).


@scalar("type")
def edge_type(r) -> Column:
    return col(r)["edge_type"]


@scalar()
def labels(n) -> Column:
    return col(n)["labels"]


@scalar("id")
def entity_id(n) -> Column:
    return col(n)["id"]


@scalar()
def properties(n) -> Column:
    return col(n)["properties"]


@scalar()
def keys(n) -> Column:
    return F.array_sort(F.map_keys(col(n)["properties"]))


@scalar()
def nodes(path) -> Column:
    return col(path)["nodes"]


@scalar("rels")
def relationships(path) -> Column:
    return col(path)["edges"]


@scalar("startNode")
def start_node(r) -> Column:
    return col(r)["src"]


@scalar("endNode")
def end_node(r) -> Column:
    return col(r)["dst"]


@scalar("length(path)")
def path_length(path) -> Column:
    return F.size(col(path)["edges"])


def label_expression(labels_col, expression: str) -> Column:
    """Truth of a label expression: ``A``, ``A|B``, ``A&B``, ``!A``, ``%`` (any), with parentheses."""
    import re

    marks = re.findall(r"[A-Za-z_][A-Za-z_0-9]*|[|&!()%:]", expression)
    held = col(labels_col)

    def either():
        out = both()
        while marks and marks[0] in "|":
            marks.pop(0)
            if marks[0] == ":":
                marks.pop(0)
            out = out | both()
        return out

    def both():
        out = one()
        while marks and marks[0] in "&:":
            marks.pop(0)
            out = out & one()
        return out

    def one():
        mark = marks.pop(0)
        if mark == ":":
            return one()
        if mark == "!":
            return ~one()
        if mark == "(":
            out = either()
            marks.pop(0)
            return out
        return F.size(held) > 0 if mark == "%" else F.array_contains(held, mark)

    return either()
