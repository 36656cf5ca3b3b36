"""String functions. NULL arguments give NULL except where said."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import col, scalar, text

BLANK = r"[\s\p{Z}]+"


@scalar()
def upper(s) -> Column:
    return F.upper(col(s))


@scalar()
def lower(s) -> Column:
    return F.lower(col(s))


@scalar("char_length")
def length(s) -> Column:
    return F.length(col(s))


@scalar()
def concat(*parts) -> Column:
    """NULL parts count as empty text; never NULL."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


@scalar("substr")
def substring(s, start, size=None) -> Column:
    """1-based; a start below 1 counts as 1, one past the end gives empty text."""
    at = F.greatest(col(start), F.lit(1))
    return F.substring(col(s), at, F.length(col(s)) if size is None else F.greatest(col(size), F.lit(0)))


@scalar()
def trim(s) -> Column:
    return F.regexp_replace(col(s), f"^{BLANK}|{BLANK}$", "")


@scalar()
def ltrim(s) -> Column:
    return F.regexp_replace(col(s), f"^{BLANK}", "")


@scalar()
def rtrim(s) -> Column:
    return F.regexp_replace(col(s), f"{BLANK}$", "")


def _pad(pad, s, n, fill) -> Column:
    short = F.length(col(s)) >= col(n)
    return F.when(col(n) <= 0, F.lit("")).when(short | (text(fill) == ""), F.left(col(s), col(n))).otherwise(pad(col(s), col(n), text(fill)))


@scalar()
def lpad(s, n, fill=" ") -> Column:
    """Cuts on the right when longer; no room gives empty text, an empty fill pads nothing."""
    return _pad(F.lpad, s, n, fill)


@scalar()
def rpad(s, n, fill=" ") -> Column:
    return _pad(F.rpad, s, n, fill)


@scalar()
def replace(s, old, new) -> Column:
    return F.replace(col(s), text(old), text(new))


@scalar("strpos")
def position(s, part) -> Column:
    """1-based place in characters, 0 if absent."""
    return F.position(text(part), col(s))


@scalar()
def concat_ws(separator, *parts) -> Column:
    """Skips NULL parts; a NULL separator gives NULL."""
    joined = [F.when(col(p).isNotNull(), col(p).cast("string")) for p in parts]
    return F.when(text(separator).isNotNull(), F.array_join(F.array_compact(F.array(*joined)), separator) if isinstance(separator, str) else F.concat_ws("\0", *joined))


@scalar()
def split_part(s, delimiter, n) -> Column:
    """1-based; a place below 1 or past the end gives empty text."""
    return F.when(col(n) < 1, F.when(col(s).isNotNull(), F.lit(""))).otherwise(F.split_part(col(s), text(delimiter), F.greatest(col(n), F.lit(1))))


@scalar("format")
def format_(template: str, *values) -> Column:
    """Fills ``%s`` from left to right."""
    return F.format_string(template, *[col(v).cast("string") for v in values])


@scalar()
def regexp_match(s, pattern: str) -> Column:
    """First capture group if the pattern has one, else the whole match; NULL without a match."""
    group = 1 if re.compile(pattern).groups else 0
    return F.when(F.rlike(col(s), F.lit(pattern)), F.regexp_extract(col(s), pattern, group))


@scalar()
def regexp_replace(s, pattern, replacement) -> Column:
    """Replaces every match."""
    return F.regexp_replace(col(s), text(pattern), text(replacement))


@scalar()
def left(s, n) -> Column:
    """A negative count gives empty text."""
    return F.left(col(s), F.greatest(col(n), F.lit(0)))


@scalar()
def right(s, n) -> Column:
    return F.right(col(s), F.greatest(col(n), F.lit(0)))


@scalar()
def coalesce(*values) -> Column:
    return F.coalesce(*[col(v) for v in values])


@scalar()
def nullif(a, b) -> Column:
    return F.nullif(col(a), col(b))


@scalar()
def starts_with(s, prefix) -> Column:
    return F.startswith(col(s), text(prefix))


@scalar()
def ends_with(s, suffix) -> Column:
    return F.endswith(col(s), text(suffix))


@scalar()
def contains(s, part) -> Column:
    return F.contains(col(s), text(part))
