"""Names of the scalar functions: ``FUNCTIONS[name]`` is a callable over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def scalar(*aliases: str):
    """Register a function under its own name (without a closing underscore) and ``aliases``."""

    def keep(function):
        for name in (function.__name__.rstrip("_"), *aliases):
            FUNCTIONS[name] = function
        return function

    return keep


def col(value) -> Column:
    """A column as it is, a string as a column name, anything else as a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def text(value) -> Column:
    """Like ``col``, but a plain string is a literal (patterns, delimiters, keys)."""
    return value if isinstance(value, Column) else F.lit(value)
