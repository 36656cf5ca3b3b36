"""Math functions; a value outside a function's domain gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import col, scalar


@scalar("abs")
def abs_(x) -> Column:
    return F.abs(col(x))


@scalar("ceiling")
def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


@scalar()
def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


@scalar("round")
def round_(x, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(col(x), digits)


def round_signed(x, digits: int = 0) -> Column:
    """Half away from zero; a negative double that becomes zero is -0.0, as in C, where Spark's own ``round`` has no such zero."""
    scale = F.lit(10.0**digits)
    return F.signum(col(x)) * F.round(F.abs(col(x)) * scale) / scale


@scalar()
def trunc(x, digits: int = 0) -> Column:
    """Toward zero."""
    scale = F.lit(10.0**digits)
    return F.signum(col(x)) * F.floor(F.abs(col(x)) * scale) / scale


@scalar()
def sqrt(x) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


@scalar("pow")
def power(a, b) -> Column:
    return F.pow(col(a), col(b))


@scalar()
def exp(x) -> Column:
    return F.exp(col(x))


@scalar()
def ln(x) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


@scalar()
def log10(x) -> Column:
    return F.when(col(x) > 0, F.log10(col(x)))


@scalar()
def log(base_or_x, x=None) -> Column:
    """One argument: base 10. Two: base, value."""
    if x is None:
        return log10(base_or_x)
    base = col(base_or_x)
    return F.when((base > 0) & (base != 1) & (col(x) > 0), F.ln(col(x)) / F.ln(base))


for _name in ("sin", "cos", "tan", "atan", "degrees", "radians"):

    def _plain(x, _f=getattr(F, _name)) -> Column:
        return _f(col(x))

    _plain.__name__ = _name
    globals()[_name] = scalar()(_plain)


@scalar()
def asin(x) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.asin(col(x)))


@scalar()
def acos(x) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.acos(col(x)))


@scalar()
def atan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


@scalar()
def sign(x) -> Column:
    return F.signum(col(x)).cast("int")


@scalar()
def pi() -> Column:
    return F.pi()


@scalar("rand")
def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def divide(a, b) -> Column:
    """Integers truncate, a zero divisor gives NULL."""
    return F.when(col(b) != 0, F.call_function("div", col(a), col(b)))


def divide_float(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def modulo(a, b) -> Column:
    return F.try_mod(col(a), col(b))
