"""Date and time functions, with SQL-style patterns where a format is asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.maths import divide
from spandrel.functions.registry import col, scalar, text

# Pattern parts of to_char / to_timestamp and the parts Spark takes, longest first.
PATTERN_PARTS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "Month": "MMMM", "MON": "MMM", "Mon": "MMM", "DDD": "DDD", "Day": "EEEE", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Dy": "EEE", "Q": "Q"}

_PARTS = re.compile("|".join(sorted(PATTERN_PARTS, key=len, reverse=True)))


def java_pattern(pattern: str) -> str:
    return _PARTS.sub(lambda m: PATTERN_PARTS[m[0]], pattern)


@scalar()
def now() -> Column:
    return F.current_timestamp()


@scalar()
def current_date() -> Column:
    return F.current_date()


@scalar()
def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS")


@scalar("date_part")
def extract(field: str, ts) -> Column:
    """DOUBLE; dow counts from Sunday = 0, week is ISO."""
    t, field = col(ts), field.lower()
    own = {
        "epoch": lambda: F.unix_micros(t.cast("timestamp")) / F.lit(1e6),
        "dow": lambda: F.dayofweek(t) - 1,
        "doy": lambda: F.dayofyear(t),
        "week": lambda: F.weekofyear(t),
        "second": lambda: F.second(t),
        "milliseconds": lambda: F.date_format(t, "ss").cast("int") * 1000 + F.date_format(t, "SSS").cast("int"),
        "microseconds": lambda: F.date_format(t, "ss").cast("int") * 1000000 + F.date_format(t, "SSSSSS").cast("int"),
    }
    plain = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}
    return (own[field]() if field in own else plain[field](t)).cast("double")


@scalar()
def date_trunc(field: str, ts) -> Column:
    return F.date_trunc(field, col(ts))


@scalar()
def to_timestamp(value, pattern: str | None = None) -> Column:
    """One argument: epoch seconds. Two: text and pattern; text that does not fit gives NULL."""
    return F.timestamp_seconds(col(value)) if pattern is None else F.try_to_timestamp(col(value), F.lit(java_pattern(pattern)))


@scalar()
def to_date(value, pattern: str) -> Column:
    return F.try_to_timestamp(col(value), F.lit(java_pattern(pattern))).cast("date")


@scalar()
def to_char(ts, pattern: str) -> Column:
    return F.date_format(col(ts), java_pattern(pattern))


@scalar()
def age(later, earlier=None) -> Column:
    """Text like ``1 year 2 mons 3 days 04:05:06`` without parts that are zero; one argument counts up to now.

    Years, months and days are those between the dates, where days borrow from
    the month before the later one (and stay negative if it is too short); the
    clock is the signed difference of the times of day. No difference gives ``00:00:00``.
    """
    end, start = (F.current_timestamp(), col(later)) if earlier is None else (col(later), col(earlier))
    end, start = end.cast("timestamp"), start.cast("timestamp")
    low, high = F.least(start, end), F.greatest(start, end)
    days = F.dayofmonth(high) - F.dayofmonth(low)
    borrowed = F.dayofmonth(F.last_day(F.add_months(high, -1)))
    months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + borrowed).otherwise(days)
    of_day = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    seconds = divide(of_day(high) - of_day(low), F.lit(1_000_000))
    clock = F.format_string("%02d:%02d:%02d", divide(seconds, F.lit(3600)), divide(seconds % 3600, F.lit(60)), seconds % 60)
    part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.lit(unit), F.when(n != 1, "s").otherwise("")))
    words = F.concat_ws(" ", part(F.floor(months / 12), "year"), part(F.pmod(months, F.lit(12)), "mon"), part(days, "day"), F.when(seconds != 0, clock))
    shown = F.when(words == "", F.lit("00:00:00")).otherwise(words)
    return F.when(low.isNotNull() & start.isNotNull() & end.isNotNull(), F.when(end < start, F.concat(F.lit("-"), shown)).otherwise(shown))


_AMOUNT = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*(year|month|mon|week|day|hour|minute|min|second|sec)s?", re.I)
_UNIT = {"year": "years", "month": "months", "mon": "months", "week": "weeks", "day": "days", "hour": "hours", "minute": "mins", "min": "mins", "second": "secs", "sec": "secs"}


def interval(words: str, sign: int = 1) -> Column:
    """Interval of text such as ``1 year 2 days 03:04:05``."""
    parts = {unit: 0.0 for unit in ("years", "months", "weeks", "days", "hours", "mins", "secs")}
    for amount, unit in _AMOUNT.findall(words):
        parts[_UNIT[unit.lower()]] += float(amount)
    clock = re.search(r"(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", words)
    if clock:
        for unit, amount in zip(("hours", "mins", "secs"), clock.groups(default="0")):
            parts[unit] += float(amount)
    whole = [F.lit(sign * int(parts[u])) for u in ("years", "months", "weeks", "days", "hours", "mins")]
    return F.make_interval(*whole, F.lit(sign * parts["secs"]).cast("decimal(18,6)"))


@scalar()
def date_add(ts, words: str) -> Column:
    return col(ts) + interval(words)


@scalar("date_sub")
def date_subtract(ts, words: str) -> Column:
    return col(ts) + interval(words, -1)


@scalar()
def make_timestamp(year, month=1, day=1, hour=0, minute=0, second=0) -> Column:
    return F.make_timestamp_ntz(col(year), col(month), col(day), col(hour), col(minute), col(second).cast("decimal(16,6)"))


@scalar()
def make_date(year, month, day) -> Column:
    return F.make_date(col(year), col(month), col(day))


@scalar()
def make_time(hour, minute, second) -> Column:
    """Text HH:MM:SS, with a fraction only if there is one."""
    whole = F.format_string("%02d:%02d:%02d", col(hour), col(minute), F.floor(col(second)))
    return F.when(col(second) == F.floor(col(second)), whole).otherwise(F.concat(whole, F.substring(F.format_string("%.6f", col(second).cast("double") - F.floor(col(second))), 2, 7)))


@scalar()
def timezone(zone, ts) -> Column:
    """Local time in ``zone`` of a UTC time."""
    return F.from_utc_timestamp(col(ts), text(zone))


# Cypher temporal values are ISO-8601 text, except dates and local times, which are typed.


def _parts(fields: dict, *names: str) -> list[Column]:
    start = {"year": 1970, "month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0}
    return [col(fields.get(n, start[n])) for n in names]


@scalar("datetime")
def cypher_datetime(value=None) -> Column:
    """ISO text with zone; a dict of fields is taken as UTC."""
    if value is None:
        moment = F.current_timestamp()
    elif isinstance(value, dict):
        moment = make_timestamp(*_parts(value, "year", "month", "day", "hour", "minute", "second")).cast("timestamp")
    else:
        moment = F.try_to_timestamp(col(value))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


@scalar("date")
def cypher_date(value=None) -> Column:
    if value is None:
        return F.current_date()
    return F.make_date(*_parts(value, "year", "month", "day")) if isinstance(value, dict) else F.try_to_timestamp(col(value)).cast("date")


@scalar("time")
def cypher_time(value=None) -> Column:
    if isinstance(value, dict):
        return F.concat(make_time(*_parts(value, "hour", "minute", "second")), F.lit("Z"))
    return F.date_format(F.current_timestamp() if value is None else F.try_to_timestamp(col(value)), "HH:mm:ssXXX")


@scalar("localdatetime")
def cypher_localdatetime(value=None) -> Column:
    if value is None:
        return F.localtimestamp()
    return make_timestamp(*_parts(value, "year", "month", "day", "hour", "minute", "second")) if isinstance(value, dict) else F.to_timestamp_ntz(col(value))


@scalar("localtime")
def cypher_localtime(value=None) -> Column:
    if isinstance(value, dict):
        return make_time(*_parts(value, "hour", "minute", "second"))
    return F.date_format(F.current_timestamp() if value is None else F.try_to_timestamp(col(value)), "HH:mm:ss")


@scalar("duration")
def cypher_duration(value) -> Column:
    """ISO-8601 text from a dict of years … seconds; text passes if it is a duration, else NULL."""
    if isinstance(value, dict):
        date = [F.when(col(value[k]) != 0, F.concat(col(value[k]).cast("string"), F.lit(s))).otherwise("") for k, s in (("years", "Y"), ("months", "M"), ("weeks", "W"), ("days", "D")) if k in value]
        time = [F.when(col(value[k]) != 0, F.concat(col(value[k]).cast("string"), F.lit(s))).otherwise("") for k, s in (("hours", "H"), ("minutes", "M"), ("seconds", "S")) if k in value]
        clock = F.concat(*time) if time else F.lit("")
        body = F.concat(*(date or [F.lit("")]), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
        return F.concat(F.lit("P"), F.when(body == "", F.lit("T0S")).otherwise(body))
    return F.when(F.rlike(col(value), F.lit(r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")), col(value))


def duration_between(earlier, later) -> Column:
    """ISO-8601 text of the time between two timestamps, in days and clock parts."""
    seconds = F.unix_timestamp(col(later).cast("timestamp")) - F.unix_timestamp(col(earlier).cast("timestamp"))
    days, rest = F.floor(F.abs(seconds) / 86400), F.pmod(F.abs(seconds), F.lit(86400))
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(""), F.format_string("P%dDT%dH%dM%dS", days, F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60))))


@scalar("datetime.truncate")
def datetime_truncate(unit: str, ts) -> Column:
    """Microsecond up to millennium."""
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(unit.lower())
    if years:
        base = F.year(col(ts)) - F.pmod(F.year(col(ts)), F.lit(years))
        return F.make_timestamp_ntz(base, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("timestamp")
    return F.date_trunc(unit, col(ts))
