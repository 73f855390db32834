"""Time helpers. Instants are ``timestamp_ntz`` holding UTC, so nothing depends on the session zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ntz(value) -> Column:
    """Literal or column as a UTC ``timestamp_ntz``."""
    c = value if isinstance(value, Column) else F.lit(str(value))
    return c.cast("timestamp_ntz")


def day_lit(value: str | date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from start to end."""
    gap = (col(end) - col(start)).cast("interval second")
    return F.floor(gap.cast("decimal(18,6)")).cast("bigint")


def epoch_seconds(ts: str | Column) -> Column:
    return seconds_between(ntz(EPOCH), ts)


def epoch_millis(ts: str | Column) -> Column:
    gap = (col(ts) - ntz(EPOCH)).cast("interval second")
    return F.floor(gap.cast("decimal(18,6)") * 1000).cast("bigint")


def plus_seconds(ts: str | Column, seconds: int | Column) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return col(ts) + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def to_second(ts: str | Column) -> Column:
    return plus_seconds(ntz(EPOCH), epoch_seconds(ts))


def local_time(ts: str | Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(ts))


def local_day(ts: str | Column, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def utc_midnight(day: str | date | Column, tz: str, plus_days: int = 0) -> Column:
    """UTC instant at which a site-local day starts (folds to a literal for literal days)."""
    d = F.date_add(day_lit(day), plus_days) if plus_days else day_lit(day)
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), d.cast("timestamp_ntz"))


def shift_months(day: str | date | Column, months: int) -> Column:
    """Date arithmetic that overflows: 31 March minus one month is 3 March, not the last of February."""
    d = day_lit(day)
    first = F.add_months(F.trunc(d, "month"), months)
    return F.date_add(first, F.dayofmonth(d) - 1)
