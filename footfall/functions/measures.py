"""Buckets, rates and weights used by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from footfall.functions.times import col, ntz, seconds_between

# Bucket limits.
VIEWPORTS = [(576, "xs"), (768, "sm"), (992, "md"), (1200, "lg"), (1600, "xl")]
AGE_MONTHS = [(1, "a1"), (6, "a2"), (12, "a3"), (24, "a4")]
DERIVED = {
    "engagement_rate": "engaged_sessions",
    "bounce_rate": "bounces",
    "pages_per_session": "pageviews",
    "avg_engaged_time": "engaged_seconds",
    "avg_duration": "duration_seconds",
    "conversion_rate": "conversions",
}


def ratio(part: str | Column, whole: str | Column, places: int, empty=0.0) -> Column:
    """part / whole rounded half up; ``empty`` when there is nothing to divide by."""
    exact = col(part).cast("decimal(20,4)") / col(whole).cast("decimal(20,0)")
    return F.when(col(whole) > 0, F.round(exact, places).cast("double")).otherwise(F.lit(empty).cast("double"))


def derived_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({name: ratio(part, "sessions", 4) for name, part in DERIVED.items()})


def viewport_bucket(width: str | Column) -> Column:
    w = col(width).try_cast("int")
    out = F.when(w.isNull() | (w <= 0), "")
    for limit, name in VIEWPORTS:
        out = out.when(w < limit, name)
    return out.otherwise("xxl")


def language(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.rlike(r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8}){0,2}$"), F.left(c, F.lit(16))).otherwise("")


def timezone(df: DataFrame, zones: DataFrame, column: str = "tz") -> DataFrame:
    """Adds timezone: the reported zone if it is a row of ``zones(zone)``, else ''."""
    known = zones.select(F.col("zone").alias("_zone")).distinct()
    joined = df.join(known, F.col(column) == F.col("_zone"), "left")
    return joined.withColumn("timezone", F.coalesce("_zone", F.lit(""))).drop("_zone")


def age_bucket(published: str | Column, now) -> Column:
    """Age in 30-day months."""
    months = seconds_between(published, ntz(now)) / F.lit(30 * 86400)
    out = None
    for limit, name in AGE_MONTHS:
        out = F.when(months < limit, name) if out is None else out.when(months < limit, name)
    return out.otherwise("a5")


def heat_intensity(cells: DataFrame) -> DataFrame:
    """Weight of each cell of one heat map against the hottest (a map has at most 100 x 1000 cells)."""
    top = F.max("clicks").over(Window.partitionBy(F.lit(1)))
    return cells.withColumn(
        "intensity", F.least(F.lit(1.0), F.lit(0.2) + F.sqrt(F.col("clicks") / top) * F.lit(0.8))
    )


def percent(part: str | Column, whole: str | Column) -> Column:
    """Click-through rate in percent, two places."""
    exact = col(part).cast("decimal(20,0)") * 100 / col(whole).cast("decimal(20,0)")
    return F.when(col(whole) > 0, F.round(exact, 2).cast("double")).otherwise(F.lit(0.0))
