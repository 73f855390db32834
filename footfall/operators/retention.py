"""Retention of raw and aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import local_day, ntz, seconds_between, shift_months
from footfall.runtime import stored
from footfall.sources.tables import write_days

RAW = {"events": "occurred_at", "sessions": "started_at"}
DAILY = [
    "daily_traffic", "daily_dimensions", "daily_content", "daily_events", "daily_searches", "heatmap_daily",
    "crawler_daily",
]


def retain(
    tables: dict[str, DataFrame], now: str, tz: str = "UTC", raw_months: int = 13, aggregate_months: int = 0
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, rows dropped per table). Zero months keeps everything of that kind.

    On a table stored by event_date the cut-off's date is compared too: what is kept is not read for the count, and
    what is old not for the rest. ``drop_old`` deletes on disk.
    """
    kept, counts = dict(tables), []
    n = ntz(now)
    time_of_day = seconds_between(F.to_date(n).cast("timestamp_ntz"), n)
    for name, df in tables.items():
        if name in RAW and raw_months > 0:
            at = shift_months(F.to_date(n), -raw_months).cast("timestamp_ntz") + F.make_dt_interval(
                secs=time_of_day.cast("decimal(18,6)")
            )
            old, kept_days, old_days = F.col(RAW[name]) < at, F.lit(True), F.lit(True)
            if "event_date" in df.columns:
                kept_days, old_days = F.col("event_date") >= F.to_date(at), F.col("event_date") <= F.to_date(at)
        elif name in DAILY and aggregate_months > 0:
            shifted = shift_months(F.to_date(n), -aggregate_months).cast("timestamp_ntz") + F.make_dt_interval(
                secs=time_of_day.cast("decimal(18,6)")
            )
            old, kept_days, old_days = F.col("day") < local_day(shifted, tz), F.lit(True), F.lit(True)
        else:
            continue
        kept[name] = df.where(~old & kept_days)
        counts.append(df.where(old & old_days).agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted"))
    if not counts:
        spark = next(iter(tables.values())).sparkSession
        return kept, spark.createDataFrame([], "table string, deleted bigint")
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return kept, out


def drop_old(spark: SparkSession, path: str, table: str, now: str, months: int, tz: str = "UTC") -> int:
    """Deletes what ``retain`` would not keep from a table stored by event_date (raw) or day, and returns the number of
    rows. Whole old partitions are dropped; the one that the cut-off goes through is written anew."""
    raw = table in RAW
    column = "event_date" if raw else "day"
    df = spark.read.parquet(path)
    kept, counts = retain({table: df}, now, tz, months if raw else 0, 0 if raw else months)
    gone = counts.collect()[0]["deleted"] if months > 0 else 0
    if gone:
        old = df.join(kept[table].select(column).distinct(), column, "left_anti").select(column).distinct()
        days = [r[0] for r in old.collect()]  # days of the table
        first = kept[table].agg(F.min(column)).first()[0]
        rows = stored(kept[table].where(F.col(column) == F.lit(first)), "border")
        second = "seen_date" if "seen_date" in df.columns else None
        write_days(rows, path, [*days, *([first] if first is not None else [])], column, second)
    return gone
