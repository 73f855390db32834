"""Range scans over stored tables and the writers that feed them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import csv_safe
from footfall.functions.times import day_lit, utc_midnight
from footfall.sources.parts import PartTable


def between_instants(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Rows with start <= ts < end, UTC. Literal bounds reach the Parquet scan; on a table stored by event_date
    they also pick the partitions."""
    rows = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    if "event_date" in df.columns:
        rows = rows.where(F.col("event_date").between(F.to_date(start), F.to_date(end)))
    return rows


def between_days(df: DataFrame, ts: str, from_, to, tz: str) -> DataFrame:
    """Rows of the site-local days from..to, as a half-open range on the raw UTC column."""
    return between_instants(df, ts, utc_midnight(from_, tz), utc_midnight(to, tz, 1))


def scan_events(events: DataFrame, from_, to, tz: str) -> DataFrame:
    return between_days(events, "occurred_at", from_, to, tz)


def scan_sessions(sessions: DataFrame, from_, to, tz: str) -> DataFrame:
    return between_days(sessions, "started_at", from_, to, tz)


def scan_daily(table: DataFrame, from_, to) -> DataFrame:
    return table.where(F.col("day").between(day_lit(from_), day_lit(to)))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_fx_rates(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Exchange rates stored as ``parquet`` or as ``csv`` with a header."""
    from footfall.schemas import FX_RATES

    if form == "csv":
        return spark.read.schema(FX_RATES).option("header", True).csv(path)
    return spark.read.schema(FX_RATES).parquet(path)


def _drop_partitions(spark: SparkSession, path: str, column: str, values: Sequence) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for v in values:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)


def write_days(df: DataFrame, path: str, days: Sequence[date | str], column: str = "day", second: str | None = None) -> None:
    """Replaces whole days of a day-partitioned table; running it twice changes nothing.

    Listed days without rows end up empty. Rows are rebalanced by day before the write, which splits a
    day that is too big for one task and packs small ones. ``second`` names the inner partition column, if any.
    """
    wanted = [str(d) for d in days]
    keys = [column] if second is None else [column, second]
    seen = Observation()
    rows = df.where(F.col(column).cast("string").isin(wanted))
    place = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in keys])
    rows = rows.observe(seen, F.collect_set(place).alias("places"))  # dates of the listed days
    (
        rows.hint("rebalance", *[F.col(c) for c in keys])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    places, spark = set(seen.get["places"]), df.sparkSession
    present = {p.split("/")[0].split("=")[1] for p in places}
    _drop_partitions(spark, path, column, [d for d in wanted if d not in present])
    if second is not None:
        for d in present:
            inner = [n.split("=")[1] for n in _children(spark, f"{path}/{column}={d}", f"{second}=")]
            _drop_partitions(spark, f"{path}/{column}={d}", second, [n for n in inner if f"{column}={d}/{second}={n}" not in places])


def append_events(df: DataFrame, path: str, ts: str = "occurred_at") -> None:
    """Appends event rows under event_date=YYYY-MM-DD."""
    (
        df.withColumn("event_date", F.to_date(ts))
        .hint("rebalance", F.col("event_date"))
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def append_sessions(df: DataFrame, path: str) -> None:
    """Appends session rows under the dates of their start (event_date) and of their last row (seen_date)."""
    (
        df.withColumns({"event_date": F.to_date("started_at"), "seen_date": F.to_date("last_seen_at")})
        .hint("rebalance", F.col("event_date"), F.col("seen_date"))
        .write.mode("append")
        .partitionBy("event_date", "seen_date")
        .parquet(path)
    )


def since(df: DataFrame, ts: str, at: Column) -> DataFrame:
    """Rows with ts >= at. On a stored table the date partition of that time is used too, so older ones are not read."""
    rows = df.where(F.col(ts) >= at)
    part = {"last_seen_at": "seen_date"}.get(ts, "event_date")
    return rows.where(F.col(part) >= F.to_date(at)) if part in df.columns else rows


def merge_counters(
    old: DataFrame | None, delta: DataFrame, keys: Sequence[str], sums: Sequence[str], last: dict[str, str] | None
) -> DataFrame:
    """Stored counters plus a delta. ``last`` maps a column to the time column that decides which value stays."""
    rows = delta if old is None else old.select(delta.columns).unionByName(delta)
    last = last or {}
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, t).alias(c) for c, t in last.items() if c != t],
        *[F.max(t).alias(t) for t in sorted(set(last.values()))],
    ).select(delta.columns)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if n.startswith(prefix))


def upsert_counters(
    batch_df: DataFrame,
    path: str,
    keys: Sequence[str],
    sums: Sequence[str],
    last: dict[str, str] | None = None,
    batch_id: int | None = None,
    query_id: str = "batch",
    partition: str = "day",
) -> None:
    """Inserts or increments counters: adds to the days of this batch what it counts.

    With ``batch_id`` a batch that is delivered again, after success or after a failure at any point, counts once: the table
    keeps the number of the last batch of each query. ``query_id`` tells queries apart; a stream that starts with a fresh
    checkpoint numbers its batches anew and needs a new one. Without ``batch_id`` every call adds. ``read_counters`` sums
    what was added and ``compact_counters`` merges it.
    """
    rows = merge_counters(None, batch_df, keys, sums, last)
    PartTable(batch_df.sparkSession, path, partition).append(rows, query_id, batch_id)


def _complete(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def batches(spark: SparkSession, path: str, inner: str = "") -> list[int]:
    """Numbers of the ``batch=`` folders that are complete, or whose folder ``inner`` is."""
    names = _children(spark, path, "batch=")
    return sorted(int(n.split("=")[1]) for n in names if _complete(spark, f"{path}/{n}/{inner}".rstrip("/")))


def drop_batches(spark: SparkSession, path: str, numbers: Sequence[int]) -> None:
    _drop_partitions(spark, path, "batch", [str(n) for n in numbers])


def read_counters(
    spark: SparkSession, path: str, schema, keys: Sequence[str], sums: Sequence[str], last: dict[str, str] | None = None, partition: str = "day"
) -> DataFrame:
    """The counters as they stand; an empty table when nothing was written."""
    return merge_counters(None, PartTable(spark, path, partition).read(schema=schema), keys, sums, last)


def compact_counters(
    spark: SparkSession, path: str, schema, keys: Sequence[str], sums: Sequence[str], last: dict[str, str] | None = None, partition: str = "day",
    most: int = 1, seconds: float = 3600,
) -> list[str]:
    """Merges the days that more than ``most`` batches have added to, and returns them; other days keep their files. Files that
    are no longer part of the table are deleted when they are ``seconds`` old."""
    table = PartTable(spark, path, partition)
    days = table.compact(lambda rows: merge_counters(None, rows, keys, sums, last), most)
    table.vacuum(seconds=seconds)
    return days


# Columns of the exported reports, in order.
EXPORTS: dict[str, list[str]] = {
    "daily": [
        "day", "visitors", "sessions", "engaged_sessions", "bounces", "pageviews", "events", "conversions",
        "revenue", "engaged_seconds", "duration_seconds", "new_visitors", "returning_visitors",
    ],
    "dimension": [
        "value", "sessions", "visitors", "engaged_sessions", "engagement_rate", "pageviews", "conversions",
        "conversion_rate", "revenue", "avg_engaged_time",
    ],
    "content": [
        "label", "pageviews", "visitors", "entrances", "exits", "exit_rate", "avg_engaged_time", "conversions",
    ],
    "events": ["event", "category", "events", "sessions", "value", "is_conversion"],
    "search": [
        "term", "searches", "sessions", "zero_results", "avg_results", "results_page", "form", "live", "last_day",
    ],
    "ads": ["ad_id", "name", "campaign", "status", "impressions", "clicks", "ctr"],
    "audit": [
        "url", "title", "status_code", "response_ms", "words", "inlinks", "errors", "warnings", "notices",
        "pageviews",
    ],
}


def export_rows(df: DataFrame, report: str, limit: int | None = None) -> DataFrame:
    rows = df.select(*EXPORTS[report])
    return csv_safe(rows if limit is None else rows.limit(limit))


def export_csv(df: DataFrame, report: str, path: str, limit: int | None = None, files: int | None = None) -> None:
    """Writes a report as UTF-8 CSV files with a header each: every row, in as many files as there are tasks, unless
    ``limit`` rows or a number of ``files`` is asked for."""
    rows = export_rows(df, report, limit)
    (
        (rows if files is None else rows.coalesce(files))
        .write.mode("overwrite")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .csv(path)
    )


