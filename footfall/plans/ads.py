"""Advertisement reports over raw events and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.measures import percent, ratio
from footfall.functions.times import plus_seconds, utc_midnight
from footfall.operators.events import MAX_DELAY_MS
from footfall.sources.tables import scan_events, since

IMPRESSION, CLICK = "ad_impression", "ad_click"


def ad_events(events: DataFrame, from_, to, tz: str) -> DataFrame:
    return scan_events(events, from_, to, tz).where(F.col("event_name").isin(IMPRESSION, CLICK))


def _per_session(events: DataFrame, from_, to, tz: str) -> DataFrame:
    """Impressions and clicks per session: the pre-aggregate every report below starts from."""
    return ad_events(events, from_, to, tz).groupBy("session_id").agg(
        F.sum((F.col("event_name") == IMPRESSION).cast("int")).alias("impressions"),
        F.sum((F.col("event_name") == CLICK).cast("int")).alias("clicks"),
    )


def _sessions_of(sessions: DataFrame, from_, to, tz: str) -> DataFrame:
    """Sessions that events of the days can belong to: seen no earlier than the first event, and started before the
    last one was received, which is at most the longest accepted delay later."""
    end = plus_seconds(utc_midnight(to, tz, 1), MAX_DELAY_MS // 1000)
    rows = since(sessions, "last_seen_at", utc_midnight(from_, tz)).where(F.col("started_at") <= end)
    return rows.where(F.col("event_date") <= F.to_date(end)) if "event_date" in sessions.columns else rows


def converting_sessions(events: DataFrame, sessions: DataFrame, from_, to, tz: str) -> DataFrame:
    """Converted sessions that have an ad click in the range."""
    clicked = _per_session(events, from_, to, tz).where((F.col("clicks") > 0) & (F.col("session_id") != 0))
    return _sessions_of(sessions, from_, to, tz).where(F.col("conversions") > 0).join(clicked.select("session_id"), "session_id", "left_semi")


def ad_visits(events: DataFrame, sessions: DataFrame, from_, to, tz: str) -> DataFrame:
    """Impressions, clicks, sessions with a click (unlinked ones count as one) and how many of those converted."""
    per = _per_session(events, from_, to, tz)
    converted = _sessions_of(sessions, from_, to, tz).where(F.col("conversions") > 0).select("session_id", F.lit(1).alias("_conv"))
    joined = per.join(converted, "session_id", "left")
    clicked = F.col("clicks") > 0
    out = joined.agg(
        F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum(clicked.cast("int")), F.lit(0)).alias("click_sessions"),
        F.coalesce(F.sum((clicked & (F.col("session_id") != 0) & F.col("_conv").isNotNull()).cast("int")), F.lit(0)).alias("converting_sessions"),
    )
    return out.withColumn("conversion_rate", ratio("converting_sessions", "click_sessions", 4))


def ad_channels(events: DataFrame, sessions: DataFrame, from_, to, tz: str, limit: int = 20) -> DataFrame:
    per = _per_session(events, from_, to, tz).join(_sessions_of(sessions, from_, to, tz).select("session_id", "channel"), "session_id")
    rows = per.groupBy("channel").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        F.sum((F.col("clicks") > 0).cast("int")).alias("sessions"),
    )
    return (
        rows.orderBy(F.desc("clicks"), F.desc("impressions"), "channel")
        .limit(limit)
        .withColumn("ctr", percent("clicks", "impressions"))
    )


def ad_pages(events: DataFrame, from_, to, tz: str, limit: int = 50) -> DataFrame:
    rows = ad_events(events, from_, to, tz).groupBy(F.col("page_path").alias("path")).agg(
        F.max("page_title").alias("title"),
        F.sum((F.col("event_name") == IMPRESSION).cast("int")).alias("impressions"),
        F.sum((F.col("event_name") == CLICK).cast("int")).alias("clicks"),
    )
    return (
        rows.orderBy(F.desc("clicks"), F.desc("impressions"), "path")
        .limit(limit)
        .withColumn("ctr", percent("clicks", "impressions"))
    )
