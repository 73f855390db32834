"""Realtime reports over raw rows. ``now`` is an argument, so results do not depend on the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import ntz, plus_seconds, seconds_between
from footfall.sources.tables import since

MINUTES = 30
TOP = 6
FEED = 12
HIDDEN = ["page_engagement", "click"]


def _since(now, minutes: int):
    return plus_seconds(ntz(now), -60 * minutes)


def realtime_active(sessions: DataFrame, now, minutes: int = 5) -> DataFrame:
    rows = since(sessions, "last_seen_at", _since(now, minutes))
    return rows.agg(F.countDistinct("visitor_key").alias("active_visitors"))


def realtime_per_minute(events: DataFrame, now, minutes: int = MINUTES) -> DataFrame:
    """Page views per minute ago, 0 for quiet minutes, oldest first."""
    ago = F.floor(seconds_between("occurred_at", ntz(now)) / 60)
    rows = since(events, "occurred_at", _since(now, minutes)).where(F.col("event_name") == "page_view")
    counts = rows.groupBy(ago.cast("bigint").alias("ago")).agg(F.count("*").alias("views"))
    slots = events.sparkSession.range(minutes).select(F.col("id").alias("ago"))
    return slots.join(counts, "ago", "left").fillna(0, ["views"]).orderBy(F.desc("ago"))


def realtime_top_pages(events: DataFrame, now, limit: int = TOP) -> DataFrame:
    rows = since(events, "occurred_at", _since(now, MINUTES)).where(F.col("event_name") == "page_view")
    pages = rows.groupBy(F.col("page_path").alias("path")).agg(
        F.max("page_title").alias("title"), F.count("*").alias("views")
    )
    return pages.orderBy(F.desc("views"), "path").limit(limit)


def realtime_top_channels(sessions: DataFrame, now, limit: int = TOP) -> DataFrame:
    rows = since(sessions, "last_seen_at", _since(now, MINUTES))
    return rows.groupBy("channel").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "channel").limit(limit)


def realtime_feed(sessions: DataFrame, events: DataFrame, now, limit: int = FEED) -> DataFrame:
    """Newest events with their session's country and device. The rows are picked before the join, and only sessions
    seen as late as those events can be are read."""
    newest = (
        since(events, "occurred_at", _since(now, MINUTES)).where(~F.col("event_name").isin(HIDDEN))
        .orderBy(F.desc("event_id"))
        .limit(limit)
    )
    # An event is received after it occurred, and its session was last seen then or later.
    side = since(sessions, "last_seen_at", _since(now, MINUTES)).select("session_id", "country", "device_type")
    return newest.join(side, "session_id", "left").select(
        "event_id",
        F.col("event_name").alias("event"),
        F.col("page_path").alias("path"),
        F.greatest(F.lit(0), seconds_between("occurred_at", ntz(now))).cast("bigint").alias("seconds"),
        F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("device_type", F.lit("")).alias("device"),
    ).orderBy(F.desc("event_id"))


def volume_24h(sessions: DataFrame, events: DataFrame, now) -> DataFrame:
    day = plus_seconds(ntz(now), -86400)
    e = since(events, "occurred_at", day).agg(F.count("*").alias("n")).select(F.lit("events").alias("what"), "n")
    s = since(sessions, "started_at", day).agg(F.count("*").alias("n")).select(F.lit("sessions").alias("what"), "n")
    return e.unionByName(s)
