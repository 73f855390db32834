"""Daily rollups. Every function covers all days of its input in one job keyed by day; there is no loop.

A rollup has two steps. The first groups by day, key and whatever is counted once (visitor, session, page view); such rows can be
added up over several inputs (``PARTS``, ``merge_part``). The second turns them into the table. Sessions may have a column
``sign``: 1 for a row as it is now, -1 for what earlier parts hold of the same session, so that a session that goes on is
counted with its new totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import normalize_term
from footfall.functions.times import day_lit, epoch_seconds, local_day, utc_midnight
from footfall.operators.scans import deal_by, tasks_for
from footfall.sources.tables import between_days, between_instants

QUARTER_HOUR = 900
DAY = 86400
ENGAGED_CAP = 1800

MONEY = "decimal(18,4)"
SIGN = "sign"


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def _on_days(df: DataFrame, days: Sequence | None) -> DataFrame:
    return df if days is None else df.where(F.col("day").cast("string").isin([str(d) for d in days]))


def _signed(df: DataFrame, value: str | Column) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return c * F.col(SIGN) if SIGN in df.columns else c


def _visitors(having: str = "sessions") -> Column:
    """Visitors of the group, those that ``having`` counts."""
    return F.count(F.when(F.col(having) > 0, F.col("visitor_key")))


def visitor_days(sessions: DataFrame, tz: str) -> DataFrame:
    """Sessions by day and visitor: grouping by visitor first gives the three distinct counts without expanding rows."""

    def total(value: str | Column, name: str) -> Column:
        return F.sum(_signed(sessions, value)).cast("bigint").alias(name)

    return (
        sessions.withColumn("day", local_day("started_at", tz))
        .groupBy("day", "visitor_key")
        .agg(
            total(F.lit(1), "sessions"),
            total("is_engaged", "engaged_sessions"),
            total(((F.col("pageviews") <= 1) & (F.col("is_engaged") == 0)).cast("int"), "bounces"),
            total("engaged_seconds", "engaged_seconds"),
            total("duration_seconds", "duration_seconds"),
            total(F.when(F.col("is_returning") == 0, 1), "new_sessions"),
            total(F.when(F.col("is_returning") == 1, 1), "returning_sessions"),
        )
    )


def traffic_of_visitors(per_visitor: DataFrame) -> DataFrame:
    return per_visitor.groupBy("day").agg(
        _visitors().alias("visitors"),
        *[F.sum(c).alias(c) for c in ("sessions", "engaged_sessions", "bounces", "engaged_seconds", "duration_seconds")],
        _visitors("new_sessions").alias("new_visitors"),
        _visitors("returning_sessions").alias("returning_visitors"),
    )


def traffic_sessions(sessions: DataFrame, tz: str) -> DataFrame:
    """Session half of the daily traffic."""
    return traffic_of_visitors(visitor_days(sessions, tz))


def traffic_events(events: DataFrame, tz: str) -> DataFrame:
    """Event half: counts by the event's own day."""
    return (
        events.withColumn("day", local_day("occurred_at", tz))
        .groupBy("day")
        .agg(
            F.count("*").alias("events"),
            F.sum((F.col("event_name") == "page_view").cast("int")).alias("pageviews"),
            F.sum("is_conversion").cast("bigint").alias("conversions"),
            _money(F.when(F.col("is_conversion") == 1, F.col("event_value_base"))).alias("revenue"),
        )
    )


def daily_traffic(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    """A day appears when it has a session or an event. Both halves are a row per day, so the join is tiny."""
    return traffic_of(visitor_days(sessions, tz), traffic_events(events, tz))


def traffic_of(per_visitor: DataFrame, per_day: DataFrame) -> DataFrame:
    out = traffic_of_visitors(per_visitor).join(per_day, "day", "full")
    zero = [c for c in out.columns if c not in ("day", "revenue")]
    return out.select(
        "day",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in zero],
        F.coalesce("revenue", F.lit(0)).cast(MONEY).alias("revenue"),
    )


def session_revenue(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    """Converted value per session within its start day and the 24 hours after that day ends.

    Conversions are first summed per session and quarter hour (day limits of every zone fall on those), so
    the join moves one row per session and quarter hour, not one per event.
    """
    conv = (
        events.where((F.col("is_conversion") == 1) & (F.col("session_id") != 0))
        .withColumn("_q", F.floor(epoch_seconds("occurred_at") / QUARTER_HOUR))
        .groupBy("session_id", "_q")
        .agg(F.sum("event_value_base").alias("_v"))
    )
    day = local_day("started_at", tz)
    bounds = sessions.select(
        "session_id",
        epoch_seconds(utc_midnight(day, tz)).alias("_from"),
        (epoch_seconds(utc_midnight(day, tz, 1)) + DAY).alias("_to"),
    )
    at = F.col("_q") * QUARTER_HOUR
    return (
        conv.join(bounds, "session_id")
        .where((at >= F.col("_from")) & (at < F.col("_to")))
        .groupBy("session_id")
        .agg(_money(F.col("_v")).alias("revenue"))
    )


def with_revenue(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    if SIGN not in sessions.columns:
        return sessions.join(session_revenue(sessions, events, tz), "session_id", "left")
    now = F.col(SIGN) > 0  # the events belong to sessions as they are now
    rows = sessions.join(session_revenue(sessions.where(now), events, tz), "session_id", "left")
    return rows.withColumn("revenue", F.when(now, F.col("revenue")))


DOT = " · "


def dimension_values() -> dict[str, Column]:
    """Label of a session under each dimension; NULL leaves the session out of that dimension."""

    def or_else(name: str, fallback: str, lower: bool = False) -> Column:
        v = F.lower(name) if lower else F.col(name)
        return F.when(F.col(name) != "", v).otherwise(fallback)

    source = (
        F.when(F.col("utm_source") != "", F.lower("utm_source"))
        .when(F.col("referrer_domain") != "", F.col("referrer_domain"))
        .otherwise("(direct)")
    )
    return {
        "channel": or_else("channel", "direct"),
        "source": source,
        "medium": or_else("utm_medium", "(none)", lower=True),
        "campaign": F.when(F.col("utm_campaign") != "", F.col("utm_campaign")),
        "referrer": F.when(F.col("referrer_domain") != "", F.col("referrer_domain")),
        "landing_page": F.col("landing_path"),
        "country": or_else("country", "(unknown)"),
        "region": F.when(F.col("region") != "", F.concat("country", F.lit(DOT), "region")),
        "city": F.when(F.col("city") != "", F.concat("country", F.lit(DOT), "city")),
        "device": or_else("device_type", "(unknown)"),
        "browser": or_else("browser", "(unknown)"),
        "os": or_else("os", "(unknown)"),
        "language": or_else("language", "(unknown)", lower=True),
        "viewport": or_else("viewport", "(unknown)"),
        "visitor_type": F.when(F.col("is_returning") == 1, "returning")
        .when(F.col("is_returning") == 0, "new")
        .otherwise("unknown"),
    }


DIMENSIONS = [
    "channel", "source", "medium", "campaign", "referrer", "landing_page", "country", "region", "city", "device",
    "browser", "os", "language", "viewport", "visitor_type",
]


def explode_dimensions(sessions: DataFrame) -> DataFrame:
    """One row per session and dimension: a single scan instead of fifteen."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in dimension_values().items()]
    )
    others = [c for c in sessions.columns]
    return (
        sessions.select(*others, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_d"))
        .select(*others, "_d.dimension", "_d.value")
    )


SESSION_SUMS = ["sessions", "engaged_sessions", "pageviews", "engaged_seconds", "conversions"]


def dimension_visitors(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    """Sessions by day, visitor and all their labels, a column for each dimension: about a row a session, not fifteen.

    Rows are dealt by day and visitor, which ``dimensions_of`` keeps: what it makes of a row stays in the task. There are
    tasks for the number of sessions, which are counted: hand in stored ones."""
    tasks = tasks_for(sessions)
    rows = with_revenue(sessions, events, tz).withColumn("day", local_day("started_at", tz))
    sums = [F.lit(1).alias("sessions"), F.col("is_engaged").alias("engaged_sessions"), "pageviews", "engaged_seconds", "conversions"]
    wide = rows.select(
        "day", "visitor_key", *[v.alias(n) for n, v in dimension_values().items()], *sums, "revenue", *[SIGN] * (SIGN in rows.columns)
    )
    return deal_by(wide, ("day", "visitor_key"), tasks).groupBy("day", "visitor_key", *DIMENSIONS).agg(
        *[F.sum(_signed(wide, c)).alias(c) for c in SESSION_SUMS], F.sum("revenue").alias("revenue")
    )


def daily_dimensions(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    """Sessions by day, dimension and value."""
    return dimensions_of(dimension_visitors(sessions, events, tz))


def dimensions_of(per_visitor: DataFrame) -> DataFrame:
    """The visitor in the first key both spreads a value that most sessions share and makes the distinct count a plain count
    afterwards. Rows dealt by day and visitor are not dealt again for it."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in DIMENSIONS])
    long = per_visitor.select(
        "day", "visitor_key", *SESSION_SUMS, "revenue", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_d")
    ).select("day", "visitor_key", "_d.dimension", "_d.value", *SESSION_SUMS, "revenue")
    each = long.groupBy("day", "visitor_key", "dimension", "value").agg(*[F.sum(c).alias(c) for c in (*SESSION_SUMS, "revenue")])
    return (
        each.groupBy("day", "dimension", "value")
        .agg(
            _visitors().alias("visitors"),
            *[F.sum(c).cast("bigint").alias(c) for c in SESSION_SUMS],
            _money(F.col("revenue")).alias("revenue"),
        )
        .withColumn("value_hash", F.md5("value"))
        .withColumn("value", F.left("value", F.lit(191)))
    )


def page_reads(events: DataFrame, tz: str) -> DataFrame:
    """The highest engaged seconds of each page view."""
    seconds = F.get_json_object("attributes", "$.engaged_seconds").try_cast("double")
    return (
        events.where(F.col("event_name") == "page_engagement")
        .select(
            local_day("occurred_at", tz).alias("day"),
            F.col("page_path").alias("path"),
            "session_id",
            F.get_json_object("attributes", "$.pv").alias("pv"),
            F.floor(seconds).cast("bigint").alias("secs"),
        )
        .groupBy("day", "path", "session_id", "pv")
        .agg(F.max("secs").alias("top"))
    )


def page_engagement(events: DataFrame, tz: str, cap: int | None = ENGAGED_CAP) -> DataFrame:
    """Engaged seconds per day and path: the highest value of each page view, at most ``cap`` (None: any), then summed."""
    return engagement_of(page_reads(events, tz), cap)


def engagement_of(per_view: DataFrame, cap: int | None = ENGAGED_CAP) -> DataFrame:
    capped = F.when(F.col("top").isNotNull(), F.col("top") if cap is None else F.least("top", F.lit(cap)))
    return per_view.groupBy("day", "path").agg(
        F.coalesce(F.sum(capped), F.lit(0)).alias("engaged_seconds"), F.count("*").alias("engaged_views")
    )


def page_visitors(events: DataFrame, tz: str) -> DataFrame:
    """Page views and conversions by day, path and visitor."""
    view = F.col("event_name") == "page_view"
    return (
        events.where(view | (F.col("is_conversion") == 1))
        .withColumn("day", local_day("occurred_at", tz))
        .groupBy("day", F.col("page_path").alias("path"), "visitor_key")
        .agg(
            F.sum(view.cast("int")).alias("pageviews"),
            F.sum("is_conversion").alias("conversions"),
            F.max(F.when(view, F.col("post_id"))).alias("post_id"),
            F.max(F.when(view, F.col("post_type"))).alias("post_type"),
            F.max(F.when(view, F.col("page_title"))).alias("title"),
        )
    )


def _page_views(per_visitor: DataFrame) -> DataFrame:
    seen = (F.col("pageviews") > 0) & F.col("visitor_key").isNotNull()
    return per_visitor.groupBy("day", "path").agg(
        F.sum("pageviews").alias("pageviews"),
        F.sum("conversions").alias("conversions"),
        F.sum(seen.cast("int")).alias("visitors"),
        F.max("post_id").alias("post_id"),
        F.max("post_type").alias("post_type"),
        F.max("title").alias("title"),
    )


def page_ends(sessions: DataFrame, tz: str) -> DataFrame:
    """Sessions that begin and end on a path, by their day."""
    sign = [SIGN] if SIGN in sessions.columns else []
    starts = sessions.select(
        *sign,
        local_day("started_at", tz).alias("day"),
        F.explode(
            F.array(
                F.struct(F.col("landing_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("exit_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("p"),
    )
    return starts.groupBy("day", "p.path").agg(
        F.sum(_signed(starts, "p.i")).alias("entrances"), F.sum(_signed(starts, "p.o")).alias("exits")
    )


def daily_content(sessions: DataFrame, events: DataFrame, tz: str) -> DataFrame:
    """Metrics per day and path."""
    return content_of(page_visitors(events, tz), page_ends(sessions, tz), page_reads(events, tz))


def content_of(per_visitor: DataFrame, ends: DataFrame, per_view: DataFrame) -> DataFrame:
    """Pre-aggregated inputs are stacked and merged by one grouping. A path that sessions only ended on for a while has no row."""
    rows = (
        _page_views(per_visitor)
        .unionByName(ends.where((F.col("entrances") != 0) | (F.col("exits") != 0)), allowMissingColumns=True)
        .unionByName(engagement_of(per_view), allowMissingColumns=True)
    )
    sums = ["pageviews", "visitors", "entrances", "exits", "engaged_seconds", "engaged_views", "conversions"]
    return rows.groupBy("day", "path").agg(
        F.coalesce(F.max("post_id"), F.lit(0)).cast("bigint").alias("post_id"),
        F.coalesce(F.max("post_type"), F.lit("")).alias("post_type"),
        F.left(F.coalesce(F.max("title"), F.lit("")), F.lit(255)).alias("title"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
    )


def event_sessions(events: DataFrame, tz: str) -> DataFrame:
    """Events by day, name and session."""
    return (
        events.withColumn("day", local_day("occurred_at", tz))
        .groupBy("day", "event_name", "session_id")
        .agg(
            F.max("category").alias("category"),
            F.max("module").alias("module"),
            F.count("*").alias("events"),
            F.sum("event_value_base").alias("value"),
            F.max("is_conversion").alias("is_conversion"),
        )
    )


def daily_events(events: DataFrame, tz: str) -> DataFrame:
    """Totals per day and event name; unlinked events count as one session."""
    return events_of(event_sessions(events, tz))


def events_of(per_session: DataFrame) -> DataFrame:
    return per_session.groupBy("day", "event_name").agg(
        F.max("category").alias("category"),
        F.max("module").alias("module"),
        F.sum("events").alias("events"),
        F.count("session_id").alias("sessions"),
        _money(F.col("value")).alias("value"),
        F.max("is_conversion").alias("is_conversion"),
    )


def search_rows(events: DataFrame) -> DataFrame:
    """Typed fields of search events with a usable term."""

    def attr(n):
        return F.get_json_object("attributes", f"$.{n}")

    number = attr("results").try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")
    flag = attr("zero_results")
    source = F.coalesce(attr("source"), F.lit("results_page"))
    return (
        events.where(F.col("event_name") == "site_search")
        .withColumns(
            {
                "term": normalize_term(F.coalesce(attr("query"), F.lit(""))),
                "counted": whole.isNotNull().cast("int"),
                "results": F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)),
                "zero": (
                    (flag.isNotNull() & ~flag.isin("", "0", "false", "[]")) | F.coalesce(whole == 0, F.lit(False))
                ).cast("int"),
                "source": F.when(source.isin("form", "live"), source).otherwise("results_page"),
            }
        )
        .where(F.col("term") != "")
    )


SEARCH_SUMS = [
    "searches", "zero_results", "results_total", "results_counted", "source_results_page", "source_form", "source_live",
]


def search_sessions(events: DataFrame, tz: str) -> DataFrame:
    """Searches by day, term and session."""

    def of(name):
        return F.sum((F.col("source") == name).cast("int")).alias(f"source_{name}")

    return (
        search_rows(events)
        .withColumn("day", local_day("occurred_at", tz))
        .groupBy("day", "term", "session_id")
        .agg(
            F.count("*").alias("searches"),
            F.sum("zero").alias("zero_results"),
            F.sum("results").alias("results_total"),
            F.sum("counted").alias("results_counted"),
            of("results_page"), of("form"), of("live"),
        )
    )


def daily_searches(events: DataFrame, tz: str) -> DataFrame:
    return searches_of(search_sessions(events, tz))


def searches_of(per_session: DataFrame) -> DataFrame:
    return per_session.groupBy("day", "term").agg(
        F.count("session_id").alias("sessions"), *[F.sum(c).alias(c) for c in SEARCH_SUMS]
    )


def heatmap_daily(points: DataFrame) -> DataFrame:
    """Clicks per UTC day, path, device and cell."""
    return (
        points.withColumn("day", F.to_date("received_at"))
        .groupBy("day", F.col("page_path").alias("path"), "device", "x", "y")
        .agg(F.count("*").alias("clicks"))
    )


def crawler_hits(requests: DataFrame, skip_agent: str | None = None) -> DataFrame:
    """Requests made by known crawlers: ts, crawler, crawler_type, path, status_code."""
    from footfall.functions.agents import crawler

    rows = requests if skip_agent is None else requests.where(~F.col("user_agent").startswith(skip_agent))
    return (
        rows.withColumn("_c", crawler("user_agent"))
        .where(F.col("_c").isNotNull())
        .select(
            "ts", F.col("_c.name").alias("crawler"), F.col("_c.type").alias("crawler_type"), "path", "status_code",
            *[c for c in ("request_id",) if c in requests.columns],
        )
    )


def crawler_daily(hits: DataFrame) -> DataFrame:
    """Hits per UTC day, crawler and path, with the last status seen that day."""
    order = F.struct("ts", "request_id") if "request_id" in hits.columns else F.struct("ts")
    return (
        hits.withColumn("day", F.to_date("ts"))
        .groupBy("day", "crawler", "path")
        .agg(
            F.max("crawler_type").alias("crawler_type"),
            F.max_by("status_code", order).alias("status_code"),
            F.count("*").alias("hits"),
            F.max("ts").alias("last_seen_at"),
        )
    )


BACKFILL_DAYS = 14
CATCH_UP_DAYS = 31


def days_to_rebuild(
    events: DataFrame, done: DataFrame, last_run: str | None, today: str, tz: str, backfill_from: str | None = None,
    backfill_days: int | None = BACKFILL_DAYS, catch_up_days: int | None = CATCH_UP_DAYS,
) -> DataFrame:
    """Days an hourly run has to rebuild, with the reason.

    Today and yesterday always; the days since the last run, up to ``catch_up_days`` back; then, newest first, up to
    ``backfill_days`` older days that are not in ``done(day)``, no further back than the first event. The two budgets
    spread a long back-fill over several runs, so no day is lost; None does all at once.
    """
    spark = events.sparkSession
    one = spark.range(1)
    t = day_lit(today)
    yesterday = F.date_sub(t, 1)
    fixed = one.select(F.explode(F.array(t, yesterday)).alias("day"), F.lit("current").alias("reason"))
    parts = [fixed]
    if last_run is not None:
        since = local_day(F.lit(last_run).cast("timestamp_ntz"), tz)
        if catch_up_days is not None:
            since = F.greatest(since, F.date_sub(yesterday, catch_up_days))
        span = F.when(since < yesterday, F.sequence(since, F.date_sub(yesterday, 1)))
        parts.append(one.select(F.explode(span).alias("day"), F.lit("catch_up").alias("reason")))
    start = day_lit(backfill_from) if backfill_from else yesterday
    first = events.agg(local_day(F.min("occurred_at"), tz).alias("first"))
    older = first.select(
        F.explode(F.when(F.col("first") < start, F.sequence("first", F.date_sub(start, 1)))).alias("day")
    )
    older = older.join(done.select("day").distinct(), "day", "left_anti")
    if backfill_days is not None:
        older = older.orderBy(F.desc("day")).limit(backfill_days)
    parts.append(older.select("day", F.lit("backfill").alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("reason") == "current", 0).when(F.col("reason") == "catch_up", 1).otherwise(2)
    return out.groupBy("day").agg(F.min_by("reason", rank).alias("reason"))


def search_days(events: DataFrame, tz: str) -> DataFrame:
    """Every local day from the first to the last search event (search back-fill)."""
    span = events.where(F.col("event_name") == "site_search").agg(
        local_day(F.min("occurred_at"), tz).alias("a"), local_day(F.max("occurred_at"), tz).alias("b")
    )
    return span.select(F.explode(F.when(F.col("a").isNotNull(), F.sequence("a", "b"))).alias("day"))


def rollup(sessions: DataFrame, events: DataFrame, days: Sequence | None, tz: str) -> dict[str, DataFrame]:
    """All session and event rollups for a set of days (NULL for every day present).

    Inputs are cut to the days by a range on the raw time columns, so partitions outside are not read;
    events keep one more day for revenue that arrives after midnight.
    """
    s, e, later = sessions, events, events
    if days:
        lo, hi = min(map(str, days)), max(map(str, days))
        s = between_days(sessions, "started_at", lo, hi, tz)
        e = between_days(events, "occurred_at", lo, hi, tz)
        later = between_instants(events, "occurred_at", utc_midnight(lo, tz), utc_midnight(hi, tz, 3))
    tables = {
        "daily_traffic": daily_traffic(s, e, tz),
        "daily_dimensions": daily_dimensions(s, later, tz),
        "daily_content": daily_content(s, e, tz),
        "daily_events": daily_events(e, tz),
        "daily_searches": daily_searches(e, tz),
    }
    return {k: _on_days(v, days) for k, v in tables.items()}


# ---- rollups in parts ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """What rows of the first step are added up by: sums, and columns of which the greatest stays. ``dealt`` are the keys that rows
    are dealt by (default: all)."""

    keys: tuple[str, ...]
    sums: tuple[str, ...]
    tops: tuple[str, ...] = ()
    dealt: tuple[str, ...] = ()


PARTS = {
    "visitor_days": Part(
        ("day", "visitor_key"),
        ("sessions", "engaged_sessions", "bounces", "engaged_seconds", "duration_seconds", "new_sessions", "returning_sessions"),
    ),
    "event_days": Part(("day",), ("events", "pageviews", "conversions", "revenue")),
    "dimension_visitors": Part(("day", "visitor_key", *DIMENSIONS), (*SESSION_SUMS, "revenue"), dealt=("day", "visitor_key")),
    "page_visitors": Part(("day", "path", "visitor_key"), ("pageviews", "conversions"), ("post_id", "post_type", "title")),
    "page_ends": Part(("day", "path"), ("entrances", "exits")),
    "page_reads": Part(("day", "path", "session_id", "pv"), (), ("top",)),
    "event_sessions": Part(("day", "event_name", "session_id"), ("events", "value"), ("category", "module", "is_conversion")),
    "search_sessions": Part(("day", "term", "session_id"), tuple(SEARCH_SUMS)),
}


def rollup_parts(sessions: DataFrame, events: DataFrame, tz: str) -> dict[str, DataFrame]:
    """The first step of all rollups. ``sessions`` has every session that a conversion of ``events`` belongs to, and may be signed."""
    return {
        "visitor_days": visitor_days(sessions, tz),
        "event_days": traffic_events(events, tz),
        "dimension_visitors": dimension_visitors(sessions, events, tz),
        "page_visitors": page_visitors(events, tz),
        "page_ends": page_ends(sessions, tz),
        "page_reads": page_reads(events, tz),
        "event_sessions": event_sessions(events, tz),
        "search_sessions": search_sessions(events, tz),
    }


def merge_part(name: str, rows: DataFrame) -> DataFrame:
    """Rows of several inputs added up, with the types they have."""
    part, kinds = PARTS[name], {f.name: f.dataType for f in rows.schema.fields}
    dealt = deal_by(rows, part.dealt, tasks_for(rows)) if part.dealt else rows
    return dealt.groupBy(*part.keys).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in part.sums], *[F.max(c).alias(c) for c in part.tops]
    ).select(rows.columns)


def rollup_of(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All rollups from rows of the first step that are added up."""
    return {
        "daily_traffic": traffic_of(parts["visitor_days"], parts["event_days"]),
        "daily_dimensions": dimensions_of(parts["dimension_visitors"]),
        "daily_content": content_of(parts["page_visitors"], parts["page_ends"], parts["page_reads"]),
        "daily_events": events_of(parts["event_sessions"]),
        "daily_searches": searches_of(parts["search_sessions"]),
    }
