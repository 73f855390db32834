"""Sessionisation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.agents import user_agent
from footfall.functions.channels import DEFAULT_RULES, channel
from footfall.functions.times import seconds_between
from footfall.operators.scans import SLICE, add_slice, running_last, running_rank
from footfall.runtime import stored

ENGAGED_SECONDS = 10
ENGAGED_PAGEVIEWS = 2
MAX_COUNT = 65535
MAX_ENGAGED = 86400
SESSION_EVENT_CAP = 2000
SLICE_SECONDS = 3600
#: Rows of a visitor that are scanned as one; those of a busier one are dealt by stretches.
BUSY_ROWS = 10_000
#: How long before the start of a stored session a row may have been received that joins it.
LATE_SECONDS = 600

FIRST_TOUCH = [
    "landing_path", "landing_post_id", "referrer_domain", "referrer_url", "channel", "utm_source", "utm_medium",
    "utm_campaign", "utm_term", "utm_content", "click_id_type", "click_id", "id_mode", "device_type", "browser",
    "browser_version", "os", "os_version", "viewport", "language", "country", "region", "city", "timezone",
    "is_logged_in", "ip", "cf_country", "user_agent", "ch_platform", "tp",
]


def _stretches(hits: DataFrame, timeout_seconds: int, slice_seconds: int, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Adds _stretch, the number of a visitor's stretch of rows without a pause over the timeout between time slices.

    Nothing carries over such a pause, so stretches can be scanned apart from each other. Slices are found from the
    first and last row of each, which are combined before the shuffle. Visitors of at most ``busy_rows`` rows are one stretch: only
    the slices of busier ones are stored and joined, so that all other rows are dealt once, to be scanned.
    """
    sliced = add_slice(hits, "received_at", slice_seconds)
    ends = sliced.groupBy("visitor_key", SLICE).agg(F.min("received_at").alias("_lo"), F.max("received_at").alias("_hi"), F.count("*").alias("_n"))
    w = Window.partitionBy("visitor_key").orderBy(SLICE)
    ends = ends.withColumn("_n", F.sum("_n").over(Window.partitionBy("visitor_key"))).where(F.col("_n") > busy_rows)
    pause = seconds_between(F.lag("_hi").over(w), F.col("_lo")) > timeout_seconds
    marked = ends.withColumn("_new", F.coalesce(pause.cast("int"), F.lit(0)))
    numbered = marked.select(F.col("visitor_key").alias("_v"), F.col(SLICE).alias("_s"), F.sum("_new").over(w).alias("_stretch"))
    same = F.col("visitor_key").eqNullSafe(F.col("_v")) & F.col(SLICE).eqNullSafe(F.col("_s"))
    rows = sliced.join(stored(numbered, "stretches"), same, "left").where(F.col(SLICE).isNotNull())
    return rows.withColumn("_stretch", F.coalesce("_stretch", F.lit(0))).drop("_v", "_s", SLICE)


def _markers(prior: DataFrame, hits: DataFrame, timeout_seconds: int, late_seconds: int) -> DataFrame:
    """Stored sessions as rows of hits: an opener (``_opener``), and rows that keep the session alive up to its last moment.

    A stored session is the interval from its start to ``last_seen_at``; it gets a row at both ends and one each timeout
    between, so that whatever is received inside finds it less than a timeout back. The opener stands ``late_seconds``
    early, but not before the visitor's session before it has ended: rows that come late belong to the session that was stored.
    Only sessions that the earliest row of hits can still join are taken.
    """
    first = hits.agg(F.min("received_at")).first()[0]
    if first is None:
        first = datetime.max
    recent = prior.where(F.col("last_seen_at") >= F.lit(first) - F.make_dt_interval(secs=F.lit(timeout_seconds)))
    w = Window.partitionBy("visitor_key").orderBy("started_at", "session_id")
    early = F.greatest(F.col("started_at") - F.make_dt_interval(secs=F.lit(late_seconds)), F.lag("last_seen_at").over(w))
    step = F.make_dt_interval(secs=F.lit(timeout_seconds))
    points = recent.withColumn("_at", F.explode(F.array_union(
        F.sequence(F.col("started_at"), F.greatest("started_at", "last_seen_at"), step), F.array("last_seen_at"),
    )))
    points = points.unionByName(recent.withColumn("_at", F.least(early, F.col("started_at"))).withColumn("_first", F.lit(True)), allowMissingColumns=True)
    have = {
        "payload_id": F.col("session_id"), "received_at": F.col("_at"), "origin": F.lit(0), "n_events": F.lit(1),
        "has_pageview": F.coalesce("_first", F.lit(False)), **{c: F.col(c) for c in ("visitor_key", "utm_source", "utm_medium", "utm_campaign", "click_id_type")},
    }
    rows = points.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in hits.schema.fields], F.coalesce("_first", F.lit(False)).alias("_opener"))
    return rows.withColumn("_stored", F.lit(True))


def sessionize(
    hits: DataFrame,
    timeout_minutes: int = 30,
    split_campaign: bool = True,
    slice_seconds: int = SLICE_SECONDS,
    prior: DataFrame | None = None,
    late_seconds: int = LATE_SECONDS,
) -> DataFrame:
    """Adds session_id to payload rows: the payload_id of the payload that opened the session.

    Needs visitor_key, received_at, payload_id, n_events, has_pageview, utm_source, utm_medium, utm_campaign
    and click_id_type; ``origin`` 1 marks server rows. A payload joins the visitor's session when that was
    seen within the timeout (inclusive). A page view with another campaign opens a new one. Rows without
    events and server rows never open one: they extend what is there, else browser rows get NULL and
    server rows 0.

    ``prior`` has sessions of earlier runs (visitor_key, session_id, started_at, last_seen_at, the three utm columns and
    click_id_type). A row joins the one that covers it: received between its start, or ``late_seconds`` before, and the
    timeout after its last moment, be it later than what is stored or earlier. Hits are read twice and dealt
    by visitor and stretch, so a busy visitor is split wherever they pause.
    """
    if "origin" not in hits.columns:
        hits = hits.withColumn("origin", F.lit(0))
    rows = hits.withColumns({"_stored": F.lit(False), "_opener": F.lit(False)})
    if prior is not None:
        rows = rows.unionByName(_markers(prior, hits, timeout_minutes * 60, late_seconds))
    df = _stretches(rows, timeout_minutes * 60, slice_seconds)
    key = Window.partitionBy("visitor_key", "_stretch").orderBy("received_at", "payload_id")
    before, upto = key.rowsBetween(Window.unboundedPreceding, -1), key.rowsBetween(Window.unboundedPreceding, 0)
    seq = F.struct("received_at", "payload_id")
    opens = (F.col("origin") == 0) & (F.col("n_events") > 0)

    def last(value: Column, w) -> Column:
        return F.last(value, ignorenulls=True).over(w)

    # Gap runs: a row starts a run when the row before it is further away than the timeout.
    df = df.withColumns({"_prev": last(F.col("received_at"), before), "_prev_opener": last(F.when(opens, seq), before)})
    gap = F.col("_prev").isNull() | (seconds_between("_prev", "received_at") > timeout_minutes * 60)
    df = df.withColumn("_run", last(F.when(gap, seq), upto))
    known = F.col("_prev_opener").isNotNull() & (F.col("_prev_opener") >= F.col("_run"))
    df = df.withColumn("_base", (opens & ~known) | F.col("_opener")).withColumn("_live", known | opens)

    if split_campaign:
        triple = F.lower(F.concat_ws("|", "utm_source", "utm_medium", "utm_campaign"))
        tagged = opens & F.col("has_pageview") & ((triple != "||") | (F.col("click_id_type") != ""))
        df = df.withColumn("_carrier", F.col("_base") | tagged).withColumn("_triple", triple)
        clicked = F.when(
            F.col("_carrier") & (F.col("click_id_type") != ""),
            F.struct(seq.alias("at"), F.col("click_id_type").alias("click")),
        )
        df = df.withColumns({"_prev_triple": last(F.when(F.col("_carrier"), F.col("_triple")), before), "_click": last(clicked, before)})
        fresh = F.col("_carrier") & (F.col("_base") | ~F.col("_triple").eqNullSafe(F.col("_prev_triple")))
        df = df.withColumn("_fresh", fresh)
        df = df.withColumn("_sub", last(F.when(F.col("_fresh"), seq), upto))
        held = F.when(F.col("_click.at") >= F.col("_sub"), F.col("_click.click"))
        other_click = F.col("_carrier") & (F.col("click_id_type") != "") & ~F.col("click_id_type").eqNullSafe(held)
        start = F.col("_fresh") | other_click
    else:
        start = F.col("_base")
    df = df.withColumn("_start", start)
    df = df.withColumn("_sid", last(F.when(F.col("_start"), F.col("payload_id")), upto))
    unlinked = F.when(F.col("origin") == 1, F.lit(0))
    out = df.where(~F.col("_stored")).withColumn("session_id", F.when(F.col("_live"), F.col("_sid")).otherwise(unlinked))
    scratch = [c for c in out.columns if c.startswith("_")]
    return out.drop(*scratch)


def cap_session(events: DataFrame, n: int = SESSION_EVENT_CAP, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Keeps the first n events of a session in arrival order; server events are always kept.

    Only sessions over the cap are ranked, in time slices, so a huge session is never one task.
    """
    linked = F.col("session_id") != 0
    over = events.where(linked).groupBy("session_id").agg(F.count("*").alias("_n")).where(F.col("_n") > n)
    over = over.select("session_id", F.lit(True).alias("_over"))
    tagged = events.join(over, "session_id", "left")
    small = tagged.where(F.col("_over").isNull()).drop("_over")
    big = add_slice(tagged.where(F.col("_over")).drop("_over"), "received_at", slice_seconds)
    big = running_rank(big, ["session_id"], ["received_at", "payload_id", "event_index"], "_rank", sliced=True)
    server = F.col("origin") == 1 if "origin" in events.columns else F.lit(False)
    return small.unionByName(big.where((F.col("_rank") <= n) | server).drop("_rank", SLICE))


def engaged_flag(engaged: Column, pageviews: Column, conversions: Column) -> Column:
    return ((engaged > ENGAGED_SECONDS) | (pageviews >= ENGAGED_PAGEVIEWS) | (conversions > 0)).cast("int")


def at_most(value: Column, most: int | None) -> Column:
    return value if most is None else F.least(value, F.lit(most))


def build_sessions(hits: DataFrame, max_count: int | None = MAX_COUNT, max_engaged: int | None = MAX_ENGAGED) -> DataFrame:
    """One row per session from payload rows with session_id.

    Needs page_path, heartbeat, n_pageviews, n_events, n_conversions and whatever first-touch columns exist.
    Everything is one aggregation; it reuses the visitor partitioning that sessionize leaves behind. Page views and
    conversions are held at ``max_count`` and engaged seconds at ``max_engaged`` (a day); None holds nothing.
    """
    rows = hits.where(F.col("session_id").isNotNull() & (F.col("session_id") != 0))
    if "landing_path" not in rows.columns:
        rows = rows.withColumn("landing_path", F.col("page_path"))
    if "landing_post_id" not in rows.columns and "post_id" in rows.columns:
        rows = rows.withColumn("landing_post_id", F.col("post_id"))
    opener = F.col("payload_id") == F.col("session_id")
    first = [c for c in FIRST_TOUCH if c in rows.columns]
    viewed_at = F.when(F.col("n_pageviews") > 0, F.struct("received_at", "payload_id"))
    grouped = rows.groupBy("visitor_key", "session_id").agg(
        F.max(F.when(opener, F.col("received_at"))).alias("started_at"),
        F.max("received_at").alias("last_seen_at"),
        F.sum("n_pageviews").alias("_pv"),
        F.sum("n_events").alias("event_count"),
        F.sum("heartbeat").alias("_hb"),
        F.sum("n_conversions").alias("_conv"),
        F.max_by("page_path", viewed_at).alias("_exit"),
        F.max(F.when(opener, F.struct(*first))).alias("_first"),
    )
    return grouped.select(
        "session_id", "visitor_key", "started_at", "last_seen_at",
        seconds_between("started_at", "last_seen_at").alias("duration_seconds"),
        at_most(F.col("_hb"), max_engaged).alias("engaged_seconds"),
        at_most(F.col("_pv"), max_count).alias("pageviews"),
        "event_count",
        at_most(F.col("_conv"), max_count).alias("conversions"),
        engaged_flag(F.col("_hb"), F.col("_pv"), F.col("_conv")).alias("is_engaged"),
        F.coalesce("_exit", "_first.landing_path").alias("exit_path"),
        "_first.*",
    )


def merge_sessions(new: DataFrame, prior: DataFrame, max_count: int | None = MAX_COUNT, max_engaged: int | None = MAX_ENGAGED) -> DataFrame:
    """Sessions of this run added to what earlier runs stored of the same ones; one row per session of ``new``.

    A session that goes on has no opener in this run: its start and first touch come from ``prior``. Counters are added up
    and then held at ``max_count`` and ``max_engaged``, as ``build_sessions`` holds them.
    """
    sums = ["engaged_seconds", "pageviews", "event_count", "conversions"]
    totals = ["session_id", "visitor_key", "started_at", "last_seen_at", "exit_path", *sums]
    first = [c for c in new.columns if c not in (*totals, "duration_seconds", "is_engaged")]
    cols = [*totals, *first]
    old = prior.join(new.select("session_id"), "session_id", "left_semi")
    both = new.select(cols).unionByName(old.select([F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in cols]))
    merged = both.groupBy("session_id", "visitor_key").agg(
        F.min("started_at").alias("started_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max_by("exit_path", F.when(F.col("exit_path").isNotNull(), F.col("last_seen_at"))).alias("exit_path"),
        *[F.sum(c).alias(c) for c in sums],
        F.max(F.when(F.col("started_at").isNotNull(), F.struct(*first))).alias("_first"),
    )
    flat = merged.select(*[c for c in merged.columns if c != "_first"], "_first.*")
    return flat.withColumns({
        "duration_seconds": seconds_between("started_at", "last_seen_at"),
        "is_engaged": engaged_flag(F.col("engaged_seconds"), F.col("pageviews"), F.col("conversions")),
        "engaged_seconds": at_most(F.col("engaged_seconds"), max_engaged),
        "pageviews": at_most(F.col("pageviews"), max_count),
        "conversions": at_most(F.col("conversions"), max_count),
    }).select(new.columns)


def describe_sessions(sessions: DataFrame, rules: dict | None = None) -> DataFrame:
    """Adds channel, browser, system and device: derived once per session, not once per hit."""
    out = channel(user_agent(sessions), rules or DEFAULT_RULES)
    return out.drop("user_agent", "ch_platform", "tp")


def flag_returning(sessions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Adds is_returning: 1 when the visitor has an earlier session, 0 when not, NULL without consented ids.

    ``prior`` has ``visitor_key`` and ``started_at`` of earlier runs' sessions, or of each visitor's first one. A minimum per visitor joined back, not a window, so one heavy visitor
    does not become one task.
    """
    starts = sessions.select("visitor_key", "started_at")
    if prior is not None:
        starts = starts.unionByName(prior.select("visitor_key", "started_at"))
    first = starts.groupBy("visitor_key").agg(F.min("started_at").alias("_first_start"))
    return (
        sessions.join(first, "visitor_key")
        .withColumn(
            "is_returning",
            F.when(F.col("id_mode") == 1, (F.col("_first_start") < F.col("started_at")).cast("int")),
        )
        .drop("_first_start")
    )


def engaged_time(ticks: DataFrame, idle: int = 60, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Visible seconds per page view from activity ticks (session_id, pv, ts, visible).

    The time after a visible tick counts until the next tick, at most ``idle`` seconds.
    """
    keys = ["session_id", "pv"]
    df = add_slice(ticks, "ts", slice_seconds)
    df = df.withColumn("_pvkey", F.coalesce("pv", F.lit("\u0000")))
    df = running_last(
        df, ["session_id", "_pvkey"], ["ts", "tick_id"], {"_prev": F.struct("ts", "visible")},
        include_current=False, sliced=True,
    )
    gap = F.least(seconds_between(F.col("_prev.ts"), "ts"), F.lit(idle))
    return (
        df.withColumn("_gap", F.when(F.col("_prev.visible") == 1, gap).otherwise(0))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("engaged_seconds"), F.count("*").alias("ticks"))
    )


def dedupe_searches(events: DataFrame) -> DataFrame:
    """Searches with one row per page view and term for typed sources; terms under two letters are dropped.

    Needs session_id, pv, term and source. Results-page rows are kept as they are.
    """
    typed = F.col("source").isin("form", "live")
    cleaned = events.withColumn("term", F.trim(F.regexp_replace("term", r"\s+", " ")))
    long_enough = cleaned.where(~typed | (F.length("term") >= 2))
    key = F.when(typed, F.lower("term")).otherwise(F.concat(F.lit("#"), F.col("event_id").cast("string")))
    order = F.struct("occurred_at", "event_id")
    kept = (
        long_enough.withColumn("_key", key)
        .groupBy("session_id", "pv", "_key")
        .agg(F.min_by(F.struct(*[c for c in cleaned.columns]), order).alias("_row"))
    )
    return kept.select("_row.*")
