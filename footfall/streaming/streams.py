"""Streaming variants. Built-in windows and aggregations wherever they fit; keyed state where they do not."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.times import epoch_millis, epoch_seconds, local_day
from footfall.operators.rollup import rollup
from footfall.operators.sessions import ENGAGED_PAGEVIEWS, ENGAGED_SECONDS, LATE_SECONDS, MAX_COUNT, MAX_ENGAGED, at_most
from footfall.plans.increments import DailyRollup
from footfall.plans.runs import collect_run, read_carry, write_carried, write_cut
from footfall.runtime import stored, together
from footfall.settings import Settings
from footfall.sources.hits import read_hits
from footfall.sources.parts import PartTable
from footfall.sources.tables import batches, drop_batches, upsert_counters
from footfall.sources.visitors import FirstSeen
from footfall.streaming.processors import ROCKSDB, FirstSession, LiveSessions, MinuteLimit, RageClicks

LATE = "10 minutes"
#: Buckets of visitors that a minute's counts lie in: each is a key of the state, and a minute is at most so many.
LIMIT_BUCKETS = 16


def stream_hits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, rejects) from beacon log files as they arrive."""
    return read_hits(spark, path, streaming=True)


# ---- the write path -----------------------------------------------------------------------------


def collected_sessions(spark: SparkSession, root: str) -> DataFrame | None:
    """The sessions that ``stream_collect`` stored, each with its latest row; None when there are none yet."""
    folders = [f"{root}/sessions/batch={n}" for n in batches(spark, f"{root}/sessions")]
    if not folders:
        return None
    rows = spark.read.option("basePath", f"{root}/sessions").parquet(*folders)
    columns = [c for c in rows.columns if c not in ("session_id", "batch")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("session_id", "r.*")


def collected_events(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The events that ``stream_collect`` stored, of all days or of those from ``first`` to ``last``: only their files are read."""
    table = PartTable(spark, f"{root}/events", "event_date")
    return table.read(between=None if first is None and last is None else (first or "", last or "9999"))


def collected_daily(spark: SparkSession, root: str, tz: str) -> DailyRollup:
    """The daily tables that ``stream_collect`` keeps when it is told a time zone for their days."""
    return DailyRollup(spark, f"{root}/daily", tz)


def _collect_batch(
    hits: DataFrame, batch_id: int, settings: Settings, salts: DataFrame, root: str, late_seconds: int, last: bool = False,
    daily_tz: str | None = None, **how
) -> None:
    """One micro-batch: reads what the one before handed on and nothing else that is stored. What does not need each other is
    made at once: events and heat points beside the sessions, then all that is made of sessions."""
    spark, kept = hits.sparkSession, {}

    def at(name: str) -> str:
        return f"{root}/{name}/batch={batch_id}"

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(at(name))

    def keep_events(events: DataFrame) -> None:
        kept["events"] = events if daily_tz is None else stored(events, "run-events")
        table = PartTable(spark, f"{root}/events", "event_date")
        table.append(kept["events"].withColumn("event_date", F.to_date("occurred_at")), "collect", batch_id)

    def beside(events: DataFrame, heat: DataFrame) -> None:
        together(lambda: keep_events(events), lambda: write("heat", heat))

    done = [n for n in batches(spark, f"{root}/carry", "cut") if n < batch_id]
    carry = read_carry(spark, f"{root}/carry/batch={done[-1]}") if done else None
    visitors = FirstSeen(spark, f"{root}/visitors")
    here = {"take_in": False, "sessions_at": at("sessions"), "beside": beside}
    out, late, after = collect_run(hits, settings, salts, carry, late_seconds, last, visitors, batch_id, **here, **how)
    rejects = out.hits.where(F.col("reason").isNotNull()).select("payload_id", "received_at", "reason").unionByName(late)

    def add_days() -> None:
        if daily_tz is not None:
            collected_daily(spark, root, daily_tz).add(out.sessions, None if carry is None else carry.sessions, kept["events"], batch_id)

    def add_visitors() -> None:
        visitors.add(out.sessions, run=batch_id, known=out.known)
        visitors.compact()

    together(add_days, add_visitors, lambda: write("rejects", rejects), lambda: write_carried(after, at("carry")))
    write_cut(after, at("carry"))
    drop_batches(spark, f"{root}/carry", done[:-1])  # the one before stays, should this batch come again


def stream_collect(
    hits: DataFrame, settings: Settings, salts: DataFrame, root: str, checkpoint: str, late_seconds: int = LATE_SECONDS,
    daily_tz: str | None = None, **how
) -> StreamingQuery:
    """The whole write path on a stream of hits, with the results of one run over all of them (``plans.runs``).

    A payload is settled when rows ``late_seconds`` younger have come; until then it is handed from micro-batch to micro-batch
    together with the sessions that can still go on, so what a micro-batch reads does not grow with the history.
    Sessions, heat points and rejects of a batch lie in folders of their own (``sessions/batch=3``), which a redelivery
    replaces; events go to a table by date that takes a batch once (``collected_events``); so every payload counts once. A
    session that goes on gets a new row with its new totals; ``collected_sessions`` gives the latest. A store of visitors tells
    who has been here before. Payloads received before what is
    settled go to ``rejects`` with the reason late, beside those that are not admitted. ``finish_collect`` settles
    the rest when the source has ended. With ``daily_tz`` the daily tables of that time zone's days are kept up to date too, from
    the rows of the micro-batch and the parts of the days they fall on (``collected_daily``). ``how`` goes to ``collect_hits``.
    """

    def collect(batch: DataFrame, batch_id: int) -> None:
        _collect_batch(batch, batch_id, settings, salts, root, late_seconds, daily_tz=daily_tz, **how)

    return hits.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_collect(
    spark: SparkSession, settings: Settings, salts: DataFrame, root: str, late_seconds: int = LATE_SECONDS, daily_tz: str | None = None, **how
) -> None:
    """Settles what a stopped ``stream_collect`` still holds, as a batch of its own; the stream cannot be continued after."""
    done = batches(spark, f"{root}/carry", "cut")
    if done:
        none = read_carry(spark, f"{root}/carry/batch={done[-1]}").pending.limit(0)
        _collect_batch(none, done[-1] + 1, settings, salts, root, late_seconds, last=True, daily_tz=daily_tz, **how)


# ---- live sessions ------------------------------------------------------------------------------

LIVE_COLUMNS = (
    "visitor_key string, session_id bigint, started_at bigint, last_seen_at bigint, pageviews bigint, "
    "event_count bigint, engaged_seconds bigint, conversions bigint, landing_path string, exit_path string, late_payloads bigint"
)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need, for streams started after."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def live_sessions(
    payloads: DataFrame, timeout_minutes: int = 30, late: str = LATE, max_count: int | None = MAX_COUNT, max_engaged: int | None = MAX_ENGAGED
) -> DataFrame:
    """Session rows touched by each micro-batch, with running counters (update mode).

    Payloads wait until those ``late`` younger have come and are taken in the order of their time, so sessions are those of one
    run over all of them. Payloads that come later still take no part: a row with null ``session_id`` has their number in
    ``late_payloads``, and what Spark drops itself, a batch later, is counted by ``late_rows``. Server rows
    (``origin`` 1) and rows without events extend a live session and never open one. Page views and conversions
    are held at ``max_count``, engaged seconds at ``max_engaged`` (None: not held).

    State is one session per visitor, dropped once it has timed out by event time, and the payloads that wait.
    """
    use_rocksdb(payloads.sparkSession)
    origin = F.coalesce("origin", F.lit(0)) if "origin" in payloads.columns else F.lit(0)
    slim = payloads.select(
        "visitor_key", F.col("payload_id").cast("bigint").alias("payload_id"), "page_path", "n_events", "n_pageviews", "n_conversions", "heartbeat",
        F.col("has_pageview").cast("int").alias("has_pageview"), origin.alias("origin"),
        epoch_seconds("received_at").cast("bigint").alias("at"), F.col("received_at").cast("timestamp").alias("event_time"),
        F.lower(F.concat_ws("|", "utm_source", "utm_medium", "utm_campaign")).alias("triple"),
        F.col("click_id_type").alias("click"),
    )
    rows = slim.withWatermark("event_time", late).groupBy("visitor_key").transformWithStateInPandas(
        LiveSessions(timeout_minutes * 60), LIVE_COLUMNS, "update", "EventTime"
    )
    capped = {
        "pageviews": at_most(F.col("pageviews"), max_count),
        "engaged_seconds": at_most(F.col("engaged_seconds"), max_engaged),
        "conversions": at_most(F.col("conversions"), max_count),
    }
    engaged = (
        (F.col("engaged_seconds") > ENGAGED_SECONDS) | (F.col("pageviews") >= ENGAGED_PAGEVIEWS) | (F.col("conversions") > 0)
    )
    return (
        rows.withColumn("is_engaged", engaged.cast("int"))
        .withColumn("duration_seconds", F.col("last_seen_at") - F.col("started_at"))
        .withColumns(capped)
        .withColumns({c: F.timestamp_seconds(c) for c in ("started_at", "last_seen_at")})
    )


# ---- windows ------------------------------------------------------------------------------------


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    return df.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)


def stream_active(payloads: DataFrame, late: str = LATE) -> DataFrame:
    """Visitors of each minute, a row each: what ``active_of`` counts exactly. State is bounded by the watermark."""
    minute = F.window("event_time", "1 minute")
    return _timed(payloads, "received_at", late).groupBy(minute, "visitor_key").agg(F.count("*").alias("payloads"))


def active_of(minutes: DataFrame, span: int = 5) -> DataFrame:
    """Distinct visitors of every ``span`` minutes, each minute, from the rows of ``stream_active``."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: F.timestamp_add("MINUTE", -i, F.col("window.start")))
    pairs = minutes.select(F.explode(starts).alias("start"), "visitor_key").distinct()
    return pairs.groupBy("start").agg(F.count("visitor_key").alias("visitors"))


def stream_active_sketch(payloads: DataFrame, late: str = LATE, lg_k: int = 12) -> DataFrame:
    """A HyperLogLog sketch of the visitors of each minute: the state is at most 2^lg_k bytes a minute, whatever their number."""
    minute = F.window("event_time", "1 minute")
    return _timed(payloads, "received_at", late).groupBy(minute).agg(F.hll_sketch_agg("visitor_key", lg_k).alias("sketch"))


def active_of_sketches(minutes: DataFrame, span: int = 5) -> DataFrame:
    """As ``active_of``, estimated from the rows of ``stream_active_sketch``: sketches of any span are merged, one row a minute.

    The standard error is 1.04 / sqrt(2^lg_k) of the number, 1.6 % by default; few visitors are counted almost exactly.
    """
    starts = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: F.timestamp_add("MINUTE", -i, F.col("window.start")))
    rows = minutes.select(F.explode(starts).alias("start"), "sketch")
    return rows.groupBy("start").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))


def stream_per_minute(events: DataFrame, late: str = LATE) -> DataFrame:
    views = _timed(events.where(F.col("event_name") == "page_view"), "occurred_at", late)
    return views.groupBy(F.window("event_time", "1 minute")).agg(F.count("*").alias("views"))


def stream_top(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Counts per key and minute; ``top_of`` adds up the newest of them. Each row is counted once, not once a window."""
    return _timed(events, "occurred_at", late).groupBy(F.window("event_time", "1 minute"), key).agg(F.count("*").alias("n"))


def top_of(minutes: DataFrame, key: str, limit: int = 6, span: int = 30) -> DataFrame:
    """The leaders of the ``span`` minutes that begin with the newest window of that length, as a sliding count has it."""
    newest = minutes.agg(F.max("window.start").alias("_w"))
    rows = minutes.join(newest, (F.col("window.start") >= F.col("_w")) & (F.col("window.start") < F.timestamp_add("MINUTE", F.lit(span), F.col("_w"))))
    sums = rows.groupBy(key).agg(F.sum("n").alias("n"))
    return sums.orderBy(F.desc("n"), key).limit(limit)


def stream_rate_limit(payloads: DataFrame, per_minute: int = 120, late: str = LATE) -> DataFrame:
    """Payloads that pass the limit of their visitor's fixed minute; the counts of a minute and a bucket of visitors are the state."""
    use_rocksdb(payloads.sparkSession)
    slim = payloads.select(
        "payload_id", "visitor_key", "received_at", F.floor(epoch_seconds("received_at") / 60).alias("minute"),
        F.pmod(F.xxhash64("visitor_key"), F.lit(LIMIT_BUCKETS)).alias("bucket"),
    )
    kind = payloads.schema["payload_id"].dataType.simpleString()
    return (
        _timed(slim, "received_at", late)
        .groupBy("bucket", "minute")
        .transformWithStateInPandas(MinuteLimit(per_minute), f"payload_id {kind}, visitor_key string", "append", "EventTime")
    )


def stream_returning(sessions: DataFrame) -> DataFrame:
    """(session_id, is_returning) of new sessions as they come: 1 when the visitor had an earlier one, NULL without consent.

    ``sessions`` is a stream of session rows in the order of their start, such as those that ``stream_collect`` stores. The state
    is the first start of every visitor in the key-value store: a micro-batch touches the visitors in it, not the history.
    """
    use_rocksdb(sessions.sparkSession)
    slim = sessions.select("visitor_key", "session_id", epoch_seconds("started_at").cast("bigint").alias("at"), "id_mode")
    return slim.groupBy("visitor_key").transformWithStateInPandas(FirstSession(), "session_id bigint, is_returning int", "append", "None")


def stream_rage_clicks(clicks: DataFrame, ms: int = 800, px: int = 30, n: int = 3, late: str = LATE) -> DataFrame:
    """``windows.rage_clicks`` on a stream: session_id, pv, element, click_id, x and y, taken in order ``late`` behind the newest."""
    use_rocksdb(clicks.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in clicks.schema.fields}
    slim = clicks.select("session_id", "pv", "element", epoch_millis("ts").alias("t"), F.col("click_id").cast("bigint").alias("click_id"),
                         F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.col("ts").cast("timestamp").alias("event_time"))
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("session_id", "pv", "element")) + ", click_id bigint, x bigint, y bigint"
    return slim.withWatermark("event_time", late).groupBy("session_id", "pv", "element").transformWithStateInPandas(
        RageClicks(ms, px, n), shape, "append", "EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark of a query has dropped so far, of the progress that the query still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


# ---- sinks --------------------------------------------------------------------------------------


def stream_counters(
    rows: DataFrame,
    to_counters: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    sums: Sequence[str],
    last: dict[str, str] | None = None,
) -> StreamingQuery:
    """Heat map or crawler counters kept up to date: each micro-batch is aggregated and stored as a delta.

    Deltas are named after the checkpoint's query id and the batch: one that is delivered again replaces itself, and a
    query with a fresh checkpoint, whose batches begin at 0 again, has another id.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        upsert_counters(to_counters(batch), path, keys, sums, last, batch_id=batch_id, query_id=json.loads(meta)["id"])

    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_rollup(
    new_events: DataFrame,
    read_sessions: Callable[[], DataFrame],
    read_events: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    tz: str,
) -> StreamingQuery:
    """Rebuilds the days that new events touch (and the day before, whose revenue window is still open) in tables by day."""

    def rebuild(batch: DataFrame, _batch_id: int) -> None:
        day = local_day("occurred_at", tz)
        touched = batch.select(F.explode(F.array(day, F.date_sub(day, 1))).alias("day")).distinct()
        days = [r["day"] for r in touched.collect()]  # the calendar days of one batch
        if not days:
            return
        for name, table in rollup(read_sessions(), read_events(), days, tz).items():
            PartTable(batch.sparkSession, f"{root}/{name}").replace(table, days)

    return (
        new_events.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

