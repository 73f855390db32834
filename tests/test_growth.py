"""Work that has to grow with the rows, and no faster: state keys, stored results and what is shuffled."""

from __future__ import annotations

import collections
import itertools
import os
import random
from functools import partial
from pathlib import Path

from pyspark.sql import functions as F

from footfall.checks import queries, warehouse
from footfall.operators import admit, audit_site, geo, rollup, scans, sessions
from footfall.settings import Settings
from footfall.sources import sample
from footfall.streaming import streams


def _stream_of(spark, folder, parts: list[list[tuple]], schema: str):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={n}")
        for file in Path(f"{folder}/part={n}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 60 * n,) * 2)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_rate_limit_keeps_a_key_a_minute_and_bucket_not_one_a_visitor(spark, tmp_path):
    rng, number, parts, left = random.Random(7), 0, [], {}
    for minute in (0, 0, 3):  # the second micro-batch goes on with the minute of the first
        rows = []
        for _ in range(300):
            number += 1
            rows.append((number, rng.choice([None, *(f"v{i}" for i in range(150))]), minute * 60 + rng.randrange(60)))
        rows.sort(key=lambda r: (r[2], r[0]))
        parts.append(rows)
    want = []
    for rows in parts:
        for number, visitor, second in rows:
            left[visitor, second // 60] = left.get((visitor, second // 60), 2) - 1
            if left[visitor, second // 60] >= 0:
                want.append((number, visitor))
    hits = _stream_of(spark, f"{tmp_path}/in", parts, "payload_id long, visitor_key string, second long")
    hits = hits.withColumn("received_at", F.timestamp_seconds(F.col("second") + 1_704_067_200).cast("timestamp_ntz"))
    out = f"{tmp_path}/out"
    q = (
        streams.stream_rate_limit(hits, 2).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("payload_id", "visitor_key").collect()]
    assert set(got) - set(want) == set() == set(want) - set(got) and len(got) == len(want)
    most = max(op.numRowsTotal for p in q.recentProgress for op in p.stateOperators)
    assert 0 < most <= 4 * 2 * streams.LIMIT_BUCKETS  # a count and its timers for each key; 302 visitor minutes


def test_dimensions_shuffle_sessions_not_their_labels(spark):
    """Sessions are dealt once by day and visitor; what is made of them is grouped where it is, with the right counts."""
    labels = {c: "x" for c in ("channel", "utm_source", "utm_medium", "utm_campaign", "referrer_domain", "landing_path", "country", "region", "city",
                               "device_type", "browser", "os", "language", "viewport")}
    rows = [(i, f"v{i % 7}", i * 3600, i % 2, 1, 5, i % 3 == 0) for i in range(60)]
    s = spark.createDataFrame(rows, "session_id long, visitor_key string, second long, is_engaged int, pageviews long, engaged_seconds long, back boolean")
    s = s.select("*", *[F.lit(v).alias(c) for c, v in labels.items()], F.lit(0).cast("bigint").alias("conversions"),
                 F.timestamp_seconds(F.col("second") + 1_704_067_200).cast("timestamp_ntz").alias("started_at"), F.col("back").cast("int").alias("is_returning"))
    e = spark.createDataFrame([], "session_id long, occurred_at timestamp_ntz, is_conversion int, event_value_base decimal(18,4)")
    per = rollup.dimension_visitors(s, e, "UTC")
    assert per.count() <= 60  # a session has at most a row, not fifteen
    got = {(str(r.day), r.dimension, r.value): (r.sessions, r.visitors, r.engaged_sessions) for r in rollup.dimensions_of(per).collect()}
    want = {}
    for i, v, second, engaged, *_, back in rows:
        day = f"2024-01-{1 + second // 86400:02d}"
        for key in ((day, "channel", "x"), (day, "visitor_type", "returning" if back else "new")):
            n, seen, m = want.get(key, (0, set(), 0))
            want[key] = (n + 1, seen | {v}, m + engaged)
    for key, (n, seen, m) in want.items():
        assert got[key] == (n, len(seen), m)
    assert {d for _, d, _ in got} == set(rollup.DIMENSIONS)


def _payloads(spark, n: int):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("payload_id"), F.when(i % 11 > 0, F.concat(F.lit("v"), i % 7)).alias("visitor_key"), F.lit(1).cast("bigint").alias("n_events"),
        F.timestamp_seconds(1_704_067_200 + (i * i * 37) % 400_000).cast("timestamp_ntz").alias("received_at"), (i % 2 == 0).alias("has_pageview"),
        F.when(i % 13 == 0, "a").otherwise("").alias("utm_source"), F.lit("").alias("utm_medium"), F.lit("").alias("utm_campaign"),
        F.when(i % 17 == 0, "gclid").otherwise("").alias("click_id_type"), F.lit(0).cast("bigint").alias("heartbeat"), F.lit(0).cast("bigint").alias("n_heat"),
    )


def test_calm_visitors_are_dealt_once(spark, monkeypatch):
    """Only the slices of busy visitors are joined to the rows; a calm table is not dealt by slice first. Sessions are the same."""
    monkeypatch.setattr(sessions, "_stretches", partial(sessions._stretches, busy_rows=50))
    rows = _payloads(spark, 800)
    split = {r.payload_id: r.session_id for r in sessions.sessionize(rows).collect()}
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        calm = sessions.sessionize(rows)
        plan = calm._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    assert {r.payload_id: r.session_id for r in calm.collect()} == split and len(split) == 800 and len(set(split.values())) > 20


def test_stored_rows_are_ranked_only_in_crowded_minutes(spark):
    """The rate limit of the write path on stored rows is that of ``admit``, a visitor without key and refused rows included."""
    rows = _payloads(spark, 900).withColumns({
        "received_at": F.timestamp_seconds(1_704_067_200 + F.col("payload_id") % 300).cast("timestamp_ntz"),
        "user_agent": F.when(F.col("payload_id") % 5 == 0, "Googlebot/2.1").otherwise("Mozilla/5.0 (X11; Linux x86_64) Firefox/132.0"),
        "wd": F.lit(False), "dnt": F.lit(False), "gpc": F.lit(False), "ip": F.lit("10.0.0.1"), "host": F.lit("site.example"), "page_path": F.lit("/"),
    })
    s = Settings(hosts=("site.example",))
    for most in (1000, 9):
        early = admit.with_early_reason(rows, s)
        want = {r.payload_id: r.reason for r in admit.admit(rows, s, per_minute=most).collect()}
        quick = admit.admit_stored(early, s, most)
        assert {r.payload_id: r.reason for r in quick.collect()} == want and len(want) == quick.count() == 900
        assert ("rate_limited" in want.values()) == (most == 9)
        assert ("Window" in quick._jdf.queryExecution().executedPlan().toString()) is False  # none, or stored


def test_few_places_are_handed_out_and_rows_are_not_dealt_by_address(spark):
    rows = spark.range(3000).select(F.concat(F.lit("10.0."), F.col("id") % 40, F.lit(".7")).alias("ip"), F.col("id"))
    ranges = spark.createDataFrame([(f"10.0.{i}.0", f"10.0.{i}.255", "KE", f"R{i}", "") for i in range(30)], "start_ip string, end_ip string, country string, region string, city string")
    found = geo.geo_lookup(rows, ranges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.id: (r.country, r.region) for r in found.collect()}
    assert got == {i: ("KE", f"R{i % 40}") if i % 40 < 30 else ("", "") for i in range(3000)}


def test_payloads_are_dealt_without_what_nobody_reads(spark, monkeypatch, tmp_path):
    """The warehouse deals no column that its tables are not made of, and hits are dealt as events, before they are wide."""
    kinds = ("view", "click", "signup", "purchase", "error")
    rows = [(i, 60 * i, i % 5, kinds[i % 5], float(i % 90), f'{{"k": {i % 97}}}') for i in range(400)]
    e = spark.createDataFrame(rows, "event_id long, second long, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.timestamp_seconds(F.col("second") + 1_704_067_200).cast("timestamp_ntz")).drop("second").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen, stored = [], warehouse.stored
    monkeypatch.setattr(warehouse, "stored", lambda df, name: seen.append(set(df.columns)) or stored(df, name))
    w = warehouse.Warehouse(spark, str(tmp_path))
    assert w.sessions.count() > 10 and w.events.count() > 300
    assert not seen[0] & {"event_id", "user_id", "k", "value", "pv"}
    dealt = sample.raw_hits(spark, str(tmp_path), deal=True)
    assert "RoundRobinPartitioning" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, sample.raw_hits(spark, str(tmp_path)).collect()))


def test_dimensions_of_more_sessions_take_more_tasks(spark, monkeypatch):
    """The rows of a task are bounded, not the tasks; the counts are those of the usual dealing, signs included."""
    s = spark.range(400).select(
        F.col("id").alias("session_id"), F.concat(F.lit("v"), F.col("id") % 50).alias("visitor_key"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).cast("timestamp_ntz").alias("started_at"),
        *[F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in (
            "channel", "utm_source", "utm_medium", "utm_campaign", "referrer_domain", "landing_path", "country", "region", "city",
            "device_type", "browser", "os", "language", "viewport")],
        *[F.lit(1).cast("bigint").alias(c) for c in ("pageviews", "engaged_seconds", "conversions")],
        (F.col("id") % 2).cast("int").alias("is_engaged"), F.lit(None).cast("int").alias("is_returning"),
        F.when(F.col("id") % 8 == 7, -1).otherwise(1).alias(rollup.SIGN),
    ).localCheckpoint()
    e = s.select("session_id", F.col("started_at").alias("occurred_at"), F.lit(1).alias("is_conversion"), F.lit(2).cast("decimal(18,4)").alias("event_value_base"))

    def run():
        per = rollup.dimension_visitors(s, e, "UTC")
        again = rollup.merge_part("dimension_visitors", per)
        return [d.rdd.getNumPartitions() for d in (per, again)], sorted(map(str, rollup.dimensions_of(again).collect()))

    few, want = run()
    monkeypatch.setattr(scans, "TASK_ROWS", 1)
    many, got = run()
    assert got == want and many[0] >= 400 > max(few) and many[1] > max(few)


def test_files_of_a_run_grow_with_its_rows_and_are_as_many_for_all_runs(spark, monkeypatch):
    """The three runs of the stream are written by more tasks the more rows they have; the smallest run tells how many."""
    days = {"2024-01-05": 700, "2024-01-18": 500, "2024-01-25": 900}
    rows = [(n, day) for day, k in days.items() for n in range(k)]
    hits = spark.createDataFrame(rows, "payload_id long, day string").withColumn("received_at", F.col("day").cast("timestamp_ntz"))
    monkeypatch.setattr(queries, "STREAM_ROWS", 50)
    assert queries.files_a_run(hits) == 10
    monkeypatch.setattr(queries, "STREAM_ROWS", 10**6)
    assert queries.files_a_run(hits) == queries.files_a_run(hits.limit(0)) == queries.STREAM_FILES


def test_audit_broadcasts_nothing_whose_size_is_only_guessed(spark, tmp_path):
    """Links are many times their stored pages; what the plan would send to every task has passed a shuffle, which tells its size."""
    rows = [(n, f"https://s.example/{n}", f"/{n}", 404 if n % 7 == 0 else 200, "content", 0, f"Title {n % 50}", f"About {n % 60}",
             [f"https://s.example/{(n + k) % 300}" for k in range(1, 40, n % 5 + 1)]) for n in range(400)]
    columns = "page_id long, url string, path string, status_code int, source string, noindex int, title string, description string, links array<string>"
    spark.createDataFrame(rows, columns).withColumn("self_url", F.col("url")).write.parquet(f"{tmp_path}/facts")
    pages = spark.read.parquet(f"{tmp_path}/facts")
    edges = pages.select("page_id", F.col("self_url").alias("src_url"), F.explode("links").alias("dst_url"))
    found = audit_site.cross_page_issues(pages, edges, audit_site.status_by_url(pages))
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*|")) for line in plan]
    guessed = 0
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            inside = [x for x, _ in itertools.takewhile(lambda p: p[1] > depth[i], zip(plan[i + 1 :], depth[i + 1 :], strict=True))]
            guessed += not any("Exchange hashpartitioning" in x for x in inside)
    assert guessed == 0, "\n".join(plan)
    got = {}
    for r in found.collect():
        got.setdefault(r.code, {})[r.page_id] = r.detail
    live, bad = {r[0] for r in rows if r[3] == 200}, {r[1] for r in rows if r[3] == 404}
    assert got["broken_internal_links"] == {r[0]: " ".join(sorted(u for u in r[8] if u in bad)) for r in rows if r[0] in live and set(r[8]) & bad}
    linked = {u for r in rows for u in r[8]}
    assert set(got["orphan_page"]) == {r[0] for r in rows if r[0] in live and r[1] not in linked} and len(got["orphan_page"]) > 50
    for code, at in (("title_duplicate", 6), ("meta_description_duplicate", 7)):
        of = collections.Counter(r[at].lower() for r in rows if r[0] in live)
        assert got[code] == {r[0]: str(of[r[at].lower()]) for r in rows if r[0] in live and of[r[at].lower()] > 1}
