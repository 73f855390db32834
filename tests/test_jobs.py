"""Whole jobs on small fixtures: sessions against a sequential fold, the write path, rollups, audit, streams."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from footfall.operators import audit_facts, audit_site, currency, geo, rollup, windows
from footfall.operators.retention import drop_old, retain
from footfall.operators.sessions import build_sessions, cap_session, engaged_time, merge_sessions, sessionize
from footfall.plans import ads, ingest, realtime, reports, runs
from footfall.runtime import stored
from footfall.settings import Settings
from footfall.sources import tables
from footfall.sources.parts import PartTable
from footfall.sources.visitors import FirstSeen
from footfall.streaming import streams

T0 = dt.datetime(2024, 1, 10, 9, 0, 0)
HIT = (
    "visitor_key string, payload_id bigint, received_at timestamp_ntz, origin int, n_events bigint, has_pageview boolean, "
    "utm_source string, utm_medium string, utm_campaign string, click_id_type string, n_pageviews bigint, "
    "n_conversions bigint, heartbeat bigint, page_path string"
)


def random_hits(n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        server, events = rnd.random() < 0.1, rnd.choice([0, 1, 1, 2])
        view = not server and events > 0 and rnd.random() < 0.6
        utm = rnd.choice(["", "", "", "A", "a", "b"])
        rows.append((
            f"v{rnd.randrange(6)}", i + 1, T0 + dt.timedelta(seconds=rnd.randrange(0, 90000, 300)), int(server), events, view,
            utm, "", "", rnd.choice(["", "", "", "gclid", "ttclid"]), int(view), 0, rnd.randrange(20), f"/{rnd.randrange(3)}/",
        ))
    return rows


def fold(rows, timeout):
    """Session of every payload by walking each visitor's history in order."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        v, pid, at, server, events, view = r[:6]
        triple, click = "|".join(r[6:9]).lower(), r[9]
        s = state.get(v)
        if s and (at - s["last"]).total_seconds() > timeout * 60:
            s = None
        if s and not server and view and (triple != "||" or click) and (triple != s["triple"] or (click and click != s["click"])):
            s = None
        if s is None:
            if server or events == 0:
                out[pid] = 0 if server else None
                continue
            s = state[v] = {"id": pid, "triple": triple, "click": click, "last": at}
        s["last"] = max(s["last"], at)
        out[pid] = s["id"]
    return out


@pytest.mark.parametrize("seed,seconds", [(1, 3600), (2, 7200), (3, 600)])
def test_sessionize_equals_fold(spark, seed, seconds):
    rows = random_hits(900, seed)
    df = spark.createDataFrame(rows, HIT)
    got = sessionize(df, 30, slice_seconds=seconds)
    assert {r.payload_id: r.session_id for r in got.select("payload_id", "session_id").collect()} == fold(rows, 30)


@pytest.mark.parametrize("seed", [4, 5])
def test_sessions_go_on_in_the_next_run(spark, seed):
    rows = sorted((r for r in random_hits(700, seed) if not r[3]), key=lambda r: (r[2], r[1]))
    cut = next(i for i in range(350, len(rows)) if rows[i][2] != rows[i - 1][2])
    whole = sessionize(spark.createDataFrame(rows, HIT), 30)
    first = sessionize(spark.createDataFrame(rows[:cut], HIT), 30)
    prior = build_sessions(first)
    second = sessionize(spark.createDataFrame(rows[cut:], HIT), 30, prior=prior)
    one = {r.payload_id: r.session_id for r in whole.select("payload_id", "session_id").collect()}
    two = {r.payload_id: r.session_id for r in first.unionByName(second).select("payload_id", "session_id").collect()}
    assert one == two
    cols = ["session_id", "started_at", "last_seen_at", "duration_seconds", "pageviews", "event_count", "exit_path", "is_engaged", "utm_source"]
    later = merge_sessions(build_sessions(second), prior)
    kept = prior.join(later.select("session_id"), "session_id", "left_anti")
    assert sorted(map(tuple, later.select(cols).unionByName(kept.select(cols)).collect())) == sorted(map(tuple, build_sessions(whole).select(cols).collect()))


def test_sessionize_plan_is_linear(spark, tmp_path):
    spark.createDataFrame(random_hits(50, 1), HIT).write.parquet(str(tmp_path / "hits"))
    plan = sessionize(spark.read.parquet(str(tmp_path / "hits")), 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and plan.count("Join") == 1


def test_gap_boundary(spark):
    def hit(pid, seconds, events=1):
        return ("v", pid, T0 + dt.timedelta(seconds=seconds), 0, events, False, "", "", "", "", 0, 0, 5, "/")

    rows = [hit(1, 0, 0), hit(2, 10), hit(3, 1810), hit(4, 3611), hit(5, 4000, 0), hit(6, 5700)]
    got = sessionize(spark.createDataFrame(rows, HIT), 30).select("payload_id", "session_id").collect()
    assert dict(map(tuple, got)) == {1: None, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4}


def delayed(rows, seed, at=2, late=599):
    """Rows in the order in which they come in: up to ``late`` seconds after their time."""
    rnd = random.Random(seed)
    return [r for _, _, r in sorted((r[at] + dt.timedelta(seconds=rnd.randrange(late)), i, r) for i, r in enumerate(rows))]


def test_live_sessions_equal_batch(spark, tmp_path):
    """Out of order over many micro-batches, with server rows: the sessions of one run."""
    rows = delayed(random_hits(600, 7), 7)
    df = spark.createDataFrame(rows, HIT)
    tick = ("tick", 0, T0 + dt.timedelta(days=9), 0, 1, False, "", "", "", "", 0, 0, 0, "/")
    for i in range(0, 601, 100):
        part = rows[i : i + 100] or [tick]
        spark.createDataFrame(part, HIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def write(batch, i):
        batch.withColumn("b", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))

    q = streams.live_sessions(stream, 30).writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.late_rows(q) == 0
    got = spark.read.parquet(str(tmp_path / "out")).where("session_id IS NOT NULL").groupBy("session_id").agg(F.max_by(F.struct("event_count", "engaged_seconds", "pageviews", "exit_path"), "b").alias("r"))
    batch = build_sessions(sessionize(df, 30)).select("session_id", "event_count", "engaged_seconds", "pageviews", "exit_path")
    assert sorted(map(tuple, got.select("session_id", "r.*").collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_of_live_sessions_are_counted(spark, tmp_path):
    rows = [r for r in sorted(random_hits(300, 3), key=lambda r: r[2]) if not r[3]]
    for part in (rows[150:], rows[:100], rows[100:150]):  # the older half comes last
        spark.createDataFrame(part, HIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(rows, HIT).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def write(batch, i):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    q = streams.live_sessions(stream, 30).writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    seen = out.agg(F.sum("late_payloads")).first()[0]
    border = rows[-1][2] - dt.timedelta(minutes=10)
    assert streams.late_rows(q) + seen == sum(r[2] < border for r in rows[:150]) == 150 and seen >= 100
    assert out.where("started_at < '%s'" % rows[150][2]).count() == 0


def test_a_late_row_joins_the_stored_session_that_covers_it(spark):
    def hit(pid, seconds, events=1, who="v"):
        return (who, pid, T0 + dt.timedelta(seconds=seconds), 0, events, events > 0, "", "", "", "", events, 0, 5, "/")

    first = sessionize(spark.createDataFrame([hit(1, 0), hit(2, 1000), hit(3, 2500), hit(4, 4000), hit(9, 0, who="w"), hit(10, 9000, who="w")], HIT), 30)
    prior = build_sessions(first)
    later = [hit(20, 900), hit(21, 2000, 0), hit(22, 3900), hit(23, 4000), hit(24, 5800), hit(25, -500), hit(26, -2000), hit(27, 100, 0, "w"), hit(28, 8700, who="w"), hit(29, 4500, who="w")]
    got = dict(map(tuple, sessionize(spark.createDataFrame(later, HIT), 30, prior=prior).select("payload_id", "session_id").collect()))
    assert got == {20: 1, 21: 1, 22: 1, 23: 1, 24: 1, 25: 1, 26: 26, 27: 9, 28: 10, 29: 29}


IPHONE = "Mozilla/5.0 (iPhone; CPU iPhone OS 18_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.1 Mobile/15E148 Safari/604.1"
URL = "https://example.org/tours/mara/"


def raw_hits(spark, rows):
    """Payload rows from dicts with the defaults of an ordinary page view."""
    base = dict(u=URL, r="", ua=IPHONE, ip="41.90.12.34", s=0, events=["page_view"], hb=None, hm=None, wd=False, dnt=False, gpc=False, vid=None)
    data = []
    for i, row in enumerate(rows):
        p = {**base, **row}
        ev = [(n, 0, '{"pv":"ab12"}', None, None, None, None, None, None, None) for n in p["events"]]
        data.append((
            i + 1, p["u"], p["r"], "Mara", "Africa/Nairobi", "en-GB", "390", False, p["vid"], p["wd"], '{"p":42,"t":"tour"}', p["hb"], p["hm"], ev,
            p["ip"], p["ua"], p["dnt"], p["gpc"], "", "KE", T0 + dt.timedelta(seconds=p["s"]),
        ))
    from footfall.schemas import HITS

    return spark.createDataFrame(data, HITS)


def salts(spark):
    return spark.createDataFrame([(T0.date() + dt.timedelta(days=i), f"salt{i}") for i in range(3)], "day date, salt string")


SITE = Settings(hosts=("example.org",), site="https://example.org", respect_dnt=True, excluded_ips=("10.0.0.0/8",), excluded_paths=("/admin/*",))


def test_ignored_payloads(spark):
    cases = [
        ({}, None), ({"dnt": True}, "dnt"), ({"ua": "curl/8.4.0 something"}, "bot"), ({"wd": True}, "bot"), ({"ip": "10.1.1.1"}, "excluded_ip"),
        ({"u": "https://example.org/admin/x"}, "excluded_path"), ({"u": "https://other.example/"}, "foreign_host"),
        ({"events": ["!!"], "ip": "41.1.1.1"}, "empty"), ({"events": [], "hb": "9", "ip": "41.2.2.2"}, "no_session"),
        ({"events": [], "hm": "[[5,5]]", "ip": "41.3.3.3"}, None),
    ]
    out = ingest.collect_hits(raw_hits(spark, [c for c, _ in cases]), SITE, salts(spark))
    got = {r.payload_id: r.reason for r in out.hits.select("payload_id", "reason").collect()}
    assert [got[i + 1] for i in range(len(cases))] == [w for _, w in cases]


def test_rate_limit_and_batch_cap(spark):
    out = ingest.collect_hits(raw_hits(spark, [{"events": ["page_view"] * 30}] + [{"s": 1}] * 130), SITE, salts(spark))
    reasons = {r.reason: r.n for r in out.hits.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {None: 120, "rate_limited": 11}
    assert out.events.count() == 25 + 119


def test_collected_session(spark):
    rows = [
        {"u": URL + "?utm_source=google&utm_medium=cpc&gclid=abc123", "r": "https://www.google.com/", "events": ["page_view"]},
        {"u": "https://example.org/contact/", "s": 60, "hb": "15", "events": ["page_view", "my_event"]},
        {"u": URL + "?utm_source=news&utm_medium=email", "s": 60, "events": ["page_view"]},
    ]
    out = ingest.collect_hits(raw_hits(spark, rows), SITE, salts(spark))
    a, b = out.sessions.orderBy("session_id").collect()
    assert (a.channel, a.click_id_type, a.click_id, a.landing_path, a.referrer_domain) == ("paid_search", "gclid", "", "/tours/mara/", "google.com")
    assert (a.os, a.device_type, a.viewport, a.is_returning, a.country) == ("iOS", "mobile", "xs", None, "")
    assert (a.pageviews, a.event_count, a.engaged_seconds, a.is_engaged, a.duration_seconds, a.exit_path) == (2, 3, 15, 1, 60, "/contact/")
    assert (b.channel, b.pageviews) == ("email", 1)
    e = out.events.where("event_name = 'my_event'").first()
    assert (e.category, e.module, e.post_id, e.page_title, e.attributes) == ("custom", "core", 42, "", '{"pv":"ab12"}')


def test_enhanced_mode(spark):
    site = Settings(**{**SITE.__dict__, "privacy_mode": "enhanced", "site_salt": "s"})
    vid = "a" * 32
    rows = [{"vid": vid, "u": URL + "?gclid=x1"}, {"vid": vid, "s": 7200, "ip": "81.2.2.2"}, {"vid": "b" * 32, "gpc": True, "u": URL + "?gclid=x1"}]
    s = {r.session_id: r for r in ingest.collect_hits(raw_hits(spark, rows), site, salts(spark)).sessions.collect()}
    assert [(s[i].id_mode, s[i].is_returning, s[i].click_id) for i in (1, 2, 3)] == [(1, 0, "x1"), (1, 1, ""), (0, None, "")]


def test_rollup_and_reports(spark):
    tz = "Africa/Nairobi"
    rows = []
    for i, (ip, query, conv) in enumerate([("41.1.1.1", "?utm_source=newsletter&utm_medium=email", True), ("81.2.2.2", "", False), ("92.3.3.3", "?gclid=abc", True)]):
        rows.append({"ip": ip, "u": URL + query, "s": i * 60, "hb": "40", "hm": "[[50,10]]", "events": ["page_view", "page_engagement"] + ["form_submit"] * conv})
    out = ingest.collect_hits(raw_hits(spark, rows), SITE, salts(spark))
    day = T0.date()
    daily = rollup.rollup(out.sessions, out.events, [day], tz)
    t = reports.totals(daily["daily_traffic"], day, day).first()
    assert (t.sessions, t.visitors, t.pageviews, t.conversions, t.engaged_seconds, t.engagement_rate, t.conversion_rate) == (3, 3, 3, 2, 120, 1.0, 0.6667)
    ch = {r.value: r.sessions for r in reports.dimension(daily["daily_dimensions"], "channel", day, day).collect()}
    assert ch == {"email": 1, "direct": 1, "paid_search": 1}
    c = daily["daily_content"].first()
    assert (c.path, c.pageviews, c.entrances, c.exits, c.conversions, c.post_type) == ("/tours/mara/", 3, 3, 3, 2, "tour")
    heat = rollup.heatmap_daily(out.heat).first()
    assert (heat.x, heat.y, heat.clicks, heat.device) == (50, 10, 3, "mobile")
    week = reports.series(daily["daily_traffic"], "2024-01-04", "2024-01-10").collect()
    assert [r.sessions for r in week] == [0, 0, 0, 0, 0, 0, 3]


def test_write_days_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(T0.date(), 1), (T0.date() + dt.timedelta(days=1), 2)], "day date, n int")
    path = str(tmp_path / "t")
    days = [T0.date(), T0.date() + dt.timedelta(days=1)]
    for _ in range(2):
        tables.write_days(df, path, days)
    assert sorted(map(tuple, spark.read.parquet(path).select("n").collect())) == [(1,), (2,)]
    tables.write_days(df.limit(0), path, days[1:])
    assert [r.n for r in spark.read.parquet(path).select("n").collect()] == [1]


def test_year_comparison():
    assert reports.comparison_range("2024-02-29", "2024-03-02", "year") == (dt.date(2023, 3, 1), dt.date(2023, 3, 2))
    assert reports.comparison_range("2024-01-08", "2024-01-10", "previous") == (dt.date(2024, 1, 5), dt.date(2024, 1, 7))


def test_currency(spark):
    fx = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "USD", "EUR", 0.5), (dt.date(2024, 1, 20), "USD", "EUR", 0.25), (dt.date(2024, 1, 1), "KES", "USD", 0.01), (dt.date(2024, 1, 1), "USD", "ZAR", 0.0), (dt.date(2024, 1, 1), "ZAR", "USD", 2.0)],
        "rate_date date, base_currency string, quote_currency string, rate double",
    ).withColumn("rate", F.col("rate").cast("decimal(20,10)"))
    cases = [("EUR", 10, 20.0), ("EUR", 25, 40.0), ("KES", 10, 0.1), ("GBP", 10, None), ("USD", 10, 10.0), ("", 10, 10.0), ("ZAR", 10, None)]
    df = spark.createDataFrame([(i, c, dt.datetime(2024, 1, d)) for i, (c, d, _) in enumerate(cases)], "i int, currency string, occurred_at timestamp_ntz")
    df = df.withColumn("event_value", F.lit(10).cast("decimal(18,4)"))
    got = currency.to_base(df, fx, "USD").orderBy("i").collect()
    assert [None if r.event_value_base is None else float(r.event_value_base) for r in got] == [w for _, _, w in cases]
    early = df.withColumn("occurred_at", F.lit("2023-12-31 00:00:00").cast("timestamp_ntz"))
    assert [r.event_value_base is None for r in currency.to_base(early, fx, "USD").orderBy("i").collect()] == [True, True, True, True, False, False, True]


def test_geo(spark):
    ranges = spark.createDataFrame(
        [("0.0.0.0", "127.255.255.255", "US", "", ""), ("41.90.0.0", "41.91.255.255", "KE", "Nairobi", "Nairobi"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "DE", "", "")],
        "start_ip string, end_ip string, country string, region string, city string",
    )
    cases = [("41.90.3.4", "", "KE"), ("8.8.8.8", "", "US"), ("2001:db8::5", "", "DE"), ("200.1.1.1", "BR", "BR"), ("200.1.1.1", "XX", ""), ("", "T1", "")]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], "i int, ip string, cf_country string")
    assert [r.country for r in geo.geo_lookup(df, ranges).orderBy("i").collect()] == [w for _, _, w in cases]


def test_session_cap_ticks_and_rage(spark):
    ev = spark.range(50).select(F.lit(7).alias("session_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 600)).alias("received_at"), F.col("id").alias("payload_id"), F.lit(0).alias("event_index"))
    assert sorted(r.payload_id for r in cap_session(ev, 20).collect()) == list(range(20))
    ticks = ev.select("session_id", F.lit(None).cast("string").alias("pv"), F.col("received_at").alias("ts"), F.lit(1).alias("visible"), F.col("payload_id").alias("tick_id"))
    assert [(r.pv, r.engaged_seconds) for r in engaged_time(ticks).collect()] == [(None, 49 * 60)]
    base = dt.datetime(2024, 1, 1, 0, 0, 59, 500000)
    at = [0, 300, 700, 1600, 1700]
    clicks = spark.createDataFrame([(1, "v", "a", base + dt.timedelta(milliseconds=m), 5, 5, i) for i, m in enumerate(at)], "session_id int, pv string, element string, ts timestamp_ntz, x int, y int, click_id int")
    assert [r.click_id for r in windows.rage_clicks(clicks).collect()] == [2]


def test_retention(spark):
    ev = spark.createDataFrame([(T0,), (T0 - dt.timedelta(days=400),)], "occurred_at timestamp_ntz")
    kept, gone = retain({"events": ev}, "2024-01-11 00:00:00")
    assert kept["events"].count() == 1 and [tuple(r) for r in gone.collect()] == [("events", 1)]


HTML = """<!DOCTYPE html><html><head><title>Great  Tours &amp; Safaris of Kenya</title><meta NAME="Description" content="short">
<meta name="robots" content="NOINDEX,follow"><link rel="Canonical" href="/other/"><script type="application/ld+json">{}</script>
<link rel="stylesheet" href="http://cdn.example/x.css"></head><body><h1>Tours</h1><h1>Two</h1><svg><text>hidden</text></svg>
<script>var a = "<img>";</script><img src="http://x.example/a.png"><img src="/b.png" alt=""><img role="presentation">
<p>one two-three it's <noscript>no</noscript></p><a href="/a/">a</a><a href="/a/#x">a</a><a href="https://www.x.example/b">b</a>
<a href="mailto:x@y.example">m</a><a href="https://else.example/">e</a><a href="/file.pdf">f</a><a href="/wp-admin/">w</a><a href=".">self</a></body></html>"""


def test_page_facts_and_issues(spark):
    rows = [(1, "https://x.example/", HTML, 200, 1600, "content"), (2, "https://x.example/a/", "", 404, 10, "content"), (3, "https://x.example/b/", None, 0, 0, "content"), (4, "http://x.example/c", "<p>Hi", 200, 1, "home")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, status_code int, response_ms int, source string")
    f = {r.page_id: r for r in audit_facts.page_issues(audit_facts.page_facts(df)).collect()}
    a = f[1]
    assert (a.title, a.description, a.h1, a.h1_count, a.words, a.images, a.images_no_alt) == ("Great Tours & Safaris of Kenya", "short", "Tours", 2, 13, 3, 1)
    assert (a.noindex, a.json_ld, a.insecure, a.external_links, a.canonical_url) == (1, 1, 2, 1, "https://x.example/other/")
    assert a.links == ["https://x.example/a/", "https://www.x.example/b/"]
    assert set(a.issues) == {
        "slow_response", "meta_description_length", "multiple_h1", "low_word_count", "images_missing_alt", "lang_missing",
        "viewport_missing", "noindex", "canonical_elsewhere", "open_graph_missing", "mixed_content",
    }
    assert a.issues["mixed_content"] == "2" and f[2].issues == {"http_4xx": "404"} and f[3].issues == {"fetch_failed": "1"}
    assert "title_missing" in f[4].issues and "no_internal_links" in f[4].issues


def test_all_links_of_a_page_count(spark):
    links = "".join(f'<a href="/p{i}/">x</a>' + '<a href="https://o.example/">o</a>' for i in range(400))
    df = spark.createDataFrame([(1, "https://x.example/", f"<body>{links}", 200, 1, "home")], "page_id bigint, url string, html string, status_code int, response_ms int, source string")
    r = audit_facts.page_facts(df).first()
    assert (len(r.links), r.external_links) == (400, 400)


def test_robots_and_health(spark):
    bodies = ["User-agent: *\nDisallow: /", "User-agent: a\nDisallow: /\nUser-agent: *\nDisallow: /x", "user-agent: *\rDISALLOW: / # all", ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "site int, body string")
    assert {r.site: r.blocks_all for r in audit_site.robots_blocks_all(df).collect()} == {0: 1, 1: 0, 2: 1, 3: 0}
    pages = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 2, 1), (3, 0, 0, 1), (4, 0, 0, 0)], "page_id int, errors bigint, warnings bigint, notices bigint")
    site = spark.createDataFrame([("robots_blocks_all",), ("no_https",)], "code string")
    assert audit_site.health(pages, site).first().health == 55  # 100 * (1 - 1.3 / 4) - 10 - 3 = 54.5
    assert audit_site.health(pages.limit(0), site.limit(0)).first().health == 100


def test_counters_survive_redelivery(spark, tmp_path):
    path, how = f"file://{tmp_path}/counters", (["day", "x"], ["n"], None)
    schema = "day date, x int, n bigint"

    def batch(*rows):
        return spark.createDataFrame([(dt.date(2024, 1, d), x, n) for d, x, n in rows], schema)

    def total():
        return {(r.day.day, r.x): r.n for r in tables.read_counters(spark, path, schema, *how).collect()}

    assert total() == {}
    tables.upsert_counters(batch((1, 1, 5)), path, *how, batch_id=0, query_id="a")
    tables.upsert_counters(batch((1, 1, 7)), path, *how, batch_id=0, query_id="b")  # a fresh checkpoint counts from 0 again
    assert total() == {(1, 1): 12}
    # A delivery that died before its manifest leaves files that nothing names.
    batch((1, 1, 100)).write.partitionBy("day").parquet(f"{path}/data/v=dead")
    assert total() == {(1, 1): 12}
    for _ in range(2):
        tables.upsert_counters(batch((1, 1, 11), (2, 3, 1)), path, *how, batch_id=1, query_id="a")
    assert total() == {(1, 1): 23, (2, 3): 1}
    tables.compact_counters(spark, path, schema, *how)
    tables.upsert_counters(batch((1, 1, 11), (2, 3, 1)), path, *how, batch_id=1, query_id="a")  # delivered again after compaction
    tables.upsert_counters(batch((2, 3, 4)), path, *how, batch_id=2, query_id="a")
    assert total() == {(1, 1): 23, (2, 3): 5}


@pytest.mark.parametrize("html,want", [
    ('<head><title>t</title><p>implied body<h1>x</h1><a href="/a">l</a>', ("t", "x", 1, 4, ["/a"], False)),
    ("<title>no head</title><h1>y</h1><p>one two", ("no head", "y", 1, 3, [], False)),
    ("<p>text first<title>late</title>", ("late", "", 0, 2, [], False)),
    ("<html><head><title>a</title></head><body><svg><title>icon</title></svg><h1>z</h1>word", ("a", "z", 1, 2, [], False)),
    ('<title>m</title><p>before</p><![foo[ x ]]><a href="/b">b</a>', ("m", "", 0, 1, [], True)),
    ("", ("", "", 0, 0, [], False)),
    ("plain words only", ("", "", 0, 3, [], False)),
])
def test_pages_with_implied_tags(html, want):
    names = [c.split()[0] for c in audit_facts.FACT_COLUMNS.split(", ")]
    got = dict(zip(names, audit_facts._read(html)))
    seen = (got["title"], got["h1"], got["h1_count"], got["words"], got["hrefs"], got["read_error"] != "")
    if want[5]:
        assert seen[0] == want[0] and seen[5]
    else:
        assert seen == want


@pytest.fixture
def stored_visits(spark, tmp_path):
    """Ten days of events and of sessions that last three hours, stored by date."""
    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 00:30:00").cast("timestamp_ntz"))
    e = spark.range(240).select(
        F.col("id").alias("event_id"), F.col("id").alias("session_id"), at.alias("occurred_at"), F.lit("ad_click").alias("event_name"),
        F.lit("/").alias("page_path"), F.lit("t").alias("page_title"),
    )
    s = spark.range(240).select(
        F.col("id").alias("session_id"), F.lit("v").alias("visitor_key"), at.alias("started_at"), F.timestamp_add("HOUR", F.lit(3), at).alias("last_seen_at"),
        F.lit("direct").alias("channel"), (F.col("id") % 2).alias("conversions"), F.lit("KE").alias("country"), F.lit("mobile").alias("device_type"),
    )
    tables.append_events(e, f"{tmp_path}/events")
    tables.append_sessions(s, f"{tmp_path}/sessions")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/events"), spark.read.parquet(f"{tmp_path}/sessions")


def test_reports_prune_by_date(stored_visits):
    _, e, s = stored_visits
    now, days = "2024-01-05 12:00:00", ("2024-01-03", "2024-01-04", "UTC")
    plans = [
        realtime.realtime_active(s, now), realtime.realtime_per_minute(e, now), realtime.realtime_top_pages(e, now),
        realtime.realtime_top_channels(s, now), realtime.realtime_feed(s, e, now), realtime.volume_24h(s, e, now),
        ads.converting_sessions(e, s, *days), ads.ad_visits(e, s, *days), ads.ad_channels(e, s, *days),
        *retain({"events": e, "sessions": s}, now, raw_months=1)[0].values(),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
        assert scans and all("_date" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans), plan
    assert ads.ad_visits(e, s, *days).first().converting_sessions == 24
    assert realtime.realtime_active(s, "2024-01-02 02:00:00", 60).first()[0] == 1


def test_retention_deletes_on_disk(spark, stored_visits):
    root, e, s = stored_visits
    for name, df, ts in (("events", e, "occurred_at"), ("sessions", s, "started_at")):
        kept, counts = retain({name: df}, "2024-02-04 12:00:00", raw_months=1)
        want, gone = sorted(r[0] for r in kept[name].select(ts).collect()), counts.first()["deleted"]
        assert drop_old(spark, f"{root}/{name}", name, "2024-02-04 12:00:00", 1) == gone > 0
        left = spark.read.parquet(f"{root}/{name}")
        assert sorted(r[0] for r in left.select(ts).collect()) == want and set(left.columns) == set(df.columns)
        assert drop_old(spark, f"{root}/{name}", name, "2024-02-04 12:00:00", 1) == 0


def test_server_events_and_keys(spark):
    pages = raw_hits(spark, [{"s": 0}, {"s": 30, "events": ["page_view", "cta_click"]}, {"s": 5000, "ip": "41.7.7.7"}])
    server = raw_hits(spark, [{"s": 60, "events": ["purchase"]}, {"s": 70, "events": ["refund"], "ip": None, "ua": None}, {"s": 90, "events": ["refund"], "ip": "41.9.9.9"}])
    server = server.withColumn("payload_id", F.col("payload_id") + 100).withColumn("u", F.lit(None).cast("string"))
    out = ingest.collect_hits(pages, SITE, salts(spark), server_hits=server)
    ev = {(r.payload_id, r.event_index): r for r in out.events.collect()}
    assert {k: (r.session_id, r.origin) for k, r in ev.items()} == {
        (1, 0): (1, 0), (2, 0): (1, 0), (2, 1): (1, 0), (3, 0): (3, 0), (101, 0): (1, 1), (102, 0): (0, 1), (103, 0): (0, 1),
    }
    assert ev[102, 0].visitor_key is None and len({r.event_id for r in ev.values()}) == 7
    ses = {r.session_id: r for r in out.sessions.collect()}
    assert set(ses) == {1, 3} and ses[1].event_count == 4 and len({r.session_key for r in ses.values()}) == 2
    # The stored rows feed the jobs behind them.
    linked = ingest.link_server_events(spark.createDataFrame([(ses[3].session_key,), ("none",)], "session_key string"), out.sessions)
    assert sorted(r.session_id for r in linked.collect()) == [0, 3]
    feed = realtime.realtime_feed(out.sessions, out.events, str(T0 + dt.timedelta(seconds=5100)))
    assert [r.event for r in feed.collect()][:1] == ["page_view"]


def test_geo_equals_brute_force(spark):
    import ipaddress

    rnd = random.Random(9)

    def some(v6):
        top = 2**128 if v6 else 2**32
        a = rnd.choice([rnd.randrange(top), rnd.randrange(50) << (112 if v6 else 20), rnd.randrange(3000) + (5 << 20)])
        return a, min(top - 1, a + rnd.choice([0, 7, 255, 256, 65_535, 70_000, 2**24, 2 ** (100 if v6 else 28)]))

    def shown(n, v6):
        return str(ipaddress.IPv6Address(n) if v6 else ipaddress.IPv4Address(n))

    ranges = [(v6, *some(v6), f"{chr(65 + i % 26)}{chr(65 + i // 26)}", f"r{i}") for i in range(120) for v6 in [i % 3 == 0]]
    ranges.append((False, 0, 2**32 - 1, "ZZ", "all"))
    ends = [(v6, x) for v6, lo, hi, *_ in ranges for x in (lo - 1, lo, hi, hi + 1, (lo + hi) // 2) if 0 <= x < (2**128 if v6 else 2**32)]
    want = []
    for v6, x in ends:
        best = [(lo, -hi, region) for w, lo, hi, _, region in ranges if w == v6 and lo <= x <= hi]
        want.append({r for lo, hi, r in best if (lo, hi) == max(best)[:2]} or {""})
    table = spark.createDataFrame([(shown(lo, w), shown(hi, w), c, r, "") for w, lo, hi, c, r in ranges], "start_ip string, end_ip string, country string, region string, city string")
    df = spark.createDataFrame([(i, shown(x, v6)) for i, (v6, x) in enumerate(ends)], "i int, ip string")
    got = [r.region for r in geo.geo_lookup(df, table).orderBy("i").collect()]
    assert len(got) == len(want) and all(g in w for g, w in zip(got, want, strict=True))
    none = geo.geo_lookup(df, table.limit(0))
    assert {r.region for r in none.collect()} == {""} and none.count() == len(ends)


def test_stream_collect_rejects_late_rows(spark, tmp_path):
    hits = raw_hits(spark, [{"s": 0}, {"s": 60}, {"s": 900}, {"s": 960}, {"s": 5, "ip": "41.8.8.8"}, {"s": 700, "ip": "41.8.8.8"}])
    for ids in ((1, 2), (3,), (4, 5, 6)):
        hits.where(F.col("payload_id").isin(*ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.stream_collect(stream, SITE, salts(spark), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    events = streams.collected_events(spark, f"{tmp_path}/out")
    assert sorted((r.payload_id, r.session_id) for r in events.collect()) == [(1, 1), (2, 1)]  # younger ones wait
    streams.finish_collect(spark, SITE, salts(spark), f"{tmp_path}/out")
    got = {r.session_id: (r.event_count, r.duration_seconds) for r in streams.collected_sessions(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (4, 960), 6: (1, 0)}
    assert [(r.payload_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()] == [(5, "late")]
    events = streams.collected_events(spark, f"{tmp_path}/out", "2024-01-10", "2024-01-10")
    assert sorted((r.payload_id, r.session_id) for r in events.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6)]
    assert streams.collected_events(spark, f"{tmp_path}/out", "2024-01-11").count() == 0


def busy_hits(spark, seed):
    """Payloads of few visitors, in the order in which they come in: many a minute, long sessions, new campaigns, pauses."""
    rnd, rows, s = random.Random(seed), [], 0
    for _ in range(260):
        s += rnd.choice([1, 1, 2, 5, 20, 60, 400, 2500])
        tag = rnd.choice(["", "", "", "?utm_source=a", "?utm_source=b&gclid=x1"])
        rows.append({"s": s, "ip": f"41.7.7.{rnd.randrange(3)}", "u": URL + tag, "events": ["page_view"] * rnd.choice([0, 1, 1, 2, 3]), "hb": str(rnd.randrange(9))})
    at = [r["s"] + rnd.randrange(599) for r in rows]
    return raw_hits(spark, rows).cache(), [i + 1 for i in sorted(range(len(rows)), key=lambda i: (at[i], i))]


LIMITS = {"per_minute": 4, "event_cap": 7}
SESSION_SHOWN = ["session_id", "started_at", "last_seen_at", "event_count", "pageviews", "engaged_seconds", "exit_path", "utm_source", "click_id_type", "is_engaged"]


@pytest.mark.parametrize("seed,cuts", [(2, 4)])
def test_runs_out_of_order_equal_one_run(spark, seed, cuts):
    hits, order = busy_hits(spark, seed)
    whole = ingest.collect_hits(hits, SITE, salts(spark), **LIMITS)
    step, carry, events, reasons, sessions = -(-len(order) // cuts), None, [], [], {}
    for n in range(cuts):
        mine = hits.where(F.col("payload_id").isin(*order[n * step : (n + 1) * step]))
        out, late, carry = runs.collect_run(mine, SITE, salts(spark), carry, last=n == cuts - 1, **LIMITS)
        events += [tuple(r) for r in out.events.select("payload_id", "session_id", "event_index").collect()]
        reasons += [tuple(r) for r in out.hits.select("payload_id", "reason").collect()] + [tuple(r) for r in late.select("payload_id", "reason").collect()]
        sessions |= {r.session_id: tuple(r) for r in out.sessions.select(SESSION_SHOWN).collect()}
    assert sorted(reasons, key=repr) == sorted(map(tuple, whole.hits.select("payload_id", "reason").collect()), key=repr)
    assert {"rate_limited", None} <= {r for _, r in reasons}
    assert sorted(events) == sorted(map(tuple, whole.events.select("payload_id", "session_id", "event_index").collect()))
    want = {r.session_id: tuple(r) for r in whole.sessions.select(SESSION_SHOWN).collect()}
    assert sessions == want and max(x[3] for x in want.values()) == LIMITS["event_cap"] and len(want) > 20


def test_a_micro_batch_reads_nothing_but_what_the_one_before_handed_on(spark, tmp_path):
    """All results of earlier batches are made unreadable while the stream goes on; a batch is delivered twice."""
    hits, order = busy_hits(spark, 3)
    whole = ingest.collect_hits(hits, SITE, salts(spark), **LIMITS)
    got, root = {}, f"{tmp_path}/out"
    for n, i in enumerate(range(0, len(order), 90)):
        mine = hits.where(F.col("payload_id").isin(*order[i : i + 90]))
        for _ in range(2 if n == 1 else 1):
            streams._collect_batch(mine, n, SITE, salts(spark), root, 600, **LIMITS)
        got |= {r.session_id: tuple(r) for r in spark.read.parquet(f"{root}/sessions/batch={n}").select(SESSION_SHOWN).collect()}
        for part in [p for name in ("sessions", "heat", "rejects") for p in (tmp_path / "out" / name / f"batch={n}").glob("part-*")]:
            part.write_bytes(b"")
        assert len(list((tmp_path / "out/carry").glob("batch=*"))) <= 2
    carry = streams.read_carry(spark, f"{root}/carry/batch={n}")
    out, _, _ = runs.collect_run(hits.limit(0), SITE, salts(spark), carry, last=True, **LIMITS)
    got |= {r.session_id: tuple(r) for r in out.sessions.select(SESSION_SHOWN).collect()}
    assert got == {r.session_id: tuple(r) for r in whole.sessions.select(SESSION_SHOWN).collect()}
    stored = [tuple(r) for r in streams.collected_events(spark, root).unionByName(out.events.withColumn("event_date", F.to_date("occurred_at"))).select("payload_id", "session_id", "event_index").collect()]
    assert sorted(stored) == sorted(map(tuple, whole.events.select("payload_id", "session_id", "event_index").collect()))
    quiet, late, after = runs.collect_run(hits.limit(0), SITE, salts(spark), None)
    assert quiet.sessions.count() == late.count() == after.pending.count() == 0


def test_a_micro_batch_asks_for_its_visitors_once_and_makes_events_beside_the_sessions(spark, tmp_path, monkeypatch):
    hits, order = busy_hits(spark, 5)
    asked, names, side = [], [], []
    lookup, sessions_of = FirstSeen.lookup, ingest._sessions
    monkeypatch.setattr(FirstSeen, "lookup", lambda self, visitors: asked.append(1) or lookup(self, visitors))
    for module in (streams, runs, ingest):
        monkeypatch.setattr(module, "stored", lambda df, name, *path: names.append(name) or stored(df, name, *path))
    events = threading.Event()
    append = PartTable.append
    monkeypatch.setattr(PartTable, "append", lambda self, *a: (events.set() if self.part == "event_date" else None, append(self, *a))[1])
    monkeypatch.setattr(ingest, "_sessions", lambda *a: side.append(events.wait(60)) or sessions_of(*a))  # events need no sessions
    streams._collect_batch(hits, 0, SITE, salts(spark), f"{tmp_path}/out", 600, daily_tz="UTC", **LIMITS)
    assert side == [True] and len(asked) == 1 and names.count("run-sessions") == names.count("run-events") == 1
    assert (tmp_path / "out/sessions/batch=0/_SUCCESS").exists() and "signed" not in names
    seen = FirstSeen(spark, f"{tmp_path}/out/visitors").table.read().count()
    assert seen == spark.read.parquet(f"{tmp_path}/out/sessions").select("visitor_key").distinct().count() > 0
