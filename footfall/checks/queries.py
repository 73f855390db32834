"""One registered query per operator. Names carry the operator ids of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.checks.warehouse import linked_payloads, plain, session_rows, warehouse
from footfall.functions import agents, measures, network, privacy, text, urls
from footfall.functions.channels import channel, domain_matches
from footfall.functions.measures import viewport_bucket
from footfall.functions.times import ntz, plus_seconds
from footfall.operators import admit as adm
from footfall.operators import audit_facts as facts
from footfall.operators import audit_site as site
from footfall.operators import currency, enrich, geo, retention, rollup, windows
from footfall.operators import events as evs
from footfall.operators import sessions as ses
from footfall.plans import ads, ingest, realtime, reports, runs
from footfall.plans.increments import DailyRollup
from footfall.runtime import scratch_dir, stored, together
from footfall.settings import Settings
from footfall.sources import sample, tables
from footfall.sources.hits import split_bodies
from footfall.sources.parts import PartTable
from footfall.sources.visitors import FirstSeen
from footfall.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FROM, TO = "2024-01-08", "2024-01-28"
NOW = "2024-01-20 12:00:00"
TODAY = "2024-01-30"
TZ = sample.TZ


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# ---- scans and sinks ----------------------------------------------------------------------------


@query
def A1_read_hits(spark, d):
    """Every mapped payload as a JSON body, a few of them broken, split into hits and rejects."""
    h = sample.raw_hits(spark, d)
    body = F.to_json(F.struct("u", "r", "ti", "tz", "lg", "vw", "tp", "vid", "wd", "hb", "e"))
    k = F.col("payload_id") % 50
    broken = (
        F.when(k == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(k == 2, F.substring(body, 1, 40))
        .when(k == 4, F.concat(F.lit('{"u":"'), F.repeat(F.lit("x"), 17000), F.lit('"}')))
        .when(k == 6, F.lit('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":[1]}}}}}}}}'))
        .when(k == 8, F.lit('{"a":{"b":{"c":{"d":{"e":{"f":{"g":"{{{{"}}}}}}}'))
        .otherwise(body)
    )
    lines = h.select(
        F.col("payload_id").alias("id"), "ip", "user_agent", "dnt", "gpc", "ch_platform", "cf_country", "received_at",
        broken.alias("body"),
    )
    hits, rejects = split_bodies(lines)
    ok = hits.select(F.lit("hit").alias("outcome"), F.coalesce("u", F.lit("")).alias("u"), F.coalesce(F.size("e"), F.lit(0)).alias("n"))
    bad = rejects.select(F.col("reason").alias("outcome"), F.lit("").alias("u"), F.lit(0).alias("n"))
    rows = ok.unionByName(bad)
    return rows.groupBy("outcome").agg(
        F.count("*").alias("lines"), F.countDistinct("u").alias("urls"), F.sum(F.greatest("n", F.lit(0))).alias("events")
    )


@query
def A2_scan_events(spark, d):
    e = tables.scan_events(warehouse(spark, d).events, FROM, TO, TZ)
    return e.groupBy("event_name").agg(F.count("*").alias("events"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))


@query
def A3_scan_sessions(spark, d):
    s = tables.scan_sessions(warehouse(spark, d).sessions, FROM, TO, TZ)
    return s.groupBy("channel").agg(F.count("*").alias("sessions"), F.min("started_at").alias("first"), F.max("started_at").alias("last"))


@query
def A4_scan_daily(spark, d):
    return tables.scan_daily(warehouse(spark, d).daily("daily_events"), FROM, TO).select("day", "event_name", "events", "sessions")


@query
def A5_read_fx_rates(spark, d):
    """Rates written in both forms and read back."""
    fx, path = sample.fx_rates(spark, d), scratch_dir(spark, "fx")
    fx.write.parquet(f"{path}/parquet")
    fx.write.option("header", True).csv(f"{path}/csv")
    both = [tables.read_fx_rates(spark, f"{path}/{form}", form).withColumn("form", F.lit(form)) for form in ("parquet", "csv")]
    return both[0].unionByName(both[1])


@query
def A10_write_days(spark, d):
    """Writes the traffic table twice, the second time for two days only; the result is the table itself."""
    w = warehouse(spark, d)
    path = scratch_dir(spark, "write-days")
    dt = w.daily("daily_traffic")
    days = [r[0] for r in dt.select("day").collect()]  # one row per day
    tables.write_days(dt, path, days)
    tables.write_days(dt, path, days[:2])
    return spark.read.parquet(path).select("day", "sessions", "events", "revenue")


@query
def A10_replace_days(spark, d):
    """The traffic table in parts: days written, some written again, one by a writer that fails before it is done."""
    dt = warehouse(spark, d).daily("daily_traffic")
    table = PartTable(spark, scratch_dir(spark, "replace-days"))
    days = [r[0] for r in dt.select("day").collect()]  # one row per day
    table.replace(dt.withColumn("sessions", F.col("sessions") * 2), days)
    table._write(dt.withColumn("sessions", F.lit(0).cast("bigint")))  # files that no manifest names
    table.replace(dt, days[::2])
    table.replace(dt, days[1::2])
    table.vacuum(keep=1, seconds=0)
    return table.read().select("day", "sessions", "events", "revenue")


@query
def A12_counters_in_batches(spark, d):
    """Crawler counters added day by day in twelve batches, some of them twice, merged now and then."""
    path = scratch_dir(spark, "counters")
    hits = stored(rollup.crawler_hits(sample.requests(spark, d), "SiteAudit/"), "crawler-hits")
    schema, *how = CRAWLER_COUNTERS
    for batch in range(12):
        part = rollup.crawler_daily(hits.where(F.pmod(F.dayofmonth("ts"), F.lit(12)) == batch))
        for _ in range(1 + batch % 2):
            tables.upsert_counters(part, path, *how, batch_id=batch, query_id="days")
        if batch % 5 == 4:
            tables.compact_counters(spark, path, schema, *how)
    rows = tables.read_counters(spark, path, schema, *how)
    return rows.select("day", "crawler", "path", "crawler_type", "status_code", "hits", "last_seen_at")


@query
def A11_append_events(spark, d):
    w = warehouse(spark, d)
    path = scratch_dir(spark, "append")
    e = w.events.select("event_id", "occurred_at", "event_name")
    tables.append_events(e.where(F.col("event_id") % 4 < 2), path)
    tables.append_events(e.where(F.col("event_id") % 4 >= 2), path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


CRAWLER_COUNTERS = (
    "day date, crawler string, path string, crawler_type string, status_code int, hits bigint, last_seen_at timestamp_ntz",
    ["day", "crawler", "path"], ["hits"], {"status_code": "last_seen_at", "crawler_type": "last_seen_at"},
)


@query
def A12_upsert_counters(spark, d):
    """Crawler counters of two queries that both count batches from 0, one batch delivered again after a compaction and
    one before, equal to the batch rollup."""
    path = scratch_dir(spark, "upsert")
    hits = rollup.crawler_hits(sample.requests(spark, d), "SiteAudit/")
    cut, later = ntz("2024-01-15 06:00:00"), ntz("2024-01-22 06:00:00")
    a, b, c = hits.where(F.col("ts") < cut), hits.where((F.col("ts") >= cut) & (F.col("ts") < later)), hits.where(F.col("ts") >= later)
    schema, *how = CRAWLER_COUNTERS
    for part, batch, name in [(a, 0, "first"), (b, 1, "first"), (b, 1, "first"), (c, 0, "second")]:
        tables.upsert_counters(rollup.crawler_daily(part), path, *how, batch_id=batch, query_id=name)
        if name == "second" or batch == 0:
            tables.compact_counters(spark, path, schema, *how)
    tables.upsert_counters(rollup.crawler_daily(a), path, *how, batch_id=0, query_id="first")
    rows = tables.read_counters(spark, path, schema, *how)
    return rows.groupBy("day", "crawler").agg(
        F.sum("hits").alias("hits"), F.count("*").alias("paths"), F.max("last_seen_at").alias("last_seen")
    )


@query
def A13_export_csv(spark, d):
    """The event report written as CSV and read back."""
    path = scratch_dir(spark, "csv")
    tables.export_csv(reports.events(warehouse(spark, d).daily("daily_events"), FROM, TO), "events", path)
    return spark.read.option("header", True).schema(
        "event string, category string, events bigint, sessions bigint, value double, is_conversion int"
    ).csv(path)


@query
def A14_csv_safe(spark, d):
    doc = sample.table(spark, d, "documents")
    first = F.element_at(F.array(*[F.lit(x) for x in ["=", "+", "-", "@", "\t", "\r", "", "a"]]), (F.col("doc_id") % 8).cast("int") + 1)
    rows = doc.select("doc_id", F.concat(first, "text").alias("cell"), (F.col("n_chars") > 500).alias("long"))
    return text.csv_safe(rows).select("doc_id", F.md5("cell").alias("cell_md5"), "long")


# ---- admission ----------------------------------------------------------------------------------

SITE = Settings(
    respect_dnt=True, privacy_mode="enhanced", excluded_ips=("41.90.3.0/24", "41.90.12.9", "2001:db8::/32"),
    excluded_paths=("/admin/*",), hosts=("site.example",), session_timeout_minutes=240, base_currency="USD",
    site="https://site.example", site_salt="site-salt",
)


def salts(spark, d):
    days = sample.raw(spark, d).select(F.explode(F.array("received_at", plus_seconds("received_at", 1))).alias("t"))
    day = days.select(F.to_date("t").alias("day")).distinct()
    return day.withColumn("salt", F.sha2(F.col("day").cast("string"), 256))


def enriched(spark, d):
    return enrich.enrich(sample.raw_hits(spark, d), SITE, salts(spark, d), sample.SAMPLE_REGISTRY)


def collected(spark, d):
    return ingest.collect_hits(
        sample.raw_hits(spark, d, deal=True), SITE, salts(spark, d), sample.geo_ranges(spark, d), sample.fx_rates(spark, d),
        sample.SAMPLE_REGISTRY, dealt=True,
    )


@query
def B1_admit(spark, d):
    return adm.admit(enriched(spark, d), SITE).select("payload_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def B2_admission_report(spark, d):
    return adm.admission_report(collected(spark, d).hits)


@query
def B3_is_bot(spark, d):
    r = sample.requests(spark, d)
    return r.withColumn("bot", agents.is_bot("user_agent").cast("int")).groupBy("user_agent", "bot").agg(F.count("*").alias("requests"))


@query
def B4_crawler(spark, d):
    return rollup.crawler_hits(sample.requests(spark, d)).groupBy("crawler", "crawler_type").agg(F.count("*").alias("requests"))


@query
def B5_exclude_ips(spark, d):
    p = sample.payloads(spark, d).select("payload_id", "ip")
    return network.exclude_ips(p, ["41.90.3.0/24", "41.90.16.0/20", "41.90.12.9", "10.0.0.0/8", "2001:db8::/32"])


@query
def B5_exclude_table(spark, d):
    """Addresses in no block of a table: a block of 25 to 32 bits for every supplier."""
    k = F.col("s_suppkey")
    octets = [F.lit("41"), F.lit("90"), (k * 37 % 256).cast("string"), (k * 11 % 256).cast("string")]
    blocks = sample.table(spark, d, "supplier").select(F.concat(F.concat_ws(".", *octets), F.lit("/"), (25 + k % 8).cast("string")).alias("block"))
    return geo.exclude_blocks(sample.payloads(spark, d).select("payload_id", "ip"), blocks)


@query
def B6_own_hosts(spark, d):
    p = sample.table(spark, d, "pages").select("page_id", F.lower(urls.url_host("url")).alias("host"))
    hosts = ["ththre.example.com", "therha.example.com", "therin.example.net", "m.therou.example.com"]
    return adm.own_hosts(p, hosts)


@query
def B7_exclude_paths(spark, d):
    p = sample.table(spark, d, "pages").select("page_id", urls.url_path("url").alias("page_path"))
    return adm.exclude_paths(p, ["/FR/*", "/en/*.html", "/de/1*/"])


@query
def B8_rate_limit(spark, d):
    """Payloads of a visitor that pass a limit of one per minute of a compressed clock."""
    p = sample.payloads(spark, d).withColumn(
        "received_at", plus_seconds(ntz("2024-01-01 00:00:00"), F.col("payload_id") / 100)
    )
    return adm.rate_limit(p, 1).select("payload_id", "visitor_key")


@query
def B9_cap_batch(spark, d):
    """Documents as payloads of words: the first 25 stay."""
    h = sample.table(spark, d, "documents").select(F.col("doc_id").alias("payload_id"), F.split("text", " ").alias("e"))
    return evs.cap_batch(h).select("payload_id", F.size("e").alias("kept"), F.md5(F.array_join("e", " ")).alias("names_md5"))


@query
def B10_cap_session(spark, d):
    e = sample.payloads(spark, d).select(
        (F.col("user_id") + 1).alias("session_id"), "received_at", "payload_id", F.lit(0).alias("event_index")
    )
    return ses.cap_session(e, 20, 86400).select("session_id", "payload_id")


@query
def B11_valid_events(spark, d):
    h = evs.valid_events(sample.raw_hits(spark, d))
    return h.select(F.explode("e").alias("ev")).groupBy(F.col("ev.n").alias("event_name")).agg(F.count("*").alias("events"))


@query
def B12_clean_attributes(spark, d):
    """Attributes built from event rows with forbidden names, personal data and lists mixed in."""
    e = sample.raw(spark, d)
    k, v = F.col("k"), F.col("value")
    json = F.to_json(
        F.struct(
            F.concat(F.lit("v"), k).alias("Label"), F.lit("bob@mail.example").alias("note"),
            F.lit("x").alias("user_email"), F.lit("y").alias("name"), k.alias("count"), (k % 2 == 0).alias("flag"),
            F.array(F.lit("a"), F.lit("+254 712 345 678"), F.concat(F.lit("b"), k)).alias("list"),
            F.lit("  <b>bold</b> ").alias("tagged"), F.lit("z").alias("9bad"), F.lit("").alias("blank"),
            F.concat(F.repeat(F.lit("ab "), 80), k).alias("long"),
        )
    )
    return evs.clean_attributes(e.select("event_id", json.alias("attributes")))


@query
def B13_exclude_roles(spark, d):
    e = sample.raw(spark, d).withColumn(
        "roles", F.when(F.col("user_id") % 5 == 0, F.array(F.lit("editor"))).when(F.col("user_id") % 5 == 1, F.array(F.lit("author"), F.lit("administrator"))).otherwise(F.array(F.lit("subscriber")))
    )
    return evs.exclude_roles(e, Settings().excluded_roles).select("event_id", "user_id")


@query
def B15_having_zero(spark, d):
    s = warehouse(spark, d).daily("daily_searches")
    return reports.having_zero(s).select("day", "term", "zero_results")


# ---- enrichment ---------------------------------------------------------------------------------


@query
def C1_parse_url(spark, d):
    p = urls.parse_url(sample.table(spark, d, "pages"), "url")
    q = F.transform(F.sort_array(F.map_entries("query_params")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select("page_id", "host", "page_path", F.array_join(q, "&").alias("query"))


@query
def C2_clean_path(spark, d):
    h = sample.raw_hits(spark, d)
    return h.select("payload_id", urls.clean_path(urls.url_path("u")).alias("path"))


@query
def C3_identity_query(spark, d):
    h = sample.raw_hits(spark, d)
    return h.select("payload_id", urls.identity_query(urls.query_map(urls.url_query("u"))).alias("identity"))


@query
def C4_campaign(spark, d):
    h = sample.raw_hits(spark, d).withColumn("m", urls.query_map(urls.url_query("u")))
    return h.select("payload_id", *urls.campaign("m"))


@query
def C5_click_id(spark, d):
    h = sample.raw_hits(spark, d).withColumn("c", urls.click_id(urls.query_map(urls.url_query("u"))))
    return h.select("payload_id", F.col("c.type").alias("click_id_type"), F.col("c.value").alias("click_id"))


@query
def C6_referrer(spark, d):
    h = sample.raw_hits(spark, d).withColumn("c", urls.referrer("r", ["site.example"]))
    return h.select("payload_id", F.col("c.domain").alias("domain"), F.col("c.url").alias("url"))


@query
def C7_channel(spark, d):
    return channel(sample.payloads(spark, d)).select("payload_id", "channel")


@query
def C8_domain_matches(spark, d):
    """Which rule entries match the hosts of all pages."""
    p = sample.table(spark, d, "pages").select("page_id", F.lower(urls.url_host("url")).alias("host"))
    return p.select(
        "page_id",
        domain_matches("host", "example.com").cast("int").alias("exact"),
        domain_matches("host", "example.").cast("int").alias("any_tld"),
        domain_matches("host", "blog.").cast("int").alias("prefix"),
    )


@query
def C9_user_agent(spark, d):
    u = agents.user_agent(sample.payloads(spark, d))
    cols = ["user_agent", "browser", "browser_version", "os", "os_version", "device_type"]
    return u.groupBy(*cols).agg(F.count("*").alias("hits"))


@query
def C10_viewport_bucket(spark, d):
    h = sample.payloads(spark, d)
    return h.groupBy("vw", measures.viewport_bucket("vw").alias("viewport")).agg(F.count("*").alias("hits"))


@query
def C11_language_timezone(spark, d):
    h = sample.raw_hits(spark, d)
    zones = sample.raw(spark, d).select(F.lit("Africa/Nairobi").alias("zone")).distinct()
    t = measures.timezone(h.select("payload_id", "tz", measures.language("lg").alias("language")), zones)
    return t.select("payload_id", "language", "timezone")


@query
def C12_scrub_pii(spark, d):
    """Redaction of every document."""
    doc = sample.table(spark, d, "documents").select("doc_id", text.scrub_pii("text").alias("c"))
    return doc.select("doc_id", F.md5("c").alias("text_md5"), F.length("c").alias("chars"))


@query
def C12_scrub_table(spark, d):
    """The full redaction job over every document."""
    doc = text.scrub_table(sample.table(spark, d, "documents"), ["text"])
    return doc.select("doc_id", F.md5("text").alias("text_md5"))


@query
def C13_pii_incidence(spark, d):
    return text.pii_incidence(sample.table(spark, d, "documents"), "text")


@query
def C14_visitor_key(spark, d):
    """Keyed hashes of every address and agent."""
    return enriched(spark, d).select("payload_id", "visitor_key")


@query
def C15_truncate_ip(spark, d):
    p = sample.payloads(spark, d)
    return p.groupBy(network.truncate_ip("ip").alias("net")).agg(F.count("*").alias("hits"))


@query
def C16_client_ip(spark, d):
    p = sample.payloads(spark, d)
    k = F.col("k")
    header = F.when(k % 3 == 0, F.concat(F.lit("unknown, "), "ip", F.lit(", 10.0.0.1"))).when(k % 3 == 1, "999.1.1.1")
    p = p.select("payload_id", header.alias("xff"), F.when(k % 5 == 0, "bad").otherwise("10.9.8.7").alias("remote_addr"))
    return network.client_ip(p, "xff").select("payload_id", "ip")


@query
def C17_identity_mode(spark, d):
    h = enrich.identity_mode(sample.raw_hits(spark, d), SITE)
    return h.groupBy("gpc", "id_mode").agg(F.count("*").alias("hits"))


@query
def C18_normalise_events(spark, d):
    h = sample.raw_hits(spark, d).select("payload_id", F.explode("e").alias("ev")).select("payload_id", "ev.*")
    n = evs.normalise_events(h.drop("d"), sample.SAMPLE_REGISTRY, "USD")
    return n.drop("attributes")


@query
def C19_event_registry(spark, d):
    """Registered definition of every event that occurs."""
    reg = evs.event_registry(spark, {"purchase": ("commerce", "shop", True)})
    p = sample.payloads(spark, d).groupBy("event_name").agg(F.count("*").alias("events"))
    return p.join(reg, "event_name", "left")


@query
def C20_event_time(spark, d):
    h = sample.raw_hits(spark, d).select("payload_id", "received_at", (F.col("e")[0]["d"] * 20).alias("d"))
    return evs.event_time(h).select("payload_id", "occurred_at")


@query
def C21_heartbeat(spark, d):
    h = sample.raw(spark, d).select("event_id", (F.col("value") * 2 - 100).cast("string").alias("hb"))
    return evs.heartbeat(h).select("event_id", "heartbeat")


@query
def C22_page_context(spark, d):
    h = enrich.page_context(sample.raw_hits(spark, d))
    return h.select("payload_id", "context.p", "context.t", "context.k", "context.li", F.col("context.pd").alias("pd"))


@query
def C23_heat_points(spark, d):
    h = sample.raw_hits(spark, d).withColumn("page_path", F.lit("/"))
    return enrich.heat_points(h).groupBy("device", "x", "y").agg(F.count("*").alias("points"))


@query
def C24_normalize_term(spark, d):
    doc = sample.table(spark, d, "documents")
    return doc.select("doc_id", text.normalize_term("text").alias("term"))


@query
def C25_explode_dimensions(spark, d):
    x = rollup.explode_dimensions(warehouse(spark, d).sessions)
    return x.groupBy("dimension", "value").agg(F.count("*").alias("sessions"))


@query
def C26_age_bucket(spark, d):
    p = sample.posts(spark, d)
    return p.groupBy(measures.age_bucket("published_at", "2024-02-01 00:00:00").alias("bucket")).agg(F.count("*").alias("posts"))


@query
def C27_normalize_url(spark, d):
    p = sample.table(spark, d, "pages")
    rel = ["../x/./y?q=1#z", "//Other.Example/A/../b", "?page=3", "a.html", "/", "https://Up.Example:8080/p//q/../"]
    i = F.element_at(F.array(*[F.lit(r) for r in rel]), (F.col("page_id") % 6).cast("int") + 1)
    return p.select("page_id", urls.normalize_url("url", "url").alias("self_url"), urls.normalize_url(i, "url").alias("target"))


@query
def C28_path_key(spark, d):
    p = sample.table(spark, d, "pages")
    return p.select("page_id", urls.path_key(F.upper(urls.url_path("url"))).alias("path_key"))


@query
def C29_form_id(spark, d):
    p = sample.table(spark, d, "part")
    return p.select("p_partkey", text.form_id(F.lit("nf"), "p_name").alias("form_id"))


@query
def C30_derived_rates(spark, d):
    dt = warehouse(spark, d).daily("daily_traffic")
    return measures.derived_rates(dt).select("day", *measures.DERIVED)


@query
def C31_heat_intensity(spark, d):
    hm = warehouse(spark, d).daily("heatmap_daily")
    cells = hm.where(F.col("path") == "/p/5/").groupBy("x", "y").agg(F.sum("clicks").alias("clicks"))
    return measures.heat_intensity(cells).select("x", "y", "clicks", F.round("intensity", 6).alias("intensity"))


def _click_table(spark, d):
    p = sample.table(spark, d, "pages")
    refs = ["tel:+25471", "mailto:a@b.example", "https://wa.me/254", "https://m.me/shop", "https://t.me/ch", "/files/Guide.PDF?x=1", "/contact", "#top", ""]
    i = (F.col("page_id") % 11).cast("int")
    href = F.when(i < 9, F.element_at(F.array(*[F.lit(r) for r in refs]), F.least(i + 1, F.lit(9)))).otherwise(F.col("url"))
    return p.select("page_id", href.alias("href"), F.when(i == 10, urls.url_host("url")).otherwise("site.example").alias("host"))


@query
def C32_classify_links(spark, d):
    return urls.classify_links(_click_table(spark, d)).select("page_id", "link_class", "contact_method")


@query
def C33_path_of(spark, d):
    return sample.table(spark, d, "pages").select("page_id", urls.path_of("url").alias("path"))


# ---- joins --------------------------------------------------------------------------------------


@query
def D1_session_revenue(spark, d):
    w = warehouse(spark, d)
    return rollup.with_revenue(w.sessions, w.events, TZ).select(
        "session_id", F.coalesce("revenue", F.lit(0)).alias("revenue")
    )


@query
def D2_live_feed(spark, d):
    w = warehouse(spark, d)
    return realtime.realtime_feed(w.sessions, w.events, NOW)


@query
def D3_ad_channels(spark, d):
    w = warehouse(spark, d)
    return ads.ad_channels(w.events, w.sessions, FROM, TO, TZ)


@query
def D4_converting_sessions(spark, d):
    w = warehouse(spark, d)
    return ads.converting_sessions(w.events, w.sessions, FROM, TO, TZ).select("session_id", "conversions")


@query
def D5_to_base(spark, d):
    p = sample.hits(spark, d).where(F.col("event_value").isNotNull()).withColumn("occurred_at", F.col("received_at"))
    return currency.to_base(p, sample.fx_rates(spark, d), "USD").select("payload_id", "currency", "event_value", "event_value_base")


@query
def D6_link_server_events(spark, d):
    """Server rows that name a session by key."""
    s = warehouse(spark, d).sessions.select("session_id", "visitor_key", F.md5(F.concat_ws("|", "session_id", "visitor_key")).alias("session_key"))
    orders = sample.table(spark, d, "events").where(F.col("event_type") == "purchase")
    server = orders.select(
        "event_id", F.md5(F.concat_ws("|", F.col("event_id") * 2 + 2, F.md5(F.col("user_id").cast("string")))).alias("session_key")
    )
    return ingest.link_server_events(server, s).select("event_id", "session_id", "visitor_key")


@query
def D7_geo_lookup(spark, d):
    p = sample.payloads(spark, d).select("payload_id", "ip", F.element_at(F.array(F.lit("KE"), F.lit("XX"), F.lit("")), (F.col("user_id") % 3).cast("int") + 1).alias("cf_country"))
    return geo.geo_lookup(p, sample.geo_ranges(spark, d)).select("payload_id", "country", "region", "city")


@query
def D8_flag_returning(spark, d):
    s = warehouse(spark, d).sessions.drop("is_returning")
    return ses.flag_returning(s).select("session_id", "is_returning")


@query
def D9_content_terms(spark, d):
    return _content(spark, d, "tax:topic")


@query
def D10_zero_fill(spark, d):
    return reports.series(warehouse(spark, d).daily("daily_traffic"), "2023-12-25", "2024-02-10")


@query
def D11_path_merge(spark, d):
    c = warehouse(spark, d).daily("daily_content")
    return c.groupBy("path").agg(*[F.sum(m).alias(m) for m in ("pageviews", "entrances", "exits", "conversions", "engaged_seconds")])


def audit(spark, d):
    """Facts and issues of all pages."""
    w = warehouse(spark, d)
    if "facts" not in w._tables:
        facts.page_issues(facts.page_facts(sample.pages(spark, d))).write.mode("overwrite").parquet(f"{w.root}/facts")
        w._tables["facts"] = spark.read.parquet(f"{w.root}/facts")
    return w._tables["facts"]


def audit_result(spark, d):
    """Audited pages and issue rows, with visits taken from the content rollup."""
    w = warehouse(spark, d)
    if "audited" not in w._tables:
        p, i = site.audited_pages(audit(spark, d), None, _visits(spark, d), w.daily("daily_traffic"), TODAY)
        p.write.mode("overwrite").parquet(f"{w.root}/audited")
        i.write.mode("overwrite").parquet(f"{w.root}/issues")
        w._tables["audited"] = spark.read.parquet(f"{w.root}/audited")
        w._tables["issues"] = spark.read.parquet(f"{w.root}/issues")
    return w._tables["audited"], w._tables["issues"]


def _visits(spark, d):
    """Content rollup whose paths are those of the audited pages (by post)."""
    c = warehouse(spark, d).daily("daily_content")
    p = sample.pages(spark, d).select((F.col("page_id") % 40).alias("post_id"), urls.path_of("url").alias("page"))
    return c.groupBy("day", "post_id").agg(F.sum("pageviews").alias("pageviews")).join(p, "post_id").select(
        "day", F.upper("page").alias("path"), "pageviews"
    )


def edges_of(spark, d):
    """Links of all pages, plus one from each page to the next crawled page."""
    f = audit(spark, d)
    nxt = f.select((F.col("page_id") - 1).alias("page_id"), F.col("self_url").alias("dst_url"))
    ring = f.where(F.col("page_id") % 3 != 1).select("page_id", F.col("self_url").alias("src_url")).join(nxt, "page_id")
    return facts.link_edges(f).unionByName(ring.select("page_id", "src_url", "dst_url"))


@query
def D12_uncrawled_links(spark, d):
    return site.uncrawled_links(edges_of(spark, d), audit(spark, d), 300)


@query
def D12_uncrawled_all(spark, d):
    """As D12_uncrawled_links, all of them."""
    return site.uncrawled_links(edges_of(spark, d), audit(spark, d))


@query
def D13_link_status(spark, d):
    e = edges_of(spark, d)
    return site.link_status(e, site.status_by_url(audit(spark, d))).groupBy("dst_status").agg(F.count("*").alias("links"))


@query
def D14_with_pageviews(spark, d):
    return site.with_pageviews(sample.pages(spark, d), _visits(spark, d), TODAY).select("page_id", "pageviews")


@query
def D15_unvisited(spark, d):
    w = warehouse(spark, d)
    return site.unvisited(sample.pages(spark, d), _visits(spark, d), w.daily("daily_traffic"), TODAY).select("page_id")


@query
def D16_issue_catalog(spark, d):
    rows = site.issue_rows(audit(spark, d))
    return site.issue_frequency(rows, site.catalog(spark)).select("code", "pages", "severity", "category", "scope")


# ---- sessions -----------------------------------------------------------------------------------


@query
def E1_sessionize(spark, d):
    """Sessions by gap alone, 30 minutes."""
    return ses.sessionize(sample.hits(spark, d), 30, split_campaign=False).select("payload_id", "session_id")


@query
def E2_campaign_split(spark, d):
    return ses.sessionize(sample.hits(spark, d), sample.TIMEOUT).select("payload_id", "session_id")


@query
def E3_no_session(spark, d):
    """Error rows become heartbeats without events, sign-ups server rows."""
    h = sample.hits(spark, d)
    name = F.col("event_name")
    h = h.withColumn("origin", (name == "form_submit").cast("int")).withColumn("n_events", F.when(name == "page_not_found", 0).otherwise(1))
    return ses.sessionize(h, sample.TIMEOUT, split_campaign=False).select("payload_id", "session_id")


@query
def E4_first_touch(spark, d):
    cols = ["landing_path", "landing_post_id", "referrer_domain", "channel", "click_id_type", "device_type", "country", "language", "viewport"]
    return session_rows(linked_payloads(spark, d)).select("session_id", *cols)


@query
def E5_session_counters(spark, d):
    cols = ["started_at", "last_seen_at", "duration_seconds", "pageviews", "event_count", "engaged_seconds", "conversions", "exit_path"]
    return session_rows(linked_payloads(spark, d)).select("session_id", *cols)


@query
def E6_engaged_flag(spark, d):
    return session_rows(linked_payloads(spark, d)).groupBy("is_engaged").agg(F.count("*").alias("sessions"))


@query
def E7_returning(spark, d):
    return session_rows(linked_payloads(spark, d)).groupBy("is_returning").agg(F.count("*").alias("sessions"))


@query
def E8_engaged_time(spark, d):
    """Activity ticks from all events on a compressed clock, one page view per user and path."""
    e = sample.raw(spark, d)
    t = e.select(
        (F.col("user_id") % 7).alias("session_id"), F.concat(F.lit("v"), F.col("k") % 5).alias("pv"),
        plus_seconds(ntz("2024-01-01 00:00:00"), F.col("event_id") * 3).alias("ts"),
        (F.col("k") % 4 != 0).cast("int").alias("visible"), F.col("event_id").alias("tick_id"),
    )
    return ses.engaged_time(t)


@query
def E9_dedupe_searches(spark, d):
    s = rollup.search_rows(warehouse(spark, d).events)
    s = s.select("event_id", "occurred_at", (F.col("event_id") % 9).alias("session_id"), (F.col("post_id") % 4).cast("string").alias("pv"), "term", "source")
    return ses.dedupe_searches(s).select("event_id", "session_id", "pv", "term", "source")


E0_COLUMNS = [
    "session_id", "id_mode", "started_at", "duration_seconds", "engaged_seconds", "pageviews", "event_count",
    "conversions", "landing_path", "exit_path", "referrer_domain", "channel", "utm_source", "utm_campaign",
    "click_id_type", "click_id", "viewport", "language", "country", "is_logged_in",
]


@query
def E0_collect(spark, d):
    """The write path from raw payloads to sessions."""
    return collected(spark, d).sessions.select(E0_COLUMNS)


# A whole minute inside visits: the second run has to go on with sessions of the first.
SECOND_RUN = "2024-01-15 12:00:00"
THIRD_RUN = "2024-01-22 12:00:00"
#: Files of a micro-batch: so many at least, and one for about so many rows of it.
STREAM_FILES = 4
STREAM_ROWS = 100_000


@query
def E0_collect_two_batches(spark, d):
    """The write path in two runs; the second gets the sessions of the first and returns those that go on."""
    raw, shared = sample.raw_hits(spark, d, deal=True), (sample.geo_ranges(spark, d), sample.fx_rates(spark, d), sample.SAMPLE_REGISTRY)
    at = F.lit(SECOND_RUN).cast("timestamp_ntz")
    first = ingest.collect_hits(raw.where(F.col("received_at") < at), SITE, salts(spark, d), *shared, dealt=True).sessions
    first = stored(first, "first")
    second = stored(ingest.collect_hits(raw.where(F.col("received_at") >= at), SITE, salts(spark, d), *shared, prior_sessions=first, dealt=True).sessions, "second")
    s = second.unionByName(first.join(second.select("session_id"), "session_id", "left_anti"))
    return s.select(E0_COLUMNS)


def came_in_run():
    """Which of three runs a payload came to: up to ten minutes after it was received, as its number has it."""
    came = plus_seconds("received_at", F.pmod(F.xxhash64("payload_id"), F.lit(600)))
    return F.when(came < ntz(SECOND_RUN), 0).when(came < ntz(THIRD_RUN), 1).otherwise(2)


def collected_late(spark, d):
    """The write path in three runs over rows out of order: sessions, events and rejects of all of them."""
    raw, shared = stored(sample.raw_hits(spark, d), "hits"), (sample.geo_ranges(spark, d), sample.fx_rates(spark, d), sample.SAMPLE_REGISTRY)
    carry, parts = None, []
    for run in range(3):
        names = dict(zip(("geo_ranges", "fx", "registry"), shared, strict=True))
        out, late, carry = runs.collect_run(raw.where(came_in_run() == run), SITE, salts(spark, d), carry, last=run == 2, **names)
        parts.append((out.sessions, out.events, out.hits.where("reason IS NOT NULL").select("payload_id", "reason").unionByName(late.select("payload_id", "reason"))))
    return parts


@query
def E0_collect_late(spark, d):
    """Three runs over rows out of order, against one run over all."""
    rows = None
    for sessions, _, _ in collected_late(spark, d):
        rows = sessions if rows is None else sessions.unionByName(rows.join(sessions, "session_id", "left_anti"))
    return rows.select(E0_COLUMNS)


@query
def E7_returning_two_batches(spark, d):
    """As E7_returning, with the visitors of the first run known to the second."""
    hits, at = sample.hits(spark, d), F.lit(SECOND_RUN).cast("timestamp_ntz")

    def sessions(linked):
        return ses.describe_sessions(ses.build_sessions(linked.withColumn("viewport", viewport_bucket("vw"))))

    first = stored(ses.flag_returning(sessions(ses.sessionize(hits.where(F.col("received_at") < at), sample.TIMEOUT))), "first")
    later = ses.sessionize(hits.where(F.col("received_at") >= at), sample.TIMEOUT, prior=first)
    second = stored(ses.flag_returning(ses.merge_sessions(sessions(later), first), first), "second")
    both = second.select("session_id", "is_returning").unionByName(first.join(second, "session_id", "left_anti").select("session_id", "is_returning"))
    return both.groupBy("is_returning").agg(F.count("*").alias("sessions"))


E0_EVENT_COLUMNS = [
    "payload_id", "session_id", "occurred_at", "event_name", "category", "module", "entity_type", "entity_id",
    "page_path", "page_title", "event_value", "currency", "event_value_base", "is_conversion",
]


@query
def E7_first_seen_store(spark, d):
    """Returning visitors over four runs that know of earlier ones by the store of visitors alone."""
    seen, rows = FirstSeen(spark, scratch_dir(spark, "visitors"), buckets=16), None
    all_sessions = warehouse(spark, d).sessions.drop("is_returning", "event_date", "seen_date")
    for run in range(4):
        mine = all_sessions.where(F.least(F.floor((F.dayofmonth("started_at") - 1) / 8), F.lit(3)) == run)
        for _ in range(1 + run % 2):  # a run that is repeated finds its own visitors
            flags = stored(ses.flag_returning(mine, seen.lookup(mine)).select("session_id", "is_returning"), "flags")
            seen.add(mine, run=run)
        if run == 2:
            seen.compact(1)
        rows = flags if rows is None else rows.unionByName(flags)
    return rows.groupBy("is_returning").agg(F.count("*").alias("sessions"))


@query
def E0_collect_events(spark, d):
    """The write path from raw payloads to event rows."""
    return collected(spark, d).events.select(E0_EVENT_COLUMNS)


# ---- rollups ------------------------------------------------------------------------------------


@query
def F1_traffic_sessions(spark, d):
    return rollup.traffic_sessions(warehouse(spark, d).sessions, TZ)


@query
def F2_daily_traffic(spark, d):
    w = warehouse(spark, d)
    return rollup.daily_traffic(w.sessions, w.events, TZ)


@query
def F3_daily_dimensions(spark, d):
    w = warehouse(spark, d)
    return rollup.daily_dimensions(w.sessions, w.events, TZ)


@query
def F4_daily_content(spark, d):
    w = warehouse(spark, d)
    return rollup.daily_content(w.sessions, w.events, TZ)


@query
def F5_page_engagement(spark, d):
    return rollup.page_engagement(warehouse(spark, d).events, TZ, 120)


@query
def F6_daily_events(spark, d):
    return rollup.daily_events(warehouse(spark, d).events, TZ)


@query
def F7_daily_searches(spark, d):
    return rollup.daily_searches(warehouse(spark, d).events, TZ)


@query
def F8_heatmap_daily(spark, d):
    return rollup.heatmap_daily(sample.heat_clicks(spark, d))


@query
def F9_crawler_daily(spark, d):
    return rollup.crawler_daily(rollup.crawler_hits(sample.requests(spark, d), "SiteAudit/"))


@query
def F10_days_to_rebuild(spark, d):
    w = warehouse(spark, d)
    done = w.daily("daily_traffic").where(F.dayofmonth("day") % 4 == 0).select("day")
    return rollup.days_to_rebuild(w.events, done, "2024-01-25 10:00:00", "2024-01-30", TZ, "2024-01-22")


@query
def F11_rollup(spark, d):
    """Three days rebuilt from range scans; the counts of every table."""
    w = warehouse(spark, d)
    out = rollup.rollup(w.sessions, w.events, ["2024-01-10", "2024-01-11", "2024-01-13"], TZ)
    rows = [t.groupBy("day").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, t in out.items()]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    return u


@query
def F12_search_days(spark, d):
    return rollup.search_days(warehouse(spark, d).events, TZ)


@query
def F13_ad_totals(spark, d):
    return reports.ad_report(sample.ad_daily(spark, d), FROM, TO)["totals"]


@query
def F13_ad_by_day(spark, d):
    return reports.ad_report(sample.ad_daily(spark, d), FROM, TO)["daily"]


@query
def F13_ads(spark, d):
    return reports.ad_report(sample.ad_daily(spark, d), FROM, TO)["ads"]


@query
def F13_campaigns(spark, d):
    return reports.ad_report(sample.ad_daily(spark, d), FROM, TO)["campaigns"]


# ---- reports ------------------------------------------------------------------------------------


def _dt(spark, d):
    return warehouse(spark, d).daily("daily_traffic")


def _dd(spark, d):
    return warehouse(spark, d).daily("daily_dimensions")


@query
def G1_totals(spark, d):
    return reports.totals(_dt(spark, d), FROM, TO)


@query
def G2_series(spark, d):
    return reports.series(_dt(spark, d), "2023-12-20", "2024-01-15")


@query
def G3_overview(spark, d):
    return reports.overview(_dt(spark, d), "2024-01-16", "2024-01-25", "previous")


@query
def G3_overview_series(spark, d):
    return reports.overview_series(_dt(spark, d), "2024-01-16", "2024-01-25", "previous").select("period", "day", "sessions", "revenue")


@query
def G4_comparison_delta(spark, d):
    r = reports.comparison_delta(_dt(spark, d), "2024-01-16", "2024-01-25", "previous")
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("now", "before", "change")], "is_flat", "is_good")


@query
def G5_weekly(spark, d):
    s = reports.series(_dt(spark, d), "2023-10-20", "2024-02-10")
    return reports.bucket_series(s, "2023-10-20", "2024-02-10").select("day", "sessions", "pageviews", "conversions")


@query
def G5_monthly(spark, d):
    s = reports.series(_dt(spark, d), "2022-12-20", "2024-02-10")
    return reports.bucket_series(s, "2022-12-20", "2024-02-10").select("day", "sessions", "pageviews", "conversions")


@query
def G6_dimension(spark, d):
    return reports.dimension(_dd(spark, d), "landing_page", FROM, TO, 10, "engaged_sessions")


@query
def G6_dimension_total(spark, d):
    return reports.dimension_total(_dd(spark, d), "landing_page", FROM, TO)


@query
def G7_channel_share(spark, d):
    return reports.channel_share(_dd(spark, d), FROM, TO, 3)


@query
def G8_device_share(spark, d):
    return reports.device_share(_dd(spark, d), FROM, TO)


def _content(spark, d, group, limit=10):
    return reports.content(
        warehouse(spark, d).daily("daily_content"), group, FROM, TO, limit, sample.posts(spark, d),
        sample.post_terms(spark, d), "2024-02-01 00:00:00",
    )


@query
def G9_content_page(spark, d):
    return _content(spark, d, "page")


@query
def G10_content_post_type(spark, d):
    return _content(spark, d, "post_type")


@query
def G11_content_author(spark, d):
    return _content(spark, d, "author")


@query
def G11_content_age(spark, d):
    return _content(spark, d, "age")


@query
def G12_entry_pages(spark, d):
    return reports.entry_exit_pages(warehouse(spark, d).daily("daily_content"), "entrances", FROM, TO)


@query
def G12_exit_pages(spark, d):
    return reports.entry_exit_pages(warehouse(spark, d).daily("daily_content"), "exits", FROM, TO)


def _de(spark, d):
    return warehouse(spark, d).daily("daily_events")


@query
def G13_events(spark, d):
    return reports.events(_de(spark, d), FROM, TO)


@query
def G14_conversions(spark, d):
    return reports.conversions(_de(spark, d), FROM, TO)


@query
def G15_interaction_summary(spark, d):
    return reports.interaction_summary(_de(spark, d), FROM, TO)


def _ds(spark, d):
    return warehouse(spark, d).daily("daily_searches")


@query
def G16_search_totals(spark, d):
    return reports.search_totals(_ds(spark, d), FROM, TO)


@query
def G17_search_terms(spark, d):
    return reports.search_terms(_ds(spark, d), FROM, TO, 7)


@query
def G18_search_no_results(spark, d):
    return reports.search_no_results(_ds(spark, d), FROM, TO, 7)


@query
def G19_realtime_active(spark, d):
    return realtime.realtime_active(warehouse(spark, d).sessions, NOW, 60)


@query
def G20_realtime_per_minute(spark, d):
    return realtime.realtime_per_minute(warehouse(spark, d).events, NOW)


@query
def G21_realtime_top_pages(spark, d):
    return realtime.realtime_top_pages(warehouse(spark, d).events, NOW)


@query
def G21_realtime_top_channels(spark, d):
    return realtime.realtime_top_channels(warehouse(spark, d).sessions, NOW)


@query
def G22_realtime_feed(spark, d):
    w = warehouse(spark, d)
    return realtime.realtime_feed(w.sessions, w.events, "2024-01-11 18:30:00")


@query
def G23_heatmap_pages(spark, d):
    return reports.heatmap_pages(warehouse(spark, d).daily("heatmap_daily"), "mobile", FROM, TO, 100)


@query
def G24_heatmap(spark, d):
    h = reports.heatmap(warehouse(spark, d).daily("heatmap_daily"), "/p/5/", "all", FROM, TO)
    return h.withColumn("intensity", F.round("intensity", 6))


@query
def G25_crawlers(spark, d):
    return reports.crawlers(warehouse(spark, d).daily("crawler_daily"), FROM, TO)


@query
def G26_crawler_404s(spark, d):
    return reports.crawler_404s(warehouse(spark, d).daily("crawler_daily"), FROM, TO, 20)


@query
def G27_ad_visits(spark, d):
    w = warehouse(spark, d)
    return ads.ad_visits(w.events, w.sessions, FROM, TO, TZ)


@query
def G28_ad_channels(spark, d):
    w = warehouse(spark, d)
    return ads.ad_channels(w.events, w.sessions, "2024-01-02", "2024-01-12", TZ, 3)


@query
def G29_ad_pages(spark, d):
    return ads.ad_pages(warehouse(spark, d).events, FROM, TO, TZ, 10)


@query
def G30_ad_trend(spark, d):
    return reports.ad_trend(sample.ad_daily(spark, d), "2023-10-20", "2024-02-10")


@query
def G32_volume_24h(spark, d):
    w = warehouse(spark, d)
    return realtime.volume_24h(w.sessions, w.events, NOW)


@query
def G33_first_day(spark, d):
    return reports.first_day(_dt(spark, d))


# ---- streams ------------------------------------------------------------------------------------


def event_stream(spark, d):
    schema = sample.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def payload_stream(spark, d):
    p = sample.map_payloads(sample.with_k(event_stream(spark, d)))
    return p.where(~agents.is_bot("user_agent"))


def run_to_table(stream, name, mode):
    """Runs a stream over what is there and returns its last state per batch row, read back from the scratch folder."""
    spark = stream.sparkSession
    out = scratch_dir(spark, name)

    def write(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{out}/rows")

    q = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def latest(rows, keys):
    """Last update per key."""
    others = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_r")).select(*keys, "_r.*")


def files_a_run(rows):
    """Files that each of the three runs is written to, the same number for all: about ``STREAM_ROWS`` rows of the smallest run a file."""
    runs = [r["count"] for r in rows.select("payload_id", "received_at").groupBy(came_in_run().alias("run")).count().collect()]  # three rows
    return max(STREAM_FILES, min(runs, default=0) // STREAM_ROWS)


_streamed: dict[tuple[str, str], str] = {}


def streamed(spark, d):
    """Folder of the write path run as a stream over three batches of files, to which rows come up to ten minutes late."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _streamed:
        root = scratch_dir(spark, "stream-collect")
        hits = sample.raw_hits(spark, d, deal=True)
        files, salt, geo_ranges, fx = together(  # every micro-batch reads the small tables: made once
            lambda: files_a_run(hits), lambda: stored(salts(spark, d), "salts"),
            lambda: stored(sample.geo_ranges(spark, d), "geo-ranges"), lambda: stored(sample.fx_rates(spark, d), "fx"),
        )
        for run in range(3):
            hits.where(came_in_run() == run).repartition(files).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        how = {"geo_ranges": geo_ranges, "fx": fx, "registry": sample.SAMPLE_REGISTRY, "daily_tz": TZ}
        streams.stream_collect(stream, SITE, salt, f"{root}/out", f"{root}/checkpoint", **how).awaitTermination()
        streams.finish_collect(spark, SITE, salt, f"{root}/out", **how)
        _streamed[key] = f"{root}/out"
    return _streamed[key]


@query
def J0_stream_collect(spark, d):
    """The write path as a stream out of order; sessions cross micro-batches and come out as in one run."""
    return streams.collected_sessions(spark, streamed(spark, d)).select(E0_COLUMNS)


@query
def J0_stream_events(spark, d):
    return streams.collected_events(spark, streamed(spark, d)).select(E0_EVENT_COLUMNS)


@query
def J0_stream_returning(spark, d):
    s = streams.collected_sessions(spark, streamed(spark, d))
    return s.groupBy("is_returning").agg(F.count("*").alias("sessions"))


@query
def J0_stream_days(spark, d):
    """Events that the stream stored for three days, read from the files of these days alone."""
    e = streams.collected_events(spark, streamed(spark, d), "2024-01-14", "2024-01-16")
    return e.groupBy("event_date", "event_name").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"))


@query
def J0_stream_heat(spark, d):
    heat = spark.read.parquet(f"{streamed(spark, d)}/heat")
    return heat.groupBy("page_path", "device", "x", "y").agg(F.count("*").alias("points"), F.max("received_at").alias("last"))


@query
def J0_stream_rejects(spark, d):
    return spark.read.parquet(f"{streamed(spark, d)}/rejects").select("payload_id", "reason")


@query
def J1_stream_hits(spark, d):
    """Payloads written as log lines, a fifth of them broken, read back as a stream."""
    path = scratch_dir(spark, "beacons")
    h = sample.raw_hits(spark, d)
    body = F.to_json(F.struct("u", "r", "ti", "hb", "e"))
    lines = h.select(
        F.col("payload_id").alias("id"), "ip", "user_agent", "received_at",
        F.when(F.col("payload_id") % 10 < 2, F.substring(body, 2, 50)).otherwise(body).alias("body"),
    )
    lines.write.json(path)
    hits, rejects = streams.stream_hits(spark, path)
    rows = hits.select(F.lit("hit").alias("outcome"), "payload_id", F.size("e").alias("n")).unionByName(
        rejects.select(F.col("reason").alias("outcome"), F.col("id").alias("payload_id"), F.lit(0).alias("n"))
    )
    out = run_to_table(rows, "stream-hits", "append")
    return out.groupBy("outcome").agg(F.count("*").alias("lines"), F.sum("n").alias("events"))


def late_payloads(spark, d):
    """Payloads as a stream over three batches of files, to which rows come up to ten minutes late, and a row of the next day
    that lets the watermark pass them all."""
    root = scratch_dir(spark, "late-payloads")
    p = sample.payloads(spark, d)
    p = stored(p.where(~agents.is_bot("user_agent")), "payloads")
    for run in range(3):
        p.where(came_in_run() == run).repartition(STREAM_FILES).write.mode("append").parquet(f"{root}/in")
    end = p.agg(F.max("received_at").alias("_end")).select(plus_seconds("_end", F.lit(86400)).alias("_end"))
    tick = p.limit(1).drop("received_at", "visitor_key").join(end).withColumnRenamed("_end", "received_at").withColumn("visitor_key", F.lit("tick"))
    tick.select(p.columns).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(p.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{root}/in")


@query
def J2_live_sessions(spark, d):
    rows = run_to_table(streams.live_sessions(late_payloads(spark, d), sample.TIMEOUT), "live", "update")
    s = latest(rows.where("session_id IS NOT NULL"), ["session_id"])
    s = s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_seen_at")})
    cols = ["started_at", "last_seen_at", "duration_seconds", "pageviews", "event_count", "engaged_seconds", "conversions", "exit_path"]
    return s.select("session_id", *cols)


@query
def J2_stream_returning(spark, d):
    """Returning visitors told as sessions come, against the flag from all sessions at once."""
    root = scratch_dir(spark, "sessions-in")
    s = warehouse(spark, d).sessions.select("visitor_key", "session_id", "started_at", "id_mode")
    for part in (F.col("started_at") < ntz(SECOND_RUN), F.col("started_at") >= ntz(SECOND_RUN)):
        s.where(part).repartition(STREAM_FILES).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(f"{root}/in")
    flags = run_to_table(streams.stream_returning(stream), "returning", "append")
    return flags.groupBy("is_returning").agg(F.count("*").alias("sessions"))


@query
def J3_stream_active(spark, d):
    rows = latest(run_to_table(streams.stream_active(payload_stream(spark, d)), "active", "update"), ["window", "visitor_key"])
    return streams.active_of(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "visitors")


@query
def J3_active_sketch(spark, d):
    """Visitors of all five minutes by the exact rows, and whether the sketches come within five per cent or one of them."""
    p = payload_stream(spark, d)
    exact = streams.active_of(latest(run_to_table(streams.stream_active(p), "active", "update"), ["window", "visitor_key"]))
    near = streams.active_of_sketches(latest(run_to_table(streams.stream_active_sketch(p), "sketches", "update"), ["window"]))
    off = F.abs(F.coalesce("estimate", F.lit(0)) - F.coalesce("visitors", F.lit(0)))
    both = exact.join(near.withColumnRenamed("visitors", "estimate"), "start", "full")
    return both.select(F.col("start").cast("timestamp_ntz").alias("start"), "visitors", (off <= F.greatest(F.lit(1), F.col("visitors") * 0.05)).alias("close"))


@query
def J4_stream_per_minute(spark, d):
    e = payload_stream(spark, d).withColumn("occurred_at", F.col("received_at"))
    rows = latest(run_to_table(streams.stream_per_minute(e), "minutes", "update"), ["window"])
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "views")


@query
def J5_stream_top(spark, d):
    e = payload_stream(spark, d).withColumn("occurred_at", F.date_trunc("day", "received_at").cast("timestamp_ntz"))
    rows = latest(run_to_table(streams.stream_top(e.where("n_pageviews = 1"), "page_path"), "top", "update"), ["window", "page_path"])
    return streams.top_of(rows, "page_path")


@query
def J6_stream_counters(spark, d):
    root = scratch_dir(spark, "stream-crawlers")
    schema, *how = CRAWLER_COUNTERS
    half = F.col("event_id") % 2
    for i in (0, 1):  # two streams with a checkpoint each, whose batches have the same numbers
        p = sample.map_requests(sample.with_k(event_stream(spark, d).where(half == i)))
        q = streams.stream_counters(
            p, lambda b: rollup.crawler_daily(rollup.crawler_hits(b, "SiteAudit/")), f"{root}/table", f"{root}/checkpoint-{i}", *how
        )
        q.awaitTermination()
    return tables.read_counters(spark, f"{root}/table", schema, *how).select("day", "crawler", "path", "crawler_type", "status_code", "hits", "last_seen_at")


@query
def J7_stream_rate_limit(spark, d):
    p = payload_stream(spark, d).withColumn(
        "received_at", plus_seconds(ntz("2024-01-01 00:00:00"), F.col("payload_id") / 100)
    )
    return run_to_table(streams.stream_rate_limit(p, 1), "limited", "append").select("payload_id", "visitor_key")


@query
def J9_stream_rollup(spark, d):
    w = warehouse(spark, d)
    root = scratch_dir(spark, "stream-rollup")
    new = payload_stream(spark, d).select(F.col("received_at").alias("occurred_at"))
    q = streams.stream_rollup(new, lambda: w.sessions, lambda: w.events, root, f"{root}/checkpoint", TZ)
    q.awaitTermination()
    return PartTable(spark, f"{root}/daily_traffic").read().select("day", "sessions", "events", "pageviews", "revenue")


@query
def J9_collect_traffic(spark, d):
    """Daily traffic that the write path keeps up to date as a stream out of order, from its micro-batches alone."""
    daily = streams.collected_daily(spark, streamed(spark, d), TZ).read("daily_traffic")
    return daily.select("day", "sessions", "bounces", "engaged_seconds", "duration_seconds", "events", "pageviews", "conversions", "revenue")


_grown: dict[tuple[str, str], DailyRollup] = {}


def grown(spark, d):
    """Daily tables of three runs that end within sessions; the second comes twice, the parts of a day are merged once it has two."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _grown:
        linked = stored(linked_payloads(spark, d), "linked")
        run = F.when(F.col("received_at") < ntz(SECOND_RUN), 0).when(F.col("received_at") < ntz(THIRD_RUN), 1).otherwise(2)
        daily, before = DailyRollup(spark, scratch_dir(spark, "grown"), TZ, folders=1), None
        for n in range(3):
            mine = linked.where(run == n)
            now = session_rows(linked.where(run <= n)).join(mine.select("session_id").distinct(), "session_id", "left_semi")
            now, events = stored(now, "now"), stored(sample.event_rows(mine, sample.fx_rates(spark, d)), "events")
            for _ in range(2 if n == 1 else 1):
                daily.add(now, before, events, n)
            before = now if before is None else now.unionByName(before.join(now, "session_id", "left_anti"))
        _grown[key] = daily
    return _grown[key]


@query
def J9_grown_traffic(spark, d):
    return grown(spark, d).read("daily_traffic")


@query
def J9_grown_dimensions(spark, d):
    return grown(spark, d).read("daily_dimensions")


@query
def J9_grown_content(spark, d):
    return grown(spark, d).read("daily_content")


@query
def J9_grown_events(spark, d):
    return grown(spark, d).read("daily_events")


@query
def J9_grown_searches(spark, d):
    return grown(spark, d).read("daily_searches")


# ---- windows ------------------------------------------------------------------------------------


def _clicks(spark, d):
    e = sample.raw(spark, d)
    t = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") * F.lit(61) / 1000).cast("decimal(18,6)"))
    return e.select(
        F.lit(1).alias("session_id"), F.lit("v").alias("pv"), (F.col("user_id") % 3).alias("element"), t.alias("ts"),
        (F.col("k") % 60).alias("x"), (F.floor("value") % 50).cast("int").alias("y"), F.col("event_id").alias("click_id"),
    )


@query
def H3_rage_clicks(spark, d):
    """Every event as a click on one of three elements, 61 ms apart, all within one page view."""
    return windows.rage_clicks(_clicks(spark, d)).select("click_id", "element", "x", "y")


@query
def H3_rage_clicks_stream(spark, d):
    """The same clicks as a stream in three files, and a click of the next day that lets the watermark pass them."""
    root, c = scratch_dir(spark, "clicks"), stored(_clicks(spark, d), "clicks")
    tick = c.limit(1).withColumn("ts", plus_seconds(ntz("2025-01-01 00:00:00"), F.lit(0))).withColumn("click_id", F.lit(-1).cast(c.schema["click_id"].dataType))
    for part in [c.where(F.pmod(F.floor((F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("click_id"), F.lit(500_000))) / 500_000), F.lit(10**6)) % 3 == i) for i in range(3)]:
        part.repartition(STREAM_FILES).write.mode("append").parquet(f"{root}/in")
    tick.select(c.columns).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 3 * STREAM_FILES).parquet(f"{root}/in")
    rows = run_to_table(streams.stream_rage_clicks(stream), "rage", "append")
    return rows.select("click_id", "element", "x", "y")


@query
def H5_duplicates(spark, d):
    return site.duplicate_text(audit(spark, d), "title").select("page_id", "pages")


def _runs(spark, d):
    e = sample.raw(spark, d)
    return e.groupBy((F.dayofmonth("received_at")).cast("bigint").alias("run_id")).agg(
        F.max("received_at").alias("finished_at"),
        (F.sum("k") % 101).alias("health"), (F.sum("k") % 17).alias("errors"), (F.sum("k") % 29).alias("warnings"),
        (F.count("*") % 31).alias("notices"), F.count("*").alias("pages"),
    ).withColumn("status", F.when(F.col("run_id") % 4 == 0, "running").otherwise("complete"))


@query
def H6_run_deltas(spark, d):
    return windows.run_deltas(_runs(spark, d))


@query
def H7_last_value(spark, d):
    """Exit path of each session, the last value of its page views."""
    return warehouse(spark, d).sessions.groupBy("exit_path").agg(F.count("*").alias("sessions"))


@query
def H8_pageview_depth(spark, d):
    e = warehouse(spark, d).events
    return windows.pageview_depth(e)


def _fields(spark, d):
    e = sample.raw(spark, d)
    return e.select(
        (F.col("user_id") % 11).alias("session_id"), F.concat(F.lit("v"), F.col("k") % 9).alias("pv"),
        F.concat(F.lit("form"), F.col("user_id") % 4).alias("form_id"),
        F.when(F.col("k") % 14 == 0, "submit").otherwise("focus").alias("kind"),
        F.concat(F.lit("f"), F.col("k") % 6).alias("field"), F.col("received_at").alias("occurred_at"), "event_id",
    )


@query
def H9_form_funnel(spark, d):
    return windows.form_funnel(_fields(spark, d))


@query
def H9_form_visits(spark, d):
    return windows.form_visits(_fields(spark, d))


@query
def H10_video_funnel(spark, d):
    e = sample.raw(spark, d)
    step = F.col("k") % 5
    v = e.select(
        "user_id", (F.col("user_id") % 13).alias("session_id"), F.concat(F.lit("v"), F.floor(F.col("k") / 5)).alias("pv"),
        F.concat(F.lit("clip"), F.col("user_id") % 3).alias("video_id"),
        F.when(step == 0, "video_start").when(step == 4, "video_complete").otherwise("video_progress").alias("event_name"),
        (step * 25).alias("percent"),
    )
    return windows.video_funnel(v)


@query
def H11_web_vitals(spark, d):
    e = sample.raw(spark, d)
    v = e.select(
        F.lit("web_vitals").alias("event_name"), F.concat(F.lit("/p/"), F.col("k") % 25, F.lit("/")).alias("page_path"),
        F.to_json(F.struct(F.floor(F.col("value") * 10).alias("lcp_ms"), (F.col("k") / 1000).alias("cls"), (F.col("k") * 3).alias("inp_ms"))).alias("attributes"),
    )
    return windows.web_vitals(v)


# ---- audit --------------------------------------------------------------------------------------


@query
def K1_page_facts(spark, d):
    """Facts of every page, read from the markup."""
    f = facts.page_facts(sample.pages(spark, d))
    return f.select(
        "page_id", "html_bytes", "title", "title_len", "h1_count", "h1", "h2_count", "words", "images", "lang",
        "noindex", "json_ld", F.size("links").alias("internal"), "external_links", "self_url",
    )


def _has(*codes):
    def run(spark, d):
        rows = site.issue_rows(audit(spark, d)).where(F.col("code").isin(list(codes)))
        return plain(rows)

    return run


QUERIES["K2_status_issues"] = _has("fetch_failed", "http_5xx", "http_4xx", "redirect")
QUERIES["K3_speed_issues"] = _has("slow_response", "large_html")
QUERIES["K4_title_issues"] = _has(
    "title_missing", "title_too_long", "title_too_short", "meta_description_missing", "meta_description_length"
)
QUERIES["K5_text_issues"] = _has("h1_missing", "multiple_h1", "low_word_count", "no_subheadings")
QUERIES["K6_title_h1"] = _has("title_h1_unrelated")
QUERIES["K7_head_issues"] = _has(
    "images_missing_alt", "lang_missing", "viewport_missing", "noindex", "canonical_missing", "canonical_elsewhere",
    "open_graph_missing", "no_structured_data",
)
QUERIES["K8_mixed_content"] = _has("mixed_content")
QUERIES["K9_no_internal_links"] = _has("no_internal_links")


@query
def K9_link_edges(spark, d):
    return facts.link_edges(audit(spark, d))


# Pages by their number: unrelated heading, insecure image, no links, optional tags left out, as they are.
VARIED = """CASE page_id % 5
  WHEN 0 THEN regexp_replace(html, '<h1[^>]*>[^<]*</h1>', '<h1>Qqzz Wwyy</h1>')
  WHEN 1 THEN replace(html, '</body>', '<img alt="a" src="http://img.example/x.png"></body>')
  WHEN 2 THEN regexp_replace(html, '<a href="[^"]*">', '<b>')
  WHEN 3 THEN regexp_replace(html, '</?(head|body)>|</html>', '')
  ELSE html END"""


@query
def K2_page_issues_varied(spark, d):
    """Every page rule on pages changed so that each of them, also the rare ones, has something to find."""
    p = sample.pages(spark, d).withColumn("html", F.expr(VARIED))
    return site.issue_rows(facts.page_issues(facts.page_facts(p)))


@query
def K10_inlinks(spark, d):
    return site.inlinks(edges_of(spark, d))


@query
def K11_broken_links(spark, d):
    b = site.broken_links(edges_of(spark, d), site.status_by_url(audit(spark, d)), listed=20)
    return b.select("page_id", "broken", F.array_join("listed", " ").alias("listed"))


@query
def K11_broken_all(spark, d):
    """As K11_broken_links, with every link listed."""
    b = site.broken_links(edges_of(spark, d), site.status_by_url(audit(spark, d)))
    return b.select("page_id", "broken", F.array_join("listed", " ").alias("listed"))


@query
def K12_duplicate_text(spark, d):
    return site.duplicate_text(audit(spark, d), "title")


@query
def K13_orphans(spark, d):
    return site.orphans(audit(spark, d), edges_of(spark, d))


@query
def K14_no_recent_visits(spark, d):
    w = warehouse(spark, d)
    return site.no_recent_visits(audit(spark, d), _visits(spark, d), w.daily("daily_traffic"), TODAY).select("page_id")


@query
def K15_severity_counts(spark, d):
    return audit_result(spark, d)[0].select("page_id", "inlinks", "errors", "warnings", "notices")


@query
def K16_crawl_buckets(spark, d):
    return site.crawl_buckets(audit_result(spark, d)[0])


def _site_issues(spark, d):
    f, g = _site_inputs(spark, d)
    return site.site_checks(f, g)


@query
def K17_health(spark, d):
    return site.health(audit_result(spark, d)[0], _site_issues(spark, d))


@query
def K18_issue_frequency(spark, d):
    return site.issue_frequency(audit_result(spark, d)[1], site.catalog(spark), _site_issues(spark, d)).select("code", "pages")


@query
def K18_ideas_by_category(spark, d):
    return site.ideas_by_category(site.issue_frequency(audit_result(spark, d)[1], site.catalog(spark)))


@query
def K19_audit_overview(spark, d):
    return site.audit_overview(audit_result(spark, d)[1]).select("code", "severity", "category", "pages")


@query
def K19_idea_totals(spark, d):
    p, i = audit_result(spark, d)
    return site.idea_totals(p, site.issue_frequency(i, site.catalog(spark)))


@query
def K20_pages_with_issue(spark, d):
    p, i = audit_result(spark, d)
    return site.pages_with_issue(p, i, "title_duplicate").select("page_id", "path", "title", "ideas", "bucket", "detail")


@query
def K20_pages_in_bucket(spark, d):
    p, _ = audit_result(spark, d)
    return site.pages_in_bucket(p, "errors", _visits(spark, d), TODAY).select("page_id", "path", "ideas", "pageviews")


@query
def K20_page_detail(spark, d):
    p, i = audit_result(spark, d)
    return site.page_detail(p, i, 5).select("page_id", "code", "severity", "category", "detail", "bucket", "ideas")


@query
def K21_top_pages_to_fix(spark, d):
    p, _ = audit_result(spark, d)
    return site.top_pages_to_fix(p, _visits(spark, d), TODAY).select("page_id", "pageviews", "errors", "ideas")


@query
def K22_common_ideas(spark, d):
    return site.common_ideas(audit_result(spark, d)[1]).select("code", "pages")


@query
def K23_url_worklist(spark, d):
    p = sample.pages(spark, d)
    i = F.col("page_id")
    c = p.select(
        F.when(i % 5 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"), "source", "post_id",
        plus_seconds(ntz("2024-01-01 00:00:00"), ((i * 7919) % 100000)).alias("modified_at"), (i % 17).alias("posts"),
    )
    dup = c.where(F.col("post_id") % 3 == 1).withColumn("source", F.lit("archive"))
    return site.url_worklist(c.unionByName(dup), 100, 30).select("url", "path", "post_id", "source")


def _robots(spark, d):
    doc = sample.table(spark, d, "documents")
    i = (F.col("doc_id") % 6).cast("int")
    head = ["User-agent: *\nDisallow: /\n", "User-agent: x\r\nDisallow: /\r\nUser-agent: *\r\nAllow: /\r\n",
            "user-AGENT: * # all\rdisallow:/ # no\r", "User-agent: *\nDisallow: /wp-admin/\n", "Disallow: /\n", "# Disallow: /\nUser-agent: *\n"]
    return doc.select(
        F.col("doc_id").alias("site"),
        F.concat(F.element_at(F.array(*[F.lit(h) for h in head]), i + 1), F.regexp_replace("text", "[\r\n]", " ")).alias("body"),
    )


@query
def K24_robots_blocks_all(spark, d):
    return site.robots_blocks_all(_robots(spark, d))


def _site_inputs(spark, d):
    """Special fetches made of the first documents; one row of flags derived from the page table."""
    doc = sample.table(spark, d, "documents").groupBy().agg(F.count("*").alias("n"), F.min("text").alias("t"))
    kinds = F.array(
        F.struct(F.lit("robots").alias("kind"), F.lit(200).alias("status"), F.concat(F.lit("User-agent: *\nDisallow: /\n# "), F.regexp_replace("t", "[\r\n]", " ")).alias("body")),
        F.struct(F.lit("sitemap").alias("kind"), F.lit(404).alias("status"), F.lit("<none/>").alias("body")),
        F.struct(F.lit("missing").alias("kind"), F.when(F.col("n") > 0, 200).otherwise(404).alias("status"), F.lit("").alias("body")),
    )
    fetches = doc.select(F.inline(kinds))
    flags = sample.pages(spark, d).agg(F.min_by("url", "page_id").alias("home_url")).select(
        "home_url", F.lit(False).alias("search_blocked"), F.lit(True).alias("plain_permalinks"), F.lit(False).alias("debug_display")
    )
    return fetches, flags


@query
def K25_site_checks(spark, d):
    return _site_issues(spark, d)


@query
def K25_site_checks_by_host(spark, d):
    """The checks of every host among the pages; what its special addresses answer follows from its first page's number."""
    hosts = sample.table(spark, d, "pages").groupBy(F.lower(urls.url_host("url")).alias("site")).agg(
        F.min("page_id").alias("m"), F.min_by("url", "page_id").alias("home_url")
    )
    m = F.col("m")
    kinds = F.array(
        F.struct(F.lit("robots").alias("kind"), F.when(m % 4 == 0, 404).otherwise(200).alias("status"),
                 F.when(m % 3 == 0, "User-agent: *\nDisallow: /\n").otherwise("User-agent: *\nDisallow: /x").alias("body")),
        F.struct(F.lit("sitemap").alias("kind"), F.when(m % 5 == 0, 404).otherwise(200).alias("status"), F.lit("<urlset/>").alias("body")),
        F.struct(F.lit("missing").alias("kind"), F.when(m % 2 == 0, 200).otherwise(404).alias("status"), F.lit("").alias("body")),
    )
    flags = hosts.select(
        "site", "home_url", (m % 7 == 0).alias("search_blocked"), (m % 6 == 0).alias("plain_permalinks"), (m % 11 == 0).alias("debug_display")
    )
    return site.site_checks(hosts.select("site", F.inline(kinds)), flags, "site")


@query
def K26_keep_runs(spark, d):
    runs = _runs(spark, d)
    pages = sample.raw(spark, d).select("event_id", F.dayofmonth("received_at").cast("bigint").alias("run_id"))
    _, kept = site.keep_runs(runs, pages, 10)
    return kept.groupBy("run_id").agg(F.count("*").alias("pages"))


# ---- retention ----------------------------------------------------------------------------------


@query
def L1_retain(spark, d):
    w = warehouse(spark, d)
    kept, gone = retention.retain(
        {"events": w.events, "sessions": w.sessions, "daily_traffic": _dt(spark, d), "daily_events": _de(spark, d)},
        "2025-03-15 12:00:00", TZ, 14, 14,
    )
    left = kept["events"].agg(F.count("*").alias("deleted")).select(F.lit("events kept").alias("table"), "deleted")
    return gone.unionByName(left)


