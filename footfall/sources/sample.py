"""Maps the sample tables (events, part, pages) to the inputs of this library.

Each function is a projection of a whole table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import plus_seconds, to_second
from footfall.operators.events import REGISTRY
from footfall.operators.scans import deal_evenly

TZ = "Africa/Nairobi"
TIMEOUT = 240
BASE_CURRENCY = "USD"
SAMPLE_REGISTRY = {**REGISTRY, "purchase": ("commerce", "shop", True)}
CONVERTING = ["form_submit", "purchase"]

# Eight user agents picked by k % 8; the last is a crawler.
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36 Edg/131.0.2903.51",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 18_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; SM-S921B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/26.0 Chrome/122.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Linux; Android 13; SM-X810) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:132.0) Gecko/20100101 Firefox/132.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Mobile/15E148 [FBAN/FBIOS;FBAV/490.0.0.40.100]",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
]
REFERRERS = ["", "google.com", "m.facebook.com", "chatgpt.com", "travelblog.example"]
COUNTRIES = ["KE", "GB", "DE", "US", "ZA", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(table(spark, sf_dir, "events"))


def with_k(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        to_second("ts").alias("received_at"),
    )


def named(e: DataFrame) -> DataFrame:
    k, tens = F.col("k"), F.floor(F.col("k") / 10)
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    name = (
        F.when(view & (k % 10 == 0), "ad_impression")
        .when(view & (k % 10 == 1), "site_search")
        .when(view, "page_view")
        .when(click & (k % 3 == 0), "ad_click")
        .when(click & (k % 3 == 1), "outbound_click")
        .when(click, "cta_click")
        .when(F.col("event_type") == "signup", "form_submit")
        .when(F.col("event_type") == "purchase", "purchase")
        .otherwise("page_not_found")
    )
    pv = F.left(F.md5(F.col("event_id").cast("string")), F.lit(8))
    term = F.when(tens % 2 == 0, F.concat(F.lit("TERM  "), tens)).otherwise(F.concat(F.lit(" Term "), tens))
    typed = pick(tens % 3, ["results_page", "form", "live"])
    attrs = F.when(
        name == "site_search",
        F.to_json(
            F.struct(
                pv.alias("pv"), term.alias("query"),
                F.when(tens % 5 != 4, tens % 4).alias("results"),
                F.when(tens % 3 != 0, typed).alias("source"),
            )
        ),
    ).otherwise(F.to_json(F.struct(pv.alias("pv"))))
    return e.withColumns({"event_name": name, "pv": pv, "attributes": attrs, "payload_id": F.col("event_id") * 2 + 2})


def _engagement(e: DataFrame) -> DataFrame:
    """One engagement payload a second after each page view."""
    views = e.where(F.col("event_name") == "page_view")
    attrs = F.to_json(
        F.struct("pv", F.floor("value").alias("engaged_seconds"), ((F.col("k") % 5) * 25).alias("scroll_depth"))
    )
    return views.withColumns(
        {
            "attributes": attrs,
            "event_name": F.lit("page_engagement"),
            "received_at": plus_seconds("received_at", 1),
            "payload_id": F.col("payload_id") + 1,
            "event_type": F.lit("engagement"),
        }
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_payloads(raw(spark, sf_dir))


def map_payloads(e: DataFrame) -> DataFrame:
    """Enriched payload rows, one event each, crawlers included."""
    e = named(e)
    e = e.unionByName(_engagement(e))
    k = F.col("k")
    news, ads = k % 7 == 0, (k % 7 != 0) & (k % 11 == 0)
    name = F.col("event_name")
    buy = name == "purchase"
    return e.select(
        "payload_id", "event_id", "user_id", "k", "value", "received_at", "event_name", "pv", "attributes",
        F.md5(F.col("user_id").cast("string")).alias("visitor_key"),
        (F.col("user_id") % 2).cast("int").alias("id_mode"),
        F.concat(F.lit("/p/"), k % 25, F.lit("/")).alias("page_path"),
        (k % 25).cast("bigint").alias("post_id"),
        F.when(k % 25 == 0, "").otherwise(pick(k % 3, ["post", "page", "tour"])).alias("post_type"),
        F.when(name == "page_view", F.concat(F.lit("Page "), k % 25)).otherwise("").alias("page_title"),
        pick(k % 5, REFERRERS).alias("referrer_domain"),
        F.when(news, "Newsletter").when(ads, "google").otherwise("").alias("utm_source"),
        F.when(news, "email").when(ads, "cpc").otherwise("").alias("utm_medium"),
        F.when(news | ads, F.concat(F.lit("c"), k % 3)).otherwise("").alias("utm_campaign"),
        F.when(k % 13 == 0, "gclid").otherwise("").alias("click_id_type"),
        pick(k % 8, AGENTS).alias("user_agent"),
        (F.lit(300) + k * 13).alias("vw"),
        pick(k % 3, ["en-GB", "de", "sw-KE"]).alias("language"),
        pick(F.col("user_id") % 6, COUNTRIES).alias("country"),
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("Region "), F.col("user_id") % 3)).otherwise("").alias("region"),
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("City "), F.col("user_id") % 5)).otherwise("").alias("city"),
        F.concat(F.lit("41.90."), F.col("user_id") % 256, F.lit("."), k).alias("ip"),
        F.when(name == "page_engagement", 0)
        .otherwise(F.least(F.lit(300), F.floor("value"))).cast("bigint").alias("heartbeat"),
        F.lit(1).cast("bigint").alias("n_events"),
        (name == "page_view").alias("has_pageview"),
        (name == "page_view").cast("bigint").alias("n_pageviews"),
        name.isin(CONVERTING).cast("bigint").alias("n_conversions"),
        F.when(buy, F.col("value").cast("decimal(18,4)")).alias("event_value"),
        F.when(buy, pick(k % 3, ["USD", "EUR", "KES"])).otherwise("").alias("currency"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are admitted: everything but the crawler's."""
    return payloads(spark, sf_dir).where(F.col("k") % 8 != 7)


def raw_hits(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Raw beacon payloads with their request facts, as ``read_hits`` would return them. With ``deal`` the events are dealt
    evenly before hits are made of them, while their rows are short."""
    e = table(spark, sf_dir, "events")
    p = named(with_k(deal_evenly(e) if deal else e))
    p = p.unionByName(_engagement(p)).withColumn("vid", F.md5(F.col("user_id").cast("string")))
    k = F.col("k")
    news, ads = k % 7 == 0, (k % 7 != 0) & (k % 11 == 0)
    query = F.concat_ws(
        "&",
        F.when(news | ads, F.concat(F.lit("utm_source="), F.when(news, "Newsletter").otherwise("google"))),
        F.when(news | ads, F.concat(F.lit("UTM_Medium="), F.when(news, "email").otherwise("cpc"))),
        F.when(news | ads, F.concat(F.lit("utm_campaign=c"), k % 3)),
        F.when(k % 13 == 0, F.concat(F.lit("gclid=id"), k)),
        F.when(k % 17 == 0, F.concat(F.lit("page_id="), k)),
    )
    host = F.when(k % 19 == 0, "other.example").when(k % 2 == 0, "www.Site.example").otherwise("site.example")
    path = F.when(k % 10 == 9, F.concat(F.lit("//admin//jane.doe%40mail.example/"), k)).otherwise(
        F.concat(F.lit("/p/"), k % 25, F.lit("/"))
    )
    ref = pick(k % 5, ["", "https://www.google.com/search?q=x", "https://m.facebook.com/", "https://chatgpt.com/", "https://site.example/start/"])
    buy = F.col("event_name") == "purchase"
    event = F.struct(
        F.when(k % 23 == 0, "Bad Name!").otherwise(F.upper("event_name")).alias("n"),
        (k * 1000).cast("bigint").alias("d"),
        F.col("attributes").alias("a"),
        F.lit(None).cast("string").alias("m"),
        F.lit(None).cast("string").alias("c"),
        F.lit("Thing").alias("et"),
        k.cast("string").alias("ei"),
        F.when(buy, F.col("value").cast("decimal(18,4)").cast("string")).alias("v"),
        F.when(buy, pick(k % 3, ["usd", "EUR", "bad!"])).alias("cu"),
        F.lit(None).cast("string").alias("lr"),
    )
    context = F.to_json(
        F.struct(
            F.lit("singular").alias("k"), F.when(k % 25 > 0, k % 25).alias("p"),
            pick(k % 3, ["post", "page", "tour"]).alias("t"), (k % 4 == 0).cast("int").alias("li"),
        )
    )
    click = F.col("event_type") == "click"
    return p.select(
        "payload_id",
        F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).alias("u"),
        ref.alias("r"),
        F.concat(F.lit("Page  "), k % 25).alias("ti"),
        pick(k % 2, ["Africa/Nairobi", "Not/AZone"]).alias("tz"),
        pick(k % 3, ["en-GB", "de", "not a language"]).alias("lg"),
        (F.lit(300) + k * 13).cast("string").alias("vw"),
        F.lit(False).alias("tp"),
        "vid",
        (k == 50).alias("wd"),
        context.alias("c"),
        F.when(F.col("event_name") == "page_engagement", "0").otherwise(F.floor("value").cast("string")).alias("hb"),
        F.when(click, F.concat(F.lit("[["), k, F.lit(","), F.floor("value"), F.lit("],[120,5],[\"x\",1]]"))).alias("hm"),
        F.array(event).alias("e"),
        F.concat(F.lit("41.90."), F.col("user_id") % 256, F.lit("."), k).alias("ip"),
        pick(k % 8, AGENTS).alias("user_agent"),
        (k == 60).alias("dnt"),
        (F.col("user_id") % 5 == 0).alias("gpc"),
        F.lit("").alias("ch_platform"),
        pick(F.col("user_id") % 3, ["KE", "XX", ""]).alias("cf_country"),
        "received_at",
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every third day of the events: EUR against the base, and the base against KES (reverse pair)."""
    days = raw(spark, sf_dir).select(F.to_date("received_at").alias("rate_date")).distinct()
    d = F.dayofmonth("rate_date")
    days = days.where(d % 3 == 0)
    return days.select("rate_date", F.explode(F.array(
        F.struct(F.lit("USD").alias("base_currency"), F.lit("EUR").alias("quote_currency"),
                 (F.lit(0.9) + d / 1000).cast("decimal(20,10)").alias("rate")),
        F.struct(F.lit("KES").alias("base_currency"), F.lit("USD").alias("quote_currency"),
                 (F.lit(0.007) + d / 100000).cast("decimal(20,10)").alias("rate")),
    )).alias("r")).select("rate_date", "r.*")


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The /24 blocks of the addresses in use, with the place of each."""
    third = raw(spark, sf_dir).select((F.col("user_id") % 256).alias("t")).distinct()
    t = F.col("t")
    return third.where(t % 7 != 0).select(
        F.concat(F.lit("41.90."), t, F.lit(".0")).alias("start_ip"),
        F.concat(F.lit("41.90."), t, F.lit(".255")).alias("end_ip"),
        pick(t % 6, ["KE", "GB", "DE", "US", "ZA", "FR"]).alias("country"),
        F.concat(F.lit("Region "), t % 4).alias("region"),
        F.concat(F.lit("City "), t % 9).alias("city"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("post_id"), F.col("p_brand").alias("author"),
        F.date_sub(F.lit("2024-01-31").cast("date"), F.col("p_size") * 20).cast("timestamp_ntz").alias("published_at"),
        F.lit("post").alias("post_type"),
    ).where(F.col("post_id") % 6 != 0)


def post_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = p.where(F.col("p_size") % 4 != 0).select(
        F.col("p_partkey").alias("post_id"), F.lit("topic").alias("taxonomy"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("term"),
    )
    second = p.select(
        F.col("p_partkey").alias("post_id"), F.lit("topic").alias("taxonomy"),
        F.concat(F.lit("size "), F.col("p_size") % 4).alias("term"),
    ).where(F.col("post_id") % 2 == 0)
    return first.unionByName(second)


def ad_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = named(raw(spark, sf_dir)).where(F.col("event_name").isin("ad_impression", "ad_click"))
    ad = F.col("k") % 5
    return rows.groupBy(F.to_date("received_at").alias("day"), ad.cast("bigint").alias("ad_id")).agg(
        F.sum((F.col("event_name") == "ad_impression").cast("int")).alias("impressions"),
        F.sum((F.col("event_name") == "ad_click").cast("int")).alias("clicks"),
    ).select(
        "day", "ad_id", (F.col("ad_id") % 2).alias("campaign_id"),
        F.concat(F.lit("Ad "), "ad_id").alias("name"),
        F.concat(F.lit("Campaign "), F.col("ad_id") % 2).alias("campaign"),
        F.when(F.col("ad_id") % 3 == 0, "paused").otherwise("active").alias("status"),
        "impressions", "clicks",
    )


def heat_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat points of click rows with the device of the page view."""
    from footfall.functions.agents import user_agent

    p = payloads(spark, sf_dir).join(
        table(spark, sf_dir, "events").where(F.col("event_type") == "click").select("event_id"), "event_id", "left_semi"
    )
    return user_agent(p).select(
        "received_at", "page_path", F.col("device_type").alias("device"), F.col("k").alias("x"),
        F.floor("value").cast("int").alias("y"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server log rows for the crawler report."""
    return map_requests(raw(spark, sf_dir))


def map_requests(e: DataFrame) -> DataFrame:
    p = named(e)
    k = F.col("k")
    crawler = pick(
        F.col("user_id") % 4,
        [AGENTS[7], "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
         "Mozilla/5.0 AppleWebKit/537.36; compatible; GPTBot/1.2; +https://openai.com/gptbot", "SiteAudit/1.0 Googlebot"],
    )
    return p.select(
        F.col("event_id").alias("request_id"), F.col("received_at").alias("ts"),
        F.when(k % 2 == 1, crawler).otherwise(pick(k % 8, AGENTS)).alias("user_agent"),
        F.concat(F.lit("/p/"), k % 25, F.lit("/")).alias("path"),
        F.when(F.col("event_name") == "page_not_found", 404).otherwise(200).alias("status_code"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        "page_id", "url", "html",
        F.when(i % 29 == 0, 404).when(i % 31 == 0, 301).when(i % 37 == 0, 0).when(i % 41 == 0, 503).otherwise(200).alias("status_code"),
        ((i * 37) % 2500).cast("int").alias("response_ms"),
        F.when(i == 1, "home").when(i % 3 == 0, "archive").otherwise("content").alias("source"),
        i.alias("post_id"),
    )


def event_rows(linked: DataFrame, fx: DataFrame | None = None) -> DataFrame:
    """Event rows of sessionised payloads, as the write path would store them."""
    from footfall.operators.currency import to_base
    from footfall.operators.events import registry_map

    known = registry_map(SAMPLE_REGISTRY)[F.col("event_name")]
    rows = linked.where(F.col("session_id").isNotNull()).select(
        F.col("payload_id").alias("event_id"), F.col("received_at").alias("occurred_at"), "session_id", "visitor_key",
        "event_name", known["category"].alias("category"), known["module"].alias("module"), F.lit(0).alias("origin"),
        "post_id", "post_type", "page_path", "page_title", "event_value", "currency",
        known["conversion"].alias("is_conversion"), "attributes",
    )
    if fx is None:
        return rows.withColumn("event_value_base", F.col("event_value"))
    return to_base(rows, fx, BASE_CURRENCY)


