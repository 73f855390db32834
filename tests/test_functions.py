"""Table-driven cases of the column functions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from footfall.functions import agents, measures, network, privacy, text, urls
from footfall.functions.channels import channel_of, domain_matches
from footfall.functions.times import shift_months, utc_midnight
from footfall.operators import geo
from footfall.operators.events import clean_attributes_of
from footfall.sources.sample import AGENTS
from footfall.streaming import streams


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_pii(spark):
    cases = {
        "/thanks/jane.doe@mail.example/": "/thanks/[email]/",
        "call +254 712 345 678 now": "call [phone] now",
        "/reset/a8f3k2b9c7d1e5f4a6b8c0d2e4f6": "/reset/[token]",
        "/tours/10-day-safari-and-beach-extension-with-guides/": "/tours/10-day-safari-and-beach-extension-with-guides/",
        "2026-12-20": "2026-12-20",
        "id abcdefab-cdef-4abc-8def-abcdefabcdef": "id [token]",
        "id 123e4567-e89b-42d3-a456-426614174000": "id 123e4567-e89b-42d3-a[phone]",  # the phone rule comes first
        "": "",
        "12345678": "12345678",
        "1-2-3-4-5-6-7-8-9": "[phone]",
        "x%40y": "x%40y",
        "bob%40mail.example": "[email]",
    }
    got = column(spark, list(cases), text.scrub_pii)
    for (src, want), g in zip(cases.items(), got):
        assert g == want, src
    assert column(spark, ["guest: bob@mail.example", "USD 1,200.00", "tel 0712345678"], text.contains_pii) == [True, False, True]


def test_phone_rule_survives_long_runs(spark):
    got = column(spark, ["1 " * 60000, "+" + "9" * 200000], text.scrub_pii)
    assert got == ["[phone] ", "[phone]"]


def test_terms_and_form_ids(spark):
    assert column(spark, ["  Masai   Mara ", "<b>Hi</b>\tthere", "É " * 200], text.normalize_term)[:2] == ["masai mara", "hi there"]
    df = spark.createDataFrame([("elementor", "a1b2c3"), ("nf", "<script>"), ("nf", "!!")], "p string, i string")
    assert [r[0] for r in df.select(text.form_id("p", "i")).collect()] == ["elementor:a1b2c3", "nf:script", "nf:0"]


def test_csv_safe(spark):
    df = spark.createDataFrame([("=1+1", 12, True), ("@SUM(A1)", 1, False), ("plain", 2, True), ("-x", 3, None)], "a string, b int, c boolean")
    rows = [tuple(r) for r in text.csv_safe(df).collect()]
    assert rows == [("'=1+1", 12, 1), ("'@SUM(A1)", 1, 0), ("plain", 2, 1), ("'-x", 3, None)]


def test_agents(spark):
    names = ["Chrome", "Edge", "Safari", "Samsung Internet", "Chrome", "Firefox", "Facebook App"]
    systems = ["Windows", "Windows", "iOS", "Android", "Android", "macOS", "iOS"]
    devices = ["desktop", "desktop", "mobile", "mobile", "tablet", "desktop", "mobile"]
    df = spark.createDataFrame([(i, u, "", False) for i, u in enumerate(AGENTS[:7])], "i int, user_agent string, ch_platform string, tp boolean")
    rows = agents.user_agent(df).orderBy("i").collect()
    assert [r.browser for r in rows] == names
    assert [r.os for r in rows] == systems
    assert [r.device_type for r in rows] == devices
    mac = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.0 Safari/605.1.15"
    odd = [(mac, "", True), ("Android thing (Mobile) Android", "", False), ("unknown agent", "Chrome OS", False), ("", "", False), ("SMART-TV x", "", False)]
    got = agents.user_agent(spark.createDataFrame(odd, "user_agent string, ch_platform string, tp boolean")).collect()
    assert [(r.os, r.device_type) for r in got] == [
        ("iPadOS", "tablet"), ("Android", "tablet"), ("ChromeOS", "desktop"), ("", "desktop"), ("Other", "tv"),
    ]


def test_bots(spark):
    cases = {
        AGENTS[7]: True,
        "curl/8.4.0": True,
        "": True,
        "Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/120.0.0.0 Safari/537.36": True,
        "Mozilla/5.0 (Linux; Android 12; CUBOT X50) AppleWebKit/537.36 Chrome/120.0.0.0 Mobile Safari/537.36": False,
        "Some nice bot of mine": True,
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/131.0.0.0 Safari/537.36": False,
    }
    assert column(spark, list(cases), agents.is_bot) == list(cases.values())
    found = column(spark, ["Mozilla GPTBot/1.2", "x bingbot/2.0", "Mozilla/5.0"], agents.crawler)
    assert [f and tuple(f) for f in found] == [("GPTBot", "ai"), ("Bingbot", "search"), None]


def test_addresses(spark):
    cases = {
        "41.90.12.34": "41.90.12.0", "2001:db8:85a3:8d3:1319:8a2e:370:7348": "2001:db8:85a3::", "::1": "::",
        "2001:db8::1": "2001:db8::", "2001:0:5::9": "2001:0:5::", "bad": "", "1.2.3": "", "01.2.3.4": "",
        "1:2:3:4:5:6:7": "", "1::2::3": "", "::ffff:1.2.3.4": "::", "fe80:0:0:1::": "fe80::",
    }
    assert column(spark, list(cases), network.truncate_ip) == list(cases.values())
    assert column(spark, ["::ffff:1.2.3.4"], network.ip_hex) == ["00000000000000000000FFFF01020304"]
    blocks = {
        "10.1.2.3": ["10.0.0.0/8"], "192.168.1.77": ["192.168.1.77"], "2001:db8::1": ["2001:db8::/32"],
        "10.0.0.200": ["10.0.0.128/25"],
    }
    for ip, cidrs in blocks.items():
        assert column(spark, [ip], lambda c: network.in_cidrs(c, cidrs)) == [True]
    assert column(spark, ["11.0.0.1"], lambda c: network.in_cidrs(c, ["10.0.0.0/8", "2001:db8::/32"])) == [False]
    assert column(spark, ["10.0.0.100"], lambda c: network.in_cidrs(c, ["10.0.0.128/25", "broken/99"])) == [False]
    df = spark.createDataFrame([("not-an-ip, 41.90.12.34, 172.70.1.1", "172.70.1.1"), ("", "172.70.1.1"), (None, "x")], "h string, remote_addr string")
    assert [r.ip for r in network.client_ip(df, "h").collect()] == ["41.90.12.34", "172.70.1.1", ""]


def test_visitor_key_is_hmac(spark):
    import datetime

    salts = spark.createDataFrame([(datetime.date(2024, 1, 1), "salt" * 30)], "day date, salt string")
    hits = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS received_at, '41.90.12.34' AS ip, 'ua' AS user_agent, "
                     "repeat('a', 32) AS vid, explode(array(true, false)) AS enhanced")
    got = {r.enhanced: r.visitor_key for r in privacy.visitor_key(hits, salts, "s" * 64, "https://x").collect()}
    assert got[True] == hmac.new(b"s" * 64, b"vid|" + b"a" * 32, hashlib.sha256).hexdigest()[:32]
    assert got[False] == hmac.new(b"salt" * 30, b"41.90.12.0|ua|https://x", hashlib.sha256).hexdigest()[:32]


def test_urls(spark):
    url = "https://WWW.Example.org//tours//great%20migration/?UTM_Source=google&utm_medium=cpc&gclid=abc-1&p=42&p=43&a[]=1"
    df = urls.parse_url(spark.createDataFrame([(url,), ("https://x.example?lang=de",), (None,)], "u string"))
    rows = df.withColumn("c", urls.click_id("query_params")).select("*", *urls.campaign("query_params")).collect()
    assert (rows[0].host, rows[0].page_path) == ("www.example.org", "/tours/great migration/?p=43")
    assert (rows[0].utm_source, rows[0].utm_medium, tuple(rows[0].c)) == ("google", "cpc", ("gclid", "abc-1"))
    assert (rows[1].page_path, rows[2].host, rows[2].page_path) == ("/?lang=de", "", "/")
    refs = ["https://www.google.com/search?q=1", "ftp://x.example/", "android-app://com.app/", "https://www.example.org/a", "", None]
    got = column(spark, refs, lambda c: urls.referrer(c, ["example.org"]))
    assert [tuple(g) for g in got] == [
        ("google.com", "https://www.google.com/search"), ("", ""), ("com.app", "android-app://com.app/"), ("", ""), ("", ""), ("", ""),
    ]
    matches = [("/admin/x", ["/admin/*"], True), ("/Admin/x", ["/admin/*"], True), ("/a.html", ["/a?html"], False), ("/b", ["/a"], False)]
    for path, patterns, want in matches:
        assert column(spark, [path], lambda c: urls.path_matches(c, patterns)) == [want]


@pytest.mark.parametrize(
    "href,want",
    [
        ("/a/../b", "https://x.example/b/"), ("c.html", "https://x.example/d/c.html"), ("../z", "https://x.example/z/"),
        ("//Y.example/q", "https://y.example/q/"), ("HTTPS://Y.Example:81/Q?a=1#f", "https://y.example:81/Q/?a=1"),
        ("#top", ""), ("./", "https://x.example/d/"), ("mailto:a@b.example", "mailto:a@b.example"), ("?p=2", "https://x.example/d/?p=2"),
    ],
)
def test_normalize_url(spark, href, want):
    assert column(spark, [href], lambda c: urls.normalize_url(c, F.lit("https://x.example/d/e"))) == [want]


def test_links(spark):
    rows = [
        ("tel:+1", "contact", "phone"), ("viber:x", "contact", "viber"), ("https://wa.me/1", "contact", "whatsapp"),
        ("https://x.example/a.PDF", "download", ""), ("https://other.example/", "outbound", ""), ("/about", "", ""),
    ]
    df = spark.createDataFrame([(h, "x.example") for h, _, _ in rows], "href string, host string")
    assert [(r.link_class, r.contact_method) for r in urls.classify_links(df).collect()] == [(c, m) for _, c, m in rows]


@pytest.mark.parametrize(
    "domain,medium,source,click,want",
    [
        ("google.com", "", "", "", "organic_search"), ("gemini.google.com", "", "", "", "ai_assistant"),
        ("mail.google.com", "", "", "", "email"), ("m.facebook.com", "", "", "", "social"), ("", "", "", "", "direct"),
        ("google.com", "CPC", "google", "", "paid_search"), ("", "cpc", "facebook", "", "paid_social"),
        ("google.com", "", "", "gclid", "paid_search"), ("", "", "", "ttclid", "paid_social"),
        ("m.facebook.com", "", "", "fbclid", "social"), ("blog.example", "", "", "", "referral"),
        ("", "", "instagram", "", "social"), ("", "", "partnerx", "", "referral"), ("www.expedia.co.uk", "", "", "", "ota_listing"),
        ("", "newsletter", "x", "", "email"), ("notgoogle.com", "", "", "", "referral"), ("", "weird", "", "", "direct"),
    ],
)
def test_channels(spark, domain, medium, source, click, want):
    df = spark.createDataFrame([(domain, medium, source, click)], "d string, m string, s string, c string")
    assert df.select(channel_of("d", "m", "s", "c")).first()[0] == want


def test_domain_rule(spark):
    got = column(spark, ["google.com", "www.google.de", "mygoogle.com", "google"], lambda c: domain_matches(c, "google."))
    assert got == [True, True, False, False]


def test_measures(spark):
    assert column(spark, ["0", "575", "576", "991", "1200", "1600", "x", None], measures.viewport_bucket) == ["", "xs", "sm", "md", "xl", "xxl", "", ""]
    assert column(spark, ["en-GB", "de", "english language", "zh-Hant-TW"], measures.language) == ["en-GB", "de", "", "zh-Hant-TW"]
    row = spark.range(1).select(
        shift_months("2024-02-29", -12).cast("string"), shift_months("2024-03-31", -1).cast("string"),
        utc_midnight("2024-01-10", "Africa/Nairobi").cast("string"), utc_midnight("2024-03-31", "Europe/Berlin", 1).cast("string"),
    ).first()
    assert tuple(row) == ("2023-03-01", "2024-03-02", "2024-01-09 21:00:00", "2024-03-31 22:00:00")


def test_attributes(spark):
    src = [
        '{"Plan":"Gold","email_address":"a@b.example","name":"x","n":2.0,"f":1.23456789,"t":true,"nil":null,"list":["a",1,"bob@mail.example"],"obj":{"a":1}}',
        "[]", None, "{bad", '{"a":"<b></b>","b":"+254712345678"}',
        "{" + ",".join(f'"k{i}":{i}' for i in range(40)) + "}",
    ]
    got = column(spark, src, clean_attributes_of)
    assert got[0] == '{"plan":"Gold","n":2.0,"f":1.234568,"t":true,"list":["a",1]}'
    assert got[1:5] == ["{}", "{}", "{}", "{}"]
    assert got[5] == "{" + ",".join(f'"k{i}":{i}' for i in range(25)) + "}"


def test_blocks_of_a_table(spark):
    """The table form excludes what the list form does; broken blocks and addresses are passed over."""
    blocks = ["10.0.0.0/8", "41.90.16.0/21", "41.90.12.9", " 192.0.2.77/30", "198.51.100.7/32", "2001:db8::/33", "2001:db9::1", "0.0.0.0/33", "x/8", "1.2.3.4/", "1.2.3.4/8/8", "", None]
    ips = [f"41.90.{i}.{i}" for i in range(8, 34)] + ["10.255.0.1", "11.0.0.0", "41.90.12.9", "192.0.2.75", "192.0.2.76", "192.0.2.79", "192.0.2.80"]
    ips += ["198.51.100.7", "198.51.100.6", "2001:DB8:7fff::1", "2001:db8:8000::1", "2001:db9::1", "2001:db9::2", "1.2.3.4", "nonsense", "", None, None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    table = spark.createDataFrame([(b,) for b in blocks], "block string")
    kept = {r.i for r in geo.exclude_blocks(df, table).collect()}
    assert kept == {r.i for r in network.exclude_ips(df, [b for b in blocks if b]).collect()} and 10 < len(kept) < len(ips)
    assert geo.exclude_blocks(df, table.limit(0)).count() == len(ips)
    everything = spark.createDataFrame([("0.0.0.0/0",)], "block string")
    assert {r.ip for r in geo.exclude_blocks(df, everything).collect()} == {ip for ip in ips if ip is None or ":" in ip or ip in ("", "nonsense")}


def test_sketches_of_active_visitors(spark):
    """Thirty minutes of 2000 visitors each, a part of whom come again: within three standard errors of the exact number."""
    rows = spark.range(60000).select(
        F.timestamp_seconds(1704067200 + F.col("id") % 1800).alias("event_time"), F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(40000))).alias("visitor_key")
    )
    minute = F.window("event_time", "1 minute")
    exact = {r.start: r.visitors for r in streams.active_of(rows.groupBy(minute, "visitor_key").agg(F.count("*").alias("payloads"))).collect()}
    near = {r.start: r.visitors for r in streams.active_of_sketches(rows.groupBy(minute).agg(F.hll_sketch_agg("visitor_key", 12).alias("sketch"))).collect()}
    assert near.keys() == exact.keys() and max(exact.values()) > 8000
    assert all(abs(near[t] - n) <= 3 * 1.04 / 64 * n for t, n in exact.items())
