"""SQL twins of the registered queries, for DuckDB, written against the source tables only."""

from __future__ import annotations

from footfall.functions.channels import DEFAULT_RULES
from footfall.operators.audit_site import CATALOG
from footfall.operators.events import REGISTRY
from footfall.sources.sample import AGENTS, COUNTRIES, REFERRERS

ORACLES: dict[str, str] = {}
FROM, TO = "2024-01-08", "2024-01-28"
NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def array(vs) -> str:
    return "[" + ", ".join(text(v) for v in vs) + "]"


def case(index: str, vs) -> str:
    return f"({array(vs)})[CAST({index} AS INT) + 1]"


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = (f"WITH {ctes.strip().rstrip(',')}\n" if ctes else "") + select.strip()


# Browser facts of the eight sample agents, worked out by hand.
UA_FACTS = [
    ("Chrome", "131", "Windows", "10", "desktop"),
    ("Edge", "131", "Windows", "10", "desktop"),
    ("Safari", "18", "iOS", "18", "mobile"),
    ("Samsung Internet", "26", "Android", "14", "mobile"),
    ("Chrome", "130", "Android", "13", "tablet"),
    ("Firefox", "132", "macOS", "10.15", "desktop"),
    ("Facebook App", "", "iOS", "17", "mobile"),
    ("Other", "", "Other", "", "desktop"),
]
UA = "ua AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {text(a)}, {', '.join(text(x) for x in f)})" for i, (a, f) in enumerate(zip(AGENTS, UA_FACTS))
) + ") t(ua_i, user_agent, browser, browser_version, os, os_version, device_type)),"

EV0 = """
ev0 AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  date_trunc('second', ts) AS received_at FROM events),
"""
EV1 = EV0 + """
ev1 AS (SELECT *, k // 10 AS tens,
  CASE WHEN event_type = 'view' AND k % 10 = 0 THEN 'ad_impression' WHEN event_type = 'view' AND k % 10 = 1 THEN 'site_search'
    WHEN event_type = 'view' THEN 'page_view' WHEN event_type = 'click' AND k % 3 = 0 THEN 'ad_click'
    WHEN event_type = 'click' AND k % 3 = 1 THEN 'outbound_click' WHEN event_type = 'click' THEN 'cta_click'
    WHEN event_type = 'signup' THEN 'form_submit' WHEN event_type = 'purchase' THEN 'purchase' ELSE 'page_not_found' END AS event_name,
  substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS pv, event_id * 2 + 2 AS payload_id FROM ev0),
"""
EV2 = EV1 + f"""
ev2 AS (SELECT *, event_type = 'click' AS is_click,
    CASE WHEN event_name = 'site_search' THEN CASE WHEN tens % 2 = 0 THEN 'TERM  ' || tens ELSE ' Term ' || tens END END AS query,
    CASE WHEN event_name = 'site_search' AND tens % 5 <> 4 THEN tens % 4 END AS results,
    CASE WHEN event_name = 'site_search' THEN {case("tens % 3", ["results_page", "form", "live"])} END AS source,
    CAST(NULL AS BIGINT) AS engaged, CAST(NULL AS BIGINT) AS scroll FROM ev1
  UNION ALL
  SELECT event_id, user_id, event_type, value, k, received_at + INTERVAL 1 SECOND, tens, 'page_engagement', pv, payload_id + 1,
    false, NULL, NULL, NULL, CAST(floor(value) AS BIGINT), k % 5 * 25 FROM ev1 WHERE event_name = 'page_view'),
"""


def _domain(d: str, entries) -> str:
    out = []
    for e in entries:
        if e.endswith("."):
            out.append(f"starts_with({d}, {text(e)}) OR contains({d}, {text('.' + e)})")
        else:
            out.append(f"{d} = {text(e)} OR ends_with({d}, {text('.' + e)})")
    return "(" + " OR ".join(out) + ")"


def channel_sql(domain: str, medium: str, source: str, click: str) -> str:
    r = DEFAULT_RULES

    def among(x: str, key: str) -> str:
        return f"{x} IN ({', '.join(text(v) for v in r[key])})"

    m, s = f"lower(trim({medium}))", f"lower(trim({source}))"
    return f"""CASE
  WHEN {among(m, 'medium_paid_search')} AND {among(s, 'social_sources')} THEN 'paid_social'
  WHEN {among(m, 'medium_paid_search')} THEN 'paid_search'
  WHEN {among(m, 'medium_paid_social')} THEN 'paid_social'
  WHEN {among(m, 'medium_display')} THEN 'display'
  WHEN {among(m, 'medium_email')} THEN 'email'
  WHEN {among(m, 'medium_affiliate')} THEN 'affiliate'
  WHEN {among(m, 'medium_social')} THEN 'social'
  WHEN {among(click, 'click_paid_search')} THEN 'paid_search'
  WHEN {among(click, 'click_paid_social')} THEN 'paid_social'
  WHEN {_domain(domain, r['ai_assistants'])} THEN 'ai_assistant'
  WHEN {_domain(domain, r['email_domains'])} THEN 'email'
  WHEN {_domain(domain, r['ota_listing'])} THEN 'ota_listing'
  WHEN {_domain(domain, r['social'])} THEN 'social'
  WHEN {_domain(domain, r['search_engines'])} THEN 'organic_search'
  WHEN {domain} <> '' THEN 'referral'
  WHEN {among(s, 'social_sources')} THEN 'social'
  WHEN {s} <> '' THEN 'referral' ELSE 'direct' END"""


PAY = UA + EV2 + f"""
pay0 AS (SELECT e.*, md5(CAST(user_id AS VARCHAR)) AS visitor_key, CAST(user_id % 2 AS INT) AS id_mode,
  '/p/' || k % 25 || '/' AS page_path, CAST(k % 25 AS BIGINT) AS post_id,
  CASE WHEN k % 25 = 0 THEN '' ELSE {case("k % 3", ["post", "page", "tour"])} END AS post_type,
  CASE WHEN event_name = 'page_view' THEN 'Page ' || k % 25 ELSE '' END AS page_title,
  {case("k % 5", REFERRERS)} AS referrer_domain,
  CASE WHEN k % 7 = 0 THEN 'Newsletter' WHEN k % 11 = 0 THEN 'google' ELSE '' END AS utm_source,
  CASE WHEN k % 7 = 0 THEN 'email' WHEN k % 11 = 0 THEN 'cpc' ELSE '' END AS utm_medium,
  CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'c' || k % 3 ELSE '' END AS utm_campaign,
  CASE WHEN k % 13 = 0 THEN 'gclid' ELSE '' END AS click_id_type,
  300 + k * 13 AS vw, {case("k % 3", ["en-GB", "de", "sw-KE"])} AS language,
  {case("user_id % 6", COUNTRIES)} AS country,
  CASE WHEN user_id % 4 = 0 THEN 'Region ' || user_id % 3 ELSE '' END AS region,
  CASE WHEN user_id % 4 = 0 THEN 'City ' || user_id % 5 ELSE '' END AS city,
  '41.90.' || user_id % 256 || '.' || k AS ip,
  CASE WHEN event_name = 'page_engagement' THEN 0 ELSE least(300, CAST(floor(value) AS BIGINT)) END AS heartbeat,
  CASE WHEN event_name = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END AS event_value,
  CASE WHEN event_name = 'purchase' THEN {case("k % 3", ["USD", "EUR", "KES"])} ELSE '' END AS currency,
  CAST(event_name IN ('form_submit', 'purchase') AS BIGINT) AS conv, CAST(event_name = 'page_view' AS BIGINT) AS pvs
  FROM ev2 e),
pay AS (SELECT p.*, u.user_agent, u.browser, u.browser_version, u.os, u.os_version, u.device_type FROM pay0 p JOIN ua u ON p.k % 8 = u.ua_i),
"""

VIEWPORT = "CASE WHEN vw < 576 THEN 'xs' WHEN vw < 768 THEN 'sm' WHEN vw < 992 THEN 'md' WHEN vw < 1200 THEN 'lg' WHEN vw < 1600 THEN 'xl' ELSE 'xxl' END"


def linked(timeout: int, split: bool, source: str = "SELECT * FROM pay WHERE k % 8 <> 7") -> str:
    """Session numbering by counting starts, the way one would do it with plain windows."""
    carrier = (
        "gap = 1 OR (event_name = 'page_view' AND (utm_source || utm_medium || utm_campaign || click_id_type) <> '')"
        if split else "gap = 1"
    )
    return f"""
h0 AS ({source}),
h1 AS (SELECT *, lower(utm_source || '|' || utm_medium || '|' || utm_campaign) AS triple,
  CASE WHEN lag(received_at) OVER w IS NULL OR date_diff('second', lag(received_at) OVER w, received_at) > {timeout * 60} THEN 1 ELSE 0 END AS gap
  FROM h0 WINDOW w AS (PARTITION BY visitor_key ORDER BY received_at, payload_id)),
c1 AS (SELECT *, CASE WHEN gap = 1 OR triple IS DISTINCT FROM lag(triple) OVER w THEN 1 ELSE 0 END AS fresh FROM h1 WHERE {carrier}
  WINDOW w AS (PARTITION BY visitor_key ORDER BY received_at, payload_id)),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor_key ORDER BY received_at, payload_id) AS sub FROM c1),
c3 AS (SELECT *, last_value(nullif(click_id_type, '') IGNORE NULLS) OVER (PARTITION BY visitor_key, sub ORDER BY received_at, payload_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c2),
starts AS (SELECT payload_id AS start_id FROM c3 WHERE fresh = 1 OR (click_id_type <> '' AND click_id_type IS DISTINCT FROM held)),
linked AS (SELECT h.*, last_value(start_id IGNORE NULLS) OVER (PARTITION BY visitor_key ORDER BY received_at, payload_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id FROM h1 h LEFT JOIN starts s ON h.payload_id = s.start_id),
"""


SESS = PAY + linked(240, True) + f"""
firsts AS (SELECT session_id, page_path AS landing_path, post_id AS landing_post_id, received_at AS started_at, referrer_domain,
  utm_source, utm_medium, utm_campaign, click_id_type, id_mode, browser, os, device_type, language, country, region, city,
  {VIEWPORT} AS viewport,
  {channel_sql("referrer_domain", "utm_medium", "utm_source", "click_id_type")} AS channel
  FROM linked WHERE payload_id = session_id),
counters AS (SELECT session_id, any_value(visitor_key) AS visitor_key, max(received_at) AS last_seen_at,
  CAST(least(sum(pvs), 65535) AS BIGINT) AS pageviews, count(*) AS event_count, CAST(least(sum(heartbeat), 86400) AS BIGINT) AS engaged_seconds,
  CAST(least(sum(conv), 65535) AS BIGINT) AS conversions,
  arg_max(page_path, received_at * 1) FILTER (WHERE false) AS unused,
  max((received_at, payload_id, page_path)) FILTER (WHERE pvs = 1) AS last_view FROM linked GROUP BY session_id),
sess0 AS (SELECT f.*, c.visitor_key, c.last_seen_at, date_diff('second', f.started_at, c.last_seen_at) AS duration_seconds, c.pageviews,
  c.event_count, c.engaged_seconds, c.conversions,
  CASE WHEN c.engaged_seconds > 10 OR c.pageviews >= 2 OR c.conversions > 0 THEN 1 ELSE 0 END AS is_engaged,
  coalesce(c.last_view[3], f.landing_path) AS exit_path FROM firsts f JOIN counters c USING (session_id)),
sess AS (SELECT *, CASE WHEN id_mode = 1 THEN CASE WHEN started_at > min(started_at) OVER (PARTITION BY visitor_key) THEN 1 ELSE 0 END END AS is_returning,
  CAST(started_at + INTERVAL 3 HOUR AS DATE) AS day FROM sess0),
""".replace("  arg_max(page_path, received_at * 1) FILTER (WHERE false) AS unused,\n", "")

FX = """
fxd AS (SELECT DISTINCT CAST(received_at AS DATE) AS d FROM ev0 WHERE day(received_at) % 3 = 0),
fx AS (SELECT d, CAST(CAST(0.9 AS DOUBLE) + day(d) / 1000 AS DECIMAL(20,10)) AS eur, CAST(CAST(0.007 AS DOUBLE) + day(d) / 100000 AS DECIMAL(20,10)) AS kes FROM fxd),
"""


def to_base(value: str, currency: str, at: str, base: str = "USD") -> str:
    eur = f"(SELECT CAST(eur AS DOUBLE) FROM fx WHERE d <= CAST({at} AS DATE) ORDER BY d DESC LIMIT 1)"
    kes = f"(SELECT CAST(kes AS DOUBLE) FROM fx WHERE d <= CAST({at} AS DATE) ORDER BY d DESC LIMIT 1)"
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN {currency} IN ('', '{base}') THEN CAST({value} AS DECIMAL(18,4)) "
        f"WHEN {currency} = 'EUR' THEN CAST(round({v} / {eur}, 4) AS DECIMAL(18,4)) "
        f"WHEN {currency} = 'KES' THEN CAST(round({v} / (1.0 / {kes}), 4) AS DECIMAL(18,4)) END"
    )


REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"({text(n)}, {text(c)}, {text(m)}, {int(v)})" for n, (c, m, v) in {**REGISTRY, "purchase": ("commerce", "shop", True)}.items()
) + ") t(event_name, category, module, is_conversion)),"

EVENTS = SESS + FX + REG + f"""
evn AS (SELECT l.*, l.payload_id AS eid, r.category, r.module, r.is_conversion, l.received_at AS occurred_at,
  {to_base("l.event_value", "l.currency", "l.received_at")} AS value_base,
  CAST(l.received_at + INTERVAL 3 HOUR AS DATE) AS day FROM linked l JOIN reg r USING (event_name)),
"""

TRAFFIC_COLS = (
    "visitors sessions engaged_sessions bounces pageviews events conversions revenue engaged_seconds duration_seconds "
    "new_visitors returning_visitors"
).split()
DT = EVENTS + """
ts AS (SELECT day, count(DISTINCT visitor_key) AS visitors, count(*) AS sessions, CAST(sum(is_engaged) AS BIGINT) AS engaged_sessions,
  CAST(sum(CASE WHEN pageviews <= 1 AND is_engaged = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bounces, CAST(sum(engaged_seconds) AS BIGINT) AS engaged_seconds,
  CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds, count(DISTINCT CASE WHEN is_returning = 0 THEN visitor_key END) AS new_visitors,
  count(DISTINCT CASE WHEN is_returning = 1 THEN visitor_key END) AS returning_visitors FROM sess GROUP BY day),
te AS (SELECT day, count(*) AS events, CAST(sum(pvs) AS BIGINT) AS pageviews, CAST(sum(is_conversion) AS BIGINT) AS conversions,
  coalesce(sum(CASE WHEN is_conversion = 1 THEN value_base END), 0) AS revenue FROM evn GROUP BY day),
dt AS (SELECT day, """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in TRAFFIC_COLS
) + """ FROM ts FULL JOIN te USING (day)),
"""

DIM = {
    "channel": "channel",
    "source": "CASE WHEN utm_source <> '' THEN lower(utm_source) WHEN referrer_domain <> '' THEN referrer_domain ELSE '(direct)' END",
    "medium": "CASE WHEN utm_medium <> '' THEN lower(utm_medium) ELSE '(none)' END",
    "campaign": "nullif(utm_campaign, '')",
    "referrer": "nullif(referrer_domain, '')",
    "landing_page": "landing_path",
    "country": "CASE WHEN country <> '' THEN country ELSE '(unknown)' END",
    "region": "CASE WHEN region <> '' THEN country || ' · ' || region END",
    "city": "CASE WHEN city <> '' THEN country || ' · ' || city END",
    "device": "device_type",
    "browser": "browser",
    "os": "os",
    "language": "lower(language)",
    "viewport": "viewport",
    "visitor_type": "CASE is_returning WHEN 1 THEN 'returning' WHEN 0 THEN 'new' ELSE 'unknown' END",
}
REV = EVENTS + """
rev AS (SELECT s.session_id, sum(e.value_base) AS rev FROM sess s JOIN evn e ON e.session_id = s.session_id
  WHERE e.is_conversion = 1 AND e.occurred_at >= CAST(s.day AS TIMESTAMP) - INTERVAL 3 HOUR
    AND e.occurred_at < CAST(s.day AS TIMESTAMP) - INTERVAL 3 HOUR + INTERVAL 48 HOUR GROUP BY s.session_id),
"""
DD = REV + "dl AS (" + " UNION ALL ".join(
    f"SELECT *, {text(n)} AS dimension, {x} AS v FROM sess" for n, x in DIM.items()
) + """),
dd AS (SELECT day, dimension, v AS value, count(*) AS sessions, count(DISTINCT visitor_key) AS visitors, CAST(sum(is_engaged) AS BIGINT) AS engaged_sessions,
  CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(engaged_seconds) AS BIGINT) AS engaged_seconds, CAST(sum(conversions) AS BIGINT) AS conversions,
  coalesce(sum(rev), 0) AS revenue FROM dl LEFT JOIN rev USING (session_id) WHERE v IS NOT NULL GROUP BY day, dimension, v),
"""
ENG = """
engv AS (SELECT day, page_path AS path, session_id, pv, max(engaged) AS top FROM evn WHERE event_name = 'page_engagement' GROUP BY ALL),
"""
CONTENT_COLS = ["pageviews", "visitors", "entrances", "exits", "engaged_seconds", "engaged_views", "conversions"]
DC = EVENTS + ENG + """
cv AS (SELECT day, page_path AS path, count(*) AS pageviews, count(DISTINCT visitor_key) AS visitors, max(post_id) AS post_id, max(post_type) AS post_type,
  max(page_title) AS title FROM evn WHERE event_name = 'page_view' GROUP BY ALL),
ci AS (SELECT day, landing_path AS path, count(*) AS entrances FROM sess GROUP BY ALL),
co AS (SELECT day, exit_path AS path, count(*) AS exits FROM sess GROUP BY ALL),
cc AS (SELECT day, page_path AS path, count(*) AS conversions FROM evn WHERE is_conversion = 1 GROUP BY ALL),
ce AS (SELECT day, path, CAST(sum(least(top, 1800)) AS BIGINT) AS engaged_seconds, count(*) AS engaged_views FROM engv GROUP BY ALL),
dc AS (SELECT day, path, coalesce(post_id, 0) AS post_id, coalesce(post_type, '') AS post_type, coalesce(title, '') AS title, """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in CONTENT_COLS
) + """ FROM cv FULL JOIN ci USING (day, path) FULL JOIN co USING (day, path) FULL JOIN cc USING (day, path) FULL JOIN ce USING (day, path)),
"""
DE = EVENTS + """
de AS (SELECT day, event_name, max(category) AS category, max(module) AS module, count(*) AS events, count(DISTINCT session_id) AS sessions,
  coalesce(sum(value_base), 0) AS value, max(is_conversion) AS is_conversion FROM evn GROUP BY day, event_name),
"""
DS = EVENTS + """
sr AS (SELECT *, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS term FROM evn WHERE event_name = 'site_search'),
ds AS (SELECT day, term, count(*) AS searches, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE results = 0) AS zero_results,
  CAST(coalesce(sum(results), 0) AS BIGINT) AS results_total, count(results) AS results_counted, count(*) FILTER (WHERE source = 'results_page') AS source_results_page,
  count(*) FILTER (WHERE source = 'form') AS source_form, count(*) FILTER (WHERE source = 'live') AS source_live FROM sr GROUP BY day, term),
"""
HM = PAY + """
pts AS (SELECT received_at, page_path AS path, device_type AS device, k AS x, CAST(floor(value) AS INT) AS y FROM pay WHERE is_click),
hm AS (SELECT CAST(received_at AS DATE) AS day, path, device, x, y, count(*) AS clicks FROM pts GROUP BY ALL),
"""
REQ = EV1 + f"""
req AS (SELECT event_id AS request_id, received_at AS ts, '/p/' || k % 25 || '/' AS path,
  CASE WHEN event_name = 'page_not_found' THEN 404 ELSE 200 END AS status_code,
  CASE WHEN k % 2 = 1 THEN user_id % 4 ELSE 10 + k % 8 END AS agent FROM ev1),
crall AS (SELECT *, CASE agent WHEN 1 THEN 'Bingbot' WHEN 2 THEN 'GPTBot' ELSE 'Googlebot' END AS crawler,
  CASE agent WHEN 2 THEN 'ai' ELSE 'search' END AS crawler_type FROM req WHERE agent IN (0, 1, 2, 3)),
cr AS (SELECT * FROM crall WHERE agent <> 3),
cd AS (SELECT CAST(ts AS DATE) AS day, crawler, path, max(crawler_type) AS crawler_type, max((ts, request_id, status_code))[3] AS status_code, count(*) AS hits,
  max(ts) AS last_seen_at FROM cr GROUP BY ALL),
"""
AD = EV1 + """
ad AS (SELECT CAST(received_at AS DATE) AS day, k % 5 AS ad_id, k % 5 % 2 AS campaign_id, count(*) FILTER (WHERE event_name = 'ad_impression') AS impressions,
  count(*) FILTER (WHERE event_name = 'ad_click') AS clicks FROM ev1 WHERE event_name IN ('ad_impression', 'ad_click') GROUP BY ALL),
"""
POSTS = """
posts AS (SELECT p_partkey AS post_id, p_brand AS author, DATE '2024-01-31' - CAST(p_size * 20 AS INT) AS published, p_size, p_type FROM part WHERE p_partkey % 6 <> 0),
terms AS (SELECT DISTINCT p_partkey AS post_id, split_part(p_type, ' ', 1) AS term FROM part WHERE p_size % 4 <> 0
  UNION SELECT p_partkey, 'size ' || p_size % 4 FROM part WHERE p_partkey % 2 = 0),
"""


def r(part: str, whole: str, places: int, empty: str = "0.0") -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(round(CAST({part} AS DECIMAL(20,4)) / CAST({whole} AS DECIMAL(20,0)), {places}) AS DOUBLE) ELSE {empty} END"


def days(a: str, b: str) -> str:
    return f"day BETWEEN DATE '{a}' AND DATE '{b}'"


RANGE = days(FROM, TO)
LOCAL = f"occurred_at >= TIMESTAMP '{FROM}' - INTERVAL 3 HOUR AND occurred_at < TIMESTAMP '{TO}' + INTERVAL 21 HOUR"
EVENT_RANGE = LOCAL

# ---- scans and sinks ----------------------------------------------------------------------------

RAW = EV2 + f"""
raw0 AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'Newsletter' WHEN k % 11 = 0 THEN 'google' END AS src,
  CASE WHEN k % 7 = 0 THEN 'email' WHEN k % 11 = 0 THEN 'cpc' END AS med,
  CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'c' || k % 3 END AS camp,
  CASE WHEN k % 13 = 0 THEN 'id' || k END AS gcl, CASE WHEN k % 17 = 0 THEN CAST(k AS VARCHAR) END AS pid,
  CASE WHEN k % 19 = 0 THEN 'other.example' WHEN k % 2 = 0 THEN 'www.Site.example' ELSE 'site.example' END AS host,
  CASE WHEN k % 10 = 9 THEN '//admin//jane.doe%40mail.example/' || k ELSE '/p/' || k % 25 || '/' END AS rawpath,
  CASE WHEN k % 10 = 9 THEN '/admin/[email]/' || k ELSE '/p/' || k % 25 || '/' END AS path FROM ev2),
raw AS (SELECT *, concat_ws('&', 'utm_source=' || src, 'UTM_Medium=' || med, 'utm_campaign=' || camp, 'gclid=' || gcl, 'page_id=' || pid) AS qs,
  path || CASE WHEN pid IS NOT NULL THEN '?page_id=' || pid ELSE '' END AS page_path,
  'https://' || host || rawpath AS base FROM raw0),
"""
add("A1_read_hits", RAW, """
SELECT outcome, count(*) AS lines, count(DISTINCT u) AS urls, CAST(sum(n) AS BIGINT) AS events FROM (
  SELECT CASE payload_id % 50 WHEN 0 THEN 'malformed' WHEN 2 THEN 'malformed' WHEN 4 THEN 'too_large' WHEN 6 THEN 'malformed' ELSE 'hit' END AS outcome,
    CASE WHEN payload_id % 50 IN (0, 2, 4, 6, 8) THEN '' ELSE base || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END END AS u,
    CASE WHEN payload_id % 50 IN (0, 2, 4, 6, 8) THEN 0 ELSE 1 END AS n FROM raw) GROUP BY outcome""")
add("A2_scan_events", EVENTS, f"""
SELECT event_name, count(*) AS events, CAST(min(occurred_at) AS VARCHAR) AS "first", CAST(max(occurred_at) AS VARCHAR) AS "last" FROM evn WHERE {LOCAL} GROUP BY event_name""")
add("A3_scan_sessions", SESS, f"""
SELECT channel, count(*) AS sessions, CAST(min(started_at) AS VARCHAR) AS "first", CAST(max(started_at) AS VARCHAR) AS "last" FROM sess WHERE {RANGE} GROUP BY channel""")
add("A4_scan_daily", DE, f"SELECT CAST(day AS VARCHAR) AS day, event_name, events, sessions FROM de WHERE {RANGE}")
add("A10_write_days", DT, "SELECT CAST(day AS VARCHAR) AS day, sessions, events, CAST(revenue AS DOUBLE) AS revenue FROM dt")
add("A11_append_events", EVENTS, "SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS event_date, count(*) AS events, count(DISTINCT eid) AS ids FROM evn GROUP BY 1")
add("A12_upsert_counters", REQ, """
SELECT CAST(day AS VARCHAR) AS day, crawler, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS paths, CAST(max(last_seen_at) AS VARCHAR) AS last_seen FROM cd GROUP BY day, crawler""")
G13 = f"""SELECT event_name AS event, max(category) AS category, max(module) AS module, CAST(sum(events) AS BIGINT) AS events, CAST(sum(sessions) AS BIGINT) AS sessions,
  CAST(round(sum(value), 2) AS DOUBLE) AS value, CAST(max(is_conversion) AS BIGINT) AS is_conversion FROM de WHERE {RANGE} GROUP BY event_name"""
add("A13_export_csv", DE, f"SELECT * EXCLUDE (module) FROM ({G13})")
add("A14_csv_safe", "", r"""
SELECT doc_id, md5(CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') THEN '''' || cell ELSE cell END) AS cell_md5, CAST(n_chars > 500 AS BIGINT) AS long
FROM (SELECT *, (['=', '+', '-', '@', chr(9), chr(13), '', 'a'])[CAST(doc_id % 8 AS INT) + 1] || text AS cell FROM documents)""")

# ---- admission ----------------------------------------------------------------------------------

# A visitor here is an address block, agent and day, or a user in enhanced mode (no opt-out signal).
ADMIT = RAW + """
adm0 AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN user_id % 256 || '/' || k % 8 || '/' || CAST(CAST(received_at AS DATE) AS VARCHAR) ELSE 'u' || user_id END AS visitor,
  CASE WHEN k % 23 = 0 THEN 0 ELSE 1 END AS n_events, CASE WHEN event_name = 'page_engagement' THEN 0 ELSE least(300, CAST(floor(value) AS BIGINT)) END AS hb,
  CASE WHEN is_click AND floor(value) <= 999 THEN 1 ELSE 0 END AS heat,
  CASE WHEN k = 60 THEN 'dnt' WHEN user_id % 256 = 3 OR (user_id % 256 = 12 AND k = 9) THEN 'excluded_ip' WHEN k = 50 OR k % 8 = 7 THEN 'bot'
    WHEN k % 19 = 0 THEN 'foreign_host' WHEN k % 10 = 9 THEN 'excluded_path' END AS early FROM raw),
adm1 AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY visitor, date_trunc('minute', received_at), early IS NULL ORDER BY received_at, payload_id) END AS rk FROM adm0),
adm AS (SELECT *, coalesce(early, CASE WHEN rk > 120 THEN 'rate_limited' WHEN n_events = 0 AND hb = 0 AND heat = 0 THEN 'empty' END) AS reason FROM adm1),
"""
add("B1_admit", ADMIT, "SELECT payload_id, coalesce(reason, '') AS reason FROM adm")

# Sessions of admitted payloads: rows without events extend a session but never open one.
COLLECT = ADMIT + """
a0 AS (SELECT *, visitor AS vk, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS id_mode,
  lower(coalesce(src, '') || '|' || coalesce(med, '') || '|' || coalesce(camp, '')) AS triple, CASE WHEN gcl IS NOT NULL THEN 'gclid' ELSE '' END AS click,
  CAST(event_name = 'page_view' AND n_events = 1 AS INT) AS pvs, CAST(event_name IN ('form_submit', 'purchase') AND n_events = 1 AS INT) AS conv
  FROM adm WHERE reason IS NULL AND (n_events > 0 OR hb > 0)),
a1 AS (SELECT *, CASE WHEN lag(received_at) OVER w IS NULL OR date_diff('second', lag(received_at) OVER w, received_at) > 14400 THEN 1 ELSE 0 END AS gap
  FROM a0 WINDOW w AS (PARTITION BY vk ORDER BY received_at, payload_id)),
a2 AS (SELECT *, sum(gap) OVER (PARTITION BY vk ORDER BY received_at, payload_id) AS run FROM a1),
a3 AS (SELECT *, sum(n_events) OVER (PARTITION BY vk, run ORDER BY received_at, payload_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM a2),
a4 AS (SELECT *, n_events = 1 AND opened = 1 AS is_base FROM a3),
b1 AS (SELECT *, CASE WHEN is_base OR triple IS DISTINCT FROM lag(triple) OVER w THEN 1 ELSE 0 END AS fresh FROM a4
  WHERE is_base OR (pvs = 1 AND (triple <> '||' OR click <> '')) WINDOW w AS (PARTITION BY vk ORDER BY received_at, payload_id)),
b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY vk ORDER BY received_at, payload_id) AS sub FROM b1),
b3 AS (SELECT *, last_value(nullif(click, '') IGNORE NULLS) OVER (PARTITION BY vk, sub ORDER BY received_at, payload_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b2),
b4 AS (SELECT payload_id AS start_id FROM b3 WHERE fresh = 1 OR (click <> '' AND click IS DISTINCT FROM held)),
col AS (SELECT a.*, CASE WHEN opened > 0 THEN last_value(start_id IGNORE NULLS) OVER (PARTITION BY vk ORDER BY received_at, payload_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS session_id
  FROM a4 a LEFT JOIN b4 s ON a.payload_id = s.start_id),
"""
add("B2_admission_report", COLLECT, """
SELECT coalesce(a.reason, CASE WHEN c.payload_id IS NOT NULL AND c.session_id IS NULL THEN 'no_session' END, 'stored') AS reason, count(*) AS hits
FROM adm a LEFT JOIN col c USING (payload_id) GROUP BY 1""")
REQ_AGENTS = f"""
reqa AS (SELECT *, CASE WHEN agent = 0 THEN {text(AGENTS[7])} WHEN agent = 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)'
  WHEN agent = 2 THEN 'Mozilla/5.0 AppleWebKit/537.36; compatible; GPTBot/1.2; +https://openai.com/gptbot' WHEN agent = 3 THEN 'SiteAudit/1.0 Googlebot'
  ELSE {case("agent - 10", AGENTS)} END AS user_agent FROM req),
"""
add("B3_is_bot", REQ + REQ_AGENTS, "SELECT user_agent, CAST(agent IN (0, 1, 2, 3, 17) AS BIGINT) AS bot, count(*) AS requests FROM reqa GROUP BY 1, 2")
add("B4_crawler", REQ, "SELECT crawler, crawler_type, count(*) AS requests FROM crall GROUP BY 1, 2")
add("B5_exclude_ips", PAY, """
SELECT payload_id, ip FROM pay WHERE NOT (user_id % 256 = 3 OR user_id % 256 BETWEEN 16 AND 31 OR ip = '41.90.12.9')""")
add("B5_exclude_table", PAY + """
bl AS (SELECT DISTINCT ((41 * 256 + 90) * 256 + s_suppkey * 37 % 256) * 256 + s_suppkey * 11 % 256 AS net, 7 - s_suppkey % 8 AS host FROM supplier),
ad AS (SELECT DISTINCT ip, ((TRY_CAST(split_part(ip, '.', 1) AS BIGINT) * 256 + TRY_CAST(split_part(ip, '.', 2) AS BIGINT)) * 256
  + TRY_CAST(split_part(ip, '.', 3) AS BIGINT)) * 256 + TRY_CAST(split_part(ip, '.', 4) AS BIGINT) AS num FROM pay),
hit AS (SELECT DISTINCT ip FROM ad JOIN bl ON num >> CAST(host AS BIGINT) = net >> CAST(host AS BIGINT))
""", "SELECT payload_id, ip FROM pay WHERE ip IS NULL OR ip NOT IN (SELECT ip FROM hit)")
URL = r"regexp_extract({0}, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {1})"


def part(u: str, i: int) -> str:
    return URL.format(u, i)


PG = f"pg AS (SELECT *, {part('url', 1)} AS scheme, lower({part('url', 2)}) AS host, {part('url', 3)} AS path, {part('url', 4)} AS q FROM pages),"
add("B6_own_hosts", PG, """
SELECT page_id, host FROM pg WHERE regexp_replace(host, '^www\\.', '') IN ('ththre.example.com', 'therha.example.com', 'therin.example.net', 'm.therou.example.com')""")
add("B7_exclude_paths", PG, r"SELECT page_id, path AS page_path FROM pg WHERE NOT regexp_full_match(lower(path), '/fr/.*|/en/.*\.html|/de/1.*/')")
add("B8_rate_limit", PAY, """
SELECT payload_id, visitor_key FROM (SELECT *, row_number() OVER (PARTITION BY visitor_key, payload_id // 6000 ORDER BY payload_id) AS rn FROM pay) WHERE rn = 1""")
add("B9_cap_batch", "", """
SELECT doc_id AS payload_id, CAST(len(string_split(text, ' ')[1:25]) AS BIGINT) AS kept, md5(array_to_string(string_split(text, ' ')[1:25], ' ')) AS names_md5 FROM documents""")
add("B10_cap_session", PAY, """
SELECT session_id, payload_id FROM (SELECT user_id + 1 AS session_id, payload_id, row_number() OVER (PARTITION BY user_id ORDER BY received_at, payload_id) AS rn FROM pay) WHERE rn <= 20""")
add("B11_valid_events", RAW, "SELECT event_name, count(*) AS events FROM raw WHERE k % 23 <> 0 GROUP BY 1")
add("B12_clean_attributes", EV0, """
SELECT event_id, '{"label":"v' || k || '","count":' || k || ',"flag":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END ||
  ',"list":["a","b' || k || '"],"tagged":"bold","long":"' || substr(repeat('ab ', 80) || k, 1, 200) || '"}' AS attributes FROM ev0""")
add("B13_exclude_roles", EV0, "SELECT event_id, user_id FROM ev0 WHERE user_id % 5 > 1")
add("B15_having_zero", DS, "SELECT CAST(day AS VARCHAR) AS day, term, zero_results FROM ds GROUP BY ALL HAVING zero_results > 0")

# ---- enrichment ---------------------------------------------------------------------------------

add("C1_parse_url", PG, """
SELECT page_id, host, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN regexp_matches(q, '(^|&)page_id=[A-Za-z0-9_-]+') THEN '?' ELSE '' END AS page_path,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') AS query FROM pg""")
add("C2_clean_path", RAW, "SELECT payload_id, path FROM raw")
add("C3_identity_query", RAW, "SELECT payload_id, coalesce('page_id=' || pid, '') AS identity FROM raw")
add("C4_campaign", RAW, "SELECT payload_id, coalesce(src, '') AS utm_source, coalesce(med, '') AS utm_medium, coalesce(camp, '') AS utm_campaign, '' AS utm_term, '' AS utm_content FROM raw")
add("C5_click_id", RAW, "SELECT payload_id, CASE WHEN gcl IS NULL THEN '' ELSE 'gclid' END AS click_id_type, coalesce(gcl, '') AS click_id FROM raw")
add("C6_referrer", RAW, f"""
SELECT payload_id, {case("k % 5", ["", "google.com", "m.facebook.com", "chatgpt.com", ""])} AS domain,
  {case("k % 5", ["", "https://www.google.com/search", "https://m.facebook.com/", "https://chatgpt.com/", ""])} AS url FROM raw""")
add("C7_channel", PAY, f"SELECT payload_id, {channel_sql('referrer_domain', 'utm_medium', 'utm_source', 'click_id_type')} AS channel FROM pay")
add("C8_domain_matches", PG, """
SELECT page_id, CAST(host = 'example.com' OR ends_with(host, '.example.com') AS BIGINT) AS exact,
  CAST(starts_with(host, 'example.') OR contains(host, '.example.') AS BIGINT) AS any_tld,
  CAST(starts_with(host, 'blog.') OR contains(host, '.blog.') AS BIGINT) AS prefix FROM pg""")
add("C9_user_agent", PAY, "SELECT user_agent, browser, browser_version, os, os_version, device_type, count(*) AS hits FROM pay GROUP BY ALL")
add("C10_viewport_bucket", PAY, f"SELECT CAST(vw AS BIGINT) AS vw, {VIEWPORT} AS viewport, count(*) AS hits FROM pay GROUP BY ALL")
add("C11_language_timezone", RAW, f"""
SELECT payload_id, {case("k % 3", ["en-GB", "de", ""])} AS language, CASE WHEN k % 2 = 0 THEN 'Africa/Nairobi' ELSE '' END AS timezone FROM raw""")
EMAIL = r"[A-Z0-9._%+\-]+(?:@|%40)[A-Z0-9.\-]+\.[A-Z]{2,}"
PHONE = r"\+?\d(?:[\s().\-]*\d){8,}"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
# Tokens by maximal runs of word characters, as the SQL's patterns cannot look around.
SCRUBBED = f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(c, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x:
  CASE WHEN length(x) >= 24 AND regexp_matches(x, '^[A-Za-z0-9_]') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') THEN '[token]' ELSE x END), '') AS c
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '[email]', 'gi'),
  '{PHONE}', '[phone]', 'g'), '{UUID}', '[token]', 'gi') AS c FROM documents)"""
add("C12_scrub_pii", "", f"""
SELECT doc_id, md5(c) AS text_md5, length(c) AS chars FROM ({SCRUBBED})""")
add("C12_scrub_table", "", f"SELECT doc_id, md5(c) AS text_md5 FROM ({SCRUBBED})")
add("C13_pii_incidence", "", f"""
SELECT kind, count(*) AS rows FROM (
  SELECT 'email' AS kind FROM documents WHERE regexp_matches(text, '(?i){EMAIL}')
  UNION ALL SELECT 'phone' FROM documents WHERE regexp_matches(text, '{PHONE}')
  UNION ALL SELECT 'any' FROM documents WHERE regexp_matches(text, '(?i){EMAIL}') OR regexp_matches(text, '{PHONE}')) GROUP BY kind""")


def xored(key: str, byte: int) -> str:
    return "||".join(f"chr({b ^ byte})" for b in key.encode().ljust(64, b"\0"))


HEX = "0123456789abcdef"


def day_pad(byte: int) -> str:
    return f"translate(salt, '{HEX}', " + "||".join(f"chr({ord(c) ^ byte})" for c in HEX) + ")"


def keyed(inner: str, outer: str, message: str) -> str:
    return f"sha256(encode({outer}) || unhex(sha256(encode(({inner}) || ({message})))))"


VISITOR_MSG = "'41.90.' || user_id % 256 || '.0|' || user_agent || '|https://site.example'"
add("C14_visitor_key", UA + RAW, f"""
SELECT payload_id, substr(CASE WHEN user_id % 5 = 0 THEN {keyed(day_pad(0x36), day_pad(0x5C), VISITOR_MSG)}
  ELSE {keyed(xored("site-salt", 0x36), xored("site-salt", 0x5C), "'vid|' || md5(CAST(user_id AS VARCHAR))")} END, 1, 32) AS visitor_key
FROM (SELECT *, sha256(CAST(CAST(received_at AS DATE) AS VARCHAR)) AS salt FROM raw JOIN ua ON k % 8 = ua_i)""")
add("C15_truncate_ip", PAY, "SELECT '41.90.' || user_id % 256 || '.0' AS net, count(*) AS hits FROM pay GROUP BY 1")
add("C16_client_ip", PAY, "SELECT payload_id, CASE WHEN k % 3 = 0 THEN ip WHEN k % 5 = 0 THEN '' ELSE '10.9.8.7' END AS ip FROM pay")
add("C17_identity_mode", RAW, "SELECT CAST(user_id % 5 = 0 AS BIGINT) AS gpc, CAST(user_id % 5 <> 0 AS BIGINT) AS id_mode, count(*) AS hits FROM raw GROUP BY 1, 2")
NORM = f"""CASE WHEN event_name <> 'purchase' THEN '' WHEN k % 3 = 1 THEN 'EUR' ELSE 'USD' END"""
add("C18_normalise_events", RAW + REG, f"""
SELECT payload_id, event_name, category, module, CAST(is_conversion AS BIGINT) AS is_conversion, 'thing' AS entity_type, CAST(k AS VARCHAR) AS entity_id,
  CASE WHEN event_name = 'purchase' THEN round(value, 4) END AS event_value, '' AS lead_ref, {NORM} AS currency FROM raw JOIN reg USING (event_name) WHERE k % 23 <> 0""")
add("C19_event_registry", PAY + REG, "SELECT event_name, count(*) AS events, category, module, CAST(is_conversion AS BIGINT) AS conversion FROM pay LEFT JOIN reg USING (event_name) GROUP BY ALL")
add("C20_event_time", RAW, "SELECT payload_id, CAST(received_at - to_seconds(least(600, k * 20)) AS VARCHAR) AS occurred_at FROM raw")
add("C21_heartbeat", EV0, "SELECT event_id, CAST(greatest(0, least(300, floor(value * 2 - 100))) AS BIGINT) AS heartbeat FROM ev0")
add("C22_page_context", RAW, f"""
SELECT payload_id, CASE WHEN k % 25 > 0 THEN CAST(k % 25 AS BIGINT) END AS p, {case("k % 3", ["post", "page", "tour"])} AS t, 'singular' AS k,
  CAST(k % 4 = 0 AS BIGINT) AS li, CAST(NULL AS VARCHAR) AS pd FROM raw""")
add("C23_heat_points", UA + RAW, """
SELECT device_type AS device, CAST(k AS BIGINT) AS x, CAST(floor(value) AS BIGINT) AS y, count(*) AS points FROM raw JOIN ua ON k % 8 = ua_i WHERE is_click AND floor(value) <= 999 GROUP BY ALL""")
ORACLES["C24_normalize_term"] = r"""
SELECT doc_id, substr(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)>', '', 'g'),
  '<[^>]*>', '', 'g'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))), 1, 191) AS term FROM documents"""
add("C25_explode_dimensions", DD, "SELECT dimension, v AS value, count(*) AS sessions FROM dl WHERE v IS NOT NULL GROUP BY 1, 2")
AGE = "CASE WHEN age < 30 THEN 'a1' WHEN age < 180 THEN 'a2' WHEN age < 360 THEN 'a3' WHEN age < 720 THEN 'a4' ELSE 'a5' END"
add("C26_age_bucket", POSTS, f"SELECT {AGE} AS bucket, count(*) AS posts FROM (SELECT DATE '2024-02-01' - published AS age FROM posts) GROUP BY 1")

SELF_PATH = "CASE WHEN path = '' OR path = '/' THEN '/' WHEN contains(regexp_extract(path, '([^/]*)/*$', 1), '.') THEN path ELSE rtrim(path, '/') || '/' END"
SELF = f"scheme || '://' || host || {SELF_PATH} || CASE WHEN q <> '' THEN '?' || q ELSE '' END"
PGS = PG + f"pgs AS (SELECT *, {SELF} AS self_url, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS folder FROM pg),"


def up(folder: str) -> str:
    return f"CASE WHEN {folder} = '/' THEN '' ELSE regexp_replace(regexp_replace({folder}, '/$', ''), '[^/]*$', '') END"


add("C27_normalize_url", PGS, f"""
SELECT page_id, self_url, CASE page_id % 6
  WHEN 0 THEN scheme || '://' || host || {up('folder')} || 'x/y/?q=1'
  WHEN 1 THEN scheme || '://other.example/b/'
  WHEN 2 THEN scheme || '://' || host || folder || '?page=3'
  WHEN 3 THEN scheme || '://' || host || folder || 'a.html'
  WHEN 4 THEN scheme || '://' || host || '/'
  ELSE 'https://up.example:8080/p/' END AS target FROM pgs""")
add("C28_path_key", PG, "SELECT page_id, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE lower(rtrim(path, '/')) END AS path_key FROM pg")
add("C29_form_id", "", "SELECT p_partkey, substr('nf:' || CASE WHEN c = '' THEN '0' ELSE c END, 1, 64) AS form_id FROM (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '', 'g') AS c FROM part)")
RATES = ", ".join(
    f"{r(p, 'sessions', 4)} AS {n}"
    for n, p in [
        ("engagement_rate", "engaged_sessions"), ("bounce_rate", "bounces"), ("pages_per_session", "pageviews"),
        ("avg_engaged_time", "engaged_seconds"), ("avg_duration", "duration_seconds"), ("conversion_rate", "conversions"),
    ]
)
add("C30_derived_rates", DT, f"SELECT CAST(day AS VARCHAR) AS day, {RATES} FROM dt")
CELLS = HM + "cells AS (SELECT x, y, CAST(sum(clicks) AS BIGINT) AS clicks FROM hm WHERE path = '/p/5/' {0} GROUP BY x, y),"
add("C31_heat_intensity", CELLS.format(""), "SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, clicks, round(least(1.0, 0.2 + 0.8 * sqrt(clicks / (SELECT max(clicks) FROM cells))), 6) AS intensity FROM cells")
add("C32_classify_links", "", """
SELECT page_id, CASE WHEN page_id % 11 < 5 THEN 'contact' WHEN page_id % 11 = 5 THEN 'download' WHEN page_id % 11 = 9 THEN 'outbound' ELSE '' END AS link_class,
  CASE page_id % 11 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'whatsapp' WHEN 3 THEN 'messenger' WHEN 4 THEN 'telegram' ELSE '' END AS contact_method FROM pages""")
add("C33_path_of", PG, "SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS path FROM pg")

# ---- joins --------------------------------------------------------------------------------------

add("D1_session_revenue", REV, "SELECT session_id, CAST(coalesce(rev, 0) AS DOUBLE) AS revenue FROM sess LEFT JOIN rev USING (session_id)")


def feed(now: str) -> str:
    return f"""SELECT e.eid AS event_id, e.event_name AS event, e.page_path AS path, greatest(0, date_diff('second', e.occurred_at, {now})) AS seconds,
  coalesce(s.country, '') AS country, coalesce(s.device_type, '') AS device FROM evn e LEFT JOIN sess s USING (session_id)
  WHERE e.occurred_at >= {now} - INTERVAL 30 MINUTE AND e.event_name NOT IN ('page_engagement', 'click') ORDER BY e.eid DESC LIMIT 12"""


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST(round(CAST({a} AS DECIMAL(20,0)) * 100 / CAST({b} AS DECIMAL(20,0)), 2) AS DOUBLE) ELSE 0.0 END"


def ad_channels(cond: str, limit: int) -> str:
    return f"""SELECT *, {pct('clicks', 'impressions')} AS ctr FROM (SELECT s.channel, count(*) FILTER (WHERE e.event_name = 'ad_impression') AS impressions,
  count(*) FILTER (WHERE e.event_name = 'ad_click') AS clicks, count(DISTINCT CASE WHEN e.event_name = 'ad_click' THEN e.session_id END) AS sessions
  FROM evn e JOIN sess s USING (session_id) WHERE e.event_name IN ('ad_impression', 'ad_click') AND {cond} GROUP BY s.channel)
  ORDER BY clicks DESC, impressions DESC, channel LIMIT {limit}"""


add("D2_live_feed", EVENTS, feed(NOW))
add("D3_ad_channels", EVENTS, ad_channels("e." + RANGE, 20))
add("D4_converting_sessions", EVENTS, f"""
SELECT session_id, conversions FROM sess WHERE conversions > 0 AND session_id IN (SELECT session_id FROM evn WHERE event_name = 'ad_click' AND {LOCAL} AND session_id > 0)""")
add("D5_to_base", PAY + FX, f"""
SELECT payload_id, currency, CAST(event_value AS DOUBLE) AS event_value, CAST({to_base("event_value", "currency", "received_at")} AS DOUBLE) AS event_value_base
FROM pay WHERE k % 8 <> 7 AND event_value IS NOT NULL""")
add("D6_link_server_events", SESS, """
SELECT event_id, coalesce(session_id, 0) AS session_id, visitor_key FROM events e LEFT JOIN sess s ON s.session_id = e.event_id * 2 + 2 AND s.visitor_key = md5(CAST(e.user_id AS VARCHAR))
WHERE event_type = 'purchase'""")
GEO_C = case("t % 6", ["KE", "GB", "DE", "US", "ZA", "FR"])
add("D7_geo_lookup", PAY, f"""
SELECT payload_id, CASE WHEN t % 7 <> 0 THEN {GEO_C} WHEN user_id % 3 = 0 THEN 'KE' ELSE '' END AS country,
  CASE WHEN t % 7 <> 0 THEN 'Region ' || t % 4 ELSE '' END AS region, CASE WHEN t % 7 <> 0 THEN 'City ' || t % 9 ELSE '' END AS city
FROM (SELECT payload_id, user_id, user_id % 256 AS t FROM pay)""")
add("D8_flag_returning", SESS, "SELECT session_id, CAST(is_returning AS BIGINT) AS is_returning FROM sess")
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in CONTENT_COLS)
CRATES = f"pageviews, visitors, entrances, exits, conversions, {r('engaged_seconds', 'engaged_views', 1)} AS avg_engaged_time, {r('exits', 'pageviews', 4)} AS exit_rate"
BYPOST = DC + POSTS + f"bp AS (SELECT post_id, {SUMS} FROM dc WHERE {RANGE} AND post_id > 0 GROUP BY post_id),"


def content(key: str, joins: str, limit: int = 10) -> str:
    return f"""SELECT key, key AS label, {CRATES} FROM (SELECT {key} AS key, {SUMS} FROM bp LEFT JOIN posts p USING (post_id) {joins} GROUP BY 1)
  ORDER BY pageviews DESC, key LIMIT {limit}"""


add("D9_content_terms", BYPOST, content("CASE WHEN p.published IS NULL THEN 'deleted' ELSE coalesce(t.term, '(none)') END", "LEFT JOIN terms t USING (post_id)"))
MONEY = {"revenue"}


def tcols(prefix: str = "") -> str:
    return ", ".join(
        f"CAST(round(coalesce({prefix}{c}, 0), 2) AS DOUBLE) AS {c}" if c in MONEY else f"coalesce({prefix}{c}, 0) AS {c}" for c in TRAFFIC_COLS
    )


def cal(a: str, b: str) -> str:
    return f"(SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY) g(d))"


def series(a: str, b: str) -> str:
    return f"SELECT CAST(c.day AS VARCHAR) AS day, {tcols('t.')} FROM {cal(a, b)} c LEFT JOIN dt t ON c.day = t.day"


add("D10_zero_fill", DT, series("2023-12-25", "2024-02-10"))
add("D11_path_merge", DC, "SELECT path, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("pageviews", "entrances", "exits", "conversions", "engaged_seconds")) + " FROM dc GROUP BY path")

# ---- audit --------------------------------------------------------------------------------------

def unescape(x: str) -> str:
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


BODY = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)>', '', 'g')"
AUD = PGS + rf"""
ap0 AS (SELECT *, CASE WHEN page_id % 29 = 0 THEN 404 WHEN page_id % 31 = 0 THEN 301 WHEN page_id % 37 = 0 THEN 0 WHEN page_id % 41 = 0 THEN 503 ELSE 200 END AS status_code,
  CAST(page_id * 37 % 2500 AS INT) AS response_ms, CASE WHEN page_id = 1 THEN 'home' WHEN page_id % 3 = 0 THEN 'archive' ELSE 'content' END AS source,
  octet_length(encode(html)) AS html_bytes, {BODY} AS clean FROM pgs),
ap1 AS (SELECT *, status_code = 200 AS live, trim(regexp_replace({unescape(r"regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title0,
  trim(regexp_replace({unescape(r"regexp_replace(regexp_extract(clean, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS h10,
  {unescape(r"regexp_replace(regexp_replace(clean, '(?is)^.*?<body[^>]*>', ''), '<[^>]*>', ' ', 'g')")} AS body,
  list_distinct(list_transform(regexp_extract_all(clean, '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda x: {unescape('x')})) AS hrefs0,
  list_transform(regexp_extract_all(clean, '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda x: {unescape('x')}) AS hrefs1 FROM ap0),
ap AS (SELECT *, CASE WHEN live THEN title0 ELSE '' END AS title, CASE WHEN live THEN h10 ELSE '' END AS h1,
  CASE WHEN live THEN len(regexp_extract_all(html, '(?i)<h1[\s>]')) ELSE 0 END AS h1_count, CASE WHEN live THEN len(regexp_extract_all(html, '(?i)<h2[\s>]')) ELSE 0 END AS h2_count,
  CASE WHEN live THEN len(regexp_extract_all(body, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*')) ELSE 0 END AS words,
  CASE WHEN live THEN len(regexp_extract_all(html, '(?i)<img[\s>]')) ELSE 0 END AS images, CASE WHEN live THEN regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) ELSE '' END AS lang,
  CASE WHEN live THEN hrefs1 ELSE [] END AS hrefs FROM ap1),
lk0 AS (SELECT page_id, self_url AS src_url, host, scheme, folder, unnest(hrefs) AS href FROM ap),
lk1 AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*', '') WHEN starts_with(href, '/') THEN scheme || '://' || host || regexp_replace(href, '#.*', '')
  ELSE scheme || '://' || host || folder || regexp_replace(href, '#.*', '') END AS a FROM lk0 WHERE href <> '' AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '(?i)^(mailto|tel|sms|javascript|data|whatsapp|skype):')),
lk2 AS (SELECT page_id, src_url, lower({part('a', 2)}) AS dhost, host, {part('a', 1)} AS dscheme, {part('a', 3)} AS dpath, {part('a', 4)} AS dq FROM lk1),
lk3 AS (SELECT *, lower(dscheme) || '://' || dhost || {SELF_PATH.replace('path', 'dpath')} || CASE WHEN dq <> '' THEN '?' || dq ELSE '' END AS dst_url FROM lk2),
edges0 AS (SELECT DISTINCT page_id, src_url, dst_url FROM lk3 WHERE regexp_replace(dhost, '^www\.', '') = regexp_replace(host, '^www\.', '') AND dst_url <> src_url
  AND NOT regexp_matches(dpath, '/(wp-admin|wp-login\.php|wp-json|xmlrpc\.php|feed)(/|$)')
  AND NOT regexp_matches(dpath, '(?i)\.(jpg|jpeg|png|gif|webp|avif|svg|ico|pdf|zip|rar|7z|mp3|mp4|mov|webm|css|js|json|xml|txt|doc|docx|xls|xlsx|ppt|pptx|csv)$')),
ext AS (SELECT page_id, count(*) AS n FROM lk3 WHERE regexp_replace(dhost, '^www\.', '') <> regexp_replace(host, '^www\.', '') GROUP BY page_id),
inn AS (SELECT page_id, count(*) AS n FROM edges0 GROUP BY page_id),
edges AS (SELECT * FROM edges0 UNION ALL SELECT a.page_id, a.self_url, b.self_url FROM ap a JOIN ap b ON b.page_id = a.page_id + 1 WHERE a.page_id % 3 <> 1),
st AS (SELECT self_url AS url, max((page_id, status_code))[2] AS status_code FROM ap GROUP BY self_url),
wa AS (SELECT page_id, list_distinct(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]{{3,}}')) AS wt, list_distinct(regexp_extract_all(lower(h1), '[\p{{L}}\p{{N}}]{{3,}}')) AS wh FROM ap),
"""
PAGE_ISSUES = [
    ("fetch_failed", "status_code = 0", "'1'"), ("http_5xx", "status_code >= 500", "status_code"),
    ("http_4xx", "status_code BETWEEN 400 AND 499", "status_code"), ("redirect", "status_code BETWEEN 300 AND 399", "status_code"),
    ("slow_response", "live AND response_ms > 1500", "response_ms"), ("large_html", "live AND html_bytes > 1048576", "html_bytes"),
    ("title_missing", "live AND title = ''", "'1'"), ("title_too_long", "live AND length(title) > 60", "length(title)"),
    ("title_too_short", "live AND length(title) BETWEEN 1 AND 19", "length(title)"),
    ("meta_description_missing", "live AND NOT regexp_matches(html, '(?i)<meta[^>]*name=\"description\"')", "'1'"),
    ("h1_missing", "live AND h1_count = 0", "'1'"), ("multiple_h1", "live AND h1_count > 1", "h1_count"),
    ("title_h1_unrelated", "live AND title <> '' AND h1 <> '' AND NOT list_has_any(wt, wh)", "'1'"),
    ("low_word_count", "live AND source = 'content' AND words < 250", "words"),
    ("no_subheadings", "live AND words > 600 AND h2_count = 0", "words"),
    ("lang_missing", "live AND lang = ''", "'1'"),
    ("viewport_missing", "live AND NOT regexp_matches(html, '(?i)<meta[^>]*name=\"viewport\"')", "'1'"),
    ("noindex", "live AND regexp_matches(html, '(?i)<meta[^>]*noindex')", "'1'"),
    ("canonical_missing", "live AND NOT regexp_matches(html, '(?i)<link[^>]*rel=\"canonical\"')", "'1'"),
    ("open_graph_missing", "live AND NOT regexp_matches(html, '(?i)og:title')", "'1'"),
    ("no_structured_data", "live AND NOT regexp_matches(html, '(?i)application/ld.json|itemtype=')", "'1'"),
    ("mixed_content", "live AND starts_with(url, 'https://') AND regexp_matches(html, '(?i)<(img|script|iframe|source|video|audio)[^>]*src=\"http://')", "'1'"),
    ("no_internal_links", "live AND coalesce(inn.n, 0) = 0", "'1'"),
]
ISS = AUD + "pi AS (" + " UNION ALL ".join(
    f"SELECT page_id, {text(c)} AS code, CAST({x} AS VARCHAR) AS detail FROM ap JOIN wa USING (page_id) LEFT JOIN inn USING (page_id) WHERE {w}" for c, w, x in PAGE_ISSUES
) + "),"
CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({text(k)}, {text(v[0])}, {text(v[1])}, {text(v[2])})" for k, v in CATALOG.items()
) + ") t(code, severity, category, scope)),"


def visits(dc: str = "dc") -> str:
    return f"""
vis0 AS (SELECT day, post_id, CAST(sum(pageviews) AS BIGINT) AS pageviews FROM {dc} GROUP BY day, post_id),
vis AS (SELECT v.day, v.pageviews, lower(rtrim(CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END, '/')) AS pk FROM vis0 v JOIN pg ON pg.page_id % 40 = v.post_id),
rv AS (SELECT CASE WHEN pk = '' THEN '/' ELSE pk END AS pk, CAST(sum(pageviews) AS BIGINT) AS pageviews FROM vis WHERE day >= DATE '2024-01-30' - 27 GROUP BY 1),
pk AS (SELECT page_id, CASE WHEN x = '' THEN '/' ELSE x END AS pk FROM (SELECT page_id, lower(rtrim(CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END, '/')) AS x FROM pg)),
pvw AS (SELECT page_id, coalesce(pageviews, 0) AS pageviews FROM pk LEFT JOIN rv USING (pk)),
"""


add("D12_uncrawled_links", AUD, """
SELECT dst_url, count(*) AS links FROM edges WHERE dst_url NOT IN (SELECT self_url FROM ap) GROUP BY dst_url ORDER BY links DESC, dst_url LIMIT 300""")
add("D13_link_status", AUD, "SELECT CAST(st.status_code AS BIGINT) AS dst_status, count(*) AS links FROM edges LEFT JOIN st ON edges.dst_url = st.url GROUP BY 1")
VIS = DC + PG + visits()
add("D14_with_pageviews", VIS, "SELECT page_id, pageviews FROM pvw")
add("D15_unvisited", VIS, "SELECT page_id FROM pvw WHERE pageviews = 0 AND (SELECT min(day) FROM dc) <= DATE '2024-01-30' - 27")
add("D16_issue_catalog", ISS + CAT, "SELECT code, count(*) AS pages, severity, category, scope FROM pi JOIN cat USING (code) GROUP BY ALL")

# ---- sessions -----------------------------------------------------------------------------------

add("E1_sessionize", PAY + linked(30, False), "SELECT payload_id, session_id FROM linked")
add("E2_campaign_split", PAY + linked(240, True), "SELECT payload_id, session_id FROM linked")
add("E3_no_session", PAY + """
h0 AS (SELECT *, CAST(event_name = 'form_submit' AS INT) AS server, CAST(event_name NOT IN ('form_submit', 'page_not_found') AS INT) AS opener FROM pay WHERE k % 8 <> 7),
h1 AS (SELECT *, CASE WHEN lag(received_at) OVER w IS NULL OR date_diff('second', lag(received_at) OVER w, received_at) > 14400 THEN 1 ELSE 0 END AS gap FROM h0
  WINDOW w AS (PARTITION BY visitor_key ORDER BY received_at, payload_id)),
h2 AS (SELECT *, sum(gap) OVER (PARTITION BY visitor_key ORDER BY received_at, payload_id) AS run FROM h1),
h3 AS (SELECT *, first_value(CASE WHEN opener = 1 THEN payload_id END IGNORE NULLS) OVER (PARTITION BY visitor_key, run ORDER BY received_at, payload_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM h2)
""", "SELECT payload_id, coalesce(sid, CASE WHEN server = 1 THEN 0 END) AS session_id FROM h3")
add("E4_first_touch", SESS, "SELECT session_id, landing_path, landing_post_id, referrer_domain, channel, click_id_type, device_type, country, language, viewport FROM sess")
add("E5_session_counters", SESS, """
SELECT session_id, CAST(started_at AS VARCHAR) AS started_at, CAST(last_seen_at AS VARCHAR) AS last_seen_at, duration_seconds, pageviews, event_count, engaged_seconds, conversions, exit_path FROM sess""")
add("E6_engaged_flag", SESS, "SELECT CAST(is_engaged AS BIGINT) AS is_engaged, count(*) AS sessions FROM sess GROUP BY 1")
add("E7_returning", SESS, "SELECT CAST(is_returning AS BIGINT) AS is_returning, count(*) AS sessions FROM sess GROUP BY 1")
add("E8_engaged_time", EV0, """
SELECT session_id, pv, CAST(coalesce(sum(CASE WHEN pvis = 1 THEN least(gap, 60) ELSE 0 END), 0) AS BIGINT) AS engaged_seconds, count(*) AS ticks FROM (
  SELECT session_id, pv, (event_id - lag(event_id) OVER w) * 3 AS gap, lag(visible) OVER w AS pvis FROM (
    SELECT user_id % 7 AS session_id, 'v' || k % 5 AS pv, event_id, CAST(k % 4 <> 0 AS INT) AS visible FROM ev0) WINDOW w AS (PARTITION BY session_id, pv ORDER BY event_id)) GROUP BY 1, 2""")
add("E9_dedupe_searches", DS, """
SELECT eid AS event_id, eid % 9 AS session_id, CAST(post_id % 4 AS VARCHAR) AS pv, term, source FROM (SELECT *, row_number() OVER (
  PARTITION BY eid % 9, post_id % 4, CASE WHEN source IN ('form', 'live') THEN term ELSE '#' || eid END ORDER BY occurred_at, eid) AS rn FROM sr) WHERE rn = 1""")
add("E0_collect", COLLECT, f"""
SELECT session_id, max(id_mode) FILTER (WHERE o) AS id_mode, CAST(max(received_at) FILTER (WHERE o) AS VARCHAR) AS started_at,
  date_diff('second', max(received_at) FILTER (WHERE o), max(received_at)) AS duration_seconds, CAST(sum(hb) AS BIGINT) AS engaged_seconds, CAST(sum(pvs) AS BIGINT) AS pageviews,
  CAST(sum(n_events) AS BIGINT) AS event_count, CAST(sum(conv) AS BIGINT) AS conversions, max(page_path) FILTER (WHERE o) AS landing_path,
  coalesce((max((received_at, payload_id, page_path)) FILTER (WHERE pvs = 1))[3], max(page_path) FILTER (WHERE o)) AS exit_path,
  max(dom) FILTER (WHERE o) AS referrer_domain, max(ch) FILTER (WHERE o) AS channel, max(coalesce(src, '')) FILTER (WHERE o) AS utm_source, max(coalesce(camp, '')) FILTER (WHERE o) AS utm_campaign,
  max(click) FILTER (WHERE o) AS click_id_type, max(CASE WHEN id_mode = 1 THEN coalesce(gcl, '') ELSE '' END) FILTER (WHERE o) AS click_id, max(vp) FILTER (WHERE o) AS viewport,
  max(lang) FILTER (WHERE o) AS language, max(ctry) FILTER (WHERE o) AS country, CAST(max(CAST(k % 4 = 0 AS INT)) FILTER (WHERE o) AS BIGINT) AS is_logged_in
FROM (SELECT *, payload_id = session_id AS o, {channel_sql("dom", "coalesce(med, '')", "coalesce(src, '')", "click")} AS ch,
  CASE WHEN t % 7 <> 0 THEN {GEO_C} WHEN user_id % 3 = 0 THEN 'KE' ELSE '' END AS ctry
  FROM (SELECT *, {case("k % 5", ["", "google.com", "m.facebook.com", "chatgpt.com", ""])} AS dom, {case("k % 3", ["en-GB", "de", ""])} AS lang, user_id % 256 AS t,
    {VIEWPORT.replace('vw', '(300 + k * 13)')} AS vp FROM col WHERE session_id IS NOT NULL)) GROUP BY session_id""".replace("max(id_mode) FILTER (WHERE o) AS id_mode", "CAST(max(id_mode) FILTER (WHERE o) AS BIGINT) AS id_mode"))
add("E0_collect_events", COLLECT + FX + REG, f"""
SELECT payload_id, session_id, CAST(received_at - to_seconds(k) AS VARCHAR) AS occurred_at, event_name, category, module, 'thing' AS entity_type, CAST(k AS VARCHAR) AS entity_id,
  page_path, CASE WHEN event_name = 'page_view' THEN 'Page ' || k % 25 ELSE '' END AS page_title, CAST(ev AS DOUBLE) AS event_value, cur AS currency,
  CAST({to_base("ev", "cur", "received_at - to_seconds(k)")} AS DOUBLE) AS event_value_base, CAST(is_conversion AS BIGINT) AS is_conversion
FROM (SELECT *, CASE WHEN event_name = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END AS ev, {NORM} AS cur FROM col) c JOIN reg USING (event_name) WHERE session_id IS NOT NULL AND n_events = 1""")

# ---- streams ------------------------------------------------------------------------------------

add("J1_stream_hits", EV2, """
SELECT CASE WHEN payload_id % 10 < 2 THEN 'malformed' ELSE 'hit' END AS outcome, count(*) AS lines, count(*) FILTER (WHERE payload_id % 10 >= 2) AS events FROM ev2 GROUP BY 1""")
ORACLES["J2_live_sessions"] = ORACLES["E5_session_counters"]
ORACLES["J2_stream_returning"] = ORACLES["E7_returning"]
add("J3_stream_active", PAY, """
SELECT CAST(start AS VARCHAR) AS start, count(DISTINCT visitor_key) AS visitors FROM (
  SELECT date_trunc('minute', received_at) - to_minutes(CAST(unnest(range(0, 5)) AS BIGINT)) AS start, visitor_key FROM pay WHERE k % 8 <> 7) GROUP BY 1""")
ORACLES["J3_active_sketch"] = f"SELECT *, CAST(1 AS BIGINT) AS close FROM ({ORACLES['J3_stream_active']})"
add("J4_stream_per_minute", PAY, """
SELECT CAST(date_trunc('minute', received_at) AS VARCHAR) AS start, count(*) AS views FROM pay WHERE k % 8 <> 7 AND pvs = 1 GROUP BY 1""")
add("J5_stream_top", PAY, """
SELECT page_path, count(*) AS n FROM pay WHERE k % 8 <> 7 AND pvs = 1 AND CAST(received_at AS DATE) = (SELECT max(CAST(received_at AS DATE)) FROM pay WHERE k % 8 <> 7 AND pvs = 1)
GROUP BY 1 ORDER BY n DESC, page_path LIMIT 6""")
add("J7_stream_rate_limit", PAY, """
SELECT payload_id, visitor_key FROM (SELECT *, row_number() OVER (PARTITION BY visitor_key, payload_id // 6000 ORDER BY payload_id) AS rn FROM pay WHERE k % 8 <> 7) WHERE rn = 1""")
add("J9_stream_rollup", DT, "SELECT CAST(day AS VARCHAR) AS day, sessions, events, pageviews, CAST(revenue AS DOUBLE) AS revenue FROM dt")

# ---- rollups ------------------------------------------------------------------------------------

add("F1_traffic_sessions", DT, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day) FROM ts")
add("F2_daily_traffic", DT, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day, revenue), CAST(revenue AS DOUBLE) AS revenue FROM dt")
add("F3_daily_dimensions", DD, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day, revenue), md5(value) AS value_hash, CAST(revenue AS DOUBLE) AS revenue FROM dd")
add("F4_daily_content", DC, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day) FROM dc")
add("F5_page_engagement", EVENTS + ENG, "SELECT CAST(day AS VARCHAR) AS day, path, CAST(sum(least(top, 120)) AS BIGINT) AS engaged_seconds, count(*) AS engaged_views FROM engv GROUP BY ALL")
add("F6_daily_events", DE, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day, value, is_conversion), CAST(value AS DOUBLE) AS value, CAST(is_conversion AS BIGINT) AS is_conversion FROM de")
add("F7_daily_searches", DS, "SELECT CAST(day AS VARCHAR) AS day, * EXCLUDE (day) FROM ds")
add("F8_heatmap_daily", HM, "SELECT CAST(day AS VARCHAR) AS day, path, device, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, clicks FROM hm")
add("F9_crawler_daily", REQ, "SELECT CAST(day AS VARCHAR) AS day, crawler, path, crawler_type, CAST(status_code AS BIGINT) AS status_code, hits, CAST(last_seen_at AS VARCHAR) AS last_seen_at FROM cd")
ORACLES["J6_stream_counters"] = ORACLES["F9_crawler_daily"]
add("F10_days_to_rebuild", EVENTS, f"""
SELECT CAST(day AS VARCHAR) AS day, CASE min(p) WHEN 0 THEN 'current' WHEN 1 THEN 'catch_up' ELSE 'backfill' END AS reason FROM (
  SELECT unnest([DATE '2024-01-30', DATE '2024-01-29']) AS day, 0 AS p
  UNION ALL SELECT day, 1 FROM {cal('2024-01-25', '2024-01-28')}
  UNION ALL (SELECT day, 2 FROM {cal('2023-01-01', '2024-01-21')} WHERE day >= (SELECT min(day) FROM evn) AND NOT (day(day) % 4 = 0 AND day IN (SELECT day FROM evn)) ORDER BY day DESC LIMIT 14)) GROUP BY day""")
ALL3 = "day IN (DATE '2024-01-10', DATE '2024-01-11', DATE '2024-01-13')"
DALL = DD + ENG + DC[len(EVENTS) + len(ENG):] + DE[len(EVENTS):] + DS[len(EVENTS):] + DT[len(EVENTS):]
add("F11_rollup", DALL, " UNION ALL ".join(
    f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS rows, '{n}' AS \"table\" FROM {t} WHERE {ALL3} GROUP BY day"
    for n, t in [("daily_traffic", "dt"), ("daily_dimensions", "dd"), ("daily_content", "dc"), ("daily_events", "de"), ("daily_searches", "ds")]
))
add("F12_search_days", EVENTS, "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM evn WHERE event_name = 'site_search'), generate_series(a, b, INTERVAL 1 DAY) g(d)")
ADS = "CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks"
CTR = pct("impressions", "clicks").replace("impressions", "~").replace("clicks", "impressions").replace("~", "clicks")
add("F13_ad_totals", AD, f"SELECT *, {CTR} AS ctr FROM (SELECT {ADS} FROM ad WHERE {RANGE})")
add("F13_ad_by_day", AD, f"SELECT CAST(day AS VARCHAR) AS day, {ADS} FROM ad WHERE {RANGE} GROUP BY day")
add("F13_ads", AD, f"""
SELECT CAST(ad_id AS BIGINT) AS ad_id, 'Ad ' || ad_id AS name, CASE WHEN ad_id % 3 = 0 THEN 'paused' ELSE 'active' END AS status, 'Campaign ' || ad_id % 2 AS campaign, impressions, clicks, {CTR} AS ctr
FROM (SELECT ad_id, {ADS} FROM ad WHERE {RANGE} GROUP BY ad_id)""")
add("F13_campaigns", AD, f"SELECT CAST(campaign_id AS BIGINT) AS campaign_id, 'Campaign ' || campaign_id AS name, impressions, clicks, {CTR} AS ctr FROM (SELECT campaign_id, {ADS} FROM ad WHERE {RANGE} GROUP BY campaign_id)")

# ---- reports ------------------------------------------------------------------------------------

TSUM = ", ".join(
    f"CAST(round(coalesce(sum({c}), 0), 2) AS DOUBLE) AS {c}" if c in MONEY else f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TRAFFIC_COLS
)
add("G1_totals", DT, f"SELECT *, {RATES} FROM (SELECT {TSUM} FROM dt WHERE {RANGE})")
add("G2_series", DT, series("2023-12-20", "2024-01-15"))
CUR, PREV = ("2024-01-16", "2024-01-25"), ("2024-01-06", "2024-01-15")
PERIODS = " UNION ALL ".join(
    f"SELECT '{n}' AS period, '{a}' AS range_from, '{b}' AS range_to, {TSUM} FROM dt WHERE {days(a, b)}" for n, (a, b) in [("current", CUR), ("compare", PREV)]
)
add("G3_overview", DT, f"SELECT *, {RATES} FROM ({PERIODS})")
add("G3_overview_series", DT, " UNION ALL ".join(f"SELECT '{n}' AS period, day, sessions, revenue FROM ({series(a, b)})" for n, (a, b) in [("current", CUR), ("compare", PREV)]))
DERIV = {"engagement_rate": "engaged_sessions", "avg_engaged_time": "engaged_seconds", "bounce_rate": "bounces", "pages_per_session": "pageviews", "conversion_rate": "conversions"}
COMPARED = "visitors sessions pageviews engagement_rate avg_engaged_time bounce_rate pages_per_session conversions conversion_rate revenue new_visitors returning_visitors".split()
add("G4_comparison_delta", DT + f"o AS ({PERIODS}), m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, period, " + (f"CASE WHEN sessions > 0 THEN CAST({DERIV[c]} AS DOUBLE) / sessions ELSE 0 END" if c in DERIV else f"CAST({c} AS DOUBLE)") + " AS v FROM o" for c in COMPARED
) + "), w AS (SELECT metric, max(v) FILTER (WHERE period = 'current') AS now, max(v) FILTER (WHERE period = 'compare') AS before FROM m GROUP BY metric)", """
SELECT metric, round(now, 6) AS now, round(before, 6) AS before, round(c, 6) AS change, CAST(abs(c) < 0.005 AS BIGINT) AS is_flat,
  CAST(CASE WHEN metric = 'bounce_rate' THEN c < 0 ELSE c > 0 END AS BIGINT) AS is_good FROM (SELECT *, CASE WHEN before > 0 THEN (now - before) / before END AS c FROM w)""")
B3 = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("sessions", "pageviews", "conversions"))
add("G5_weekly", DT, f"SELECT CAST(min(day) AS VARCHAR) AS day, {B3} FROM ({series('2023-10-20', '2024-02-10')}) GROUP BY (CAST(day AS DATE) - DATE '2023-10-20') // 7")
add("G5_monthly", DT, f"SELECT CAST(min(day) AS VARCHAR) AS day, {B3} FROM ({series('2022-12-20', '2024-02-10')}) GROUP BY substr(day, 1, 7)")
DSUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("sessions", "visitors", "engaged_sessions", "pageviews", "engaged_seconds", "conversions")) + ", CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue"


def dim(name: str) -> str:
    return f"(SELECT value, {DSUM} FROM dd WHERE dimension = '{name}' AND {RANGE} GROUP BY value)"


add("G6_dimension", DD, f"""
SELECT value, sessions, visitors, engaged_sessions, pageviews, conversions, revenue, {r('engaged_sessions', 'sessions', 4)} AS engagement_rate,
  {r('conversions', 'sessions', 4)} AS conversion_rate, {r('engaged_seconds', 'sessions', 1)} AS avg_engaged_time FROM {dim('landing_page')} ORDER BY engaged_sessions DESC, value LIMIT 10""")
add("G6_dimension_total", DD, f"SELECT count(DISTINCT value) AS total FROM dd WHERE dimension = 'landing_page' AND {RANGE}")
add("G7_channel_share", DD, f"""
SELECT name, CAST(sum(sessions) AS BIGINT) AS sessions FROM (SELECT sessions, CASE WHEN rn <= 3 THEN value ELSE 'Other' END AS name FROM (
  SELECT *, row_number() OVER (ORDER BY sessions DESC, value) AS rn FROM {dim('channel')} WHERE value NOT IN ('paid_social', 'display', 'affiliate'))
  UNION ALL SELECT sessions, 'Other' FROM {dim('channel')} WHERE value IN ('paid_social', 'display', 'affiliate')) GROUP BY name""")
add("G8_device_share", DD, f"SELECT value AS device, sessions, round(sessions / sum(sessions) OVER (), 6) AS share FROM {dim('device')}")
BYPATH = f"(SELECT path, max(title) AS title, max(post_id) AS post_id, {SUMS} FROM dc WHERE {RANGE} GROUP BY path)"
PAGECOLS = f"path AS key, CASE WHEN title <> '' THEN title ELSE path END AS label, path, post_id, {CRATES}"
add("G9_content_page", DC, f"SELECT {PAGECOLS} FROM {BYPATH} ORDER BY pageviews DESC, path LIMIT 10")
add("G10_content_post_type", DC, f"""
SELECT post_type AS key, CASE WHEN post_type = '' THEN 'Archives & other pages' ELSE post_type END AS label, {CRATES}
FROM (SELECT post_type, {SUMS} FROM dc WHERE {RANGE} GROUP BY post_type) ORDER BY pageviews DESC, post_type LIMIT 10""")
add("G11_content_author", BYPOST, content("CASE WHEN p.published IS NULL THEN 'deleted' ELSE p.author END", ""))
add("G11_content_age", BYPOST, content("CASE WHEN p.published IS NULL THEN 'deleted' ELSE " + AGE.replace("age", "(DATE '2024-02-01' - p.published)") + " END", ""))
for _m, _n in [("entrances", "entry"), ("exits", "exit")]:
    add(f"G12_{_n}_pages", DC, f"SELECT {PAGECOLS} FROM {BYPATH} WHERE {_m} > 0")
add("G13_events", DE, G13)
add("G14_conversions", DE, f"SELECT * FROM ({G13}) WHERE is_conversion = 1")
INTER = {
    "forms_submitted": "form_submit", "forms_started": "form_start", "forms_abandoned": "form_abandon", "contact_taps": "contact_click",
    "downloads": "file_download", "outbound_clicks": "outbound_click", "video_plays": "video_start", "video_completes": "video_complete",
    "site_searches": "site_search", "rage_clicks": "rage_click", "dead_clicks": "dead_click", "not_found": "page_not_found",
}
add("G15_interaction_summary", DE, f"SELECT *, {r('forms_submitted', 'forms_started', 4)} AS form_completion, {r('video_completes', 'video_plays', 4)} AS video_completion FROM (SELECT " + ", ".join(
    f"CAST(coalesce(sum(events) FILTER (WHERE event_name = '{e}'), 0) AS BIGINT) AS {n}" for n, e in INTER.items()
) + f" FROM de WHERE {RANGE})")
SSUM = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("searches", "zero_results", "results_total", "results_counted", "source_results_page", "source_form", "source_live"))
SCOLS = f"{r('results_total', 'results_counted', 1, 'NULL')} AS avg_results, source_results_page AS results_page, source_form AS form, source_live AS live"
add("G16_search_totals", DS, f"SELECT searches, terms, zero_results, {r('zero_results', 'searches', 4)} AS zero_results_rate, {SCOLS} FROM (SELECT count(DISTINCT term) AS terms, {SSUM} FROM ds WHERE {RANGE})")
STERM = f"(SELECT term, {SSUM}, CAST(sum(sessions) AS BIGINT) AS sessions, max(day) AS last_day FROM ds WHERE {RANGE} GROUP BY term)"
SROW = f"SELECT term, searches, sessions, zero_results, {SCOLS}, CAST(last_day AS VARCHAR) AS last_day FROM {STERM} t"
add("G17_search_terms", DS, f"{SROW} ORDER BY searches DESC, t.last_day DESC, term LIMIT 7")
add("G18_search_no_results", DS, f"{SROW} WHERE zero_results > 0 ORDER BY zero_results DESC, t.last_day DESC, term LIMIT 7")
add("G19_realtime_active", SESS, f"SELECT count(DISTINCT visitor_key) AS active_visitors FROM sess WHERE last_seen_at >= {NOW} - INTERVAL 60 MINUTE")
add("G20_realtime_per_minute", EVENTS, f"""
SELECT i AS ago, coalesce(n, 0) AS views FROM range(30) t(i) LEFT JOIN (SELECT CAST(floor(date_diff('second', occurred_at, {NOW}) / 60) AS BIGINT) AS ago, count(*) AS n FROM evn
  WHERE event_name = 'page_view' AND occurred_at >= {NOW} - INTERVAL 30 MINUTE GROUP BY 1) c ON c.ago = t.i""")
add("G21_realtime_top_pages", EVENTS, f"""
SELECT page_path AS path, max(page_title) AS title, count(*) AS views FROM evn WHERE event_name = 'page_view' AND occurred_at >= {NOW} - INTERVAL 30 MINUTE GROUP BY 1 ORDER BY views DESC, path LIMIT 6""")
add("G21_realtime_top_channels", SESS, f"SELECT channel, count(*) AS sessions FROM sess WHERE last_seen_at >= {NOW} - INTERVAL 30 MINUTE GROUP BY 1 ORDER BY sessions DESC, channel LIMIT 6")
add("G22_realtime_feed", EVENTS, feed("TIMESTAMP '2024-01-11 18:30:00'"))
add("G23_heatmap_pages", HM, f"SELECT path, CAST(sum(clicks) AS BIGINT) AS clicks FROM hm WHERE device = 'mobile' AND {RANGE} GROUP BY path ORDER BY clicks DESC, path LIMIT 100")
add("G24_heatmap", CELLS.format("AND " + RANGE), """
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, clicks, max(clicks) OVER () AS max_clicks, CAST(sum(clicks) OVER () AS BIGINT) AS total_clicks,
  round(least(1.0, 0.2 + 0.8 * sqrt(clicks / (SELECT max(clicks) FROM cells))), 6) AS intensity FROM cells""")
add("G25_crawlers", REQ, f"""
SELECT crawler, max(crawler_type) AS type, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT path) AS pages, CAST(sum(CASE WHEN status_code = 404 THEN hits ELSE 0 END) AS BIGINT) AS not_found,
  CAST(max(last_seen_at) AS VARCHAR) AS last_seen FROM cd WHERE {RANGE} GROUP BY crawler""")
add("G26_crawler_404s", REQ, f"SELECT path, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT crawler) AS crawlers FROM cd WHERE {RANGE} AND status_code = 404 GROUP BY path ORDER BY hits DESC, path LIMIT 20")
add("G27_ad_visits", EVENTS, f"""
SELECT *, {r('converting_sessions', 'click_sessions', 4)} AS conversion_rate FROM (SELECT count(*) FILTER (WHERE event_name = 'ad_impression') AS impressions, count(*) FILTER (WHERE event_name = 'ad_click') AS clicks,
  count(DISTINCT CASE WHEN event_name = 'ad_click' THEN session_id END) AS click_sessions,
  (SELECT count(*) FROM sess WHERE conversions > 0 AND session_id IN (SELECT session_id FROM evn WHERE event_name = 'ad_click' AND {LOCAL})) AS converting_sessions
  FROM evn WHERE {LOCAL})""")
add("G28_ad_channels", EVENTS, ad_channels("e." + days("2024-01-02", "2024-01-12"), 3))
add("G29_ad_pages", EVENTS, f"""
SELECT *, {pct('clicks', 'impressions')} AS ctr FROM (SELECT page_path AS path, max(page_title) AS title, count(*) FILTER (WHERE event_name = 'ad_impression') AS impressions,
  count(*) FILTER (WHERE event_name = 'ad_click') AS clicks FROM evn WHERE event_name IN ('ad_impression', 'ad_click') AND {LOCAL} GROUP BY 1) ORDER BY clicks DESC, impressions DESC, path LIMIT 10""")
add("G30_ad_trend", AD, f"SELECT CAST(min(day) AS VARCHAR) AS day, {ADS} FROM ad WHERE {days('2023-10-20', '2024-02-10')} GROUP BY (day - DATE '2023-10-20') // 7")
add("G32_volume_24h", EVENTS, f"""
SELECT 'events' AS what, count(*) AS n FROM evn WHERE occurred_at >= {NOW} - INTERVAL 1 DAY UNION ALL SELECT 'sessions', count(*) FROM sess WHERE started_at >= {NOW} - INTERVAL 1 DAY""")
add("G33_first_day", DT, "SELECT CAST(min(day) AS VARCHAR) AS first_day FROM dt")

# ---- windows ------------------------------------------------------------------------------------

add("H3_rage_clicks", EV0, """
SELECT a.click_id, CAST(a.element AS BIGINT) AS element, CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y FROM
  (SELECT event_id AS click_id, user_id % 3 AS element, k % 60 AS x, CAST(floor(value) AS BIGINT) % 50 AS y FROM ev0) a
  JOIN (SELECT event_id AS click_id, user_id % 3 AS element, k % 60 AS x, CAST(floor(value) AS BIGINT) % 50 AS y FROM ev0) b
  ON a.element = b.element AND b.click_id BETWEEN a.click_id - 13 AND a.click_id AND (a.click_id - b.click_id) * 61 < 800 AND abs(a.x - b.x) < 30 AND abs(a.y - b.y) < 30
GROUP BY ALL HAVING count(*) = 3""")
DUP = "dup AS (SELECT page_id, lower(trim(title)) AS text, count(*) OVER (PARTITION BY lower(trim(title))) AS pages FROM ap WHERE live AND title <> '' AND NOT regexp_matches(html, '(?i)<meta[^>]*noindex')),"
add("H5_duplicates", AUD + DUP, "SELECT page_id, pages FROM dup WHERE pages > 1")
RUNS = EV0 + """
runs AS (SELECT day(received_at) AS run_id, max(received_at) AS finished_at, CAST(sum(k) % 101 AS BIGINT) AS health, CAST(sum(k) % 17 AS BIGINT) AS errors, CAST(sum(k) % 29 AS BIGINT) AS warnings,
  count(*) % 31 AS notices, count(*) AS pages FROM ev0 GROUP BY 1),
"""
add("H6_run_deltas", RUNS, """
SELECT run_id, CAST(finished_at AS VARCHAR) AS finished_at, health, errors, warnings, notices, pages, health - lag(health) OVER w AS health_delta, errors - lag(errors) OVER w AS errors_delta,
  warnings - lag(warnings) OVER w AS warnings_delta, notices - lag(notices) OVER w AS notices_delta
FROM (SELECT * FROM runs WHERE run_id % 4 <> 0 ORDER BY run_id DESC LIMIT 10) WINDOW w AS (ORDER BY run_id)""")
add("H7_last_value", SESS, "SELECT exit_path, count(*) AS sessions FROM sess GROUP BY 1")
add("H8_pageview_depth", EVENTS, "SELECT session_id, pv, CAST(max(scroll) AS BIGINT) AS scroll_depth, max(engaged) AS engaged_seconds FROM evn WHERE event_name = 'page_engagement' GROUP BY 1, 2")
FORMS = EV0 + """
ff AS (SELECT user_id % 11 AS session_id, 'v' || k % 9 AS pv, 'form' || user_id % 4 AS form_id, k % 14 = 0 AS sub, 'f' || k % 6 AS field, received_at, event_id FROM ev0),
fv AS (SELECT session_id, pv, form_id, CAST(max(CAST(NOT sub AS INT)) AS BIGINT) AS started, CAST(max(CAST(sub AS INT)) AS BIGINT) AS submitted, count(DISTINCT CASE WHEN NOT sub THEN field END) AS fields_touched,
  (max((received_at, event_id, field)) FILTER (WHERE NOT sub))[3] AS last_field FROM ff GROUP BY 1, 2, 3),
fw AS (SELECT *, CAST(started = 1 AND submitted = 0 AS BIGINT) AS abandoned FROM fv),
"""
add("H9_form_funnel", FORMS, f"""
SELECT *, {r('submitted', 'started', 4)} AS completion_rate FROM (SELECT form_id, CAST(sum(started) AS BIGINT) AS started, CAST(sum(submitted) AS BIGINT) AS submitted, CAST(sum(abandoned) AS BIGINT) AS abandoned,
  CAST(sum(fields_touched) AS BIGINT) AS fields_touched FROM fw GROUP BY form_id)""")
add("H9_form_visits", FORMS, "SELECT * FROM fw")
add("H10_video_funnel", EV0, f"""
SELECT *, {r('completed', 'started', 4)} AS completion_rate FROM (SELECT video_id, CAST(sum(s0) AS BIGINT) AS started, CAST(sum(s1) AS BIGINT) AS p25, CAST(sum(s2) AS BIGINT) AS p50, CAST(sum(s3) AS BIGINT) AS p75,
  CAST(sum(s4) AS BIGINT) AS completed FROM (SELECT user_id % 13 AS s, k // 5 AS pv, 'clip' || user_id % 3 AS video_id, """ + ", ".join(f"max(CAST(k % 5 = {i} AS INT)) AS s{i}" for i in range(5)) + """
  FROM ev0 GROUP BY 1, 2, 3) GROUP BY video_id)""")
add("H11_web_vitals", EV0, """
SELECT '/p/' || k % 25 || '/' AS page_path, count(*) AS readings, CAST(quantile_disc(floor(value * 10), 0.75) AS DOUBLE) AS lcp_ms_p75, quantile_disc(k / 1000, 0.75) AS cls_p75,
  CAST(quantile_disc(k * 3, 0.75) AS DOUBLE) AS inp_ms_p75 FROM ev0 GROUP BY 1""")

# ---- audit reports ------------------------------------------------------------------------------

add("K1_page_facts", AUD, """
SELECT page_id, CAST(html_bytes AS BIGINT) AS html_bytes, title, length(title) AS title_len, h1_count, h1, h2_count, words, images, lang, CAST(live AND regexp_matches(html, '(?i)<meta[^>]*noindex') AS BIGINT) AS noindex,
  CAST(CASE WHEN live THEN len(regexp_extract_all(html, '(?i)application/ld.json')) ELSE 0 END AS BIGINT) AS json_ld, coalesce(inn.n, 0) AS internal, coalesce(ext.n, 0) AS external_links, self_url
FROM ap LEFT JOIN inn USING (page_id) LEFT JOIN ext USING (page_id)""")
for _name, _codes in {
    "K2_status_issues": ["fetch_failed", "http_5xx", "http_4xx", "redirect"],
    "K3_speed_issues": ["slow_response", "large_html"],
    "K4_title_issues": ["title_missing", "title_too_long", "title_too_short", "meta_description_missing", "meta_description_length"],
    "K5_text_issues": ["h1_missing", "multiple_h1", "low_word_count", "no_subheadings"],
    "K6_title_h1": ["title_h1_unrelated"],
    "K7_head_issues": ["images_missing_alt", "lang_missing", "viewport_missing", "noindex", "canonical_missing", "canonical_elsewhere", "open_graph_missing", "no_structured_data"],
    "K8_mixed_content": ["mixed_content"],
    "K9_no_internal_links": ["no_internal_links"],
}.items():
    add(_name, ISS, f"SELECT page_id, code, detail FROM pi WHERE code IN ({', '.join(map(text, _codes))})")
add("K9_link_edges", AUD, "SELECT page_id, src_url, dst_url FROM edges0")
add("K10_inlinks", AUD, "SELECT dst_url, count(DISTINCT page_id) AS inlinks FROM edges GROUP BY dst_url")
add("K11_broken_links", AUD, """
SELECT page_id, count(*) AS broken, array_to_string(list_sort(list(dst_url))[1:20], ' ') AS listed FROM edges JOIN st ON dst_url = url WHERE status_code = 0 OR status_code >= 400 GROUP BY page_id""")
add("K12_duplicate_text", AUD + DUP, "SELECT page_id, text, pages FROM dup WHERE pages > 1")
ORPHAN = "SELECT page_id, self_url FROM ap WHERE live AND source <> 'home' AND self_url NOT IN (SELECT dst_url FROM {0})"
add("K13_orphans", AUD, ORPHAN.format("edges"))
# The pages CTE is already part of AUD; only the content part of the visit chain is added.
AUDV = ISS + DC + visits()
NOVISIT = "SELECT page_id FROM ap JOIN pvw USING (page_id) WHERE live AND pageviews = 0 AND (SELECT min(day) FROM dc) <= DATE '2024-01-30' - 27"
add("K14_no_recent_visits", AUDV, NOVISIT)
FULL = AUDV + CAT + DUP + f"""
ai AS (SELECT page_id, code, detail FROM pi
  UNION ALL SELECT a.page_id, 'broken_internal_links', array_to_string(list_sort(list(dst_url))[1:20], ' ') FROM edges0 e JOIN ap a USING (page_id) JOIN st ON dst_url = st.url WHERE a.live AND (st.status_code = 0 OR st.status_code >= 400) GROUP BY a.page_id
  UNION ALL SELECT page_id, 'title_duplicate', CAST(pages AS VARCHAR) FROM dup WHERE pages > 1
  UNION ALL SELECT page_id, 'orphan_page', '1' FROM ({ORPHAN.format("edges0")})
  UNION ALL SELECT page_id, 'no_recent_visits', '1' FROM ({NOVISIT})),
sc AS (SELECT page_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'notice') AS notices FROM ai JOIN cat USING (code) GROUP BY page_id),
il AS (SELECT dst_url, count(DISTINCT page_id) AS n FROM edges0 GROUP BY dst_url),
au0 AS (SELECT ap.*, coalesce(il.n, 0) AS inlinks, coalesce(sc.errors, 0) AS errors, coalesce(sc.warnings, 0) AS warnings, coalesce(sc.notices, 0) AS notices FROM ap LEFT JOIN il ON il.dst_url = ap.self_url LEFT JOIN sc USING (page_id)),
au AS (SELECT *, errors + warnings + notices AS ideas, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS vpath,
  CASE WHEN status_code = 0 OR status_code >= 400 THEN 'broken' WHEN status_code >= 300 THEN 'redirects' WHEN errors > 0 THEN 'errors' WHEN warnings > 0 THEN 'warnings' ELSE 'healthy' END AS bucket FROM au0),
si AS (SELECT unnest(['robots_blocks_all', 'sitemap_missing', 'plain_permalinks', 'soft_404']) AS code UNION ALL SELECT 'no_https' FROM pages WHERE page_id = (SELECT min(page_id) FROM pages) AND NOT starts_with(url, 'https:')),
"""
add("K15_severity_counts", FULL, "SELECT page_id, inlinks, errors, warnings, notices FROM au")
add("K16_crawl_buckets", FULL, "SELECT bucket, count(*) AS pages FROM au GROUP BY 1")
add("K17_health", FULL, """
SELECT pages, with_errors, with_warnings, errors + se AS errors, warnings + sw AS warnings, notices + sn AS notices,
  CAST(round(greatest(0, least(100, 100 * (1 - (with_errors + 0.3 * with_warnings) / pages) - 10 * se - 3 * sw))) AS BIGINT) AS health FROM
  (SELECT count(*) AS pages, count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) FILTER (WHERE errors = 0 AND warnings > 0) AS with_warnings, CAST(sum(errors) AS BIGINT) AS errors,
    CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(notices) AS BIGINT) AS notices FROM au),
  (SELECT count(*) FILTER (WHERE severity = 'error') AS se, count(*) FILTER (WHERE severity = 'warning') AS sw, count(*) FILTER (WHERE severity = 'notice') AS sn FROM si JOIN cat USING (code))""")
add("K18_issue_frequency", FULL, "SELECT code, CAST(sum(n) AS BIGINT) AS pages FROM (SELECT code, 1 AS n FROM ai UNION ALL SELECT code, 1 FROM si) GROUP BY code")
add("K18_ideas_by_category", FULL, "SELECT category, count(ai.code) AS ideas FROM cat LEFT JOIN ai USING (code) GROUP BY category")
add("K19_audit_overview", FULL, "SELECT code, severity, category, count(*) AS pages FROM ai JOIN cat USING (code) GROUP BY ALL")
add("K19_idea_totals", FULL, "SELECT count(*) FILTER (WHERE ideas > 0) AS pages, CAST(sum(ideas) AS BIGINT) AS ideas FROM au")
add("K20_pages_with_issue", FULL, "SELECT page_id, vpath AS path, title, ideas, bucket, detail FROM au JOIN ai USING (page_id) WHERE code = 'title_duplicate'")
add("K20_pages_in_bucket", FULL, "SELECT page_id, vpath AS path, ideas, pageviews FROM au JOIN pvw USING (page_id) WHERE bucket = 'errors'")
add("K20_page_detail", FULL, "SELECT page_id, code, severity, category, detail, bucket, ideas FROM au JOIN ai USING (page_id) JOIN cat USING (code) WHERE page_id = 5")
add("K21_top_pages_to_fix", FULL, "SELECT page_id, pageviews, errors, ideas FROM au JOIN pvw USING (page_id) WHERE live AND ideas > 0 ORDER BY pageviews DESC, errors DESC, ideas DESC, page_id LIMIT 10")
add("K22_common_ideas", FULL, "SELECT code, pages FROM (SELECT code, severity, count(*) AS pages FROM ai JOIN cat USING (code) GROUP BY ALL) ORDER BY pages DESC, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, code LIMIT 6")
add("K23_url_worklist", PGS + """
cand0 AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '#again' ELSE url END AS url, self_url, path, q, page_id * 7919 % 100000 AS age, page_id % 17 AS posts,
  CASE WHEN page_id = 1 THEN 'home' WHEN page_id % 3 = 0 THEN 'archive' ELSE 'content' END AS source FROM pgs),
cand AS (SELECT * FROM cand0 UNION ALL SELECT * REPLACE ('archive' AS source) FROM cand0 WHERE page_id % 3 = 1),
pick AS (SELECT *, 0 AS p FROM cand WHERE source = 'home' UNION ALL (SELECT *, 1 FROM cand WHERE source = 'content' ORDER BY age DESC, url LIMIT 100)
  UNION ALL (SELECT *, 2 FROM cand WHERE source = 'archive' ORDER BY posts DESC, url LIMIT 30)),
rk AS (SELECT *, CASE WHEN p = 1 THEN -age ELSE 0 END AS o1, CASE WHEN p = 2 THEN -posts ELSE 0 END AS o2 FROM pick),
once AS (SELECT *, row_number() OVER (PARTITION BY self_url ORDER BY p, o1, o2, url) AS rn FROM rk)
""", "SELECT url, CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS path, page_id AS post_id, source FROM once WHERE rn = 1 ORDER BY p, o1, o2, url LIMIT 100")
add("K24_robots_blocks_all", "", "SELECT doc_id AS site, CAST(doc_id % 6 IN (0, 2) AS BIGINT) AS blocks_all FROM documents")
add("K25_site_checks", FULL, "SELECT code FROM si")
add("K26_keep_runs", EV0, "SELECT * FROM (SELECT CAST(day(received_at) AS BIGINT) AS run_id, count(*) AS pages FROM ev0 GROUP BY 1) ORDER BY run_id DESC LIMIT 10")
add("L1_retain", DALL, """
SELECT 'events' AS "table", count(*) AS deleted FROM evn WHERE occurred_at < TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'sessions', count(*) FROM sess WHERE started_at < TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'daily_traffic', count(*) FROM dt WHERE day < DATE '2024-01-15'
UNION ALL SELECT 'daily_events', count(*) FROM de WHERE day < DATE '2024-01-15'
UNION ALL SELECT 'events kept', count(*) FROM evn WHERE occurred_at >= TIMESTAMP '2024-01-15 12:00:00'""")
# Two runs have to give what one gives.
ORACLES["E0_collect_two_batches"] = ORACLES["E0_collect"]
ORACLES["E7_returning_two_batches"] = ORACLES["E7_returning"]
# The page rules once more, on pages changed as the query changes them. Without a body tag the text begins after the title.
VARIED = """(SELECT page_id, url, CASE page_id % 5
  WHEN 0 THEN regexp_replace(html, '<h1[^>]*>[^<]*</h1>', '<h1>Qqzz Wwyy</h1>', 'g')
  WHEN 1 THEN replace(html, '</body>', '<img alt="a" src="http://img.example/x.png"></body>')
  WHEN 2 THEN regexp_replace(html, '<a href="[^"]*">', '<b>', 'g')
  WHEN 3 THEN regexp_replace(html, '</?(head|body)>|</html>', '', 'g')
  ELSE html END AS html FROM pages)"""
add("K2_page_issues_varied", ISS.replace("FROM pages)", f"FROM {VARIED})").replace("(?is)^.*?<body[^>]*>", "(?is)^.*?(?:<body[^>]*>|</title>)"), "SELECT page_id, code, detail FROM pi")
# Rates of every third day, once for each stored form.
add("A5_read_fx_rates", EV0, """
SELECT form, CAST(rate_date AS VARCHAR) AS rate_date, base_currency, quote_currency, rate FROM (
  SELECT DISTINCT CAST(received_at AS DATE) AS rate_date FROM ev0 WHERE day(received_at) % 3 = 0),
  (VALUES ('parquet'), ('csv')) f(form), LATERAL (
  SELECT 'USD' AS base_currency, 'EUR' AS quote_currency, round(0.9 + day(rate_date) / 1000.0, 10) AS rate
  UNION ALL SELECT 'KES', 'USD', round(0.007 + day(rate_date) / 100000.0, 10))""")
ORACLES["J0_stream_collect"] = ORACLES["E0_collect_late"] = ORACLES["E0_collect"]
ORACLES["J0_stream_events"] = ORACLES["E0_collect_events"]
for _name, _full in (("traffic", "F2_daily_traffic"), ("dimensions", "F3_daily_dimensions"), ("content", "F4_daily_content"), ("events", "F6_daily_events"), ("searches", "F7_daily_searches")):
    ORACLES[f"J9_grown_{_name}"] = ORACLES[_full]
ORACLES["J9_collect_traffic"] = f"""
WITH s0 AS ({ORACLES["E0_collect"]}),
e0 AS ({ORACLES["E0_collect_events"]}),
s AS (SELECT CAST(CAST(started_at AS TIMESTAMP) + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS sessions, CAST(sum(engaged_seconds) AS BIGINT) AS engaged_seconds,
  CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds, count(*) FILTER (WHERE pageviews <= 1 AND engaged_seconds <= 10 AND conversions = 0) AS bounces FROM s0 GROUP BY 1),
e AS (SELECT CAST(CAST(occurred_at AS TIMESTAMP) + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE event_name = 'page_view') AS pageviews,
  CAST(sum(is_conversion) AS BIGINT) AS conversions, CAST(coalesce(sum(CAST(event_value_base AS DECIMAL(18,4))) FILTER (WHERE is_conversion = 1), 0) AS DOUBLE) AS revenue FROM e0 GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in ("sessions", "bounces", "engaged_seconds", "duration_seconds", "events", "pageviews", "conversions", "revenue")
) + " FROM s FULL JOIN e USING (day)"
ORACLES["D12_uncrawled_all"] = ORACLES["D12_uncrawled_links"].replace(" LIMIT 300", "")
ORACLES["K11_broken_all"] = ORACLES["K11_broken_links"].replace("[1:20]", "")
ORACLES["H3_rage_clicks_stream"] = ORACLES["H3_rage_clicks"]
ORACLES["E7_first_seen_store"] = ORACLES["E7_returning"]
ORACLES["A10_replace_days"] = ORACLES["A10_write_days"]
ORACLES["A12_counters_in_batches"] = ORACLES["F9_crawler_daily"]
add("J0_stream_returning", COLLECT, """
SELECT CAST(CASE WHEN id_mode = 1 THEN CASE WHEN low < opened THEN 1 ELSE 0 END END AS BIGINT) AS is_returning, count(*) AS sessions FROM (
  SELECT *, min(opened) OVER (PARTITION BY vk) AS low FROM (
    SELECT session_id, max(vk) AS vk, max(id_mode) FILTER (WHERE payload_id = session_id) AS id_mode, max(received_at) FILTER (WHERE payload_id = session_id) AS opened
    FROM col WHERE session_id IS NOT NULL GROUP BY session_id)) GROUP BY 1""")
add("J0_stream_days", COLLECT + REG, """
SELECT CAST(CAST(received_at - to_seconds(k) AS DATE) AS VARCHAR) AS event_date, event_name, count(*) AS events, count(DISTINCT session_id) AS sessions
FROM col JOIN reg USING (event_name) WHERE session_id IS NOT NULL AND n_events = 1
  AND CAST(received_at - to_seconds(k) AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-16' GROUP BY 1, 2""")
add("J0_stream_heat", UA + ADMIT, """
SELECT page_path, device_type AS device, CAST(k AS BIGINT) AS x, CAST(floor(value) AS BIGINT) AS y, count(*) AS points, CAST(max(received_at) AS VARCHAR) AS last
FROM adm JOIN ua ON k % 8 = ua_i WHERE reason IS NULL AND heat = 1 GROUP BY 1, 2, 3, 4""")
add("J0_stream_rejects", COLLECT, """
SELECT a.payload_id, coalesce(a.reason, 'no_session') AS reason FROM adm a LEFT JOIN col c USING (payload_id)
WHERE a.reason IS NOT NULL OR (c.payload_id IS NOT NULL AND c.session_id IS NULL)""")
add("K25_site_checks_by_host", PG, """
SELECT site, code FROM (
  SELECT site, unnest([CASE WHEN m % 7 = 0 THEN 'search_engines_blocked' END, CASE WHEN NOT starts_with(lower(home), 'https:') THEN 'no_https' END,
    CASE WHEN m % 6 = 0 THEN 'plain_permalinks' END, CASE WHEN m % 11 = 0 THEN 'debug_display' END, CASE WHEN m % 4 = 0 THEN 'robots_missing' END,
    CASE WHEN m % 4 <> 0 AND m % 3 = 0 THEN 'robots_blocks_all' END, CASE WHEN m % 5 = 0 THEN 'sitemap_missing' END, CASE WHEN m % 2 = 0 THEN 'soft_404' END]) AS code
  FROM (SELECT host AS site, min(page_id) AS m, min_by(url, page_id) AS home FROM pg GROUP BY host)) WHERE code IS NOT NULL""")
