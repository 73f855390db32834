"""Table schemas as DDL text. Times are UTC ``timestamp_ntz``; '' stands for unknown text, NULL only where noted."""

from __future__ import annotations

EVENT_IN = (
    "n string, d bigint, a string, m string, c string, et string, ei string, v string, cu string, lr string"
)
CONTEXT_IN = (
    "k string, p string, t string, a string, pd string, md string, b string, tpl string, l string, "
    "li string, r string, tx map<string,array<string>>, q struct<tax:string,term:string,author:string>"
)
# The beacon body as sent by a page.
PAYLOAD = (
    "u string, r string, ti string, tz string, lg string, vw string, tp boolean, vid string, wd boolean, "
    f"c string, hb string, hm string, e array<struct<{EVENT_IN.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
)
# What the receiving server knows about the request.
REQUEST = (
    "ip string, user_agent string, dnt boolean, gpc boolean, ch_platform string, cf_country string, "
    "received_at timestamp_ntz"
)
HITS = (f"payload_id bigint, {PAYLOAD}, {REQUEST}")
HIT_LINE = (f"id bigint, {REQUEST}, body string")

SESSIONS = ("session_id bigint, visitor_key string, id_mode int, is_returning int, started_at timestamp_ntz, "
    "last_seen_at timestamp_ntz, duration_seconds bigint, engaged_seconds bigint, pageviews bigint, "
    "event_count bigint, conversions bigint, is_engaged int, landing_path string, landing_post_id bigint, "
    "exit_path string, referrer_domain string, referrer_url string, channel string, utm_source string, "
    "utm_medium string, utm_campaign string, utm_term string, utm_content string, click_id_type string, "
    "click_id string, device_type string, browser string, browser_version string, os string, "
    "os_version string, viewport string, language string, country string, region string, city string, "
    "timezone string, is_logged_in int"
)
EVENTS = ("event_id bigint, occurred_at timestamp_ntz, session_id bigint, visitor_key string, event_name string, "
    "category string, module string, origin int, entity_type string, entity_id string, post_id bigint, "
    "post_type string, page_path string, page_title string, event_value decimal(18,4), currency string, "
    "event_value_base decimal(18,4), is_conversion int, lead_ref string, attributes string, context string"
)
FX_RATES = ("rate_date date, base_currency string, quote_currency string, rate decimal(20,10)")
DAILY_TRAFFIC = ("day date, visitors bigint, sessions bigint, engaged_sessions bigint, bounces bigint, pageviews bigint, "
    "events bigint, conversions bigint, revenue decimal(18,4), engaged_seconds bigint, "
    "duration_seconds bigint, new_visitors bigint, returning_visitors bigint"
)
DAILY_DIMENSIONS = ("day date, dimension string, value_hash string, value string, sessions bigint, visitors bigint, "
    "engaged_sessions bigint, pageviews bigint, engaged_seconds bigint, conversions bigint, revenue decimal(18,4)"
)
DAILY_CONTENT = ("day date, path string, post_id bigint, post_type string, title string, pageviews bigint, "
    "visitors bigint, entrances bigint, exits bigint, engaged_seconds bigint, engaged_views bigint, "
    "conversions bigint"
)
DAILY_EVENTS = ("day date, event_name string, category string, module string, events bigint, sessions bigint, "
    "value decimal(18,4), is_conversion int"
)
DAILY_SEARCHES = ("day date, term string, searches bigint, sessions bigint, zero_results bigint, results_total bigint, "
    "results_counted bigint, source_results_page bigint, source_form bigint, source_live bigint"
)
HEATMAP_DAILY = ("day date, path string, device string, x int, y int, clicks bigint")
CRAWLER_DAILY = ("day date, crawler string, crawler_type string, path string, status_code int, hits bigint, "
    "last_seen_at timestamp_ntz"
)
AD_DAILY = ("day date, ad_id bigint, campaign_id bigint, name string, campaign string, status string, "
    "impressions bigint, clicks bigint"
)
GEO_RANGES = ("start_ip string, end_ip string, country string, region string, city string")
POSTS = ("post_id bigint, author string, published_at timestamp_ntz, post_type string")
POST_TERMS = ("post_id bigint, taxonomy string, term string")
PAGES = ("page_id bigint, url string, html string, status_code int, response_ms int, source string, post_id bigint"
)
AUDIT_RUNS = ("run_id bigint, status string, finished_at timestamp_ntz, health int, errors bigint, warnings bigint, "
    "notices bigint, pages bigint"
)
SITE_FETCHES = ("kind string, status int, body string")
SITE_FLAGS = ("home_url string, search_blocked boolean, plain_permalinks boolean, debug_display boolean"
)

TRAFFIC_METRICS = [
    "visitors", "sessions", "engaged_sessions", "bounces", "pageviews", "events", "conversions", "revenue",
    "engaged_seconds", "duration_seconds", "new_visitors", "returning_visitors",
]
CONTENT_METRICS = [
    "pageviews", "visitors", "entrances", "exits", "engaged_seconds", "engaged_views", "conversions",
]


def columns(ddl: str) -> list[str]:
    """Top-level column names of a schema text."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(part.split()[0])
            part = ""
        else:
            part += ch
    return out
