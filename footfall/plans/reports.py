"""Report queries over the daily rollups. Dates are site-local days, both ends included."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.measures import DERIVED, age_bucket, derived_rates, heat_intensity, percent, ratio
from footfall.functions.times import day_lit
from footfall.schemas import CONTENT_METRICS, TRAFFIC_METRICS
from footfall.sources.tables import scan_daily

ORDERABLE = ["sessions", "visitors", "engaged_sessions", "pageviews", "conversions", "revenue"]
WEEKLY_FROM, MONTHLY_FROM = 92, 400
SHARE_SIZE = 5


def _sum(name: str) -> Column:
    total = F.coalesce(F.sum(name), F.lit(0))
    return (F.round(total, 2).cast("double") if name in ("revenue", "value") else total.cast("bigint")).alias(name)


def _date(d: str | date) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


# ---- traffic ------------------------------------------------------------------------------------


def totals(dt: DataFrame, from_, to) -> DataFrame:
    return derived_rates(scan_daily(dt, from_, to).agg(*[_sum(m) for m in TRAFFIC_METRICS]))


def calendar(spark, from_, to) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(day_lit(from_), day_lit(to))).alias("day"))


def series(dt: DataFrame, from_, to) -> DataFrame:
    """One row per day of the range, zero where the rollup has none."""
    rows = scan_daily(dt, from_, to).select("day", *TRAFFIC_METRICS)
    filled = calendar(dt.sparkSession, from_, to).join(rows, "day", "left").fillna(0, TRAFFIC_METRICS)
    return filled.withColumn("revenue", F.round(F.coalesce("revenue", F.lit(0)), 2).cast("double"))


def comparison_range(from_, to, compare: str) -> tuple[date, date] | None:
    a, b = _date(from_), _date(to)
    if compare == "previous":
        return a - timedelta(days=(b - a).days + 1), a - timedelta(days=1)
    if compare == "year":
        def shift(d: date) -> date:
            try:
                return d.replace(year=d.year - 1)
            except ValueError:  # 29 February runs over to 1 March
                return date(d.year - 1, 3, 1)

        return shift(a), shift(b)
    return None


def _periods(from_, to, compare: str) -> list[tuple[str, date, date]]:
    out = [("current", _date(from_), _date(to))]
    other = comparison_range(from_, to, compare)
    return out + ([("compare", *other)] if other else [])


def overview(dt: DataFrame, from_, to, compare: str = "previous") -> DataFrame:
    """Totals and rates of the range and of the range it is compared with: one scan, grouped by period."""
    periods = _periods(from_, to, compare)
    lo, hi = min(p[1] for p in periods), max(p[2] for p in periods)
    hits = F.array(*[F.when(F.col("day").between(day_lit(a), day_lit(b)), F.lit(n)) for n, a, b in periods])
    tagged = scan_daily(dt, lo, hi).withColumn("period", F.explode(F.array_compact(hits)))
    sums = tagged.groupBy("period").agg(*[_sum(m) for m in TRAFFIC_METRICS])
    names = dt.sparkSession.createDataFrame([(n, str(a), str(b)) for n, a, b in periods], "period string, range_from string, range_to string")
    return derived_rates(names.join(sums, "period", "left").fillna(0, TRAFFIC_METRICS))


def overview_series(dt: DataFrame, from_, to, compare: str = "previous") -> DataFrame:
    out = None
    for name, a, b in _periods(from_, to, compare):
        part = series(dt, a, b).withColumn("period", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


COMPARED = [
    "visitors", "sessions", "pageviews", "engagement_rate", "avg_engaged_time", "bounce_rate", "pages_per_session",
    "conversions", "conversion_rate", "revenue", "new_visitors", "returning_visitors",
]
LOWER_IS_BETTER = ["bounce_rate"]
FLAT = 0.005


def comparison_delta(dt: DataFrame, from_, to, compare: str = "previous") -> DataFrame:
    """Change per metric against the comparison range; NULL without earlier data."""
    o = overview(dt, from_, to, compare)

    def value(m: str) -> Column:
        if m not in DERIVED:
            return F.col(m).cast("double")
        return F.when(F.col("sessions") > 0, F.col(DERIVED[m]).cast("double") / F.col("sessions")).otherwise(0.0)

    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("v")) for m in COMPARED])
    long = o.select("period", F.explode(pairs).alias("p"))
    wide = long.groupBy(F.col("p.metric").alias("metric")).agg(
        F.max(F.when(F.col("period") == "current", F.col("p.v"))).alias("now"),
        F.max(F.when(F.col("period") == "compare", F.col("p.v"))).alias("before"),
    )
    change = F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before"))
    better = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.col("change") < 0).otherwise(F.col("change") > 0)
    return (
        wide.withColumn("change", change)
        .withColumn("is_flat", (F.abs("change") < FLAT).cast("int"))
        .withColumn("is_good", better.cast("int"))
    )


def bucket_series(points: DataFrame, from_, to, metrics: list[str] = TRAFFIC_METRICS) -> DataFrame:
    """Daily points up to 92 days, 7-day blocks from the range start up to 400 days, else calendar months."""
    days = (_date(to) - _date(from_)).days + 1
    if days <= WEEKLY_FROM:
        return points.select("day", *metrics)
    if days <= MONTHLY_FROM:
        key = F.floor(F.datediff("day", day_lit(from_)) / 7)
    else:
        key = F.trunc("day", "month")
    return (
        points.groupBy(key.alias("_k")).agg(F.min("day").alias("day"), *[F.sum(m).alias(m) for m in metrics]).drop("_k")
    )


def first_day(dt: DataFrame) -> DataFrame:
    return dt.agg(F.min("day").alias("first_day"))


# ---- session dimensions -------------------------------------------------------------------------


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def dimension(dd: DataFrame, name: str, from_, to, limit: int | None = 10, orderby: str = "sessions") -> DataFrame:
    """Top values of a dimension, all with ``limit=None``; ties go by value."""
    by = orderby if orderby in ORDERABLE else "sessions"
    rows = scan_daily(dd, from_, to).where(F.col("dimension") == name)
    sums = rows.groupBy("value_hash").agg(
        F.max("value").alias("value"),
        *[_sum(m) for m in ("sessions", "visitors", "engaged_sessions", "pageviews", "engaged_seconds", "conversions", "revenue")],
    )
    ordered = sums if limit is None else sums.orderBy(F.desc(by), "value").limit(limit)
    return ordered.select(
        "value", "sessions", "visitors", "engaged_sessions", "pageviews", "conversions", "revenue",
        ratio("engaged_sessions", "sessions", 4).alias("engagement_rate"),
        ratio("conversions", "sessions", 4).alias("conversion_rate"),
        ratio("engaged_seconds", "sessions", 1).alias("avg_engaged_time"),
    )


def dimension_total(dd: DataFrame, name: str, from_, to) -> DataFrame:
    """How many values a dimension has in the range."""
    rows = scan_daily(dd, from_, to).where(F.col("dimension") == name)
    return rows.agg(F.countDistinct("value_hash").alias("total"))


# Channels drawn as slices of their own; the others always fall under Other.
SHARE_CHANNELS = [
    "organic_search", "social", "referral", "paid_search", "ai_assistant", "email", "direct", "ota_listing",
]


def channel_share(dd: DataFrame, from_, to, slices: int = SHARE_SIZE) -> DataFrame:
    """First five recognised channels by sessions, the rest as Other. Every channel counts."""
    rows = dimension(dd, "channel", from_, to, None).select("value", "sessions")
    known = F.col("value").isin(SHARE_CHANNELS)
    w = Window.partitionBy(known).orderBy(F.desc("sessions"), "value")
    named = rows.withColumn("_n", F.row_number().over(w)).withColumn(
        "name", F.when(known & (F.col("_n") <= slices), F.col("value")).otherwise("Other")
    )
    return named.groupBy("name").agg(F.sum("sessions").alias("sessions")).where(F.col("sessions") > 0)


def device_share(dd: DataFrame, from_, to) -> DataFrame:
    """Share of all sessions per device."""
    rows = dimension(dd, "device", from_, to, None).select(F.col("value").alias("device"), "sessions")
    total = F.sum("sessions").over(Window.partitionBy(F.lit(1)))  # one row per device
    return rows.withColumn("share", F.when(total > 0, F.round(F.col("sessions") / total, 6)).otherwise(0.0))


# ---- content ------------------------------------------------------------------------------------


def _content_rates() -> list[Column]:
    return [
        "pageviews", "visitors", "entrances", "exits", "conversions",
        ratio("engaged_seconds", "engaged_views", 1).alias("avg_engaged_time"),
        ratio("exits", "pageviews", 4).alias("exit_rate"),
    ]


def _by_path(dc: DataFrame, from_, to) -> DataFrame:
    return scan_daily(dc, from_, to).groupBy("path").agg(
        F.max("title").alias("title"), F.max("post_id").alias("post_id"), *[_sum(m) for m in CONTENT_METRICS]
    )


def _by_post(dc: DataFrame, from_, to) -> DataFrame:
    rows = scan_daily(dc, from_, to).where(F.col("post_id") > 0)
    return rows.groupBy("post_id").agg(*[_sum(m) for m in CONTENT_METRICS])


def content(
    dc: DataFrame,
    group: str,
    from_,
    to,
    limit: int | None = 10,
    posts: DataFrame | None = None,
    post_terms: DataFrame | None = None,
    now=None,
) -> DataFrame:
    """Content by 'page', 'post_type', 'author', 'age' or 'tax:<name>'.

    The last three regroup all viewed posts by what ``posts`` and ``post_terms`` say about them
    now; a post with several terms counts under each of them.
    """
    if group == "page":
        label = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("path"))
        top = _top(_by_path(dc, from_, to).orderBy(F.desc("pageviews"), "path"), limit)
        return top.select(F.col("path").alias("key"), label.alias("label"), "path", "post_id", *_content_rates())
    if group == "post_type":
        rows = scan_daily(dc, from_, to).groupBy("post_type").agg(*[_sum(m) for m in CONTENT_METRICS])
        label = F.when(F.col("post_type") == "", "Archives & other pages").otherwise(F.col("post_type"))
        return _top(rows.orderBy(F.desc("pageviews"), "post_type"), limit).select(
            F.col("post_type").alias("key"), label.alias("label"), *_content_rates()
        )
    known = _by_post(dc, from_, to).join(posts.select("post_id", "author", "published_at"), "post_id", "left")
    gone = F.col("published_at").isNull()
    if group == "author":
        keyed = known.withColumn("key", F.when(gone, "deleted").otherwise(F.col("author")))
    elif group == "age":
        keyed = known.withColumn("key", F.when(gone, "deleted").otherwise(age_bucket("published_at", now)))
    elif group.startswith("tax:"):
        terms = post_terms.where(F.col("taxonomy") == group[4:]).select("post_id", "term").distinct()
        keyed = known.join(terms, "post_id", "left").withColumn(
            "key", F.when(gone, "deleted").otherwise(F.coalesce("term", F.lit("(none)")))
        )
    else:
        raise ValueError(f"unknown content group {group}")
    rows = keyed.groupBy("key").agg(*[_sum(m) for m in CONTENT_METRICS])
    return _top(rows.orderBy(F.desc("pageviews"), "key"), limit).select(
        "key", F.col("key").alias("label"), *_content_rates()
    )


def entry_exit_pages(dc: DataFrame, metric: str, from_, to, limit: int | None = None) -> DataFrame:
    """Pages sorted by entrances or exits, without those that have none; ``limit`` keeps the first of them."""
    pages = content(dc, "page", from_, to, None)
    return _top(pages.where(F.col(metric) > 0).orderBy(F.desc(metric), "path"), limit)


# ---- events and search --------------------------------------------------------------------------


def events(de: DataFrame, from_, to) -> DataFrame:
    rows = scan_daily(de, from_, to).groupBy(F.col("event_name").alias("event")).agg(
        F.max("category").alias("category"), F.max("module").alias("module"), _sum("events"), _sum("sessions"),
        _sum("value"), F.max("is_conversion").alias("is_conversion"),
    )
    return rows.orderBy(F.desc("events"), "event")


def conversions(de: DataFrame, from_, to) -> DataFrame:
    return events(de, from_, to).where(F.col("is_conversion") == 1)


# Figures of the interaction summary and the event each one counts.
INTERACTIONS = {
    "forms_submitted": "form_submit", "forms_started": "form_start", "forms_abandoned": "form_abandon",
    "contact_taps": "contact_click", "downloads": "file_download", "outbound_clicks": "outbound_click",
    "video_plays": "video_start", "video_completes": "video_complete", "site_searches": "site_search",
    "rage_clicks": "rage_click", "dead_clicks": "dead_click", "not_found": "page_not_found",
}


def interaction_summary(de: DataFrame, from_, to) -> DataFrame:
    rows = scan_daily(de, from_, to).where(F.col("event_name").isin(list(INTERACTIONS.values())))
    counts = rows.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_name") == e, F.col("events"))), F.lit(0)).alias(n)
            for n, e in INTERACTIONS.items()
        ]
    )
    return counts.withColumn("form_completion", ratio("forms_submitted", "forms_started", 4)).withColumn(
        "video_completion", ratio("video_completes", "video_plays", 4)
    )


SEARCH_SUMS = [
    "searches", "zero_results", "results_total", "results_counted", "source_results_page", "source_form", "source_live",
]


def search_totals(ds: DataFrame, from_, to) -> DataFrame:
    t = scan_daily(ds, from_, to).agg(F.countDistinct("term").alias("terms"), *[_sum(c) for c in SEARCH_SUMS])
    return t.select(
        "searches", "terms", "zero_results", ratio("zero_results", "searches", 4).alias("zero_results_rate"),
        ratio("results_total", "results_counted", 1, None).alias("avg_results"),
        F.col("source_results_page").alias("results_page"), F.col("source_form").alias("form"),
        F.col("source_live").alias("live"),
    )


def _search_rows(ds: DataFrame, from_, to) -> DataFrame:
    return scan_daily(ds, from_, to).groupBy("term").agg(
        *[_sum(c) for c in SEARCH_SUMS], _sum("sessions"), F.max("day").alias("last_day")
    )


def _search_columns() -> list[Column]:
    return [
        "term", "searches", "sessions", "zero_results",
        ratio("results_total", "results_counted", 1, None).alias("avg_results"),
        F.col("source_results_page").alias("results_page"), F.col("source_form").alias("form"),
        F.col("source_live").alias("live"), "last_day",
    ]


def search_terms(ds: DataFrame, from_, to, limit: int = 50) -> DataFrame:
    rows = _search_rows(ds, from_, to)
    return rows.orderBy(F.desc("searches"), F.desc("last_day"), "term").limit(limit).select(*_search_columns())


def having_zero(df: DataFrame) -> DataFrame:
    return df.where(F.col("zero_results") > 0)


def search_no_results(ds: DataFrame, from_, to, limit: int = 50) -> DataFrame:
    rows = having_zero(_search_rows(ds, from_, to))
    return rows.orderBy(F.desc("zero_results"), F.desc("last_day"), "term").limit(limit).select(*_search_columns())


# ---- heat maps and crawlers ---------------------------------------------------------------------


def _device(df: DataFrame, device: str) -> DataFrame:
    return df if device == "all" else df.where(F.col("device") == device)


def heatmap_pages(hm: DataFrame, device: str, from_, to, limit: int | None = None) -> DataFrame:
    rows = _device(scan_daily(hm, from_, to), device).groupBy("path").agg(F.sum("clicks").alias("clicks"))
    return _top(rows.orderBy(F.desc("clicks"), "path"), limit)


def heatmap(hm: DataFrame, path: str, device: str, from_, to) -> DataFrame:
    """Cells of one page with the map's maximum and total, and each cell's drawing weight.

    A page has at most 100 x 1000 cells, so the window over them is bounded whatever the traffic.
    """
    rows = _device(scan_daily(hm, from_, to).where(F.col("path") == path), device)
    cells = rows.groupBy("x", "y").agg(F.sum("clicks").alias("clicks"))
    w = Window.partitionBy(F.lit(1))
    with_totals = cells.withColumn("max_clicks", F.max("clicks").over(w)).withColumn(
        "total_clicks", F.sum("clicks").over(w)
    )
    return heat_intensity(with_totals)


def crawlers(cd: DataFrame, from_, to) -> DataFrame:
    rows = scan_daily(cd, from_, to).groupBy("crawler", "path").agg(
        F.max("crawler_type").alias("type"),
        F.sum("hits").alias("hits"),
        F.sum(F.when(F.col("status_code") == 404, F.col("hits")).otherwise(0)).alias("not_found"),
        F.max("last_seen_at").alias("last_seen"),
    )
    return (
        rows.groupBy("crawler")
        .agg(
            F.max("type").alias("type"), F.sum("hits").alias("hits"), F.count("*").alias("pages"),
            F.sum("not_found").alias("not_found"), F.max("last_seen").alias("last_seen"),
        )
        .orderBy(F.desc("hits"), "crawler")
    )


def crawler_404s(cd: DataFrame, from_, to, limit: int | None = None) -> DataFrame:
    rows = scan_daily(cd, from_, to).where(F.col("status_code") == 404)
    pages = rows.groupBy("path").agg(F.sum("hits").alias("hits"), F.countDistinct("crawler").alias("crawlers"))
    return _top(pages.orderBy(F.desc("hits"), "path"), limit)


# ---- advertisements -----------------------------------------------------------------------------


def ad_report(ad_daily: DataFrame, from_, to) -> dict[str, DataFrame]:
    """Impressions and clicks in total, by day, by ad and by campaign."""
    rows = scan_daily(ad_daily, from_, to)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("impressions", "clicks")]
    ctr = percent("clicks", "impressions").alias("ctr")
    by_ad = rows.groupBy("ad_id").agg(
        F.max("name").alias("name"), F.max("status").alias("status"), F.max("campaign").alias("campaign"), *sums
    )
    by_campaign = rows.groupBy("campaign_id").agg(F.max("campaign").alias("name"), *sums)
    return {
        "totals": rows.agg(*sums).select("*", ctr),
        "daily": rows.groupBy("day").agg(*sums),
        "ads": by_ad.select("*", ctr),
        "campaigns": by_campaign.select("*", ctr),
    }


def ad_trend(ad_daily: DataFrame, from_, to) -> DataFrame:
    return bucket_series(ad_report(ad_daily, from_, to)["daily"], from_, to, ["impressions", "clicks"])
