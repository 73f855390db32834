"""Payload enrichment: the columns a session or event row needs, each computed from the raw hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.agents import user_agent
from footfall.functions.measures import language, viewport_bucket
from footfall.functions.privacy import CLIENT_ID, visitor_key
from footfall.functions.text import clean_line, scrub_pii, slug
from footfall.functions.urls import campaign, click_id, parse_url, referrer
from footfall.operators.events import REGISTRY, Registry, cap_batch, count_events, heartbeat, valid_events
from footfall.settings import Settings

MAX_HEAT_POINTS = 300
MAX_HEAT_X = 99
MAX_HEAT_Y = 999


def identity_mode(hits: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``enhanced`` and id_mode: a first-party id counts only in enhanced mode, valid and without opt-out."""
    allowed = F.lit(settings.privacy_mode == "enhanced")
    if settings.respect_gpc:
        allowed = allowed & ~F.coalesce("gpc", F.lit(False))
    on = F.coalesce(allowed & F.col("vid").rlike(CLIENT_ID), F.lit(False))
    return hits.withColumn("enhanced", on).withColumn("id_mode", on.cast("int"))


def heat_list(hm: str | Column, most: int = MAX_HEAT_POINTS) -> Column:
    """Usable [x, y] points of a payload: of its first ``most``, those that are whole numbers inside the grid."""
    c = F.col(hm) if isinstance(hm, str) else hm
    raw = F.slice(F.coalesce(F.from_json(c, "array<array<string>>"), F.array().cast("array<array<string>>")), 1, most)
    pts = F.transform(
        raw,
        lambda p: F.struct(
            F.get(p, F.lit(0)).try_cast("double").cast("int").alias("x"),
            F.get(p, F.lit(1)).try_cast("double").cast("int").alias("y"),
        ),
    )
    return F.filter(pts, lambda p: p["x"].between(0, MAX_HEAT_X) & p["y"].between(0, MAX_HEAT_Y))


def heat_points(hits: DataFrame, most: int = MAX_HEAT_POINTS) -> DataFrame:
    """One row per usable heat point: received_at, page_path, device, x, y."""
    rows = hits.select("received_at", "page_path", "user_agent", "ch_platform", "tp", heat_list("hm", most).alias("_l"))
    rows = user_agent(rows.where(F.size("_l") > 0))
    return rows.select("received_at", "page_path", F.col("device_type").alias("device"), F.inline("_l"))


# Text keys of the page context with their longest length.
CONTEXT_TEXT = {"t": 20, "tpl": 64, "b": 20, "k": 20, "r": 32}
CONTEXT_IN = (
    "k string, p string, t string, a string, pd string, md string, b string, tpl string, l string, li string, "
    "r string, tx map<string,array<string>>, q struct<tax:string,term:string,author:string>"
)


def _positive(c: Column) -> Column:
    n = c.try_cast("double").cast("bigint")
    return F.when(n > 0, n)


def _text_key(c: Column, size: int) -> Column:
    return F.nullif(slug(c, size), F.lit(""))


def _taxonomies(tx: Column) -> Column:
    """At most 10 taxonomies with at most 20 positive ids each; empty ones are left out."""
    pairs = F.transform(
        F.slice(F.map_entries(tx), 1, 10),
        lambda e: F.struct(
            slug(e["key"], 32).alias("key"),
            F.filter(
                F.transform(F.slice(e["value"], 1, 20), lambda v: v.try_cast("bigint")), lambda v: v > 0
            ).alias("value"),
        ),
    )
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & (F.size(e["value"]) > 0))
    names = F.transform(pairs, lambda e: e["key"])
    pairs = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def page_context(df: DataFrame, source: str = "c") -> DataFrame:
    """Adds ``context``, a struct of the checked page-context keys (NULL where missing or not usable)."""
    raw = F.from_json(F.col(source), CONTEXT_IN)
    df = df.withColumn("_c", raw)
    c = F.col("_c")
    day = r"^\d{4}-\d{2}-\d{2}$"
    query = F.struct(
        slug(c["q"]["tax"], 32).alias("tax"),
        c["q"]["term"].try_cast("bigint").alias("term"),
        c["q"]["author"].try_cast("bigint").alias("author"),
    )
    has_query = F.coalesce(c["q"]["tax"], c["q"]["term"], c["q"]["author"]).isNotNull()
    parts = [_positive(c["p"]).alias("p"), _positive(c["a"]).alias("a")]
    parts += [_text_key(c[k], n).alias(k) for k, n in CONTEXT_TEXT.items()]
    parts += [F.when(c[k].rlike(day), c[k]).alias(k) for k in ("pd", "md")]
    parts += [
        F.when(c["l"].rlike(r"^[a-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})?$"), c["l"]).alias("l"),
        F.when(c["li"].isNotNull(), (~c["li"].isin("", "0", "false")).cast("int")).alias("li"),
        _taxonomies(c["tx"]).alias("tx"),
        F.when(has_query, query).alias("q"),
    ]
    return df.withColumn("context", F.struct(*parts)).drop("_c")


def enrich(
    hits: DataFrame,
    settings: Settings,
    salts: DataFrame,
    registry: Registry = REGISTRY,
    zones: DataFrame | None = None,
) -> DataFrame:
    """All row-level columns of a payload; the only join is the salt of the day."""
    df = parse_url(hits) if settings.identity_params is None else parse_url(hits, names=settings.identity_params)
    df = identity_mode(df, settings)
    df = visitor_key(df, salts, settings.site_salt, settings.site)
    df = count_events(valid_events(cap_batch(df)), registry)
    df = heartbeat(df)
    df = df.withColumn("n_heat", F.size(heat_list("hm")).cast("bigint"))
    df = page_context(df)
    df = df.withColumn("_click", click_id("query_params")).withColumn("_ref", referrer("r", settings.hosts))
    df = df.select("*", *campaign("query_params"))
    df = df.withColumns(
        {
            "click_id_type": F.col("_click.type"),
            "click_id": F.when(F.col("enhanced"), F.col("_click.value")).otherwise(""),
            "referrer_domain": F.col("_ref.domain"),
            "referrer_url": F.col("_ref.url"),
            "page_title": F.left(scrub_pii(clean_line(F.coalesce("ti", F.lit("")))), F.lit(255)),
            "viewport": viewport_bucket("vw"),
            "language": language(F.coalesce("lg", F.lit(""))),
            "post_id": F.coalesce("context.p", F.lit(0)).cast("bigint"),
            "post_type": F.coalesce("context.t", F.lit("")),
            "is_logged_in": F.coalesce("context.li", F.lit(0)),
            "landing_path": F.col("page_path"),
            "landing_post_id": F.coalesce("context.p", F.lit(0)).cast("bigint"),
        }
    ).drop("_click", "_ref")
    if zones is not None:
        from footfall.functions.measures import timezone

        df = timezone(df, zones)
    return df
