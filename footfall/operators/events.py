"""Event validation and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.text import contains_pii, scrub_pii, slug, strip_tags
from footfall.functions.times import col, let, plus_seconds

MAX_EVENTS = 25
MAX_ATTRIBUTES = 25
MAX_LIST = 10
MAX_STRING = 200
LEAD_PATTERN = r"^[A-Z]{2,5}-[A-Z0-9]{5,10}$"
MAX_DELAY_MS = 600000
MAX_HEARTBEAT = 300
EVENT_NAME = r"^[a-z][a-z0-9_]{1,63}$"
ATTRIBUTE_NAME = r"^[a-z][a-z0-9_]{0,39}$"

# Built-in events as name -> (category, module, counts as a conversion).
REGISTRY: dict[str, tuple[str, str, bool]] = {
    "page_view": ("page", "core", False),
    "page_engagement": ("engagement", "core", False),
    "outbound_click": ("navigation", "core", False),
    "file_download": ("download", "core", False),
    "contact_click": ("contact", "core", False),
    "cta_click": ("cta", "core", False),
    "site_search": ("search", "core", False),
    "page_not_found": ("error", "core", False),
    "js_error": ("error", "core", False),
    "web_vitals": ("performance", "core", False),
    "video_start": ("video", "core", False),
    "video_progress": ("video", "core", False),
    "video_complete": ("video", "core", False),
    "form_start": ("form", "core", False),
    "form_abandon": ("form", "core", False),
    "form_submit": ("form", "core", True),
    "click": ("interaction", "core", False),
    "rage_click": ("interaction", "core", False),
    "dead_click": ("interaction", "core", False),
    "copy_text": ("interaction", "core", False),
    "ad_impression": ("advertising", "local_ads", False),
    "ad_click": ("advertising", "local_ads", False),
}
# Attribute names that are never stored, and parts of names that are never stored.
FORBIDDEN_KEYS = [
    "name", "first_name", "last_name", "full_name", "fullname", "surname", "firstname", "lastname", "address",
    "street", "street_address", "postcode", "zip", "zipcode", "dob", "birthday", "birth_date", "date_of_birth",
    "ip", "ip_address", "user_agent", "username", "user_login",
]
FORBIDDEN_TOKENS = [
    "email", "phone", "mobile", "passport", "password", "passwd", "card_number", "cardnumber", "cvv", "cvc",
    "iban", "ssn", "national_id", "id_number", "tax_id", "document_number", "token", "secret",
]

Registry = dict[str, tuple[str, str, bool]]


def with_extra(extra: Registry | None) -> Registry:
    return {**REGISTRY, **(extra or {})}


def event_registry(spark: SparkSession, extra: Registry | None = None) -> DataFrame:
    rows = [(n, c, m, int(v)) for n, (c, m, v) in with_extra(extra).items()]
    return spark.createDataFrame(rows, "event_name string, category string, module string, conversion int")


def registry_map(registry: Registry) -> Column:
    """The registry as one map literal: a setting of a few dozen rows, looked up without a join."""
    parts = []
    for n, (c, m, v) in registry.items():
        parts += [F.lit(n), F.struct(F.lit(c).alias("category"), F.lit(m).alias("module"), F.lit(int(v)).alias("conversion"))]
    return F.create_map(*parts)


def event_name(c: str | Column) -> Column:
    """Normalised event name, NULL when it is not usable."""
    n = F.lower(F.trim(col(c)))
    return F.when(n.rlike(EVENT_NAME), n)


def cap_batch(hits: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    return hits.withColumn("e", F.slice("e", 1, n))


def valid_events(hits: DataFrame) -> DataFrame:
    """Keeps the events of each payload whose name is usable, with that name normalised."""
    named = F.transform(
        F.coalesce("e", F.array().cast(hits.schema["e"].dataType)),
        lambda e: e.withField("n", event_name(e["n"])),
    )
    return hits.withColumn("e", F.filter(named, lambda e: e["n"].isNotNull()))


def count_events(hits: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Adds n_events, n_pageviews, n_conversions and has_pageview from the payload's event list."""
    converting = [n for n, (_, _, v) in registry.items() if v]
    views = F.size(F.filter("e", lambda e: e["n"] == "page_view"))
    return hits.withColumns(
        {
            "n_events": F.size("e").cast("bigint"),
            "n_pageviews": views.cast("bigint"),
            "n_conversions": F.size(F.filter("e", lambda e: e["n"].isin(converting))).cast("bigint"),
            "has_pageview": views > 0,
        }
    )


def heartbeat(df: DataFrame, source: str = "hb") -> DataFrame:
    """Engaged seconds of one payload, 0..300."""
    seconds = F.floor(col(source).try_cast("double")).cast("bigint")
    return df.withColumn("heartbeat", F.greatest(F.lit(0), F.least(F.lit(MAX_HEARTBEAT), F.coalesce(seconds, F.lit(0)))).cast("bigint"))


def event_time(df: DataFrame, delay: str = "d") -> DataFrame:
    """occurred_at = received_at minus the client's delay, clamped to ten minutes."""
    ms = F.greatest(F.lit(0), F.least(F.lit(MAX_DELAY_MS), F.coalesce(F.col(delay), F.lit(0))))
    return df.withColumn("occurred_at", plus_seconds("received_at", -F.floor(ms / 1000)))


def forbidden_key(k: Column) -> Column:
    return k.isin(FORBIDDEN_KEYS) | k.rlike("|".join(FORBIDDEN_TOKENS))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def _scalar(v: Column, kind: Column, max_string: int = MAX_STRING) -> Column:
    """JSON text of one attribute value, NULL when it is not storable."""
    number = F.round(F.try_variant_get(v, "$", "double"), 6)

    def stored(text: Column) -> Column:
        return F.when((text != "") & ~contains_pii(text), _quoted(F.left(scrub_pii(text), F.lit(max_string))))

    return (
        F.when(kind == "STRING", let(F.trim(strip_tags(F.try_variant_get(v, "$", "string"))), stored))
        .when(kind.isin("BOOLEAN", "BIGINT"), F.try_variant_get(v, "$", "string"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.regexp_replace(F.to_json(F.array(number)), r"[\[\]]", ""))
    )


def clean_attributes_of(
    json: str | Column, max_keys: int = MAX_ATTRIBUTES, max_list: int = MAX_LIST, max_string: int = MAX_STRING
) -> Column:
    """Filtered attributes as JSON text, '{}' for none. Keys keep their order; the first ``max_keys`` kept count, of a
    list the first ``max_list`` items, of a text the first ``max_string`` characters."""
    src = col(json)
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.coalesce(F.json_object_keys(src), none))

    def value(v: Column) -> Column:
        def typed(kind: Column) -> Column:
            many = F.filter(
                F.transform(
                    F.slice(v.try_cast("array<variant>"), 1, max_list), lambda x: _scalar(x, F.schema_of_variant(x), max_string)
                ),
                lambda x: x.isNotNull(),
            )
            listed = let(many, lambda m: F.when(F.size(m) > 0, F.concat(F.lit("["), F.array_join(m, ","), F.lit("]"))))
            return F.when(kind.startswith("ARRAY"), listed).otherwise(_scalar(v, kind, max_string))

        return let(F.schema_of_variant(v), typed)

    def entries(values: Column) -> Column:
        def entry(k: Column) -> Column:
            low = F.lower(k)
            ok = low.rlike(ATTRIBUTE_NAME) & ~forbidden_key(low)
            body = let(F.element_at(values, k), value)
            return F.when(ok, F.concat(F.lit('"'), low, F.lit('":'), body))

        return F.filter(F.transform(names, entry), lambda x: x.isNotNull())

    kept = F.slice(let(F.try_parse_json(src).try_cast("map<string,variant>"), entries), 1, max_keys)
    return F.concat(F.lit("{"), F.array_join(F.coalesce(kept, none), ","), F.lit("}"))


def clean_attributes(
    events: DataFrame, max_keys: int = MAX_ATTRIBUTES, column: str = "attributes", max_list: int = MAX_LIST, max_string: int = MAX_STRING
) -> DataFrame:
    return events.withColumn(column, clean_attributes_of(column, max_keys, max_list, max_string))


def _key(c: Column, size: int, fallback: str) -> Column:
    k = slug(F.coalesce(c, F.lit("")), size)
    return F.when(k == "", fallback).otherwise(k)


def normalise_events(
    events: DataFrame, registry: Registry = REGISTRY, base_currency: str = "USD", lead_pattern: str = LEAD_PATTERN
) -> DataFrame:
    """Typed event columns from raw ones (n, c, m, et, ei, v, cu, lr, a). Rows with an unusable name go; a lead
    reference stays when it matches ``lead_pattern``."""
    known = registry_map(registry)[F.col("event_name")]
    value = F.col("v").try_cast("double")
    value = F.when((F.abs(value) < 1e12) & ~F.isnan(value), F.round(value.cast("decimal(30,10)"), 4).cast("decimal(18,4)"))
    code = F.upper(F.trim(F.coalesce("cu", F.lit(""))))
    return (
        events.withColumn("event_name", event_name("n"))
        .where(F.col("event_name").isNotNull())
        .withColumns(
            {
                "category": F.coalesce(known["category"], _key(F.col("c"), 32, "custom")),
                "module": F.coalesce(known["module"], _key(F.col("m"), 32, "core")),
                "is_conversion": F.coalesce(known["conversion"], F.lit(0)),
                "entity_type": _key(F.col("et"), 32, ""),
                "entity_id": F.when(F.col("ei").rlike(r"^[A-Za-z0-9_\-.:]{1,64}$"), F.col("ei")).otherwise(""),
                "event_value": value,
                "lead_ref": F.when(F.col("lr").rlike(lead_pattern), F.col("lr")).otherwise(""),
                "attributes": clean_attributes_of("a"),
            }
        )
        .withColumn(
            "currency",
            F.when(F.col("event_value").isNull(), "").when(code.rlike("^[A-Z]{3}$"), code).otherwise(base_currency),
        )
        .drop("n", "c", "m", "et", "ei", "v", "cu", "lr", "a")
    )


def exclude_roles(df: DataFrame, roles: Sequence[str], column: str = "roles") -> DataFrame:
    """Drops rows sent by staff: anyone with one of the excluded roles."""
    staff = F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*[F.lit(r) for r in roles]).cast("array<string>"))
    return df.where(~staff)
