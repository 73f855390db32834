"""URL handling on columns. URLs are split with the generic-syntax pattern, which never rejects a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import clean_line, scrub_pii
from footfall.functions.times import col, let

# Parameter names with a meaning, in order of precedence.
UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
CLICK_IDS = ["gclid", "gbraid", "wbraid", "fbclid", "msclkid", "ttclid"]
IDENTITY_PARAMS = [
    "p", "page_id", "cat", "tag", "author", "post_type", "product", "product_cat", "paged", "lang",
]
REFERRER_SCHEMES = ["http", "https", "android-app"]
CONTACT_SCHEMES = {
    "tel": "phone", "mailto": "email", "sms": "sms",
    "whatsapp": "whatsapp", "skype": "skype", "viber": "viber",
}
DOWNLOAD_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "txt", "zip", "rar", "7z", "epub", "mp3", "mp4",
    "mov", "gpx", "kml", "apk", "dmg", "exe",
]

# Generic URI syntax (RFC 3986, appendix B) and its authority part.
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
AUTHORITY = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$"


def url_scheme(u: str | Column) -> Column:
    return F.regexp_extract(col(u), URI, 1)


def url_authority(u: str | Column) -> Column:
    return F.regexp_extract(col(u), URI, 2)


def url_host(u: str | Column) -> Column:
    return F.regexp_extract(url_authority(u), AUTHORITY, 1)


def url_port(u: str | Column) -> Column:
    return F.regexp_extract(url_authority(u), AUTHORITY, 2)


def url_path(u: str | Column) -> Column:
    return F.regexp_extract(col(u), URI, 3)


def url_query(u: str | Column) -> Column:
    return F.regexp_extract(col(u), URI, 4)


def bare_host(host: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(host)), r"^www\.", "")


def decode_path(c: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def query_map(query: str | Column) -> Column:
    """Lower-cased name -> decoded value. A repeated name keeps its last value; list names are left out."""
    pairs = F.transform(
        F.filter(F.split(col(query), "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit(""))).alias("k"),
            F.when(
                p.contains("="),
                F.coalesce(
                    F.try_url_decode(F.regexp_replace(p, r"^[^=]*=", "")),
                    F.regexp_replace(p, r"^[^=]*=", ""),
                ),
            ).otherwise(F.lit("")).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & ~p["k"].contains("["))

    def last_of_each(ps: Column) -> Column:
        names = F.transform(ps, lambda p: p["k"])
        return F.filter(ps, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["k"]))

    some = F.map_from_entries(let(pairs, last_of_each))
    return F.when(col(query) == "", F.create_map().cast("map<string,string>")).otherwise(some)


def clean_path(c: str | Column) -> Column:
    """Display path: one leading slash, no doubles, decoded, redacted, no control characters."""
    p = F.concat(F.lit("/"), F.regexp_replace(col(c), "^/+", ""))
    p = scrub_pii(decode_path(F.regexp_replace(p, "/{2,}", "/")))
    return F.left(F.regexp_replace(p, r"[\x00-\x1F\x7F]", ""), F.lit(512))


def identity_query(params: str | Column, names: Sequence[str] = IDENTITY_PARAMS) -> Column:
    """Query string made of the parameters that name a distinct page, '' when there are none."""
    m = col(params)
    kept = [
        F.when(m[n].rlike(r"^[A-Za-z0-9_\-]{1,64}$"), F.concat(F.lit(f"{n}="), m[n])) for n in names
    ]
    return F.when(F.size(m) > 0, F.concat_ws("&", *kept)).otherwise("")


def page_path(path: str | Column, params: str | Column, names: Sequence[str] = IDENTITY_PARAMS) -> Column:
    base = clean_path(F.when(col(path) == "", "/").otherwise(col(path)))
    q = identity_query(params, names)
    tail = let(q, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise(""))
    return F.left(F.concat(base, tail), F.lit(512))


def parse_url(df: DataFrame, url: str = "u", names: Sequence[str] = IDENTITY_PARAMS) -> DataFrame:
    """Adds host, query_params and page_path; ``names`` are the parameters that tell pages of one path apart."""
    return (
        df.withColumn("host", F.lower(url_host(F.coalesce(F.col(url), F.lit("")))))
        .withColumn("query_params", query_map(url_query(F.coalesce(F.col(url), F.lit("")))))
        .withColumn("page_path", page_path(url_path(F.coalesce(F.col(url), F.lit(""))), "query_params", names))
    )


def campaign(params: str | Column) -> list[Column]:
    """The five campaign columns, '' where the parameter is missing."""
    m = col(params)
    return [
        F.when(F.coalesce(m[k], F.lit("")) == "", "").otherwise(F.left(scrub_pii(clean_line(m[k])), F.lit(191))).alias(k)
        for k in UTM_KEYS
    ]


def click_id(params: str | Column) -> Column:
    """Struct of the first ad click identifier with a plausible value."""
    m = col(params)
    ok = [m[k].rlike(r"^[A-Za-z0-9_\-.~]{1,255}$") for k in CLICK_IDS]
    return F.coalesce(
        *[
            F.when(o, F.struct(F.lit(k).alias("type"), m[k].alias("value")))
            for k, o in zip(CLICK_IDS, ok)
        ],
        F.struct(F.lit("").alias("type"), F.lit("").alias("value")),
    )


def referrer(url: str | Column, hosts: Sequence[str] = ()) -> Column:
    """Struct(domain, url). Blank for other schemes and for the site's own hosts; the query is dropped."""
    u = F.coalesce(col(url), F.lit(""))
    scheme, host = url_scheme(u), F.lower(url_host(u))
    path = url_path(u)
    domain = bare_host(host)
    ok = (host != "") & scheme.isin(REFERRER_SCHEMES)
    if hosts:
        ok = ok & ~domain.isin(list(hosts))
    full = F.concat(scheme, F.lit("://"), host, clean_path(F.when(path == "", "/").otherwise(path)))
    return F.struct(
        F.when(ok, F.left(domain, F.lit(191))).otherwise("").alias("domain"),
        F.when(ok, F.left(full, F.lit(1024))).otherwise("").alias("url"),
    )


def _resolve_dots(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(kept, "/")


def _absolute(href: Column, base: Column) -> Column:
    scheme = F.when(url_scheme(base) == "", "https").otherwise(url_scheme(base))
    origin = F.concat(scheme, F.lit("://"), F.regexp_replace(url_authority(base), "^[^@]*@", ""))
    folder = F.when(url_path(base) == "", "/").otherwise(F.regexp_replace(url_path(base), "/[^/]*$", "/"))
    return (
        F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(~href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), F.concat(origin, folder, href))
        .otherwise(href)
    )


def _closed(path: Column) -> Column:
    """A trailing slash unless the last segment looks like a file."""
    p = F.when(path == "", "/").otherwise(path)
    file = F.regexp_extract(p, r"([^/]*)/*$", 1).contains(".")
    return F.when((p == "/") | file, p).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/")))


def _canonical(a: Column) -> Column:
    """Scheme and host in lower case, dot segments resolved; what has no host stays as it is."""
    port, query = url_port(a), url_query(a)
    path = let(_resolve_dots(F.when(url_path(a) == "", "/").otherwise(url_path(a))), _closed)
    full = F.concat(
        F.lower(url_scheme(a)), F.lit("://"), F.lower(url_host(a)),
        F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
        path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url_host(a) == "", a).otherwise(full)


def normalize_url(href: str | Column, base: str | Column) -> Column:
    """Absolute form used to compare URLs. ``href`` must already have its entities decoded."""
    base = col(base)

    def resolve(h: Column) -> Column:
        full = let(_absolute(h, base), _canonical)
        return F.when(h == "", F.lit("")).when(url_host(base) == "", h).otherwise(full)

    return let(F.regexp_replace(F.trim(col(href)), r"(?s)#.*$", ""), resolve)


def path_of(url: str | Column) -> Column:
    p, q = url_path(url), url_query(url)
    return F.concat(
        F.when(p == "", "/").otherwise(p), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    )


def path_key(path: str | Column) -> Column:
    k = F.lower(F.regexp_replace(col(path), r"[/\\]+$", ""))
    return F.when(k == "", "/").otherwise(k)


def path_matches(path: str | Column, patterns: Sequence[str]) -> Column:
    """Whether a path matches a wildcard pattern in full, ignoring case."""
    hit = F.lit(False)
    for p in patterns:
        body = "".join(".*" if ch == "*" else "\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in p)
        hit = hit | col(path).rlike(f"(?i)^{body}$")
    return hit


def classify_links(clicks: DataFrame, extensions: Sequence[str] = DOWNLOAD_EXTENSIONS) -> DataFrame:
    """Adds link_class (contact, download, outbound or '') and contact_method to rows of (href, host)."""
    href = F.trim(F.col("href"))
    scheme = F.lower(url_scheme(href))
    host = F.lower(url_host(href))
    file = F.regexp_extract(url_path(href), r"([^/]*)$", 1)
    ext = F.when(file.contains("."), F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1))).otherwise("")
    web = scheme.isin("http", "https") | ((scheme == "") & (href != ""))
    method = F.lit("")
    for s, name in CONTACT_SCHEMES.items():
        method = F.when(scheme == s, name).otherwise(method)
    method = (
        F.when(web & host.rlike(r"(^|\.)m\.me$"), "messenger")
        .when(web & host.rlike(r"(^|\.)t\.me$"), "telegram")
        .when(web & host.rlike(r"(^|\.)(wa\.me|whatsapp\.com)$"), "whatsapp")
        .otherwise(method)
    )
    cls = (
        F.when(method != "", "contact")
        .when(web & ext.isin(list(extensions)), "download")
        .when(web & (host != "") & (host != F.lower(F.col("host"))), "outbound")
        .otherwise("")
    )
    return clicks.withColumn("contact_method", method).withColumn("link_class", cls)
