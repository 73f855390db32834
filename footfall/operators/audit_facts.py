"""On-page facts and issues.

Only reading the markup is Python (a small parser inside ``mapInPandas``, one page at a time); links, URLs
and every rule are column expressions on the facts it returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.urls import bare_host, normalize_url, url_host, url_path

# Limits of the page rules.
SLOW_MS = 1500
LARGE_BYTES = 1048576
TITLE_MAX, TITLE_MIN = 60, 20
DESCRIPTION_MIN, DESCRIPTION_MAX = 70, 160
MIN_WORDS = 250
SUBHEADING_WORDS = 600
SKIP_SCHEMES = r"(?i)^(mailto|tel|sms|javascript|data|whatsapp|skype):"
SKIP_PATHS = r"/(wp-admin|wp-login\.php|wp-json|xmlrpc\.php|feed)(/|$)"
SKIP_EXTENSIONS = (
    r"(?i)\.(jpg|jpeg|png|gif|webp|avif|svg|ico|pdf|zip|rar|7z|mp3|mp4|mov|webm|css|js|json|xml|txt|doc|docx"
    r"|xls|xlsx|ppt|pptx|csv)$"
)
WORD = re.compile(r"[^\W_](?:[^\W_]|['’-])*")
SILENT = {"script", "style", "noscript", "template", "svg"}
VOID = {"br", "img", "input", "meta", "link", "hr", "source", "area", "base", "col", "embed", "param", "track", "wbr"}
ASSETS = {"img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src"}

# Elements that may stand in a head whose tags are left out.
HEAD = {"html", "head", "title", "base", "link", "meta", "script", "style", "noscript", "template"}

FACT_COLUMNS = (
    "title string, description string, h1_count int, h1 string, h2_count int, words int, images int, "
    "images_no_alt int, lang string, viewport string, robots string, canonical string, og_title string, "
    "og_image string, json_ld int, itemtypes int, insecure int, hrefs array<string>, read_error string"
)


class _Facts(HTMLParser):
    """Counts and texts of one page.

    The tags of head and body may be left out: a page begins in its head, and leaves it at the first tag or text that
    cannot stand there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: dict[str, int] = {}
        self.in_head = True
        self.meta: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {"title": [], "h1": []}
        self.n = dict.fromkeys(["title", "h1", "h2", "img", "no_alt", "json_ld", "itemtype", "insecure", "words"], 0)
        self.lang = self.canonical = None
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag not in HEAD:
            self.in_head = False
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang", "")
        elif tag == "meta":
            for kind in ("name", "property"):
                if kind in a:
                    self.meta.setdefault(f"{kind}:{a[kind].lower()}", a.get("content", "").strip())
        elif tag == "link":
            if self.in_head and a.get("rel", "").lower() == "canonical" and self.canonical is None:
                self.canonical = a.get("href", "").strip()
            self.n["insecure"] += a.get("rel") == "stylesheet" and a.get("href", "").startswith("http://")
        elif tag == "img" and not self.in_head:
            self.n["img"] += 1
            self.n["no_alt"] += "alt" not in a and a.get("role") != "presentation" and a.get("aria-hidden") != "true"
        elif tag == "script":
            self.n["json_ld"] += a.get("type") == "application/ld+json"
        elif tag == "a" and "href" in a and not self.in_head:
            self.hrefs.append(a["href"].strip())
        if tag in ("h1", "h2") or tag == "title" and not self.open.get("svg"):
            self.n[tag] += 1
        self.n["itemtype"] += "itemtype" in a
        self.n["insecure"] += a.get(ASSETS.get(tag, ""), "").startswith("http://")
        if tag not in VOID:
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
        if self.open.get(tag):
            self.open[tag] -= 1

    def handle_data(self, data):
        if self.in_head and data.strip() and not any(self.open.get(t) for t in ("title", *SILENT)):
            self.in_head = False
        for tag in ("title", "h1"):
            if self.open.get(tag) and self.n[tag] == 1 and not (tag == "title" and self.open.get("svg")):
                self.texts[tag].append(data)
        if not self.in_head and not self.open.get("title") and not any(self.open.get(t) for t in SILENT):
            self.n["words"] += len(WORD.findall(data))


def _line(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def _read(html: str) -> tuple:
    """Facts of a page, and why reading stopped early, if it did: one broken page never fails the others."""
    p, error = _Facts(), ""
    try:
        p.feed(html)
        p.close()
    except Exception as e:  # the parser raises bare assertions on marked sections it does not know
        error = f"{type(e).__name__}: {e}"[:200]
    m, n = p.meta, p.n
    return (
        _line(p.texts["title"]), m.get("name:description", ""), n["h1"], _line(p.texts["h1"]), n["h2"], n["words"],
        n["img"], n["no_alt"], p.lang or "", m.get("name:viewport", ""), m.get("name:robots", ""), p.canonical or "",
        m.get("property:og:title", ""), m.get("property:og:image", ""), n["json_ld"], n["itemtype"], n["insecure"],
        p.hrefs, error,
    )


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FACT_COLUMNS.split(", ")]
    for b in batches:
        rows = pd.DataFrame([_read(h) for h in b["html"]], columns=names, index=b.index)
        yield pd.concat([b.drop(columns=["html"]), rows], axis=1)


def _links(df: DataFrame) -> DataFrame:
    """links (distinct internal targets) and external_links (how many point elsewhere), over the whole page."""
    usable = F.filter("hrefs", lambda h: (h != "") & ~h.startswith("#") & ~h.rlike(SKIP_SCHEMES))
    absolute = F.filter(
        F.transform(usable, lambda h: normalize_url(h, F.col("url"))), lambda u: u.rlike("(?i)^https?://")
    )
    df = df.withColumn("_host", bare_host(url_host("url")))
    df = df.withColumn(
        "_tagged",
        F.transform(
            absolute,
            lambda u: F.struct(
                u.alias("u"),
                (bare_host(url_host(u)) == F.col("_host")).alias("inside"),
                (
                    ~url_path(u).rlike(SKIP_PATHS) & ~url_path(u).rlike(SKIP_EXTENSIONS) & (u != F.col("self_url"))
                ).alias("page"),
            ),
        ),
    )
    inner = F.array_distinct(
        F.transform(F.filter("_tagged", lambda t: t["inside"] & t["page"]), lambda t: t["u"])
    )
    return (
        df.withColumn("links", inner)
        .withColumn("external_links", F.size(F.filter("_tagged", lambda t: ~t["inside"])))
        .drop("_host", "_tagged", "hrefs")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of each page: needs page_id, url, html, status_code, response_ms, source (and post_id, if any).

    Pages that were not answered with content carry no facts beyond size and status. Only html goes through
    Python; batches are cut by size, because pages are large.
    """
    base = pages.withColumn("html", F.coalesce("html", F.lit("")))
    base = base.withColumn("html_bytes", F.octet_length("html")).withColumn(
        "has_content", ((F.col("status_code") > 0) & (F.col("status_code") < 300) & (F.trim("html") != "")).cast("int")
    )
    text = F.when(F.col("has_content") == 1, F.col("html")).otherwise("")
    carried = [f for f in base.schema.fields if f.name != "html"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    parsed = base.withColumn("html", text).mapInPandas(_parse_batches, f"{ddl}, {FACT_COLUMNS}")
    df = parsed.withColumn("self_url", normalize_url("url", "url"))
    df = _links(df)
    canonical = F.when(F.col("canonical") != "", normalize_url("canonical", "url")).otherwise("")
    return df.withColumns(
        {
            "title_len": F.length("title"),
            "desc_len": F.length("description"),
            "noindex": F.lower("robots").contains("noindex").cast("int"),
            "og": ((F.col("og_title") != "") & (F.col("og_image") != "")).cast("int"),
            "canonical_url": canonical,
        }
    )


def share_words(a: Column, b: Column) -> Column:
    """Whether two texts have a word of three or more letters or digits in common."""
    pattern = r"([\p{L}\p{N}]{3,})"
    wa, wb = (F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(1)) for x in (a, b))
    return F.arrays_overlap(wa, wb)


def issue_rules() -> list[tuple[str, Column, Column]]:
    """(code, condition, detail) of every rule that needs nothing but the page itself."""
    c = F.col
    one = F.lit("1")
    status, ms, words = c("status_code"), c("response_ms"), c("words")
    live = c("has_content") == 1
    has_desc = c("description") != ""

    def num(name: str) -> Column:
        return c(name).cast("string")

    return [
        ("fetch_failed", status == 0, one),
        ("http_5xx", status >= 500, num("status_code")),
        ("http_4xx", status.between(400, 499), num("status_code")),
        ("redirect", status.between(300, 399), num("status_code")),
        ("slow_response", live & (ms > SLOW_MS), num("response_ms")),
        ("large_html", live & (c("html_bytes") > LARGE_BYTES), num("html_bytes")),
        ("title_missing", live & (c("title") == ""), one),
        ("title_too_long", live & (c("title_len") > TITLE_MAX), num("title_len")),
        ("title_too_short", live & c("title_len").between(1, TITLE_MIN - 1), num("title_len")),
        ("meta_description_missing", live & ~has_desc, one),
        (
            "meta_description_length",
            live & has_desc & ~c("desc_len").between(DESCRIPTION_MIN, DESCRIPTION_MAX),
            num("desc_len"),
        ),
        ("h1_missing", live & (c("h1_count") == 0), one),
        ("multiple_h1", live & (c("h1_count") > 1), num("h1_count")),
        (
            "title_h1_unrelated",
            live & (c("title") != "") & (c("h1") != "") & ~share_words(c("title"), c("h1")),
            one,
        ),
        ("low_word_count", live & (c("source") == "content") & (words < MIN_WORDS), num("words")),
        ("no_subheadings", live & (words > SUBHEADING_WORDS) & (c("h2_count") == 0), num("words")),
        ("images_missing_alt", live & (c("images_no_alt") > 0), num("images_no_alt")),
        ("lang_missing", live & (c("lang") == ""), one),
        ("viewport_missing", live & (c("viewport") == ""), one),
        ("noindex", live & (c("noindex") == 1), one),
        ("canonical_missing", live & (c("canonical") == ""), one),
        (
            "canonical_elsewhere",
            live & (c("canonical") != "") & (c("canonical_url") != c("self_url")),
            c("canonical"),
        ),
        ("open_graph_missing", live & (c("og") == 0), one),
        ("no_structured_data", live & (c("json_ld") == 0) & (c("itemtypes") == 0), one),
        (
            "mixed_content",
            live & F.lower("url").startswith("https://") & (c("insecure") > 0),
            num("insecure"),
        ),
        ("no_internal_links", live & (F.size("links") == 0), one),
    ]


def page_issues(facts: DataFrame) -> DataFrame:
    """Adds ``issues``, a map from issue code to its detail."""
    entries = F.array(
        *[
            F.when(cond, F.struct(F.lit(code).alias("key"), detail.alias("value")))
            for code, cond, detail in issue_rules()
        ]
    )
    return facts.withColumn("issues", F.map_from_entries(F.array_compact(entries)))


def link_edges(facts: DataFrame) -> DataFrame:
    """(page_id, src_url, dst_url) of every internal link."""
    return facts.select("page_id", F.col("self_url").alias("src_url"), F.explode("links").alias("dst_url"))
