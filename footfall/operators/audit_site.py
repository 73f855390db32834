"""Cross-page audit: link graph, duplicates, severity, health and the audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import day_lit
from footfall.functions.urls import normalize_url, path_key, path_of, url_scheme

# Issue code -> (severity, category, scope, short title, what to do).
CATALOG: dict[str, tuple[str, str, str, str, str]] = {
    "http_4xx": ("error", "technical", "page", "Answers with a 4xx error", "Bring the page back or redirect it, and update links to it."),
    "http_5xx": ("error", "technical", "page", "Answers with a 5xx error", "Look in the server's error log for this address."),
    "fetch_failed": ("error", "technical", "page", "Could not be fetched", "Check that the page loads and that the crawler is not blocked."),
    "title_missing": ("error", "technical", "page", "No title", "Give the page a title element."),
    "title_duplicate": ("error", "technical", "page", "Title used by several pages", "Write a title of its own for each page."),
    "broken_internal_links": ("error", "technical", "page", "Links to pages that fail", "Correct or remove the failing links."),
    "mixed_content": ("error", "ux", "page", "Insecure resources on a secure page", "Load every resource over https."),
    "meta_description_missing": ("warning", "serp", "page", "No meta description", "Add a summary of 70 to 160 characters."),
    "meta_description_duplicate": ("warning", "serp", "page", "Description used by several pages", "Describe each page on its own."),
    "title_too_long": ("warning", "serp", "page", "Title too long", "Stay below about 60 characters."),
    "title_too_short": ("warning", "content", "page", "Title too short", "Use 20 characters or more."),
    "h1_missing": ("warning", "content", "page", "No main heading", "Add one h1 that names the topic."),
    "low_word_count": ("warning", "content", "page", "Little text", "Add what visitors look for; aim for 250 words."),
    "images_missing_alt": ("warning", "semantic", "page", "Images without alternative text", "Describe the images."),
    "slow_response": ("warning", "ux", "page", "Slow answer", "Cache pages; aim for less than 1.5 seconds."),
    "large_html": ("warning", "ux", "page", "Very large markup", "Trim inline scripts, styles and markup."),
    "viewport_missing": ("warning", "ux", "page", "No viewport for phones", "Add a viewport meta element."),
    "lang_missing": ("warning", "semantic", "page", "Language not declared", "Set the lang attribute."),
    "orphan_page": ("warning", "strategy", "page", "No page links here", "Link to it from related pages."),
    "redirect": ("notice", "technical", "page", "Redirects", "Link to the final address."),
    "noindex": ("notice", "technical", "page", "Kept out of search", "Check that this is intended."),
    "canonical_missing": ("notice", "technical", "page", "No canonical address", "Declare the preferred address."),
    "canonical_elsewhere": ("notice", "technical", "page", "Canonical names another address", "Check that this is intended."),
    "multiple_h1": ("notice", "content", "page", "Several main headings", "Keep one h1."),
    "no_subheadings": ("notice", "content", "page", "Long text without subheadings", "Split the text with h2 headings."),
    "meta_description_length": ("notice", "serp", "page", "Description too short or too long", "Aim for 70 to 160 characters."),
    "no_structured_data": ("notice", "serp", "page", "No structured data", "Add JSON-LD or item types."),
    "open_graph_missing": ("notice", "serp", "page", "No sharing tags", "Add og:title and og:image."),
    "title_h1_unrelated": ("notice", "semantic", "page", "Title and heading share no word", "Use the topic in both."),
    "no_internal_links": ("notice", "strategy", "page", "No links to other pages", "Link to related pages."),
    "no_recent_visits": ("notice", "strategy", "page", "No visits in 28 days", "Improve, promote, merge or retire it."),
    "search_engines_blocked": ("error", "technical", "site", "Search engines are kept out", "Allow indexing once the site is live."),
    "robots_blocks_all": ("error", "technical", "site", "robots.txt blocks everything", "Remove the rule."),
    "no_https": ("warning", "ux", "site", "Not served over HTTPS", "Install a certificate."),
    "sitemap_missing": ("warning", "technical", "site", "No sitemap", "Publish a sitemap."),
    "plain_permalinks": ("warning", "technical", "site", "Plain addresses", "Use readable addresses."),
    "soft_404": ("warning", "technical", "site", "Missing pages answer with 200", "Answer with 404."),
    "debug_display": ("warning", "ux", "site", "Errors shown to visitors", "Log errors to a file."),
    "robots_missing": ("notice", "technical", "site", "No robots.txt", "Add one that names the sitemap."),
}
CATEGORIES = ["strategy", "technical", "content", "ux", "semantic", "serp"]
WINDOW_DAYS = 28


def catalog(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """The issue catalogue: a few dozen rows, so joining it never moves the other side."""
    rows = [(k, *v) for k, v in {**CATALOG, **(extra or {})}.items()]
    return spark.createDataFrame(rows, "code string, severity string, category string, scope string, title string, fix string")


def _ok() -> Column:
    return F.col("status_code").between(200, 299)


# ---- link graph ---------------------------------------------------------------------------------


def uncrawled_links(edges: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Internal targets that were not crawled, by number of linking pages: the next addresses to check, all of them
    unless a run's budget is given as ``limit``."""
    crawled = pages.select(F.col("self_url").alias("dst_url"))
    targets = edges.groupBy("dst_url").agg(F.count("*").alias("links"))
    rows = targets.join(crawled, "dst_url", "left_anti").orderBy(F.desc("links"), "dst_url")
    return rows if limit is None else rows.limit(limit)


def status_by_url(facts: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """url -> status of crawled pages and of separately checked links (which decide when both exist)."""
    rows = facts.select(F.col("self_url").alias("url"), "status_code", F.lit(0).alias("_p"), F.col("page_id").alias("_o"))
    if checked is not None:
        rows = rows.unionByName(checked.select("url", "status_code", F.lit(1).alias("_p"), F.lit(0).cast("bigint").alias("_o")))
    return rows.groupBy("url").agg(F.max_by("status_code", F.struct("_p", "_o")).alias("status_code"))


def link_status(edges: DataFrame, status: DataFrame) -> DataFrame:
    s = status.select(F.col("url").alias("dst_url"), F.col("status_code").alias("dst_status"))
    return edges.join(s, "dst_url", "left")


def inlinks(edges: DataFrame) -> DataFrame:
    """Pages linking to each target; edges that repeat a page and target count once."""
    return edges.select("page_id", "dst_url").distinct().groupBy("dst_url").agg(F.count("*").alias("inlinks"))


def broken_links(edges: DataFrame, status: DataFrame, listed: int | None = None) -> DataFrame:
    """Per page, its links that fail: all counted, and all listed unless ``listed`` says how many. A list holds the
    links of one page, so it is as long as the page. ``status`` has a row for each address, as ``status_by_url`` gives; links
    themselves are never broadcast, however short their pages are when stored."""
    failing = status.where((F.col("status_code") == 0) | (F.col("status_code") >= 400)).select(F.col("url").alias("dst_url"))
    bad = edges.join(failing, "dst_url", "left_semi")
    return bad.groupBy("page_id").agg(
        F.count("*").alias("broken"),
        (F.sort_array(F.collect_list("dst_url")) if listed is None else F.slice(F.sort_array(F.collect_list("dst_url")), 1, listed)).alias("listed"),
    )


def duplicate_text(facts: DataFrame, col: str) -> DataFrame:
    """Pages whose title or description is shared, with the number of sharers.

    Counted by grouping and joined back: a text that a third of all pages carry is combined before the shuffle. Merged, because
    the size of all texts is not known beforehand and must not be sent to every task.
    """
    key = F.lower(F.trim(F.col(col)))
    rows = facts.where(_ok() & (F.col("noindex") == 0) & (key != "")).select("page_id", key.alias("text"))
    shared = rows.groupBy("text").agg(F.count("*").alias("pages")).where(F.col("pages") > 1)
    return rows.join(shared.hint("merge"), "text").select("page_id", "text", "pages")


def orphans(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that no link leads to. Targets are made distinct first: what is left of them is known before it is joined."""
    rows = facts.where(_ok() & (F.col("source") != "home") & (F.col("noindex") == 0))
    linked = edges.select(F.col("dst_url").alias("self_url")).distinct()
    return rows.join(linked, "self_url", "left_anti").select("page_id", "self_url")


# ---- visits -------------------------------------------------------------------------------------


def recent_views(daily_content: DataFrame, today) -> DataFrame:
    """path key -> page views of the last 28 days."""
    rows = daily_content.where(F.col("day") >= F.date_sub(day_lit(today), WINDOW_DAYS - 1))
    return rows.groupBy(path_key("path").alias("path_key")).agg(F.sum("pageviews").alias("pageviews"))


def with_pageviews(pages: DataFrame, daily_content: DataFrame, today) -> DataFrame:
    key = path_key(path_of("url"))
    return (
        pages.withColumn("path_key", key)
        .join(recent_views(daily_content, today), "path_key", "left")
        .withColumn("pageviews", F.coalesce("pageviews", F.lit(0)))
        .drop("path_key")
    )


def unvisited(pages: DataFrame, daily_content: DataFrame, daily_traffic: DataFrame, today) -> DataFrame:
    """Pages without a view in 28 days; none at all while the history is shorter than that.

    The history check is an anti-join against a row that exists only when history is short.
    """
    since = F.date_sub(day_lit(today), WINDOW_DAYS - 1)
    seen = recent_views(daily_content, today).where(F.col("pageviews") > 0).select("path_key")
    first = daily_traffic.agg(F.min("day").alias("first"))
    short = first.where(F.col("first").isNull() | (F.col("first") > since)).select(F.lit(1).alias("_k"))
    return (
        pages.withColumn("path_key", path_key(path_of("url")))
        .join(seen, "path_key", "left_anti")
        .withColumn("_k", F.lit(1))
        .join(short, "_k", "left_anti")
        .drop("path_key", "_k")
    )


def no_recent_visits(facts: DataFrame, daily_content: DataFrame, daily_traffic: DataFrame, today) -> DataFrame:
    rows = facts.where(_ok() & (F.col("noindex") == 0))
    return unvisited(rows, daily_content, daily_traffic, today)


# ---- severity and health ------------------------------------------------------------------------


def issue_rows(pages: DataFrame) -> DataFrame:
    """(page_id, code, detail), one row per issue."""
    return pages.select("page_id", F.explode("issues").alias("code", "detail"))


def cross_page_issues(
    facts: DataFrame,
    edges: DataFrame,
    status: DataFrame,
    daily_content: DataFrame | None = None,
    daily_traffic: DataFrame | None = None,
    today=None,
) -> DataFrame:
    """Issues that need the other pages or the visit history, as (page_id, code, detail)."""
    live = facts.where(_ok()).select("page_id").distinct()
    parts = [
        broken_links(edges, status).join(live, "page_id", "left_semi").select(
            "page_id", F.lit("broken_internal_links").alias("code"), F.array_join("listed", " ").alias("detail")
        ),
        duplicate_text(facts, "title").select(
            "page_id", F.lit("title_duplicate").alias("code"), F.col("pages").cast("string").alias("detail")
        ),
        duplicate_text(facts, "description").select(
            "page_id", F.lit("meta_description_duplicate").alias("code"), F.col("pages").cast("string").alias("detail")
        ),
        orphans(facts, edges).select("page_id", F.lit("orphan_page").alias("code"), F.lit("1").alias("detail")),
    ]
    if daily_content is not None:
        parts.append(
            no_recent_visits(facts, daily_content, daily_traffic, today).select(
                "page_id", F.lit("no_recent_visits").alias("code"), F.lit("1").alias("detail")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_counts(issues: DataFrame, cat: DataFrame) -> DataFrame:
    """Errors, warnings and notices per page; a code outside the catalogue is a notice."""
    rows = issues.join(F.broadcast(cat.select("code", "severity")), "code", "left")  # catalogue: a few dozen rows
    sev = F.coalesce("severity", F.lit("notice"))
    return rows.groupBy("page_id").agg(
        F.sum((sev == "error").cast("int")).alias("errors"),
        F.sum((sev == "warning").cast("int")).alias("warnings"),
        F.sum((~sev.isin("error", "warning")).cast("int")).alias("notices"),
    )


def audited_pages(
    facts: DataFrame,
    checked_links: DataFrame | None = None,
    daily_content: DataFrame | None = None,
    daily_traffic: DataFrame | None = None,
    today=None,
    extra: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(pages with inlinks and severity counts, all issue rows) from facts with page issues. ``extra`` adds to the
    catalogue or replaces entries of it."""
    edges = _edges(facts)
    rows = issue_rows(facts).unionByName(
        cross_page_issues(facts, edges, status_by_url(facts, checked_links), daily_content, daily_traffic, today)
    )
    counts = severity_counts(rows, catalog(facts.sparkSession, extra))
    into = inlinks(edges).withColumnRenamed("dst_url", "self_url")
    zero = ["inlinks", "errors", "warnings", "notices"]
    pages = facts.drop("issues").join(into, "self_url", "left").join(counts, "page_id", "left").fillna(0, zero)
    return pages.withColumn("bucket", bucket()), rows


def _edges(facts: DataFrame) -> DataFrame:
    from footfall.operators.audit_facts import link_edges

    return link_edges(facts)


def bucket() -> Column:
    s = F.col("status_code")
    return (
        F.when((s == 0) | (s >= 400), "broken")
        .when(s >= 300, "redirects")
        .when(F.col("errors") > 0, "errors")
        .when(F.col("warnings") > 0, "warnings")
        .otherwise("healthy")
    )


def crawl_buckets(pages: DataFrame) -> DataFrame:
    return pages.groupBy(bucket().alias("bucket")).agg(F.count("*").alias("pages"))


def health(pages: DataFrame, site_issues: DataFrame, extra: dict | None = None) -> DataFrame:
    """Site score 0..100 with the issue totals. ``site_issues`` has a ``code`` column."""
    spark = pages.sparkSession
    site = site_issues.join(F.broadcast(catalog(spark, extra).select("code", "severity")), "code", "left").agg(
        F.lit(1).alias("_k"),
        F.coalesce(F.sum((F.col("severity") == "error").cast("int")), F.lit(0)).alias("_se"),
        F.coalesce(F.sum((F.col("severity") == "warning").cast("int")), F.lit(0)).alias("_sw"),
        F.count("*").alias("_sn"),
    )
    p = pages.agg(
        F.lit(1).alias("_k"),
        F.count("*").alias("pages"),
        F.coalesce(F.sum((F.col("errors") > 0).cast("int")), F.lit(0)).alias("with_errors"),
        F.coalesce(F.sum(((F.col("errors") == 0) & (F.col("warnings") > 0)).cast("int")), F.lit(0)).alias("with_warnings"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("errors", "warnings", "notices")],
    )
    share = (F.col("with_errors") + F.lit(0.3) * F.col("with_warnings")) / F.col("pages")
    score = F.when(F.col("pages") > 0, F.lit(100.0) * (F.lit(1.0) - share)).otherwise(100.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - 10 * F.col("_se") - 3 * F.col("_sw")))
    return p.join(site, "_k").select(
        "pages", "with_errors", "with_warnings",
        (F.col("errors") + F.col("_se")).alias("errors"),
        (F.col("warnings") + F.col("_sw")).alias("warnings"),
        (F.col("notices") + F.col("_sn") - F.col("_se") - F.col("_sw")).alias("notices"),
        F.round(score).cast("int").alias("health"),
    )


def issue_frequency(issues: DataFrame, cat: DataFrame, site_issues: DataFrame | None = None) -> DataFrame:
    """Pages per issue code with what the catalogue says about it. A code outside it is a notice about a page without
    category and advice, as ``severity_counts`` counts it."""
    rows = issues.groupBy("code").agg(F.count("*").alias("pages"))
    if site_issues is not None:
        rows = rows.unionByName(site_issues.select("code", F.lit(1).cast("bigint").alias("pages")))
        rows = rows.groupBy("code").agg(F.sum("pages").alias("pages"))
    unknown = {"severity": "notice", "category": "", "scope": "page", "title": "", "fix": ""}
    return rows.join(F.broadcast(cat), "code", "left").fillna(unknown)


def ideas_by_category(frequency: DataFrame) -> DataFrame:
    spark = frequency.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    sums = frequency.groupBy("category").agg(F.sum("pages").alias("ideas"))
    return names.join(sums, "category", "left").fillna(0, ["ideas"])


def severity_rank() -> Column:
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def audit_overview(issues: DataFrame, site_issues: DataFrame | None = None, extra: dict | None = None) -> DataFrame:
    """Issue list by severity, then pages."""
    freq = issue_frequency(issues, catalog(issues.sparkSession, extra), site_issues)
    return freq.orderBy(severity_rank(), F.desc("pages"), "code")


def idea_totals(pages: DataFrame, frequency: DataFrame) -> DataFrame:
    """All ideas and the pages that have any."""
    a = pages.agg(
        F.lit(1).alias("_k"),
        F.coalesce(F.sum(((F.col("errors") + F.col("warnings") + F.col("notices")) > 0).cast("int")), F.lit(0)).alias("pages"),
    )
    b = frequency.agg(F.lit(1).alias("_k"), F.coalesce(F.sum("pages"), F.lit(0)).alias("ideas"))
    return a.join(b, "_k").drop("_k")


PAGE_ROW = [
    "page_id", "url", "title", "source", "status_code", "response_ms", "words", "inlinks", "errors", "warnings",
    "notices",
]


def page_rows(pages: DataFrame, *extra: str) -> DataFrame:
    return pages.select(
        *PAGE_ROW, path_of("url").alias("path"), (F.col("errors") + F.col("warnings") + F.col("notices")).alias("ideas"),
        bucket().alias("bucket"), *extra,
    )


def pages_with_issue(pages: DataFrame, issues: DataFrame, code: str) -> DataFrame:
    hit = issues.where(F.col("code") == code).select("page_id", "detail")
    return page_rows(pages.join(hit, "page_id"), "detail")


def pages_in_bucket(pages: DataFrame, name: str, daily_content: DataFrame, today) -> DataFrame:
    rows = pages if name == "all" else pages.where(bucket() == name)
    return page_rows(with_pageviews(rows, daily_content, today), "pageviews")


def page_detail(pages: DataFrame, issues: DataFrame, page_id: int, extra: dict | None = None) -> DataFrame:
    """One page's issues with severity and advice, most severe first."""
    mine = issues.where(F.col("page_id") == page_id)
    rows = mine.join(F.broadcast(catalog(pages.sparkSession, extra)), "code")
    row = page_rows(pages.where(F.col("page_id") == page_id)).select("page_id", "url", "bucket", "ideas", "inlinks")
    return rows.select("page_id", "code", "severity", "category", "fix", "detail").join(row, "page_id").orderBy(
        severity_rank(), "code"
    )


def top_pages_to_fix(pages: DataFrame, daily_content: DataFrame, today, limit: int = 10) -> DataFrame:
    rows = pages.where(_ok() & ((F.col("errors") + F.col("warnings") + F.col("notices")) > 0))
    out = page_rows(with_pageviews(rows, daily_content, today), "pageviews")
    return out.orderBy(F.desc("pageviews"), F.desc("errors"), F.desc("ideas"), "page_id").limit(limit)


def common_ideas(issues: DataFrame, limit: int = 6, extra: dict | None = None) -> DataFrame:
    freq = issue_frequency(issues, catalog(issues.sparkSession, extra)).where(F.col("scope") != "site")
    return freq.orderBy(F.desc("pages"), severity_rank(), "code").limit(limit)


# ---- worklist, site checks, runs ----------------------------------------------------------------


def url_worklist(candidates: DataFrame, limit: int | None = None, archives: int | None = None) -> DataFrame:
    """Addresses to audit from (url, source, post_id, modified_at, posts).

    The home page, then content by last change, then archives by size; an address counts once. ``limit`` is a run's
    budget of addresses and ``archives`` that of archives; by default there is none.
    """
    kind = F.when(F.col("source") == "home", 0).when(F.col("source") == "content", 1).otherwise(2)
    newest, busiest = candidates.where(F.col("source") == "content"), candidates.where(F.col("source") == "archive")
    if limit is not None:
        newest = newest.orderBy(F.desc("modified_at"), "url").limit(limit)
    if archives is not None:
        busiest = busiest.orderBy(F.desc("posts"), "url").limit(archives)
    rows = candidates.where(F.col("source") == "home").unionByName(newest).unionByName(busiest)
    ranked = rows.where(F.col("url") != "").withColumn(
        "_rank",
        F.struct(
            kind.alias("kind"),
            F.when(F.col("source") == "content", -F.unix_micros(F.col("modified_at").cast("timestamp"))).otherwise(0).alias("age"),
            F.when(F.col("source") == "archive", -F.col("posts")).otherwise(0).alias("size"),
            F.col("url").alias("u"),
        ),
    )
    once = ranked.groupBy(normalize_url("url", "url").alias("url_key")).agg(
        F.min("_rank").alias("_rank"), F.min_by(F.struct("url", "source", "post_id"), "_rank").alias("r")
    )
    once = once.orderBy("_rank")
    once = once if limit is None else once.limit(limit)
    return once.select("r.url", path_of("r.url").alias("path"), "r.post_id", "r.source")


def robots_lines(robots: DataFrame) -> DataFrame:
    """(site, line_no, agent, disallow) of robots.txt bodies given as (site, body)."""
    lines = robots.select("site", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*", ""))
    return lines.select(
        "site", "line_no",
        F.when(text.rlike(r"(?i)^user-agent:\s*.+$"), F.trim(F.regexp_extract(text, r"(?i)^user-agent:\s*(.+)$", 1))).alias("agent"),
        text.rlike(r"(?i)^disallow:\s*/\s*$").alias("blocks"),
    )


def robots_blocks_all(robots: DataFrame) -> DataFrame:
    """Per site: 1 when a group for every crawler disallows everything. One site's file is one small group."""
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("line_no")
    rows = robots_lines(robots).withColumn("in_force", F.last("agent", ignorenulls=True).over(w))
    hit = F.col("blocks") & (F.coalesce("in_force", F.lit("")) == "*")
    return rows.groupBy("site").agg(F.max(hit.cast("int")).alias("blocks_all"))


def site_checks(site_fetches: DataFrame, site_flags: DataFrame, by: str | None = None) -> DataFrame:
    """Site-wide issues from fetched special addresses (kind: robots, sitemap, missing) and a row of flags.

    ``by`` names the column of both inputs that tells sites apart; the result then has it too. Without it all rows are
    one site's.
    """
    key = "_k" if by is None else by
    if by is None:
        site_fetches, site_flags = (df.withColumn("_k", F.lit(1)) for df in (site_fetches, site_flags))
    kind, status = F.col("kind"), F.col("status")
    f = site_fetches.groupBy(key).agg(
        F.max(F.when(kind == "robots", status)).alias("robots"),
        F.max(F.when((kind == "sitemap") & (status == 200) & F.col("body").contains("<"), 1)).alias("sitemap"),
        F.max(F.when((kind == "missing") & (status == 200), 1)).alias("soft"),
    )
    text = site_fetches.where((kind == "robots") & (status == 200)).select(F.col(key).alias("site"), "body")
    blocked = robots_blocks_all(text).select(F.col("site").alias(key), "blocks_all")
    row = site_flags.join(f, key).join(blocked, key, "left")
    found = {
        "search_engines_blocked": F.col("search_blocked"),
        "no_https": url_scheme("home_url") != "https",
        "plain_permalinks": F.col("plain_permalinks"),
        "debug_display": F.col("debug_display"),
        "robots_missing": F.coalesce(F.col("robots"), F.lit(0)) != 200,
        "robots_blocks_all": (F.col("robots") == 200) & (F.col("blocks_all") == 1),
        "sitemap_missing": F.col("sitemap").isNull(),
        "soft_404": F.col("soft") == 1,
    }
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    return row.select(*([] if by is None else [by]), F.explode(codes).alias("code"))


def keep_runs(runs: DataFrame, pages: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Newest n runs and their pages."""
    newest = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n)
    return runs.join(newest, "run_id", "left_semi"), pages.join(newest, "run_id", "left_semi")
