"""Traffic channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import col

# Default channel rules. An entry ending in a dot stands for any top-level domain.
DEFAULT_RULES: dict[str, list[str]] = {
    "ai_assistants": [
        "chatgpt.com", "chat.openai.com", "perplexity.ai", "claude.ai", "gemini.google.com",
        "bard.google.com", "copilot.microsoft.com", "you.com", "phind.com", "poe.com", "meta.ai",
        "chat.mistral.ai", "chat.deepseek.com", "grok.com",
    ],
    "ota_listing": [
        "booking.com", "expedia.", "hotels.com", "agoda.com", "tripadvisor.", "airbnb.", "viator.com",
        "getyourguide.", "safaribookings.com", "tourradar.com", "trivago.", "kayak.", "skyscanner.",
        "trip.com", "hostelworld.com", "klook.com", "lonelyplanet.com",
    ],
    "social": [
        "facebook.com", "fb.com", "fb.me", "instagram.com", "t.co", "twitter.com", "x.com",
        "linkedin.com", "lnkd.in", "pinterest.", "youtube.com", "youtu.be", "tiktok.com", "reddit.com",
        "threads.net", "snapchat.com", "whatsapp.com", "wa.me", "t.me", "vk.com", "quora.com",
        "tumblr.com", "bsky.app", "mastodon.social",
    ],
    "search_engines": [
        "google.", "bing.com", "yahoo.", "duckduckgo.com", "yandex.", "baidu.com", "ecosia.org",
        "search.brave.com", "qwant.com", "naver.com", "seznam.cz", "startpage.com", "ask.com", "aol.com",
    ],
    "email_domains": [
        "mail.google.com", "outlook.live.com", "outlook.office.com", "outlook.office365.com",
        "mail.yahoo.com", "mail.aol.com", "mail.proton.me",
    ],
    "social_sources": [
        "facebook", "fb", "instagram", "ig", "meta", "twitter", "x", "linkedin", "pinterest", "youtube",
        "tiktok", "reddit", "snapchat", "whatsapp", "threads",
    ],
    "medium_paid_search": ["cpc", "ppc", "paidsearch", "paid_search", "paid-search", "sem"],
    "medium_paid_social": [
        "paid_social", "paidsocial", "paid-social", "social_paid", "social-paid", "paid-social-media",
    ],
    "medium_display": ["display", "banner", "cpm", "expandable", "interstitial"],
    "medium_email": ["email", "e-mail", "e_mail", "newsletter"],
    "medium_affiliate": ["affiliate", "affiliates", "partner"],
    "medium_social": ["social", "social-network", "social-media", "social_media", "sm"],
    "click_paid_search": ["gclid", "gbraid", "wbraid", "msclkid"],
    "click_paid_social": ["ttclid"],
}
CHANNELS = [
    "direct", "organic_search", "paid_search", "paid_social", "social", "email", "referral", "display",
    "affiliate", "ai_assistant", "ota_listing",
]
# Referrer groups in the order they are tried: an assistant on a search engine's domain is no search.
REFERRER_GROUPS = [
    ("ai_assistants", "ai_assistant"),
    ("email_domains", "email"),
    ("ota_listing", "ota_listing"),
    ("social", "social"),
    ("search_engines", "organic_search"),
]


def domain_matches(domain: str | Column, entry: str) -> Column:
    d, entry = col(domain), entry.lower()
    if entry.endswith("."):
        return d.startswith(entry) | d.contains("." + entry)
    return (d == entry) | d.endswith("." + entry)


def _group_pattern(entries: list[str]) -> str:
    """One alternation per rule group, so a row is tested once per group and not once per entry."""
    esc = lambda e: e.lower().replace(".", r"\.").replace("-", r"\-")
    any_tld = [esc(e) for e in entries if e.endswith(".")]
    exact = [esc(e) for e in entries if not e.endswith(".")]
    parts = ([f"(?:{'|'.join(any_tld)})"] if any_tld else []) + ([f"(?:{'|'.join(exact)})$"] if exact else [])
    return rf"(?:^|\.)(?:{'|'.join(parts)})"


def merge_rules(overrides: dict[str, list[str]] | None) -> dict[str, list[str]]:
    extra = {k: [str(x) for x in v] for k, v in (overrides or {}).items() if k in DEFAULT_RULES}
    return {**DEFAULT_RULES, **extra}


def channel_of(
    referrer_domain: str | Column,
    utm_medium: str | Column,
    utm_source: str | Column,
    click_type: str | Column,
    rules: dict[str, list[str]] = DEFAULT_RULES,
) -> Column:
    """Medium, then click identifier, then referrer, then source; direct when nothing is known."""
    rules = merge_rules(rules)
    medium = F.lower(F.trim(F.coalesce(col(utm_medium), F.lit(""))))
    source = F.lower(F.trim(F.coalesce(col(utm_source), F.lit(""))))
    domain, click = col(referrer_domain), col(click_type)
    social_source = source.isin(rules["social_sources"])
    by_medium = (
        F.when(medium.isin(rules["medium_paid_search"]), F.when(social_source, "paid_social").otherwise("paid_search"))
        .when(medium.isin(rules["medium_paid_social"]), "paid_social")
        .when(medium.isin(rules["medium_display"]), "display")
        .when(medium.isin(rules["medium_email"]), "email")
        .when(medium.isin(rules["medium_affiliate"]), "affiliate")
        .when(medium.isin(rules["medium_social"]), "social")
    )
    by_click = F.when(click.isin(rules["click_paid_search"]), "paid_search").when(
        click.isin(rules["click_paid_social"]), "paid_social"
    )
    known = None
    for group, name in REFERRER_GROUPS:
        if not rules[group]:
            continue
        test = domain.rlike(_group_pattern(rules[group]))
        known = F.when(test, name) if known is None else known.when(test, name)
    by_referrer = F.when(domain != "", known.otherwise("referral") if known is not None else F.lit("referral"))
    by_source = F.when(source != "", F.when(social_source, "social").otherwise("referral"))
    return F.coalesce(by_medium, by_click, by_referrer, by_source, F.lit("direct"))


def channel(df: DataFrame, rules: dict[str, list[str]] = DEFAULT_RULES) -> DataFrame:
    return df.withColumn(
        "channel", channel_of("referrer_domain", "utm_medium", "utm_source", "click_id_type", rules)
    )
