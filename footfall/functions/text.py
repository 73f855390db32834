"""Text cleaning and personal-data redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import col, let

# What counts as an e-mail address, phone number, identifier or opaque token.
# An address is tried only where its run of characters starts (or right after the match before), which finds
# the same matches and keeps long runs linear.
EMAIL = r"(?i)(?:\G|(?<![A-Z0-9._%+\-]))[A-Z0-9._%+\-]+(?:@|%40)[A-Z0-9.\-]+\.[A-Z]{2,}"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
TOKEN = (
    r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*\d)(?=[A-Za-z0-9_]*[A-Za-z])"
    r"[A-Za-z0-9_]{24,}(?![A-Za-z0-9_])"
)
# A run of digits and separators with nine or more digits. The bounded look-ahead does the counting,
# so the engine never recurses over a long run.
PHONE = r"\+?(?=\d(?:[\s().\-]*+\d){8})\d[\d\s().\-]{6,}\d"


# What a text must have for a pattern to match at all: a cheap look before the search.
_AT = r"@|%40"
_DIGIT = r"[0-9]"
_GROUP = r"[0-9a-fA-F]{8}-"
_RUN = r"[A-Za-z0-9_]{24}"


def scrub_pii(c: str | Column) -> Column:
    def step(value: Column, needs: str, pattern: str, label: str) -> Column:
        return let(value, lambda v: F.when(v.rlike(needs), F.regexp_replace(v, pattern, label)).otherwise(v))

    c = step(col(c), _AT, EMAIL, "[email]")
    c = step(c, _DIGIT, PHONE, "[phone]")
    c = step(c, _GROUP, UUID, "[token]")
    return step(c, _RUN, TOKEN, "[token]")


def has_email(c: str | Column) -> Column:
    return col(c).rlike(EMAIL)


def has_phone(c: str | Column) -> Column:
    return col(c).rlike(PHONE)


def contains_pii(c: str | Column) -> Column:
    return has_email(c) | has_phone(c)


def pii_incidence(df: DataFrame, text_col: str) -> DataFrame:
    """Rows per kind of personal data found, one pass over the text."""
    found = df.select(has_email(text_col).alias("e"), has_phone(text_col).alias("p"))
    kinds = F.array(
        F.when(F.col("e"), F.lit("email")), F.when(F.col("p"), F.lit("phone")), F.when(F.col("e") | F.col("p"), F.lit("any"))
    )
    return (
        found.select(F.explode(kinds).alias("kind"))
        .where(F.col("kind").isNotNull())
        .groupBy("kind")
        .agg(F.count("*").alias("rows"))
    )


def scrub_table(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: scrub_pii(c) for c in cols})


def strip_tags(c: str | Column) -> Column:
    """Script and style elements go with their content, other tags alone."""
    c = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(c, r"(?s)<[^>]*>", "")


def clean_line(c: str | Column) -> Column:
    """One line of plain text: no tags, no percent-escapes, single spaces."""
    c = F.regexp_replace(strip_tags(c), r"[\r\n\t ]+", " ")
    c = F.regexp_replace(c, r"(?i)%[a-f0-9]{2}", "")
    return F.trim(F.regexp_replace(c, " +", " "))


def normalize_term(c: str | Column) -> Column:
    """Search term as grouped in reports: no tags, single spaces, lower case, 191 characters."""
    c = F.trim(F.regexp_replace(strip_tags(c), r"(?U)\s+", " "))
    return F.left(F.lower(c), F.lit(191))


def slug(c: str | Column, size: int) -> Column:
    """Lower-case key of letters, digits, dash and underscore."""
    return F.left(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_\-]", ""), F.lit(size))


def form_id(plugin: str | Column, ident: str | Column) -> Column:
    clean = F.regexp_replace(col(ident).cast("string"), r"[^A-Za-z0-9_\-]", "")
    clean = F.when(clean == "", "0").otherwise(clean)
    return F.left(F.concat(col(plugin), F.lit(":"), clean), F.lit(64))


def csv_safe(df: DataFrame) -> DataFrame:
    """Booleans as 0/1; text cells a spreadsheet would run as a formula get a leading quote."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "boolean":
            c = c.cast("int")
        elif f.dataType.typeName() == "string":
            c = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)
