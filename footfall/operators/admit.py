"""Hit admission: one reason column, decided by the first rule that fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.agents import MIN_AGENT_LENGTH, bot_signs
from footfall.functions.network import in_cidrs
from footfall.functions.times import epoch_seconds
from footfall.functions.urls import bare_host, path_matches
from footfall.runtime import stored
from footfall.settings import Settings

RATE_LIMIT = 120
RATE_WINDOW = 60


def own_host(host: Column, hosts: Sequence[str]) -> Column:
    if not hosts:
        return F.lit(False)
    return F.coalesce((host != "") & bare_host(host).isin(list(hosts)), F.lit(False))


def own_hosts(df: DataFrame, hosts: Sequence[str], column: str = "host") -> DataFrame:
    return df.where(own_host(F.col(column), hosts))


def exclude_paths(df: DataFrame, patterns: Sequence[str], column: str = "page_path") -> DataFrame:
    return df.where(~path_matches(column, patterns))


def rate_rank(hits: DataFrame, eligible: Column) -> Column:
    """Position of a payload among the visitor's eligible ones in its fixed minute.

    The minute is part of the key, so even a very busy visitor is spread over as many groups as minutes. Rows that
    are not eligible need no rank and are spread by their number: a flood from one address meets in no task.
    """
    apart = F.when(~F.col("_eligible"), F.pmod(F.xxhash64("payload_id"), F.lit(1024)))
    w = Window.partitionBy("visitor_key", "_minute", "_eligible", apart).orderBy("received_at", "payload_id")
    return F.row_number().over(w)


def with_rate_rank(hits: DataFrame, eligible: Column) -> DataFrame:
    minute = F.floor(epoch_seconds("received_at") / RATE_WINDOW)
    df = hits.withColumn("_minute", minute).withColumn("_eligible", eligible)
    return df.withColumn("_rank", F.when(F.col("_eligible"), rate_rank(df, eligible))).drop("_minute", "_eligible")


def crowded_minutes(hits: DataFrame, eligible: Column, per_minute: int) -> DataFrame:
    """Visitors and fixed minutes with more than per_minute eligible payloads: at most a row for so many of them."""
    minute = F.floor(epoch_seconds("received_at") / RATE_WINDOW)
    return hits.where(eligible).groupBy(F.col("visitor_key").alias("_v"), minute.alias("_m")).agg(F.count("*").alias("_n")).where(F.col("_n") > per_minute)


def rate_limit(hits: DataFrame, per_minute: int = RATE_LIMIT) -> DataFrame:
    """Keeps at most per_minute payloads of a visitor per fixed minute."""
    return with_rate_rank(hits, F.lit(True)).where(F.col("_rank") <= per_minute).drop("_rank")


def _bot() -> Column:
    """``is_bot`` on the lower-cased agent that ``admit`` has put into a column, so it stays in generated code."""
    return (F.octet_length("_agent") < MIN_AGENT_LENGTH) | bot_signs(F.col("_agent"))


def early_reason(settings: Settings, bot: Column | None = None) -> Column:
    """Reasons that need nothing but the row: everything up to the path check."""
    s = settings
    automated = F.coalesce(F.col("wd").cast("boolean"), F.lit(False)) | (_bot() if bot is None else bot)
    return F.coalesce(
        F.when(F.lit(not s.tracking_enabled), "disabled"),
        F.when(F.lit(s.respect_dnt) & F.coalesce("dnt", F.lit(False)), "dnt"),
        F.when(F.lit(s.respect_gpc and s.gpc_action == "stop") & F.coalesce("gpc", F.lit(False)), "gpc"),
        F.when(in_cidrs("ip", s.excluded_ips), "excluded_ip"),
        F.when(automated, "bot"),
        F.when(~own_host(F.col("host"), s.hosts), "foreign_host"),
        F.when(path_matches("page_path", s.excluded_paths), "excluded_path"),
    )


def admit(hits: DataFrame, settings: Settings, bot: Column | None = None, per_minute: int = RATE_LIMIT) -> DataFrame:
    """Adds ``reason``: NULL for accepted payloads. Needs the columns of ``enrich`` up to the visitor key.

    ``no_session`` is known only once sessions are built; see ``plans.ingest``. A payload with nothing but
    heat points is accepted and opens no session.
    """
    df = with_rate_rank(with_early_reason(hits, settings, bot), F.col("_early").isNull())
    return with_reason(df, settings, per_minute)


def with_early_reason(hits: DataFrame, settings: Settings, bot: Column | None = None) -> DataFrame:
    """Adds ``_early``, the reason that needs nothing but the row."""
    df = hits.withColumn("_agent", F.lower(F.coalesce("user_agent", F.lit(""))))
    return df.withColumn("_early", early_reason(settings, bot)).drop("_agent")


def admit_stored(hits: DataFrame, settings: Settings, per_minute: int = RATE_LIMIT) -> DataFrame:
    """As ``admit``, of stored rows that have ``_early``: only rows of crowded minutes are dealt and ranked."""
    crowded = stored(crowded_minutes(hits, F.col("_early").isNull(), per_minute), "crowded")
    if crowded.isEmpty():
        return with_reason(hits.withColumn("_rank", F.lit(0)), settings, per_minute)
    minute = F.floor(epoch_seconds("received_at") / RATE_WINDOW)
    found = F.col("visitor_key").eqNullSafe(F.col("_v")) & minute.eqNullSafe(F.col("_m")) & F.col("_early").isNull()
    rows = hits.join(crowded, found, "left")
    many = with_rate_rank(rows.where(F.col("_n").isNotNull()), F.lit(True))
    few = rows.where(F.col("_n").isNull()).withColumn("_rank", F.lit(0))
    return stored(with_reason(few.unionByName(many).drop("_v", "_m", "_n"), settings, per_minute), "admitted")


def with_reason(df: DataFrame, settings: Settings, per_minute: int) -> DataFrame:
    heat = F.lit(settings.heatmaps) & (F.coalesce(F.col("n_heat"), F.lit(0)) > 0)
    late = F.coalesce(
        F.when(F.col("_rank") > per_minute, "rate_limited"),
        F.when((F.col("n_events") == 0) & (F.col("heartbeat") == 0) & ~heat, "empty"),
    )
    return df.withColumn("reason", F.coalesce("_early", late)).drop("_early", "_rank")


def admission_report(admitted: DataFrame) -> DataFrame:
    """Payloads per reason; accepted ones under 'stored'."""
    return (
        admitted.groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("hits"))
    )
