"""Currency conversion as of the event date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dense(rates: DataFrame) -> DataFrame:
    """One row per pair and day from the first rate to the last, each holding the latest rate by then.

    The table has days x currencies rows whatever the number of events, so events are never windowed or shuffled.
    """
    pair = Window.partitionBy("base_currency", "quote_currency")
    once = rates.groupBy("base_currency", "quote_currency", "rate_date").agg(F.max("rate").alias("rate"))
    spans = once.withColumn("_next", F.lead("rate_date").over(pair.orderBy("rate_date")))
    until = F.coalesce(F.date_sub("_next", 1), F.col("rate_date"))
    return spans.select("base_currency", "quote_currency", F.explode(F.sequence("rate_date", until)).alias("rate_date"), "rate")


#: Days over all currencies that are handed to every task, 8 bytes each; more of them are joined by currency.
MAX_DAYS = 4_000_000


def _packed(dense: DataFrame, code: str, name: str) -> DataFrame:
    """A row per currency: its first day and the rates of all days from there, so a day's rate is found by its number."""
    by_day = dense.groupBy(F.col(code).alias("_code")).agg(F.min("rate_date").alias("_first"), F.array_sort(F.collect_list(F.struct("rate_date", "rate"))).alias("_days"))
    return by_day.select("_code", "_first", F.col("_days.rate").alias(f"{name}_days"))


def _rate(df: DataFrame, rates: DataFrame, code: str, name: str) -> DataFrame:
    """Adds the rate in force on the event's day for the currency in ``code``: events are looked up where they are."""
    dense = _dense(rates)
    packed = _packed(dense, code, name)
    if dense.count() <= MAX_DAYS:  # days x currencies, whatever the number of events
        packed = F.broadcast(packed)
    day = F.least(F.datediff("_date", "_first"), F.size(f"{name}_days") - 1)
    joined = df.join(packed, df["currency"] == F.col("_code"), "left")
    return joined.withColumn(name, F.when(day >= 0, F.get(f"{name}_days", day))).drop("_code", "_first", f"{name}_days")


def to_base(
    df: DataFrame, fx: DataFrame, base_currency: str, value: str = "event_value", out: str = "event_value_base"
) -> DataFrame:
    """Adds the value in the base currency.

    The latest direct rate on or before the event date divides; only when there is none, the latest rate
    of the reverse pair multiplies. NULL without a positive rate. No currency, or the base one, is kept.
    Needs currency and occurred_at.
    """
    d = df.withColumn("_date", F.to_date("occurred_at"))
    d = _rate(d, fx.where(F.col("base_currency") == base_currency), "quote_currency", "_direct")
    d = _rate(d, fx.where(F.col("quote_currency") == base_currency), "base_currency", "_inverse")
    by: Column = F.when(F.col("_direct").isNotNull(), F.col("_direct").cast("double")).when(
        F.col("_inverse") > 0, F.lit(1.0) / F.col("_inverse").cast("double")
    )
    amount = F.col(value).cast("double")
    converted = F.when(by > 0, F.round(amount / by, 4)).cast("decimal(18,4)")
    same = F.coalesce(F.col("currency").isin("", base_currency), F.lit(True))
    return d.withColumn(out, F.when(same, F.col(value).cast("decimal(18,4)")).otherwise(converted)).drop(
        "_date", "_direct", "_inverse"
    )
