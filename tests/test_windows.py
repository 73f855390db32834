"""Rage clicks against all pairs and in a burst; rates without a shuffle of events."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from footfall.operators import currency, windows
from footfall.streaming import streams

T0 = dt.datetime(2024, 1, 10, 9, 0, 59)
CLICK = "session_id bigint, pv string, element int, ts timestamp_ntz, x int, y int, click_id bigint"


def clicks(seed, n=700):
    """Bursts over minute borders, equal times, negative places, unknown page views."""
    rnd, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rnd.choice([0, 0, 1, 40, 200, 399, 400, 799, 800, 5000])
        rows.append((rnd.randrange(2), rnd.choice(["a", None]), rnd.randrange(2), T0 + dt.timedelta(milliseconds=at), rnd.randrange(-40, 60), rnd.randrange(45), (i * 7919) % 100_003))
    return rows


def plain(rows, n=3, ms=800, px=30):
    out = []
    for r in rows:
        near = [q for q in rows if q[:3] == r[:3] and abs(q[4] - r[4]) < px and abs(q[5] - r[5]) < px and (q[3], q[6]) <= (r[3], r[6]) and r[3] - q[3] < dt.timedelta(milliseconds=ms)]
        if len(near) == n:
            out.append(r[6])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rage_clicks_equal_all_pairs(spark, seed):
    rows = clicks(seed)
    for n in (1, 3):
        got = windows.rage_clicks(spark.createDataFrame(rows, CLICK).repartition(5), n=n)
        assert sorted(r.click_id for r in got.collect()) == plain(rows, n)
    assert got.columns == [c.split()[0] for c in CLICK.split(", ")]


def test_rage_clicks_of_a_burst(spark):
    """Three hundred thousand clicks at one place within 800 ms, next to others: only the third is one."""
    burst = spark.range(300_000).select(
        F.lit(1).cast("bigint").alias("session_id"), F.lit("a").alias("pv"), F.lit(1).alias("element"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("id") % 500)).cast("timestamp_ntz").alias("ts"),
        F.lit(10).alias("x"), F.lit(20).alias("y"), F.col("id").alias("click_id"),
    )
    got = windows.rage_clicks(burst).collect()
    assert [r.click_id for r in got] == [1000]  # the third at the first millisecond


def test_stream_of_rage_clicks_equals_batch(spark, tmp_path):
    rows = clicks(5, 400)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][3] + dt.timedelta(seconds=random.Random(i).randrange(500)), i))
    tick = (9, "z", 0, T0 + dt.timedelta(days=2), 0, 0, 999_999)
    schema = spark.createDataFrame(rows, CLICK).schema
    for i in range(0, 500, 100):
        part = [rows[j] for j in order[i : i + 100]] or [tick]
        spark.createDataFrame(part, CLICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def write(batch, i):
        batch.write.mode("append").parquet(str(tmp_path / "out"))

    streams.stream_rage_clicks(stream).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.click_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == plain(rows)


def test_rates_are_looked_up_where_the_events_are(spark, tmp_path):
    spark.range(2000).select(
        F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit(""), F.lit("KES"), F.lit("XXX")), (F.col("id") % 5).cast("int") + 1).alias("currency"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz").alias("occurred_at"), F.lit(10).cast("decimal(18,4)").alias("event_value"),
    ).write.parquet(str(tmp_path / "events"))
    rates = [("USD", "EUR", dt.date(2024, 1, 10), 2.0), ("USD", "EUR", dt.date(2024, 1, 20), 4.0), ("KES", "USD", dt.date(2024, 1, 5), 0.5)]
    fx = spark.createDataFrame(rates, "base_currency string, quote_currency string, rate_date date, rate double")
    events = spark.read.parquet(str(tmp_path / "events"))
    out = currency.to_base(events, fx, "USD")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    got = {(r.currency, r.day, r.v) for r in out.select("currency", F.to_date("occurred_at").cast("string").alias("day"), F.col("event_value_base").cast("double").alias("v")).collect()}
    want = {"EUR": [("2024-01-09", None), ("2024-01-10", 5.0), ("2024-01-19", 5.0), ("2024-01-20", 2.5), ("2024-03-01", 2.5)],
            "KES": [("2024-01-04", None), ("2024-01-05", 5.0), ("2024-02-20", 5.0)], "USD": [("2024-01-03", 10.0)], "XXX": [("2024-02-02", None)]}
    assert all((c, d, v) in got and sum(1 for x in got if x[:2] == (c, d)) == 1 for c, pairs in want.items() for d, v in pairs)


def test_all_currencies_beyond_the_bound_give_the_same(spark, monkeypatch):
    rows = [("EUR", dt.datetime(2024, 1, 3), 8.0), ("USD", dt.datetime(2024, 1, 3), 8.0), ("EUR", dt.datetime(2023, 1, 3), 8.0)]
    df = spark.createDataFrame(rows, "currency string, occurred_at timestamp_ntz, event_value double")
    fx = spark.createDataFrame([("USD", "EUR", dt.date(2024, 1, 1), 2.0)], "base_currency string, quote_currency string, rate_date date, rate double")
    want = sorted(map(tuple, currency.to_base(df, fx, "USD").collect()))
    monkeypatch.setattr(currency, "MAX_DAYS", 0)
    assert sorted(map(tuple, currency.to_base(df, fx, "USD").collect())) == want
