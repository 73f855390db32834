"""Running values over one visitor's history that hold up when one visitor owns a third of all rows.

A plain window puts a whole key into one task. Here a key is cut into time slices: each slice is scanned
on its own, a one-row summary per slice is carried forward over the (few) slices of the key, and the
carried value fills the rows that have nothing before them in their own slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.times import epoch_seconds

SLICE = "_slice"
#: Tasks for each shuffle partition where rows are expanded after they are dealt.
SPREAD = 4
#: Rows that a task gets at most, about, where it holds in memory what it makes of them.
TASK_ROWS = 32_000


def tasks_for(rows: DataFrame) -> int:
    """How many tasks rows are dealt to, so that one gets no more the more rows there are. Counts them: hand in stored ones."""
    return -(-rows.count() // TASK_ROWS)


def deal_by(rows: DataFrame, keys: Sequence[str], tasks: int = 0) -> DataFrame:
    """Rows dealt to more tasks than usual, to ``tasks`` at least, and not merged again into fewer by what they weigh before
    they are expanded."""
    return rows.repartition(max(SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), *keys)


def deal_evenly(rows: DataFrame) -> DataFrame:
    """Rows dealt in turn to a task for each shuffle partition, whatever files they came in."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def add_slice(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn(SLICE, F.floor(epoch_seconds(ts) / seconds))


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    include_current: bool,
    sliced: bool,
) -> DataFrame:
    """Adds, per name, the last non-null value of an expression over the rows up to the current one.

    ``order`` must be unique within a key and, when sliced, must follow the slice column.
    """
    part = [*keys, SLICE] if sliced else list(keys)
    end = 0 if include_current else -1
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.withColumns({name: F.last(v, ignorenulls=True).over(w) for name, v in values.items()})
    if not sliced:
        return local
    position = F.struct(*order)
    tails = df.groupBy(*part).agg(
        *[F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_c_{n}") for n, v in values.items()]
    )
    back = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *part, *[F.last(f"_c_{n}", ignorenulls=True).over(back).alias(f"_c_{n}") for n in values]
    )
    return (
        local.join(carry, part, "left")
        .withColumns({n: F.coalesce(n, f"_c_{n}") for n in values})
        .drop(*[f"_c_{n}" for n in values])
    )


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, sliced: bool) -> DataFrame:
    """Adds the 1-based position of each row within its key."""
    part = [*keys, SLICE] if sliced else list(keys)
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    if not sliced:
        return local
    back = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = before.select(*part, F.coalesce(F.sum("_n").over(back), F.lit(0)).alias("_before"))
    return local.join(before, part, "left").withColumn(name, F.col(name) + F.col("_before")).drop("_before")
