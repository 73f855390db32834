"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import shared_dir, table

#: Rows of a cell: what one task permutes after the exchange.
CELL_ROWS = 4096
#: Rows of a matrix that may be broadcast.
BROADCAST_ROWS = 100_000


def communication_matrix(held: list[int], sizes: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows i of held[i] items, columns j of sizes[j] items: how many go from i to j when all are shuffled uniformly.

    Row after row is drawn from the places still free, so all sums are exact.
    """
    free = np.array(sizes, dtype=np.int64)
    out = np.zeros((len(held), len(sizes)), dtype=np.int64)
    for i, n in enumerate(held):
        if n:
            left, room = n, int(free.sum())
            for j in range(len(sizes)):
                room -= int(free[j])
                got = _draw(int(free[j]), room, left, rng)
                out[i, j] = got
                left -= got
            free -= out[i]
    return out


def _draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n items drawn without replacement are good."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # Beyond the generator's range: ratio of uniforms around the mode.
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    low, high = max(0, n - bad), min(n, good)
    var = n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))
    mid, width = n * good / total + 0.5, 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)

    def weight(x: int) -> float:
        return -sum(math.lgamma(v + 1) for v in (x, good - x, n - x, bad - n + x))

    top = weight(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mid + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= weight(x) - top:
            return x


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that stands in the plan itself."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard), a uniform shuffle of all rows.

    Shard sizes differ by one at most. Rows are permuted inside their input partition by a random key, a matrix of
    hypergeometric draws says how many rows each partition sends to each shard, the rows are exchanged, and each cell
    of a shard is permuted again. A cell is a range of random keys of about ``cell_rows`` rows, so a task never holds
    a whole shard; equal rows and hot keys play no part, because only random keys decide.

    Nulls, empty and long texts, repeated rows and extra columns are carried unchanged; columns of df named shard or
    slot are replaced. An empty table gives an empty result. The result is a function of the seed and of how the
    input is partitioned; the permuted rows are stored once, so that a lost executor cannot change them.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    packed = df.select(F.struct(*cols).alias("row")) if cols else df.select(F.struct(F.lit(0).alias("_")).alias("row"))
    path = shared_dir(spark, "permuted")
    (
        packed.withColumns({"r1": F.rand(seed), "r2": F.rand(seed + 1)})
        .sortWithinPartitions("r1")
        .withColumn("at", F.monotonically_increasing_id())
        .select("row", "r2", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"))
        .write.option("compression", "zstd").parquet(path)
    )
    permuted = spark.read.parquet(path)
    # One row per input partition: their number is bounded by the input's splits, not by its rows.
    held = sorted((r.part, r.n) for r in permuted.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in held)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([n for _, n in held], sizes, np.random.default_rng(seed))
    ends = _literal(
        spark, [{"p": p, "ends": e} for (p, _), e in zip(held, np.cumsum(matrix, axis=1).tolist(), strict=True)], "p int, ends array<bigint>"
    )
    cells = max(1, -(-(total // shards) // cell_rows))
    shard = sum(((F.col("pos") >= F.col("ends")[j]).cast("int") for j in range(shards - 1)), F.lit(0))
    dealt = permuted.join(_bounded(ends, len(held)), F.col("part") == F.col("p")).select(
        "row", "r2", "part", "pos", shard.alias("shard"), F.floor(F.col("r2") * cells).cast("int").alias("cell")
    )
    # Counts of the cells come from the key columns alone; their running sums are the cells' first slots.
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    first = counts.select(
        "shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first")
    )
    again = Window.partitionBy("shard", "cell").orderBy("r2", "part", "pos")
    placed = dealt.withColumn("rn", F.row_number().over(again) - 1)
    out = placed.join(_bounded(first, cells * shards), ["shard", "cell"])
    slot = (F.col("first") + F.col("rn")).cast("long").alias("slot")
    return out.select(*([f"row.`{c}`" for c in cols]), F.col("shard").cast("int").alias("shard"), slot)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law of equal row counts."""
    out = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
