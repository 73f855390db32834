"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import stored, table

#: Queries that meet a block of candidates at once, and candidates of a block, about.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 1 << 16
#: Candidates whose bounds are held at once.
TILE = 4096
#: Segments of a vector at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
SCALE = 1024
#: Scores are held within 64 bits.
LOW, HIGH = -(2**63), 2**63 - 1


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by the root of the length, and norms of what is left, of each of ``count`` segments of the rows of x.

    With them, x.y is at most sum(sx * sy + rx * ry) over segments: the means' part is exact, and the inner product of
    the deviations cannot exceed the product of their norms. As x.y = (|x|^2 + |y|^2 - d^2) / 2, this is the lower
    bound d^2 >= sum((sx - sy)^2 + (rx - ry)^2) on the distance.
    """
    edges = np.linspace(0, x.shape[1], count + 1).astype(int)[:-1]
    size = np.diff(np.append(edges, x.shape[1]))
    total = np.add.reduceat(x, edges, axis=1)
    square = np.add.reduceat(x * x, edges, axis=1)
    s = total / np.sqrt(size)
    return s, np.sqrt(np.maximum(square - s * s, 0))


def block_top(q: np.ndarray, q_rid: np.ndarray, v: np.ndarray, v_rid: np.ndarray, v_id: np.ndarray, null_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, positions in v and scores of its k best rows: highest score, then smallest id (null last), then row."""
    dims = v.shape[1]
    levels = [c for c in RESOLUTIONS if c < dims]
    # Inner products of integers are exact in floating point as long as they stay below 2^53.
    big = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, dims) >= 2.0**53

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not big:
            return (a @ b).astype(np.int64)
        return np.array([min(HIGH, max(LOW, sum(x * y for x, y in zip(r, b.tolist(), strict=True)))) for r in a.tolist()], dtype=object)

    qf, vf = (q.astype(np.float64), v.astype(np.float64))
    q_stats, v_stats = [segments(qf, c) for c in levels], [segments(vf, c) for c in levels]
    # Norms of what is left are differences of squares: rounding may lower them by some 1e-8 of the whole vector's norm.
    slack = 1e-6 * (np.linalg.norm(qf, axis=1) * np.linalg.norm(vf, axis=1).max(initial=0) + 1)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object if big else np.int64))] * len(q)

    def keep(i: int, at: np.ndarray) -> None:
        at = at[v_rid[at] != q_rid[i]]
        score = exact(v[at] if big else vf[at], q[i] if big else qf[i])
        at, score = np.concatenate((best[i][0], at)), np.concatenate((best[i][1], score))
        order = sorted(range(len(at)), key=lambda j: (-score[j], null_id[at[j]], v_id[at[j]], v_rid[at[j]])) if big else np.lexsort((v_rid[at], v_id[at], null_id[at], -score))
        order = np.asarray(order[:k], dtype=np.int64)
        best[i] = at[order], score[order]

    for lo in range(0, len(v), TILE):
        tile = np.arange(lo, min(len(v), lo + TILE))
        if not levels:
            for i in range(len(q)):
                keep(i, tile)
            continue
        s, r = v_stats[0][0][tile], v_stats[0][1][tile]
        coarse = q_stats[0][0] @ s.T + q_stats[0][1] @ r.T
        for i in range(len(q)):
            bound = coarse[i] + slack[i]
            left = tile
            if len(best[i][1]) < k:
                # The most promising rows are scored first, which gives a threshold.
                first = np.argpartition(-bound, min(len(bound) - 1, 2 * k))[: 2 * k]
                keep(i, tile[first])
                mask = np.ones(len(tile), dtype=bool)
                mask[first] = False
                left, bound = tile[mask], bound[mask]
            for level in range(len(levels)):
                if level:
                    s, r = v_stats[level][0][left], v_stats[level][1][left]
                    bound = s @ q_stats[level][0][i] + r @ q_stats[level][1][i] + slack[i]
                if len(best[i][1]) >= k:
                    left = left[np.maximum(bound, float(LOW)) >= float(best[i][1][-1])]
                if not len(left):
                    break
            if len(left):
                keep(i, left)
    return best


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest inner product, ties to the smaller id.

    ``queries`` and ``vectors`` have ``rid`` (a number of the row; a query never finds the row with its own), ``id``
    and ``v`` (array of long). Queries are cut into blocks of about QUERY_BLOCK and vectors into blocks by a hash of
    rid; each pair of blocks is one group, which returns k rows a query, so nothing but the k best of each block is
    shuffled again. In a group, upper bounds from segment means and deviations are computed coarse to fine and only
    what may still be among the k best is scored.

    Scores beyond 64 bits are held at the least or greatest long, and tie there; all others are exact, however large the
    components. Vectors of another length than the query's are no candidates for it. Repeated rows are candidates each; a null id
    sorts last. With fewer than k candidates all are returned; empty tables give an empty result.
    """
    spark = queries.sparkSession
    n_q = queries.count()
    n_v = vectors.count()
    q_blocks = max(1, -(-n_q // QUERY_BLOCK))
    v_blocks = max(-(-n_v // CANDIDATE_BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-n_v // TILE)), 1)
    keyed_q = queries.select(
        "rid", "id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64(F.lit("q"), "rid"), F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"),
    )
    keyed_v = vectors.select(
        "rid", "id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64(F.lit("v"), "rid"), F.lit(v_blocks)).cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
    )

    def run(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"q_rid": [], "query_id": [], "vec_id": [], "v_rid": [], "score": []}).astype("Int64")
        dims = len(q.v.iloc[0])
        qm, vm = np.stack(q.v.to_numpy()).reshape(len(q), dims), np.stack(v.v.to_numpy()).reshape(len(v), dims)
        null = v.id.isna().to_numpy()
        ids = v.id.astype("Int64")
        best = block_top(qm, q.rid.to_numpy(), vm, v.rid.to_numpy(), ids.fillna(0).to_numpy(np.int64), null, k)
        at = np.concatenate([b[0] for b in best])
        rep = np.repeat(np.arange(len(q)), [len(b[0]) for b in best])
        return pd.DataFrame({
            "q_rid": q.rid.to_numpy()[rep], "query_id": q.id.astype("Int64").to_numpy()[rep], "vec_id": ids.iloc[at].to_numpy(),
            "v_rid": v.rid.to_numpy()[at], "score": np.concatenate([b[1] for b in best]).astype(np.int64),
        })

    keys = ["dims", "qb", "vb"]
    part = keyed_q.groupBy(*keys).cogroup(keyed_v.groupBy(*keys)).applyInPandas(run, "q_rid long, query_id long, vec_id long, v_rid long, score long")
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "v_rid")
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """rid, id and v: floor(scale * x) of each component x as double. Null vectors and those with a null or non-finite
    component are left out. Stored once, so that queries and candidates agree on the rows' numbers."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.filter(F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.monotonically_increasing_id().alias("rid"))
    return stored(rows, "vectors")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of every row whose vec_id is divisible by 100."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors.filter(F.col("id") % 100 == 0), vectors)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
