"""Removal of lines that many documents share, over levelled sorted runs of line hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from footfall.llm.common import ascii_lower, row_key, shared_dir, stored, table

MIN_CHARS = 20
MIN_DOCS = 3
#: Runs of a level that are merged into one run of the next.
FANOUT = 3
BATCHES = 4
SPACE = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def keyed_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc`` (row_key), ``id``, ``line`` (from 0) and the 128-bit hash ``h1, h2`` of each line whose key is long enough."""
    lines = docs.select(F.col(key).alias("id"), row_key(key, text_col).alias("doc"), F.posexplode(split_lines(F.col(text_col))).alias("line", "s"))
    keys = lines.select("doc", "id", "line", line_key(F.col("s")).alias("s")).filter(F.length("s") >= min_chars)
    return keys.select("doc", "id", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), "s").alias("h2"))


class LineRuns:
    """Which line hashes were seen, in how many documents, and the largest id that has them.

    A batch is merged with the live runs by hash: hashes that no run holds (the anti-join) start their count, the
    others carry it on, and what the batch holds becomes one sorted run of level 0. ``fanout`` runs of a level are merged
    into one of the next, so a hash is rewritten once a level and a batch merges with few runs. As counts and largest
    ids only grow, the greatest entry of a hash is its newest one, wherever compaction has put it. Runs are Parquet
    folders below ``root`` and never change once written; the list of live runs is ``paths``, which may be handed to a
    later object.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, paths: list[tuple[int, str]] | None = None) -> None:
        self.spark, self.root, self.fanout = spark, root, fanout
        self.paths: list[tuple[int, str]] = list(paths or [])
        self._made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{shared_dir(self.spark, 'run') if not self.root else self.root}/L{level}-{len(self.paths)}-{self._made}"
        self._made += 1
        run.sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(path)
        self.paths.append((level, path))

    def _merge(self, paths: list[str], min_docs: int = 0) -> DataFrame:
        runs = self.spark.read.schema("h1 long, h2 long, n long, top long").parquet(*paths).filter(F.col("n") >= min_docs)
        return runs.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.max("top").alias("top"))

    def add(self, lines: DataFrame) -> None:
        """Adds a batch's lines as a run. A document belongs to one batch, so counts of batches add up.

        A null id counts as no document and is below all others."""
        # First by document, then by line: a line that a third of all documents hold is spread over all tasks.
        per_doc = lines.select("h1", "h2", "id").distinct()
        batch = per_doc.groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").cast("long").alias("top"))
        if self.paths:  # dealt by hash on both sides already: the join moves nothing
            live = self.entries().select("h1", "h2", F.col("n").alias("had"), F.col("top").alias("had_top"))
            batch = batch.join(live, ["h1", "h2"], "left").select(
                "h1", "h2", (F.col("n") + F.coalesce("had", F.lit(0))).alias("n"), F.greatest("top", "had_top").alias("top")
            )
        self._write(batch, 0)
        level = 0
        while len(full := [p for v, p in self.paths if v == level]) >= self.fanout:
            merged = self._merge(full)
            self._write(merged, level + 1)
            self.paths = [x for x in self.paths if x[1] not in full]
            level += 1

    def entries(self, min_docs: int = 0) -> DataFrame:
        """All runs merged, or only the hashes that ``min_docs`` documents or more hold; others are not shuffled then."""
        if not self.paths:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, top long")
        return self._merge([p for _, p in self.paths], min_docs)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines that no run holds: each run is anti-joined in turn, the largest first."""
        for _, path in sorted(self.paths, reverse=True):
            lines = lines.join(self.spark.read.schema("h1 long, h2 long, n long, top long").parquet(path), ["h1", "h2"], "left_anti")
        return lines

    def add_new(self, docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
        """One batch of a growing corpus: docs without the lines that earlier batches hold; then adds its own lines."""
        lines = stored(keyed_lines(docs, key, text_col, min_chars), "batch")
        seen = lines.join(self.unseen(lines).select("h1", "h2").distinct(), ["h1", "h2"], "left_anti").select("doc", "line")
        out = stored(without_lines(docs, seen, key, text_col), "kept").drop("_n_lines", "_n_dropped")
        self.add(lines)
        return out


@F.pandas_udf(StringType())
def _kept(text: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None or gone is None:
            return None
        out = set(gone.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)

    return pd.Series([one(t, g) for t, g in zip(text, dropped, strict=True)], dtype=object)


def without_lines(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of ``dropped`` (doc, line) cut out of the text, and ``_n_lines`` and ``_n_dropped``."""
    gone = dropped.groupBy("doc").agg(F.collect_set("line").alias("gone")).select(F.col("doc").alias("_doc"), "gone")
    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("row"), row_key(key, text_col).alias("doc"))
    joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("_doc")), "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.col("cut"))
    cut = joined.withColumn("cut", _kept(F.when(F.col("gone").isNotNull(), text), F.col("gone")))
    return cut.select(
        *[(kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in cols],
        F.size(split_lines(text)).cast("long").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_dropped"),
    )


def dedupe_lines(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """docs whose repeated lines stay only in the largest id that holds them; ``_n_lines`` and ``_n_dropped`` are added.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of ``min_chars`` code
    points or more that ``min_docs`` distinct ids hold are repeated; all lines of such a key go, except in the
    largest id. Batches of documents (by a hash of the id) are merged with the runs of earlier ones and added as sorted
    runs, which are compacted by level; then every document is merged with the runs' repeated lines.

    A null or empty text is one empty line; a null text without dropped lines stays null. A null id counts as no
    document and never keeps a repeated line; rows that repeat an id count once and keep the same lines. Columns of any
    name are carried. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "lines")
    batch = F.coalesce(F.pmod(F.xxhash64("id"), F.lit(batches)), F.lit(0)).cast("int")
    keyed_lines(docs, key, text_col, min_chars).withColumn("batch", batch).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    id_type = docs.select(F.col(key).alias("id"), row_key(key, text_col).alias("doc")).schema
    lines = spark.read.schema(
        f"doc {id_type['doc'].dataType.simpleString()}, id {id_type['id'].dataType.simpleString()}, line int, h1 long, h2 long, batch int"
    ).parquet(path)
    runs = LineRuns(spark, shared_dir(spark, "runs"), fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    # Stored, so that the join below deals out both sides itself and can split the lines of a hot key.
    repeated = stored(runs.entries(min_docs).select("h1", "h2", "top"), "repeated")
    dropped = lines.join(repeated, ["h1", "h2"]).filter(F.col("id").isNull() | (F.col("id") < F.col("top"))).select("doc", "line")
    return without_lines(docs, dropped, key, text_col)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and the hash of what is kept."""
    out = dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), r AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT l.doc_id, l.i, l.line, r.top IS NOT NULL AND l.doc_id < r.top AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
