"""Benchmark decontamination by a broadcast hash set of word windows; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import ascii_lower, row_key, table

WINDOW = 10
#: Bytes of benchmark windows (their words, and some for each) that may be broadcast; more of them are joined by hash.
BROADCAST_BYTES = 128 << 20
#: A word is a run of these, after lower-casing A-Z.
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{NON_WORD}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _at(ws: str, i: Column, n: int) -> list[Column]:
    return [F.get(F.col(ws), i + k) for k in range(n)]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The windows of all items: ``n`` words, ``h`` hash, ``gram`` words and ``item`` (id as text), a row for each item.

    An item of fewer words than a window is one window. Null texts and texts without words have none; an item whose
    id is null has windows, with a null ``item``.
    """
    ws = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    grams = ws.select("item", "ws", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("i")).select(
        "item", "n", F.slice("ws", F.col("i") + 1, F.col("n")).alias("gram")
    )
    # The hash takes the words one by one, as find_windows does; a short window hashes as many as it has.
    h = reduce(lambda rest, k: F.when(F.col("n") == k, F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(k)])).otherwise(rest), range(1, window + 1), F.lit(None).cast("long"))
    return grams.distinct().withColumn("h", h)


def find_windows(docs: DataFrame, grams: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each occurrence of a benchmark window in a document, and one with null ``gram`` for each document.

    Columns: ``key`` (row_key of the document), ``n_words``, ``i`` (word the window begins at), ``n``, ``gram``. Every word
    position of every text is looked up; a hit counts only when the words are equal, not just their hashes. Windows of
    up to ``BROADCAST_BYTES`` are sent to all tasks; of more, the hash of every position is shuffled, and the texts
    once, to compare the words where a hash was found: both in proportion to the words.
    """
    side = grams.select(F.col("n").alias("g_n"), F.col("h").alias("g_h"), "gram").distinct()
    size = F.sum(F.aggregate("gram", F.lit(0).cast("long"), lambda acc, w: acc + F.octet_length(w) + 8) + 64)
    facts = side.groupBy("g_n").agg(size.alias("bytes")).collect()  # at most one row per window length
    lengths, total = sorted(r.g_n for r in facts), sum(r.bytes for r in facts)
    base = docs.select(row_key(key, text_col).alias("key"), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("ws"))
    # Position -1 stands for the document itself, so that one pass gives both its word count and its hits.
    at = base.select("key", "ws", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("ws") - 1, F.lit(-1)))).alias("i"))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("h"))
    hashed = [F.when((F.col("i") >= 0) & (F.col("i") + n <= F.size("ws")), F.xxhash64(*_at("ws", F.col("i"), n))) for n in lengths]
    if len(lengths) > 1:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), h.alias("h")) for n, h in zip(lengths, hashed, strict=True)]))
        probes = at.select("key", "ws", "i", each.alias("p")).select("key", "ws", "i", F.col("p.n").alias("n"), F.col("p.h").alias("h"))
    else:
        n, h = (lengths[0], hashed[0]) if lengths else (0, none["h"])
        probes = at.select("key", "ws", "i", F.lit(n).alias("n"), h.alias("h"))
    # The hash alone is the join key, one long; the words are compared only where it matches.
    equal = (F.col("n") == F.col("g_n")) & (F.slice("ws", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("n")) == F.col("gram"))
    if total <= BROADCAST_BYTES:
        found = probes.join(F.broadcast(side), F.col("h") == F.col("g_h"), "left").filter(F.coalesce(equal, F.lit(False)) | (F.col("i") < 0))
        return found.select("key", F.size("ws").alias("n_words"), "i", "n", "gram")
    likely = probes.filter("h IS NOT NULL").select("key", "i", "n", "h").join(side.select(F.col("g_h").alias("h")).distinct(), "h", "left_semi")
    places = likely.distinct().groupBy("key").agg(F.collect_list(F.struct("i", "n", "h")).alias("p")).withColumnRenamed("key", "_key")
    whole = base.join(places, F.col("key").eqNullSafe(F.col("_key"))).select("key", "ws", F.explode("p").alias("p"))
    hits = whole.select("key", "ws", F.col("p.i").alias("i"), F.col("p.n").alias("n"), F.col("p.h").alias("h")).join(side, F.col("h") == F.col("g_h")).filter(equal)
    alone = base.select("key", F.size("ws").alias("n_words"), F.lit(-1).alias("i"), F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("gram"))
    return hits.select("key", F.size("ws").alias("n_words"), "i", "n", "gram").unionByName(alone)


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per distinct document (``key``): ``n_words``, ``n_hit`` words inside a window's occurrence, ``items``
    with occurring windows (ids as text, sorted), ``hits`` (ordinals of the hit words, ascending)."""
    grams = benchmark_windows(benchmark, window=window)
    found = find_windows(docs, grams, text_col, key)
    # A document's hits are told apart by word before they meet, so repeated passages are merged before the shuffle. The window
    # that begins at a word stands with it.
    words_hit = F.when(F.col("gram").isNotNull(), F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).otherwise(F.array(F.lit(-1)))
    spread = found.select("key", "n_words", "i", "gram", F.explode(words_hit).alias("w"))
    by_word = spread.groupBy("key", "w").agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("w") == F.col("i"), F.col("gram"))).alias("grams"))
    # Items come in last, by window, so that one that many items share is not a long list in every step before. Words without
    # a window have a key of their document's, which finds nothing.
    starts = by_word.select("key", "n_words", "w", F.explode_outer("grams").alias("gram"))
    starts = starts.withColumn("g", F.when(F.col("gram").isNull(), F.xxhash64("key", "w")).otherwise(F.xxhash64("gram")))
    named = grams.select(F.col("gram").alias("g_gram"), F.xxhash64("gram").alias("g_g"), "item")
    rows = starts.join(named, (F.col("g") == F.col("g_g")) & (F.col("gram") == F.col("g_gram")), "left")
    per_doc = rows.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("w") >= 0, F.col("w")))).alias("hits"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    return per_doc.select("key", "n_words", F.size("hits").alias("n_hit"), "items", "hits")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "document", text_col: str = "text", key: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """docs without what overlaps the benchmark.

    ``remove="document"`` drops every document with a hit word; ``"span"`` cuts the hit words out of the text, keeping
    what stands between words elsewhere. All columns are kept. Null and empty texts have no words and stay;
    repeated rows are judged alike and all stay or go; an empty benchmark removes nothing.
    """
    res = overlaps(docs, benchmark, text_col, key, window).filter("n_hit > 0").select(F.col("key").alias("_key"), F.col("hits").alias("_hits"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(key, text_col).alias("key"))
    same = F.col("key").eqNullSafe(F.col("_key"))
    if remove == "document":
        return keyed.join(res, same, "left_anti").select("row.*")
    parts = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(f"[^{NON_WORD_ANY_CASE}]+|[{NON_WORD_ANY_CASE}]+"), F.lit(0))
    leads = F.get(parts, F.lit(0)).rlike(f"^[^{NON_WORD_ANY_CASE}]").cast("int")
    # Words and gaps alternate: word number w is part 2w when the text begins with a word, else part 2w + 1.
    cut = F.array_join(
        F.filter(parts, lambda p, k: ~((k + leads) % 2 == 1) | ~F.array_contains(F.col("_hits"), ((k + leads - 1) / 2).cast("int"))), ""
    )
    joined = keyed.join(res, same, "left")
    text = F.when(F.col("_hits").isNull(), F.col(f"row.{text_col}")).otherwise(cut)
    return joined.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: The same classes before lower-casing: A-Z belong to words.
NON_WORD_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its word count, its hit words and the items it overlaps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    res = overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("own"))
    return keyed.join(res, F.col("own").eqNullSafe(F.col("key"))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM g), p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, p.i, p.n, item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
