"""SimHash near-duplicate groups by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import shared_dir, stored, table

MAX_BITS = 3
#: 8 - MAX_BITS bytes of two linked fingerprints are equal at least.
MIN_BYTES = 5
#: Byte positions of an index key: the 14 sets of four whose exclusive or is 0. Any three positions lie in one of them
#: (a Steiner quadruple system), so the complement of any three, five positions, holds the complement of one, which is
#: one of them again.
KEYS = tuple(k for k in combinations(range(8), 4) if k[0] ^ k[1] ^ k[2] ^ k[3] == 0)
#: Fingerprints of an index key that one task compares; larger keys are split by further equal bytes.
MAX_BUCKET = 8192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits; a bit is set when it is set in over half of the hashes of all n-word shingles."""
    import xxhash

    norm_words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not norm_words:
        return 0
    joined = b" ".join(norm_words)
    ends = np.cumsum([len(w) + 1 for w in norm_words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    m = max(1, len(norm_words) - n + 1)
    stops = (ends[min(n, len(norm_words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, m, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(m, at + CHUNK)], stops[at : at + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _neighbours(x: np.ndarray, seed: int) -> np.ndarray:
    """Which of x share enough positional bytes with seed and differ in few enough bits."""
    diff = x ^ np.uint64(seed)
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= MIN_BYTES) & (np.bitwise_count(diff) <= MAX_BITS)


def bucket_links(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what is linked in x, distinct fingerprints of one key: a forest, not all pairs."""
    a, b, left = [], [], x
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            seed = todo.pop()
            near = _neighbours(left, seed)
            if near.any():
                found = left[near].tolist()
                a += [seed] * len(found)
                b += found
                todo += found
                left = left[~near]
    return a, b


def _links(key_cols: int, max_bucket: int, split: bool):
    """A map over rows sorted by key: (link, key, a, b), or the rows of a key that is too large as (rows, key, fp, -)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, key: np.ndarray, a, b) -> pa.RecordBatch:
            a, b = np.asarray(a, dtype=np.uint64).view(np.int64), np.asarray(b, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, dtype=np.int32)), *[pa.array(np.full(len(a), k, dtype=np.int64)) for k in key], pa.array(a), pa.array(b)],
                ["kind", *[f"k{i}" for i in range(key_cols)], "a", "b"],
            )

        held: list[np.ndarray] = []
        now, count, streaming = None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if count > 1 and not streaming:
                a, b = bucket_links(np.unique(np.concatenate(held)))
                if a:
                    yield out(0, now, a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(key_cols)], axis=1)
            fps = batch.column(key_cols).to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]))
            lone = np.diff(cuts) == 1
            for j in range(len(cuts) - 1):
                first, last = j == 0, j == len(cuts) - 2
                if lone[j] and not first and not last:
                    continue  # a key of one fingerprint links nothing
                key, part = keys[cuts[j]], fps[cuts[j] : cuts[j + 1]]
                if now is None or (key != now).any():
                    if now is not None:
                        yield from close()
                    now, count, streaming, held = key, 0, False, []
                count += len(part)
                if streaming:
                    yield out(1, now, part, part)
                    continue
                held.append(part)
                if split and count > max_bucket:
                    whole = np.concatenate(held)
                    yield out(1, now, whole, whole)
                    streaming, held = True, []
        if now is not None:
            yield from close()

    return run


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _byte(fp: str, p: int):
    return F.shiftrightunsigned(F.col(fp), 8 * p).bitwiseAND(0xFF)


def _packed(fp: str, positions: tuple[int, ...]):
    return reduce(lambda acc, p: F.shiftleft(acc, 8).bitwiseOR(_byte(fp, p)), positions, F.lit(0).cast("long"))


def _deal(rows: DataFrame, keys: list[str], max_bucket: int, split: bool) -> DataFrame:
    schema = "kind int, " + ", ".join(f"k{i} long" for i in range(len(keys))) + ", a long, b long"
    by_key = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp")
    return stored(by_key.mapInArrow(_links(len(keys), max_bucket, split), schema), "links")


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` differing in 3 bits or fewer, without all pairs.

    Such a pair shares 5 of 8 bytes in place, so it meets under one of 14 keys of 4 byte positions. Under a key, the
    shared positional bytes of each pair are tallied; those with 5 or more are verified. A key of over ``max_bucket``
    fingerprints is passed on: its pairs share one of the 4 other bytes too, then (24 bits being left) one of four
    6-bit pieces, after which a key can hold no more than 2^18 fingerprints.
    """
    index = F.array(*[F.struct(F.lit(i).cast("long").alias("s"), _packed("fp", k).alias("v")) for i, k in enumerate(KEYS)])
    level = _deal(fps.select("fp", F.explode(index).alias("k")).select(F.col("k.s").alias("s"), F.col("k.v").alias("v"), "fp"), ["s", "v"], max_bucket, True)
    found = level.filter("kind = 0").select("a", "b")
    big = level.filter("kind = 1").select(F.col("k0").alias("s"), F.col("k1").alias("v"), F.col("a").alias("fp"))
    if big.isEmpty():
        return found
    # One more of the other 4 bytes is equal.
    def rest_of(s):
        return F.element_at(F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in k]) for k in KEYS]), (F.col(s) + 1).cast("int"))

    more = big.select("s", "v", "fp", F.posexplode(rest_of("s")).alias("x", "p"))
    byte_at = _shifted(F.col("fp"), F.col("p") * 8).bitwiseAND(0xFF)
    more = more.select((F.col("s") * 8 + F.col("p")).alias("s"), F.shiftleft(F.col("v"), 8).bitwiseOR(byte_at).alias("v"), "fp")
    level = _deal(more, ["s", "v"], max_bucket, True)
    found = found.union(level.filter("kind = 0").select("a", "b"))
    big = level.filter("kind = 1").select(F.col("k0").alias("s"), F.col("k1").alias("v"), F.col("a").alias("fp"))
    if big.isEmpty():
        return found
    # Of the last 24 bits, cut into four pieces of 6, one piece is equal.
    left = F.filter(rest_of("s0"), lambda p: p != F.col("p0"))
    big = big.withColumns({"s0": F.floor(F.col("s") / 8).cast("long"), "p0": (F.col("s") % 8).cast("int")})
    bits = F.aggregate(left, F.lit(0).cast("long"), lambda acc, p: F.shiftleft(acc, 8).bitwiseOR(_shifted(F.col("fp"), p * 8).bitwiseAND(0xFF)))
    more = big.withColumn("bits", bits).select("s", "v", "fp", "bits", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    piece = _shifted(F.col("bits"), F.col("q") * 6).bitwiseAND(63)
    more = more.select((F.col("s") * 4 + F.col("q")).alias("s"), F.shiftleft(F.col("v"), 6).bitwiseOR(piece).alias("v"), "fp")
    return found.union(_deal(more, ["s", "v"], max_bucket, False).filter("kind = 0").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the smallest node of its component.

    Alternates star contractions: each round points every neighbour above a node at the smallest node around it, then
    every smaller neighbour of a node at its smallest. Rounds grow with the logarithm of the longest chain; each is
    stored, so nothing is recomputed and nothing is gathered.
    """
    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        after = stored(small, "edges")
        # Settled when every node points at one root and no root points further.
        loose = after.groupBy("u").count().filter("count > 1").select("u").union(after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").distinct())
        if loose.isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        pairs = after


def near_groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``id``, ``fp`` and ``component_id``, the smallest id reachable over links, of every row of docs.

    Rows with equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint zero
    and are linked like others; texts of fewer words than a shingle are one shingle; a null id takes no part in the
    smallest id (null only if all ids of a group are); repeated rows all come back; an empty table gives none.
    """
    fps = stored(fingerprints(docs, key, text_col, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    comp = stored(components(links(nodes.select("fp"), max_bucket)), "components")
    joined = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(roots, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("id", "fp", "component_id")


def pick_one(docs: DataFrame, key: str, text_col: str, groups_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with one row of each group: ``groups_of`` gives ``id`` and ``component_id`` of rows (``rid``, ``text``)."""
    cols = docs.columns
    path = shared_dir(docs.sparkSession, "rows")
    docs.select(F.struct(*cols).alias("row"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("rid")).write.option(
        "compression", "zstd"
    ).parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    groups = groups_of(rows.select("rid", F.col(f"row.{text_col}").alias("text")))
    ids = groups.select(F.col("id").alias("rid"), F.col("component_id").alias("c")).join(rows.select("rid", "id"), "rid")
    best = ids.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "rid")).alias("m")).select(F.col("m.rid").alias("rid"))
    return rows.join(best, "rid", "left_semi").select("row.*")


def keep_one(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id.

    Of rows that repeat that id, one stays: the one with the smallest text hash. All columns are kept. A group whose
    ids are all null keeps one row too.
    """
    return pick_one(docs, key, text_col, lambda rows: near_groups(rows, "rid", "text", shingle))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
