"""Files of raw token ids with a minimal perfect hash index from document keys to places in them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import shared_dir, stored, table
from footfall.llm.tokens import WholeFile, encoder, file_system

MAGIC = b"FFTOKEN1"
HEADER = "<8sII"  # magic, bytes per id, end id; then the ids
#: Keys of an index file, on average.
BUCKET_KEYS = 1 << 16
#: Places per key at each level of the hash.
GAMMA = 2
LEVELS = 48


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """n distinct hashes to slots 0 to n-1: at each level the hashes that fall alone on a place keep it.

    Slots are ranks of set places. Hashes that are still not alone after all levels (equal 64-bit hashes of different
    keys) take the last slots, which a look-up walks through.
    """

    def __init__(self, levels: list[np.ndarray], n: int) -> None:
        self.levels, self.n = levels, n
        self.ranks = [np.cumsum(b, dtype=np.int64) for b in levels]
        self.first = np.concatenate(([0], np.cumsum([int(r[-1]) if len(r) else 0 for r in self.ranks]))).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels, left = [], h
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, len(h))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; the first of the last slots for one that has no place."""
        out = np.full(len(h), self.first[-1], dtype=np.int64)
        todo = np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = (_mix(h[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.first[level] + self.ranks[level][at[hit]] - 1
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack(f"<QI{len(self.levels)}Q", self.n, len(self.levels), *[len(b) for b in self.levels])
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        n, count = struct.unpack_from("<QI", data)
        sizes = struct.unpack_from(f"<{count}Q", data, 12)
        at, levels = 12 + 8 * count, []
        for s in sizes:
            width = (s + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=s).astype(bool))
            at += width
        return cls(levels, n), at


ENTRY = np.dtype([("fp", "<u8"), ("part", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def build_bucket(h: np.ndarray, rows: np.ndarray) -> bytes:
    mph = PerfectHash.build(h)
    slots = mph.slots(h)
    rest = slots == mph.first[-1]
    slots[rest] += np.arange(int(rest.sum()))
    entries = np.zeros(len(h), dtype=ENTRY)
    entries[slots] = rows
    return mph.dump() + entries.tobytes()


def find_in_bucket(data: bytes, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are there, and the entries of those."""
    mph, at = PerfectHash.load(data)
    entries = np.frombuffer(data, ENTRY, mph.n, at)
    slots = mph.slots(h)
    placed = slots < mph.first[-1]
    found = np.zeros(len(h), dtype=bool)
    found[placed] = entries["fp"][slots[placed]] == fp[placed]
    for i in np.flatnonzero(~placed):
        more = np.flatnonzero(entries["fp"][mph.first[-1]:] == fp[i])
        if len(more):
            slots[i], found[i] = mph.first[-1] + more[0], True
    return found, entries[slots[found]]


class TokenFiles:
    """Written files: ``shard-*.bin`` in ascending key order and ``index-*.mph``, below ``root``.

    ``parts`` has a row per shard file: part, start (ids in earlier files), first_k and again (how many documents with
    that key earlier files hold). Its length is bounded by the number of write tasks.
    """

    def __init__(self, spark: SparkSession, root: str, parts: list[tuple], buckets: int) -> None:
        self.spark, self.root, self.parts, self.buckets = spark, root, parts, buckets

    def starts(self) -> DataFrame:
        df = self.spark.createDataFrame(self.parts, "part int, start long, first_k long, again long")
        return F.broadcast(df) if len(self.parts) <= 100_000 else df

    def keyed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("k", "occ")
        keyed = keys.withColumns({"h": h, "fp": F.xxhash64(F.lit("fingerprint"), "k", "occ")})
        return keyed.withColumn("bucket", F.pmod("h", F.lit(self.buckets)).cast("int"))

    def find(self, keys: DataFrame) -> DataFrame:
        """k, occ, part, offset, n of those distinct keys (k, occ) that the index holds; others give no row."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, data = None, b""
            for b in batches:
                bucket = b.column(4).to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if hi == lo:
                        continue
                    if bucket[lo] != now:
                        now = bucket[lo]
                        fs, path = file_system(f"{root}/index-{now:06d}.mph")
                        with fs.open_input_file(path) as f:
                            data = f.read()
                    part = b.slice(lo, hi - lo)
                    found, e = find_in_bucket(data, part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy().view(np.uint64))
                    mask = pa.array(found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).filter(mask), part.column(1).filter(mask), pa.array(e["part"].astype(np.int32)), pa.array(e["offset"].astype(np.int64)), pa.array(e["n"].astype(np.int64))],
                        ["k", "occ", "part", "offset", "n"],
                    )

        by_bucket = self.keyed(keys.select(F.col("k").cast("long").alias("k"), F.col("occ").cast("long").alias("occ"))).repartition("bucket").sortWithinPartitions("bucket")
        return by_bucket.mapInArrow(run, "k long, occ long, part int, offset long, n long")

    def read(self, found: DataFrame) -> DataFrame:
        """found with ``ids``: the document's ids as little-endian unsigned 32-bit integers, read from its range."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, f, head = None, None, None
            for b in batches:
                out = []
                for part, offset, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if part != now:
                        if f is not None:
                            f.close()
                        fs, path = file_system(f"{root}/shard-{part:06d}.bin")
                        now, f = part, fs.open_input_file(path)
                        magic, width, _ = struct.unpack(HEADER, f.read_at(struct.calcsize(HEADER), 0))
                        if magic != MAGIC:
                            raise ValueError(f"{path} is no token file")
                        head = np.dtype(f"<u{width}")
                    raw = f.read_at(n * head.itemsize, struct.calcsize(HEADER) + offset * head.itemsize)
                    out.append(np.frombuffer(raw, head).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["k", "occ", "part", "offset", "n", "ids"])
            if f is not None:
                f.close()

        ordered = found.repartitionByRange("part", "offset").sortWithinPartitions("part", "offset")
        return ordered.mapInArrow(run, "k long, occ long, part int, offset long, n long, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text_col: str = "text", root: str | None = None) -> TokenFiles:
    """Encodes every text, adds ``end_id``, writes the ids in ascending key order and builds the index.

    A null or empty text is the end id alone. Rows that repeat a key follow each other (``occ`` 0, 1, ... in input
    order) and each has its own index key; null keys come first. Keys are whole numbers. An empty table gives no shard
    file and an index without entries. Rows are dealt to tasks by ranges of (key, row), so that even one key with a
    third of all rows is spread.
    """
    spark = docs.sparkSession
    root = root or shared_dir(spark, "tokens")
    schema = "kind int, part int, k long, occ long, offset long, n long, last_k long, last_run long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        out, at, last, occ, first = None, 0, None, 0, None

        def rows(*cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), *[pa.int64()] * 6], strict=True)], ["kind", "part", "k", "occ", "offset", "n", "last_k", "last_run"])

        for b in batches:
            ks, occs, offs, ns = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    out, first = WholeFile(f"{root}/shard-{part:06d}.bin"), k
                    out.write(struct.pack(HEADER, MAGIC, enc.dtype.itemsize, end_id))
                    occ = 0
                else:
                    occ = occ + 1 if k == last else 0
                last = k
                ids = enc.encode(text) + end
                out.write(ids)
                n = len(ids) // enc.dtype.itemsize
                ks.append(k), occs.append(occ), offs.append(at), ns.append(n)
                at += n
            none = [None] * len(ks)
            yield rows([0] * len(ks), [part] * len(ks), ks, occs, offs, ns, none, none)
        if out is not None:
            out.close()
            yield rows([1], [part], [first], [None], [None], [at], [last], [occ + 1])

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    ordered = source.repartitionByRange("k", "rid").sortWithinPartitions("k", "rid").select("k", "text")
    written = stored(ordered.mapInArrow(run, schema), "written")
    # A row per file; where a key goes on from one file to the next, its documents are numbered on.
    parts, start, before, run_len = [], 0, None, 0
    for r in sorted(written.filter("kind = 1").select("part", "k", "n", "last_k", "last_run").collect(), key=lambda r: r.part):
        again = run_len if parts and before == r.k else 0
        parts.append((r.part, start, r.k, again))
        start += r.n
        run_len = r.last_run + (again if r.last_k == r.k else 0)
        before = r.last_k
    entries = written.filter("kind = 0").select("part", "k", "occ", "offset", "n")
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))
    files = TokenFiles(spark, root, parts, buckets)
    same = F.col("k").eqNullSafe(F.col("first_k"))
    placed = entries.join(files.starts().drop("start"), "part").withColumn("occ", F.col("occ") + F.when(same, F.col("again")).otherwise(0))
    rows = files.keyed(placed).select("bucket", "h", "fp", "part", "offset", "n")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.zeros(len(pdf), dtype=ENTRY)
        e["fp"], e["part"], e["offset"], e["n"] = pdf.fp.to_numpy().view(np.uint64), pdf.part, pdf.offset, pdf.n
        bucket = int(pdf.bucket.iloc[0])
        f = WholeFile(f"{root}/index-{bucket:06d}.mph")
        f.write(build_bucket(pdf.h.to_numpy().view(np.uint64), e))
        f.close()
        return pd.DataFrame({"bucket": [bucket], "n": [len(pdf)]})

    have = {r.bucket for r in rows.groupBy("bucket").applyInPandas(index, "bucket int, n long").select("bucket").collect()}
    for b in range(buckets):  # a bucket without keys still has its file
        if b not in have:
            f = WholeFile(f"{root}/index-{b:06d}.mph")
            f.write(build_bucket(np.zeros(0, np.uint64), np.zeros(0, ENTRY)))
            f.close()
    return files


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents, then reads every one back through the index."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    keys = docs.groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("c")).select("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("occ"))
    back = files.read(files.find(keys)).join(files.starts().select("part", "start"), "part")
    return back.select(
        F.col("k").alias("doc_id"), (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
