"""Best-fit-decreasing packing of documents into token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import shared_dir, stored, table
from footfall.llm.tokens import encoder, file_system

LENGTH = 1024
#: Documents that are encoded or placed at once.
ROWS = 1024


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``length``; a leaf tells how many open bins have that much room."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = self.size + capacity
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open bin has: up to the first right-hand subtree with open
        bins, then down its left edge, in logarithmic time."""
        at = self.size + need
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


class Move(NamedTuple):
    """Items ``rank`` to ``rank + count - 1`` of a size go to the bins from ``bin`` on, ``each`` to a bin, from ``offset`` on."""

    rank: int
    count: int
    bin: int
    each: int
    offset: int


def best_fit(counts: dict[int, int], length: int) -> dict[int, list[Move]]:
    """Best-fit decreasing of ``counts[size]`` items of each size, 1 to ``length``: the moves of each size, by rank.

    Items come in descending size; each goes to the tightest open bin that has room, else to a new one. Items of a
    size are alike, and a bin that has taken one and has room for the next is the tightest for it, so a bin
    takes as many as fit, and bins that look alike are served together: work and result depend on the number of sizes,
    not of items, and bins get as full as by the item-by-item rule (of two bins with equal room either may be the tightest).
    """
    tree, groups, bins = CapacityTree(length), {}, 0
    moves: dict[int, list[Move]] = {}

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for size in sorted(counts, reverse=True):
        left, rank, out = counts[size], 0, moves.setdefault(size, [])
        while left:
            room = tree.tightest(size)
            each = (length if room is None else room) // size
            if room is None:
                room, first, n = length, bins, -(-left // each)
                bins += n
            else:
                first, n = groups[room].pop()
                tree.add(room, -n)
            full = min(n, left // each)
            put(room - each * size, first, full)
            rest = min(left - full * each, each) if full < n else 0
            if rest:
                put(room - rest * size, first + full, 1)
            untouched = n - full - (rest > 0)
            put(room, first + n - untouched, untouched)
            taken = full * each + rest
            out.append(Move(rank, taken, first, each, length - room))
            rank, left = rank + taken, left - taken
    return moves


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces: part, size, rank (among the part's pieces of that size), k, piece, start, ids; and for each
    part and size a row with null start whose rank is the number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        sums = np.zeros(length + 1, dtype=np.int64)
        names = ["part", "size", "rank", "k", "piece", "start", "ids"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

        def rows(size, *cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([np.full(len(size), part), size, *cols], types, strict=True)], names)

        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                size, rank, ks, piece, start, ids = [], [], [], [], [], []
                for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = enc.encode(text) + end
                    at, n = 0, len(raw) // width
                    step = (n - 1) % length + 1  # what is over a multiple of the length comes first
                    for p in range(-(-n // length)):
                        size.append(step)
                        rank.append(sums[step])
                        sums[step] += 1
                        ks.append(k), piece.append(p), start.append(at), ids.append(raw[at * width : (at + step) * width])
                        at, step = at + step, length
                yield rows(size, rank, ks, piece, start, ids)
        sizes = np.flatnonzero(sums)
        none = [None] * len(sizes)
        yield rows(sizes, sums[sizes], none, none, none, none)

    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text_col).alias("text"))
    return stored(slim.mapInArrow(run, "part int, size int, rank long, k long, piece int, start long, ids binary"), "pieces")


def write_bases(shares: DataFrame, path: str) -> None:
    """Where the numbers of a part's pieces begin, by size: after those of the parts before it. A folder for each part."""
    base = shares.selectExpr("part", "size", "sum(n) OVER (PARTITION BY size ORDER BY part) - n AS base")
    base.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)


def bases_of(path: str, part: int, length: int) -> np.ndarray:
    """The part's bases by size, of at most ``length`` sizes."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = file_system(f"{path}/part={part}")
    out = np.zeros(length + 1, dtype=np.int64)
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".parquet"):
            t = pq.ParquetFile(fs.open_input_file(f.path)).read(["size", "base"])
            out[t["size"].to_numpy()] = t["base"].to_numpy()
    return out


def pack_best_fit(
    docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens: k, piece, start, length, ids, sequence_id, offset.

    A document is its ids and ``end_id``. Documents over ``length`` are cut into pieces of that length, of which the
    first is what is over; no other is cut. Pieces are placed by best-fit decreasing over the whole corpus: texts are encoded
    where they are read and given a number among the pieces of their size; the counts by size, at most ``length``
    numbers, give the places of all numbers on the driver (``best_fit``). Pieces are neither sorted nor shuffled: a small file
    for each part tells where its numbers begin, and a task reads those of the parts it places.
    Sequences are numbered from 0 without gaps, and places in them follow each other without gaps. ``ids`` are
    little-endian unsigned 32-bit integers.

    Null and empty texts are the end id alone; null keys and rows that repeat a key are packed each by itself; an empty
    table gives no piece. Pieces of one size are alike, so which of them share a sequence depends on the input's
    partitions; the number of sequences and the sizes in them do not.
    """
    pieces = token_pieces(docs, tokenizer, end_id, length, key, text_col)
    shares = pieces.filter("start is null").select("part", "size", F.col("rank").alias("n"))
    counts = {r["size"]: r.n for r in shares.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most length rows
    bases = shared_dir(docs.sparkSession, "bases")
    write_bases(shares, bases)
    moves = {size: np.array(m, dtype=np.int64).reshape(-1, len(Move._fields)) for size, m in best_fit(counts, length).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = None, None
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                size, rank, parts = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy().copy(), b.column(6).to_numpy()
                for part in np.unique(parts):
                    if part != held:
                        held, base = part, bases_of(bases, part, length)
                    here = parts == part
                    rank[here] += base[size[here]]
                bin_, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
                for s in np.unique(size):
                    own = size == s
                    m = moves[int(s)]
                    at = np.searchsorted(m[:, 0], rank[own], side="right") - 1
                    nth = rank[own] - m[at, 0]
                    bin_[own] = m[at, 2] + nth // m[at, 3]
                    offset[own] = m[at, 4] + nth % m[at, 3] * s
                raw = b.column(5).to_pylist()
                ids = np.frombuffer(b"".join(raw), np.dtype(f"<u{len(raw[0]) // int(size[0])}")).astype("<u4")
                ends = np.concatenate(([0], np.cumsum(size))) * 4
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                cols = [*b.columns[:3], pa.array(size), packed, pa.array(bin_), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(cols, ["k", "piece", "start", "length", "ids", "sequence_id", "offset"])

    placed = pieces.filter("start is not null")
    return placed.select("k", "piece", "start", "size", "rank", "ids", "part").mapInArrow(
        run, "k long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    )


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into as few sequences of at most 1024 tokens as best-fit decreasing finds."""
    import public_tokenizers

    out = pack_best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("k").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
