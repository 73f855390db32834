"""Packing of documents into token sequences under controlled mixture proportions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import stored, table
from footfall.llm.tokens import encoder

LENGTH = 1024
#: Documents that are cut at once.
ROWS = 1024
#: Tokens a queue sends in one turn, well below LENGTH so that a sequence mixes sources; divides LENGTH.
QUANTUM = 64
#: The largest sources, and those with a target, have a queue each; the others share this many queues by ranges of name.
OWN, POOLS = 512, 512
#: Step between the phases of neighbouring queues: keeps any number of them spread evenly.
GOLDEN = 0.6180339887498949


def tokens_before(s: int, j: np.ndarray, totals: np.ndarray, quantum: int, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """How many tokens come before turn j of queue s.

    After t tokens a queue of weight w is owed t * w / sum(weights) of them, and the queue with the largest deficit is
    served, with ``quantum`` tokens or, in its last turn, what it has left. A turn is due when the part ``phases`` of it
    is owed, so its turn j (from 0) of n tokens comes at (2 * j * quantum + 2 * phase * n) / w; turns are ordered by that
    value, then by queue; a queue that has run out is skipped. Deficits are thus carried through the whole corpus, and any
    turn's place follows from its number alone, in whatever partition it is.
    """

    def due_of(k: int, c: np.ndarray) -> np.ndarray:
        return (2.0 * c * quantum + 2.0 * phases[k] * np.minimum(quantum, totals[k] - c * quantum)) / weights[k]

    due = due_of(s, j)
    out = np.zeros(len(j), dtype=np.int64)
    for k in range(len(totals)):
        if k == s:
            out += j * quantum
            continue
        turns = -(-totals[k] // quantum)

        def earlier(c: np.ndarray, k=k) -> np.ndarray:
            key = due_of(k, c)
            return (key < due) | ((key == due) & (k < s))

        c = np.clip(np.floor(due * weights[k] / (2 * quantum) - phases[k] + 1), 0, turns).astype(np.int64)
        while (up := (c < turns) & earlier(c)).any():
            c += up
        while (down := (c > 0) & ~earlier(c - 1)).any():
            c -= down
        out += np.minimum(c * quantum, totals[k])
    return out


def turns_before(s: int, j: np.ndarray, quanta: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many turns come before turn j of queue s, all turns being due in their middle."""
    return tokens_before(s, j, quanta, 1, weights, np.full(len(quanta), 0.5))


def token_queues(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document's ids in the queue of its source, in key order: part, source, k, at (in the part's share of the
    queue), n, ids; and for each part and source a row with null ids whose n is the share's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        sums: dict[str | None, int] = {}
        names = ["part", "source", "k", "at", "n", "ids"]

        def rows(source, k, at, n, ids) -> pa.RecordBatch:
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[part] * len(n), source, k, at, n, ids], types, strict=True)], names)

        for b in batches:
            sources, at, n, ids = b.column(0).to_pylist(), [], [], []
            for source, text in zip(sources, b.column(2).to_pylist(), strict=True):
                raw = enc.encode(text) + end
                m = len(raw) // width
                at.append(sums.get(source, 0))
                n.append(m)
                ids.append(raw)
                sums[source] = at[-1] + m
            yield rows(sources, b.column(1).to_pylist(), at, n, ids)
        if sums:
            yield rows(list(sums), [None] * len(sums), [None] * len(sums), list(sums.values()), [None] * len(sums))

    source = docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(key).cast("long").alias("k"), F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("rid"),
    )
    ordered = source.repartitionByRange("source", "k", "rid").sortWithinPartitions("source", "k", "rid").select("source", "k", "text")
    return stored(ordered.mapInArrow(run, "part int, source string, k long, at long, n long, ids binary"), "queues")


def source_queues(queues: DataFrame, targets: dict[str, float] | None, own: int = OWN, pools: int = POOLS) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(part, source, queue, base) of what each part holds of a source, and every queue's length and weight.

    ``base`` is where that share begins in its queue. The ``own`` sources with most tokens and those with a target have queues
    of their own; of the others, those in neighbouring parts (ranges of source and key) follow each other in one of
    ``pools`` queues, whose weight is the sum of theirs. So the state of the round robin does not grow with the sources.
    """
    shares = queues.filter("at is null").select("part", "source", "n")
    largest = shares.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(own)
    named = sorted({(r.source is not None, r.source or "") for r in largest.collect()} | {(True, s) for s in targets or {}})
    parts = (shares.agg(F.max("part")).first()[0] or 0) + 1
    number = F.create_map(*[x for i, (known, s) in enumerate(named) if known for x in (F.lit(s), F.lit(i))]) if any(k for k, _ in named) else F.create_map().cast("map<string,int>")
    alone = F.try_element_at(number, F.coalesce("source", F.lit("")))
    alone = F.when(F.col("source").isNull(), F.lit(0 if (False, "") in named else None).cast("int")).otherwise(alone)
    pooled = (F.lit(len(named)) + F.floor(F.col("part").cast("long") * pools / parts)).cast("int")
    dealt = shares.withColumn("queue", F.coalesce(alone, pooled))
    base = "sum(n) OVER (PARTITION BY queue ORDER BY source, part) - n AS base"
    dealt = stored(dealt.selectExpr("part", "source", "queue", "n", base), "bases")
    sums = {r.queue: r for r in dealt.groupBy("queue").agg(F.sum("n").alias("n"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("s")).collect()}
    out = []
    for i in range(len(named) + pools):
        n, many = (sums[i].n, sums[i].s) if i in sums else (0, 0)
        weight = float(n) if targets is None else targets.get(named[i][1], 1.0) if i < len(named) and named[i][0] else 1.0 if i < len(named) else float(many)
        out.append((n, weight))
    return dealt.select("part", "source", "queue", "base"), out


def pack(
    docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, end_id: int = 0, length: int = LENGTH, quantum: int = QUANTUM,
    key: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: k, start, length, ids, doc_tokens, sequence_id, offset.

    Each source is a queue of its documents in key order, each document its ids and ``end_id``. Queues take turns by
    deficit round robin and send ``quantum`` tokens a turn, so every window of sequences holds each source's target
    share up to about one quantum (large ones two; the largest source takes up the rounding of all others too), and what
    a source lacks in a window is made up in the next. ``targets`` gives the weight
    of sources (others weigh nothing extra: 1); by default the weight is the source's token count, which makes all
    queues end together. A queue that ends early leaves its turns to the others. The last turn of a queue, and the only
    one of a source with less than a quantum, is short and takes its place like any other; queues start at different
    phases, so small sources are spread over the corpus. Beyond some hundred sources the smallest share queues
    (``source_queues``), each with the sum of its sources' shares; their number has no limit. Turns follow each other without gaps, so only the last sequence
    can be short. ``ids`` are little-endian unsigned 32-bit integers.

    Null and empty texts are the end id alone; a null source is a queue of its own; rows that repeat a key are packed
    each by itself; an empty table gives no piece. A hot source is spread over tasks by ranges of (source, key, row).
    """
    if length % quantum:
        raise ValueError("quantum must divide length")
    queues = token_queues(docs, tokenizer, end_id, key, text_col, source_col)
    bases, dealt = source_queues(queues, targets)
    total, weights = np.array([n for n, _ in dealt], dtype=np.int64), np.array([w for _, w in dealt], dtype=float)
    live = np.flatnonzero(total)  # empty queues take no turn
    place_of = np.full(len(total), -1)
    place_of[live] = np.arange(len(live))
    total, weights = total[live], weights[live]
    phases = (0.5 + GOLDEN * np.arange(len(live))) % 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                yield packed(b)

    def packed(b: pa.RecordBatch) -> pa.RecordBatch:
        queue, lo, n = place_of[b.column(0).to_numpy()], b.column(2).to_numpy(), b.column(3).to_numpy()
        # One piece a document and turn: its row, turn, place in the queue and length.
        count = (lo + n - 1) // quantum - lo // quantum + 1
        row = np.repeat(np.arange(len(n)), count)
        turn = (lo // quantum)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = np.maximum(turn * quantum, lo[row])
        size = np.minimum((turn + 1) * quantum, (lo + n)[row]) - place
        where = place - turn * quantum
        for s in np.unique(queue):
            own = queue[row] == s
            uniq, back = np.unique(turn[own], return_inverse=True)
            where[own] += tokens_before(int(s), uniq, total, quantum, weights, phases)[back]
        # A piece over the end of a sequence is cut there; one that goes on where the piece before ends is joined to it.
        head = np.minimum(size, length - where % length)
        twice = np.repeat(np.arange(len(row)), 1 + (head < size))
        second = np.concatenate(([False], twice[1:] == twice[:-1]))
        row, where = row[twice], where[twice] + np.where(second, head[twice], 0)
        size = np.where(second, (size - head)[twice], head[twice])
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (where[1:] != where[:-1] + size[:-1]) | (where[1:] % length == 0)))
        at = np.flatnonzero(first)
        row, where, size = row[at], where[at], np.add.reduceat(size, at)
        before = np.cumsum(size) - size
        start = before - (np.cumsum(n) - n)[row]
        raw = b.column(4).to_pylist()
        ids = np.frombuffer(b"".join(raw), np.dtype(f"<u{len(raw[0]) // n[0]}")).astype("<u4")
        ends = np.concatenate((before, [len(ids)])) * 4
        cols = [
            b.column(1).take(pa.array(row)), pa.array(start), pa.array(size),
            pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
            pa.array(n[row]), pa.array(where // length), pa.array(where % length),
        ]
        return pa.RecordBatch.from_arrays(cols, ["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    mine = queues.filter("at is not null").alias("q").join(bases.alias("b"), (F.col("q.part") == F.col("b.part")) & F.col("q.source").eqNullSafe(F.col("b.source")))
    return mine.select("queue", "k", (F.col("at") + F.col("base")).alias("lo"), "n", "ids").mapInArrow(
        run, "k long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def packed_pieces(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pieces in digest form, with_ids with the token ids too."""
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        F.col("k").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, mixed by source."""
    return packed_pieces(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
