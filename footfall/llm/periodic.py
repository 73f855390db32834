"""Periodic runs of words, found online by dyadic square catching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import table

MIN_WORDS = 24
#: Length of a run over its period, at least; the catchers' blocks are sized for 3.
EXPONENT = 3
#: Words that a catcher takes in at once, and words of short documents that share one.
STEP = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant modulo 2 to the 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, _ODD))))
    return _powers


class SquareCatcher:
    """Runs of a growing sequence of numbers: maximal stretches whose smallest period fits ``EXPONENT`` times.

    For each power of two B, every completed block of B words, aligned to B, has a catcher that watches the next words
    for the block to come back at a distance q of B to 2 B - 1. Every run of period q and length 3 q holds such a block and its
    return, and exactly one catcher of a level looks at each suffix of B words, so an appended word costs one comparison
    a level, of prefix hashes. A return is extended to both sides (binary search over hashes) to the stretch with period q. A
    stretch that goes on to the last word stays open and is compared word by word as others are appended; returns inside a
    run of a smaller period that divides q belong to that run and are dropped; other returns of one stretch are merged.
    Stretches are checked against the words before they are reported, so hashes only save time.
    """

    def __init__(self, longest_period: int | None = None) -> None:
        self.longest = longest_period
        self.n = 0
        self.words = np.empty(1024, dtype=np.int64)
        self.sums = np.zeros(1025, dtype=np.uint64)
        none = np.zeros((0, 3), dtype=np.int64)
        self.runs, self.open = none, none  # (start, end, period); an open stretch ends with the sequence

    def append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        if n > len(self.words):
            room = max(n, 2 * len(self.words))
            self.words, self.sums = np.resize(self.words, room), np.resize(self.sums, room + 1)
        self.words[old:n] = words
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.sums[old + 1 : n + 1] = self.sums[old] + np.cumsum((mixed ^ (mixed >> np.uint64(32))) * powers(n)[old:n])
        self.n = n
        self._advance(old)
        block = 1
        while EXPONENT * block <= n and (self.longest is None or block <= self.longest):
            self._catch(block, max(block, old - block + 1))
            block *= 2

    def close(self) -> np.ndarray:
        """The sequence ends here: all runs as rows (start, end, period) by start, then period."""
        self._settle(self.open)
        self.open = self.open[:0]
        return self.runs[np.lexsort((self.runs[:, 2], self.runs[:, 0]))]

    def _advance(self, old: int) -> None:
        """Compares the appended words with those a period before, for every open stretch."""
        still, ended = [], []
        for a, _, q in self.open.tolist():
            differs = np.flatnonzero(self.words[old : self.n] != self.words[old - q : self.n - q])
            (ended if len(differs) else still).append((a, old + int(differs[0]) if len(differs) else self.n, q))
        self.open = np.array(still, dtype=np.int64).reshape(-1, 3)
        self._settle(np.array(ended, dtype=np.int64).reshape(-1, 3))

    def _same(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        """Whether the words from a on hash like those from b on, a being before b."""
        s = self.sums
        return (s[a + size] - s[a]) * powers(self.n)[b - a] == s[b + size] - s[b]

    def _catch(self, block: int, first: int) -> None:
        """One level: the suffixes of ``block`` words that begin at ``first`` or later."""
        p = np.arange(first, self.n - block + 1)
        s = (p - block) // block * block
        hit = self._same(s, p, block)
        if not hit.any():
            return
        s, q = s[hit], p[hit] - s[hit]
        # Inside a run of a smaller period: reach has the furthest end of those that begin at or before a word.
        smaller = np.concatenate([x[x[:, 2] < block] for x in (self.runs, self.open)])
        if len(smaller):
            order = np.argsort(smaller[:, 0], kind="stable")
            reach = np.concatenate(([0], np.maximum.accumulate(smaller[order, 1])))
            new = reach[np.searchsorted(smaller[order, 0], s, side="right")] < s + q + block
            s, q = s[new], q[new]
        known = np.isin(q, self.open[:, 2])
        s, q = s[~known], q[~known]
        if not len(s):
            return
        found = np.unique(np.stack(self._stretch(s, q, block), axis=1), axis=0)
        on = found[:, 1] == self.n
        self.open = np.concatenate((self.open, found[on]))
        self._settle(found[~on])

    def _stretch(self, s: np.ndarray, q: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretch with period q around each return of the block at s: start, end, period."""
        lo, hi = np.full(len(s), block), self.n - s - q
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._same(s, s + q, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        left, most = np.zeros(len(s), dtype=np.int64), s.copy()
        while (left < most).any():
            mid = (left + most + 1) // 2
            same = self._same(s - mid, s + q - mid, mid)
            left, most = np.where(same, mid, left), np.where(same, most, mid - 1)
        return s - left, s + q + lo, q

    def _settle(self, found: np.ndarray) -> None:
        """Adds the stretches that are runs."""
        runs = found[found[:, 1] - found[:, 0] >= EXPONENT * found[:, 2]]
        out = []
        for a, b, q in runs.tolist():
            equal = self.words[a : b - q] == self.words[a + q : b]
            if equal.all():
                out.append((a, b, q))
            else:  # different words with equal hashes: the stretches inside, by the words themselves
                edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False]))))
                out += [(a + i, a + j + q, q) for i, j in edges.reshape(-1, 2).tolist() if j - i >= (EXPONENT - 1) * q]
        if out:
            self.runs = np.unique(np.concatenate((self.runs, np.array(out, dtype=np.int64))), axis=0)


def catch_runs(sequences: list[np.ndarray], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of numbers from 0, of at least ``min_words`` words.

    The sequences go through one catcher, parted by numbers of their own that no run can cross."""
    catcher = SquareCatcher(max(map(len, sequences), default=0) // EXPONENT)
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]) <= STEP)
    short: list[np.ndarray] = []
    for i in order:
        parts = [*np.split(sequences[i], range(STEP, len(sequences[i]), STEP)), np.array([-i - 1])]
        if len(parts) == 2:
            short += parts
        else:
            for part in parts:
                catcher.append(part)
    if short:
        catcher.append(np.concatenate(short))
    starts = np.cumsum([0, *[len(sequences[i]) + 1 for i in order]])[:-1]
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    for a, b, q in catcher.close().tolist():
        if b - a >= min_words:
            at = int(np.searchsorted(starts, a, side="right")) - 1
            out[order[at]].append((a - int(starts[at]), b - a, q))
    return out


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def periodic_runs(docs: DataFrame, key: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key``, ``runs`` and ``collapsed`` of every row of docs.

    Words stand between white space (space and U+0009 to U+000D) and are numbered from 0. A run is a stretch of words with smallest
    period q, at least ``min_words`` and 3 q long, which no neighbouring word extends: ``start``, ``length`` and ``period``, by
    start, then period. ``collapsed`` has the words that no run holds after its first q, joined by single spaces.
    Every row is worked on where it is read, nothing is shuffled; texts are cut into steps, so memory follows the longest text.

    Null and empty texts have no words: no runs and an empty ``collapsed``. Null keys and repeated rows all come back; other
    columns take no part; an empty table gives none.
    """
    kind = docs.schema[key].dataType

    def out(keys: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        words = [(t or b"").split() for t in texts]
        numbers = _Numbers()
        runs = catch_runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], min_words)
        collapsed = []
        for w, found in zip(words, runs, strict=True):
            if found:
                gone = np.zeros(len(w) + 1, dtype=np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                w = [x for x, g in zip(w, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            collapsed.append(b" ".join(w))
        entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
        return pa.RecordBatch.from_arrays([keys, pa.array(named, pa.list_(entry)), pa.array(collapsed, pa.binary())], ["k", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, size = b.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):  # about STEP words at once; a long text may stand alone
                size += len(t or b"") // 4 + 1
                if size >= STEP or i == len(texts) - 1:
                    yield out(b.column(0).slice(at, i + 1 - at), texts[at : i + 1])
                    at, size = i + 1, 0

    slim = docs.select(F.col(key).alias("k"), F.col(text_col).cast("binary").alias("t"))
    found = slim.mapInArrow(run, f"k {kind.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("k").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(doc_id: Column, text: str) -> tuple[Column, Column]:
    """The words of a tenth of the documents and the text in which they repeat from a word on; null for the others."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")
    ws = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.size("_ws")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_ws", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return ws, F.when(n > 0, F.array_join(at, " "))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, the one with the greatest exponent, and digests of runs and collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ws, text = planted(F.col("doc_id"), "text")
    given = docs.withColumn("_ws", ws).select("doc_id", F.coalesce(text, F.col("text")).alias("text"))
    found = periodic_runs(given)
    # Runs come by start, then period: of those with equal exponents the first stays.
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top)
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
