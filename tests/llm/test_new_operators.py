"""Best-fit packing, periodic runs and the Merkle manifest against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from bisect import bisect_left, insort
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from footfall.llm import best_fit, merkle, periodic  # noqa: E402
from footfall.llm.common import table  # noqa: E402
from test_operators import ODD, empty_docs, odd_docs  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


# 11. best fit


def plain_best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Item by item: the tightest open bin, by a sorted list."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(size)
        insort(rooms, (room - size, b))
    return bins


@pytest.mark.parametrize(("seed", "length"), [(s, n) for s in range(6) for n in (1, 7, 64, 100, 1024)])
def test_moves_are_best_fit_decreasing(seed, length):
    rng = random.Random(seed)
    top = rng.choice([length, max(1, length // 2), max(1, length // 5)])
    sizes = [rng.randint(1, top) if rng.random() < 0.7 else rng.randint(1, max(1, top // 8)) for _ in range(rng.choice([0, 1, 30, 3000]))]
    counts = {x: sizes.count(x) for x in set(sizes)}
    bins: dict[int, list[tuple[int, int]]] = {}
    for size, moves in best_fit.best_fit(counts, length).items():
        assert [m.rank for m in moves] == np.cumsum([0, *[m.count for m in moves]])[:-1].tolist() and sum(m.count for m in moves) == counts[size]
        for m in moves:
            for j in range(m.count):
                bins.setdefault(m.bin + j // m.each, []).append((m.offset + j % m.each * size, size))
    for items in bins.values():
        items.sort()
        assert [at for at, _ in items] == np.cumsum([0, *[n for _, n in items]])[:-1].tolist() and sum(n for _, n in items) <= length
    assert sorted(bins) == list(range(len(bins)))
    # Which of two bins with equal room takes an item is open; how full the bins get is not.
    assert sorted(sum(n for _, n in items) for items in bins.values()) == sorted(map(sum, plain_best_fit(sizes, length)))


def test_capacity_tree_finds_the_tightest():
    rng, tree, have = random.Random(2), best_fit.CapacityTree(100), [0] * 101
    for _ in range(3000):
        c = rng.randint(0, 100)
        n = rng.choice([1, -1]) if have[c] else 1
        tree.add(c, n)
        have[c] += n
        need = rng.randint(0, 100)
        assert tree.tightest(need) == next((x for x in range(need, 101) if have[x]), None)


def test_best_fit_covers_every_token_once(spark):
    rng = random.Random(8)
    rows = ODD + [(i, "word " * rng.choice([0, 1, 40, 500, 1022, 1023, 1024, 1025, 3000])) for i in range(100, 220)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, ids string, part int, rank int").repartition(5)
    out = best_fit.pack_best_fit(docs, BPE).toPandas()
    tok = Tokenizer.from_file(BPE)
    want = sorted((i is not None, i or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    sizes = [x for _, _, ids in want for x in [(len(ids) - 1) % 1024 + 1] + [1024] * ((len(ids) - 1) // 1024)]
    assert sorted(out.length) == sorted(sizes)
    assert out.sequence_id.nunique() == len(plain_best_fit(sizes, 1024)) == out.sequence_id.max() + 1
    ordered = out.sort_values(["sequence_id", "offset"])
    per = ordered.groupby("sequence_id").length
    assert (ordered.offset == per.cumsum() - ordered.length).all() and per.sum().max() <= 1024
    assert all(len(r.ids) == 4 * r.length for r in out.itertuples())
    # Only keys that one document has tell which pieces belong together.
    ids = [i for i, _ in rows]
    for i, t in rows:
        if i is not None and ids.count(i) == 1:
            mine = out[out.k == i].sort_values("piece")
            assert mine.piece.tolist() == list(range(len(mine))) and (mine.start == mine.length.cumsum() - mine.length).all()
            assert (mine.length[1:] == 1024).all()
            assert np.frombuffer(b"".join(mine.ids), "<u4").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert best_fit.pack_best_fit(empty_docs(spark), BPE).count() == 0


def test_best_fit_query(spark):
    out, tok = best_fit.op11_best_fit(spark, SF).toPandas(), Tokenizer.from_file(BPE)
    for r in table(spark, SF, "documents").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = out[out.doc_id == r.doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and len(mine) == -(-len(ids) // 1024)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)]


def test_best_fit_places_pieces_where_they_are(spark):
    """Pieces are not dealt again to be placed, whatever the broadcast limit; numbers go on over many parts, empty ones too."""
    texts = [None if i % 9 == 0 else "word " * (i % 40) + "x" * (i % 3) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(23)
    docs = docs.unionByName(docs.where("doc_id < 0"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = best_fit.pack_best_fit(docs, BPE, length=64)
        plan = packed._jdf.queryExecution().executedPlan().toString()
        out = packed.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(set(out.k)) == list(range(300))
    ordered = out.sort_values(["sequence_id", "offset"])
    per = ordered.groupby("sequence_id").length
    assert (ordered.offset == per.cumsum() - ordered.length).all() and per.sum().max() <= 64
    assert out.sequence_id.nunique() == len(plain_best_fit(out.length.tolist(), 64)) == out.sequence_id.max() + 1


# 12. periodic runs


def plain_runs(w: list, min_words: int) -> list[tuple[int, int, int]]:
    """Every period, every stretch; a stretch counts with its smallest period only."""
    out: list[tuple[int, int, int]] = []
    for q in range(1, len(w) // 3 + 1):
        a = 0
        while a < len(w) - q:
            b = a
            while b < len(w) - q and w[b] == w[b + q]:
                b += 1
            if b - a + q >= max(min_words, 3 * q) and not any(s <= a and s + n >= b + q and q % p == 0 for s, n, p in out):
                out.append((a, b - a + q, q))
            a = max(b, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[int]:
    """Nested repeats with slips, over few letters."""
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 14))]
    for _ in range(rng.randint(1, 4)):
        w = w * rng.randint(1, 5) + w[: rng.randrange(len(w) + 1)] + [rng.randrange(3) for _ in range(rng.randint(0, 3))]
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.randrange(9)
    return w[:500]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_all_periods(seed):
    rng = random.Random(seed)
    words = [repetitive(rng) for _ in range(12)] + [[], [5], [7] * 300]
    least = rng.choice([1, 3, 24])
    got = periodic.catch_runs([np.array(w, dtype=np.int64) for w in words], least)
    assert got == [plain_runs(w, least) for w in words]


@pytest.mark.parametrize("step", [1, 2, 3, 17, 100, 1000])
def test_runs_do_not_depend_on_how_words_arrive(step):
    rng = random.Random(step)
    for _ in range(8):
        w = np.array(repetitive(rng) + repetitive(rng), dtype=np.int64)
        catcher = periodic.SquareCatcher()
        for at in range(0, len(w), step):
            catcher.append(w[at : at + step])
        assert [(a, b - a, q) for a, b, q in catcher.close().tolist()] == plain_runs(w.tolist(), 1)


def test_equal_hashes_are_looked_through(monkeypatch):
    """A sequence on which every hash of 2048 words or more collides, and one on which all do."""
    thue = [bin(i).count("1") % 2 for i in range(1 << 13)]
    assert periodic.catch_runs([np.array(thue * 3, dtype=np.int64)]) == [[(0, 3 << 13, 1 << 13)]]
    monkeypatch.setattr(periodic, "_powers", np.zeros(1 << 16, dtype=np.uint64))
    rng = random.Random(1)
    words = [[rng.randrange(3)] * 30 + [1, 2] * 20 for _ in range(3)]
    got = [{r for r in found} for found in periodic.catch_runs([np.array(w, dtype=np.int64) for w in words], 24)]
    assert all(set(x) <= set(plain_runs(w, 24)) for x, w in zip(got, words, strict=True))


def test_long_sequences_are_taken_in_steps(monkeypatch):
    rng = np.random.default_rng(5)
    long = np.concatenate([rng.integers(0, 10**6, 3000), np.tile(rng.integers(0, 10**6, 700), 5), rng.integers(0, 4, 2000), np.full(900, 3)])
    whole = periodic.catch_runs([long, long[:50], long[2500:9000]])
    monkeypatch.setattr(periodic, "STEP", 512)
    assert periodic.catch_runs([long, long[:50], long[2500:9000]]) == whole
    assert (3000, 3500, 700) in whole[0]


def plain_op12(doc_id: int | None, text: str | None) -> tuple:
    words = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 24) if n < 3000 else [(s, x, q) for (s, x, q) in periodic.catch_runs([np.unique(words, return_inverse=True)[1]])[0]]
    gone = {i for s, x, q in runs for i in range(s + q, s + x)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_runs_query_equals_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic.op12_runs(spark, SF).collect()}
    assert got == {plain_op12(r.doc_id, r.text) for r in docs} and max(r[1] for r in got) > 0


def test_runs_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark).select("doc_id", "text", F.lit(1).alias("runs"), F.lit("x").alias("k"), F.lit(2).alias("collapsed"))
    got = periodic.periodic_runs(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in ODD)
    by_id = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by_id[7].runs] == [(0, 30_000, 1)] and by_id[7].collapsed == "x end"
    assert by_id[1].collapsed == by_id[2].collapsed == by_id[3].collapsed == "" and not by_id[1].runs
    assert periodic.periodic_runs(empty_docs(spark)).count() == 0
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    key = repr
    assert sorted((tuple(r) for r in periodic.op12_runs(spark, str(tmp_path)).collect()), key=key) == sorted((plain_op12(i, t) for i, t in ODD), key=key)


# 13. Merkle manifest


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top of a tree and every node's way: siblings left and right, level by level."""
    ways, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, own, strict=True):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            w.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, own = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in own]
    return (nodes or [None])[0], ways


def plain_op13(rows: list[tuple]) -> list[tuple]:
    def leaf(r: tuple, lower: bool = False) -> str:
        cells = list(r)
        if lower and cells[4] is not None:
            cells[4] = re.sub("[A-Z]+", lambda m: m[0].lower(), cells[4])
        return sha(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: plain_tree([leaf(r) for r in per[s]]) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, upper, strict=True):
        for r, way in zip(per[s], trees[s][1], strict=True):
            f = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in way + up:
                f = sha(left, f, right)
            out.append((r[0], leaf(r), trees[s][0], root, sha(*[x for pair in way + up for x in pair]), f, f == root))
    return sorted(out, key=repr)


def manifest_rows() -> list[tuple]:
    rng = random.Random(4)
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(300)] + [(i, None, None, None, None) for i in range(17)] + [(7, "lone", "de", 3, "")]
    rows += [(i, f"s{i % 23:02d}", "fr", 1, "A" * rng.randrange(9)) for i in range(1000, 1040)] + [(3, "hot", "en", 3, "other")] * 2
    rows += [(None, "hot", None, 0, "No Id"), (None, "hot", None, 1, None), (5, "", "x", 1, "null source is not empty"), (6, "É", "x", 1, "b"), (6, "z", "x", 1, "b")]
    return rows


@pytest.mark.parametrize("rows", [manifest_rows(), [(1, "a", "b", 1, "One")], [(i, "a", None, None, None) for i in range(16)], [(i, None, None, None, "X") for i in range(257)], []])
def test_manifest_equals_plain_tree_and_sql(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    docs.withColumns({"g": F.lit("clash"), "idx": F.lit(1), "path": F.lit("p"), "h": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_op13(rows)
    assert sorted((tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()), key=repr) == want
    if rows:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.execute(merkle.OP13_SQL).fetchall(), key=repr) == want


def test_manifest_of_odd_rows(spark):
    out = merkle.manifest(odd_docs(spark), columns=("doc_id", "source", "text", "row", "part"))
    rows = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == len(ODD) and all(r.folded == r.root for r in rows) and len({r.root for r in rows}) == 1
    assert merkle.manifest(empty_docs(spark), columns=("doc_id", "text")).count() == 0
