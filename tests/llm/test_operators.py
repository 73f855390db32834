"""Each operator against a plain version, a round trip or held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from footfall.llm import decontaminate, langid, lines, packing, shards, simhash, token_files, tokens, topk, toxicity, warc  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "a shared line of more than twenty characters"
ODD = [
    (1, None), (2, ""), (3, "  \n\t"), (4, LONG + "\nown line one of four"), (5, LONG.upper() + " \nown line two"), (6, LONG),
    (6, LONG), (7, "x " * 30_000 + "end"), (8, "é日本語 ŁŁ 😀 " + LONG), (None, LONG + "\nno id"), (None, None), (-9, "short"),
    (9, "before <|endoftext|> after<|endoftext|>"),
]


def odd_docs(spark, parts=3):
    """Odd rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, f"s{n % 3}" if n % 5 else None, "en", n, "c", n) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key int, row string, part int").repartition(parts)


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


# 1. top-k


def plain_top(rows, k):
    good = [(n, i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and i % 100 == 0:
            s = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v, strict=True)))), j is None, j or 0, m) for m, j, v in good if m != n and len(v) == len(q))
            out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(s[:k])]
    return sorted(out, key=repr)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 24))
    rows = [(int(i), (centre[i % 4] + 0.2 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(100, rows[100][1]), (700, rows[3][1]), (5, rows[0][1]), (None, rows[0][1]), (1000, None), (1001, [None] * 24), (1002, [float("nan")] * 24)]
    rows += [(1100, [float("inf")] * 24), (1200, [1.0, 2.0]), (1201, [0.5, -2.0]), (1300, []), (1301, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    v = topk.integer_vectors(df)
    got = topk.top_k(v.filter("id % 100 = 0"), v, 10).collect()
    assert sorted(map(tuple, got), key=repr) == plain_top(rows, 10)
    none = topk.integer_vectors(df.limit(0))
    assert topk.top_k(none, none).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=20) * 10.0 ** (i % 4 * 3)).tolist()) for i in range(300)]  # scores from small to beyond 64 bits
    rows += [(400, [1e9] * 20), (401, [-1e9] * 20), (402, [1e9] * 20), (500, [1e300] * 20), (501, [-1e300, *[0.0] * 19])]
    df = spark.createDataFrame([(i, v) for i, v in rows if i < 500], "vec_id long, embedding array<double>").repartition(3)
    v = topk.integer_vectors(df)
    got = topk.top_k(v.filter("id % 100 = 0"), v, 10).collect()
    assert sorted(map(tuple, got), key=repr) == plain_top([r for r in rows if r[0] < 500], 10)
    far = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.rank for r in topk.top_k(far.filter("id = 500"), far, 10).collect()} == set(range(1, 11))


def test_topk_bounds_are_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-900, 900, (50, 33)).astype(float), rng.integers(-900, 900, (60, 33)).astype(float)
    exact = a @ b.T
    for n in (1, 4, 16, 32):
        (sa, ra), (sb, rb) = topk.segments(a, n), topk.segments(b, n)
        assert (sa @ sb.T + ra @ rb.T >= exact - 1e-6).all()


# 2. WARC


def test_archive_round_trip(spark):
    rows = [(i, f"http://A.example.com:80/x y?q={i % 3}#f", None if i % 4 == 0 else f"body {i % 5} é") for i in range(60)]
    rows += [(None, None, "n"), (None, None, "n"), (70, "http://[bad", "zz"), (-3, "", ""), (71, "http://h/" + "p" * 9000, "q" * 100_000), (5, "http://b.org/", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    a = warc.Archive(pages)
    got = a.lookup(pages.select("url")).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    by_url: dict = {}
    for r in got:
        body = None if r.payload is None else bytes(r.payload).decode()
        by_url.setdefault((r.page_id, r.payload_digest), []).append((r.record_type, r.refers_to, body, r.payload_bytes))
    import base64

    for i, _, t in rows:
        raw = (t or "").encode()
        kind, ref, body, n = by_url[i, base64.b32encode(hashlib.sha1(raw).digest()).decode()][0]
        low = first.get(t or "")
        assert n == len(raw) and (kind, ref) == (("response", None) if low == i else ("revisit", low))
        assert body == ((t or "") if kind == "response" else None)
    one = a.lookup(spark.createDataFrame([("https://a.example.com/x%20y?q=1", 4), ("http://none/", 1)], "url string, page long")).collect()
    assert [r.page_id for r in one] == [4]
    # Equal payloads below the least size are all responses.
    small = warc.write_warcs(pages, a.root + "-small", min_payload=1000)
    kinds = warc.read_records(small, a.root + "-small").groupBy("record_type").count().collect()
    assert [(r[0], r[1]) for r in kinds] == [("response", len(rows))]
    assert warc.Archive(pages.limit(0)).lookup(pages.select("url")).count() == 0


def test_index_spreads_a_hot_url(spark):
    pages = spark.createDataFrame([(i, "http://hot/", f"{i}") for i in range(500)], "page_id long, url string, html string")
    captures = warc.write_warcs(pages, root := warc.shared_dir(spark, "hot"))
    index = warc.build_index(captures, root, block_lines=20)
    asked = spark.createDataFrame([(warc.url_key("http://hot/"), warc.LOWEST, warc.HIGHEST)], "key string, low long, high long")
    assert index.find(asked).distinct().count() == 500


# 3. token files


def test_token_files_round_trip(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ODD + [(5, f"copy {i}") for i in range(200)] + [(i, f"w{i}") for i in range(20, 90)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        files = token_files.write_token_files(docs, BPE)
        assert len(files.parts) > 1
        keys = docs.groupBy(F.col("doc_id").alias("k")).count().select("k", F.explode(F.sequence(F.lit(0), F.col("count") + 2)).alias("occ"))
        back = files.read(files.find(keys)).join(files.starts().select("part", "start"), "part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(back) == len(rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    want = sorted((i is not None, i or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    got = sorted((r.start + r.offset, r.k, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back)
    assert sorted((k is not None, k or 0, ids) for _, k, ids in got) == want
    assert [g[0] for g in got] == np.cumsum([0] + [len(g[2]) for g in got[:-1]]).tolist()
    ks = [g[1] for g in got]
    assert ks == sorted(ks, key=lambda k: (k is not None, k or 0))
    none = token_files.write_token_files(empty_docs(spark), BPE)
    assert none.find(keys).count() == 0


def test_perfect_hash_places_every_key():
    h = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000, dtype=np.uint64))
    data = token_files.build_bucket(h, np.array([(int(x) >> 5, 1, i, 2) for i, x in enumerate(h)], dtype=token_files.ENTRY))
    found, e = token_files.find_in_bucket(data, h, h >> np.uint64(5))
    assert found.all() and (e["offset"] == np.arange(len(h))).all()
    assert not token_files.find_in_bucket(data, h, h)[0].any()
    twice = np.array([7, 7, 9], dtype=np.uint64)  # equal hashes of different keys
    data = token_files.build_bucket(twice, np.array([(1, 0, 10, 1), (2, 0, 20, 1), (3, 0, 30, 1)], dtype=token_files.ENTRY))
    found, e = token_files.find_in_bucket(data, twice, np.array([1, 2, 3], dtype=np.uint64))
    assert found.all() and e["offset"].tolist() == [10, 20, 30]


def test_piecewise_ids_are_the_librarys():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    enc, rng = tokens.Encoder(BPE), random.Random(4)
    pool = "ab c'sd 12²\t\n\r\x0b\x85\xa0 .,!?-—’“éßñÄşЖж_@日 　😀\x1c\x00"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> it's I'LL", "a <|endoftext|> b", "<|endoftext|", " <|endoftext|><|endoftext|>\n"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# 4. decontamination


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, words(rng, n, "abc")) for i, n in enumerate([30, 12, 10, 7, 3, 1])] + [(10, None), (11, "..."), (12, "")]
    items += [(20, items[0][1]), (None, words(rng, 11, "xyz"))]
    texts = [words(rng, 40, "abc") for _ in range(40)]
    texts += [f"{words(rng, 9)}, {items[k][1].upper()}! {words(rng, 5)}" for k in range(6)] + [items[0][1][:60], items[4][1] + " " + items[4][1]]
    docs = [(i, t) for i, t in enumerate(texts)] + ODD + [(3, texts[41])] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    res = decontaminate.overlaps(d, b)
    got = {(r.key.k, r.key.h, r.key.n): (r.n_words, r.n_hit, list(r["items"])) for r in res.collect()}
    keyed = d.select("doc_id", "text", decontaminate.row_key("doc_id", "text").alias("o")).collect()
    for r in keyed:
        n, hit, found = brute.overlap(r.text, [x for x in items])
        assert got[r.o.k, r.o.h, r.o.n] == (n, hit, [x for x in found if x != "None"]), r.text
    kept = decontaminate.decontaminate(d, b).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((r.doc_id or 0, r.text or "") for r in keyed if not got[r.o.k, r.o.h, r.o.n][1])
    cut = decontaminate.decontaminate(d.filter("doc_id = 41"), b, remove="span").collect()
    assert len(cut) == 1 and items[1][1].upper() not in cut[0].text and words(random.Random(9), 1) is not None
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)
    assert decontaminate.overlaps(empty_docs(spark), b).count() == 0


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_both_ways_of_looking_up_windows_give_the_same(spark, monkeypatch, bytes_):
    rng = random.Random(12)
    items = [(i, words(rng, n, "ab")) for i, n in enumerate([40, 15, 10, 6, 2])] + [(9, None), (None, "one two")]
    docs = [(i, words(rng, 60, "ab")) for i in range(50)] + [(i + 100, f"{words(rng, 5)} {items[i % 3][1]} {words(rng, 5)}") for i in range(9)] + ODD + [(100, "one two")] * 2
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
    got = {(r.key.k, r.key.h): (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.overlaps(d, b).collect()}
    for r in d.select("doc_id", "text", decontaminate.row_key("doc_id", "text").alias("o")).collect():
        n, hit, found = brute.overlap(r.text, items)
        assert got[r.o.k, r.o.h] == (n, hit, [x for x in found if x != "None"])
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shuffle_beyond_the_broadcast_grows_with_the_words(spark, monkeypatch, tmp_path):
    """Texts of 1,000 to 4,000 words, as many bytes a word for each."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    rng, sizes = random.Random(3), []
    b = spark.createDataFrame([(1, words(rng, 30))], "item_id long, text string")
    set_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        for n in (1000, 4000):
            d = spark.createDataFrame([(1, words(rng, n))], "doc_id long, text string")
            out = decontaminate.find_windows(d, decontaminate.benchmark_windows(b))
            assert [r.n_words for r in out.collect()] == [n]
            todo, total = [out._jdf.queryExecution().executedPlan()], 0
            while todo:
                node = todo.pop()
                if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                    total += node.metrics().apply("shuffleBytesWritten").value()
                todo += [node.children().apply(i) for i in range(node.children().size())]
            sizes.append(total)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < sizes[1] < 8 * sizes[0], sizes


def test_decontamination_is_native(spark):
    d, b = odd_docs(spark), spark.createDataFrame([(1, LONG)], "item_id long, text string")
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 5. toxicity


def test_toxicity_learns_and_folds(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(rng, rng.choice([5, 40, 300]))
        if toxic:
            at = rng.randint(0, len(text))
            text = text[:at] + " " + rng.choice(["zorgon", "Zorgons", "zorgonly", "blight"]) + " " + text[at:]
        rows.append((i, text)), labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, words(rng, 20) + " ZØRG0N " + words(rng, 9)), (None, "zorgon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("x"))
    lab = spark.createDataFrame(labels + [(0, 1), (None, 1), (55_555, 1), (3, None)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, lab.filter("doc_id % 3 <> 0 or doc_id is null"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, lex).collect()}
    test = [(got[i], y) for i, y in labels if i % 3 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in test]) > 0.97
    assert got[9002] >= 0.3 and got[9000] == got[9001] < 0.3 and all(0 <= s <= 1 for s in got.values())
    for none in (lab.limit(0), lab.filter("toxic = 0")):
        assert toxicity.score(docs, toxicity.fit(docs, none)).filter("toxicity between 0 and 1").count() == len(rows)
    assert toxicity.score(empty_docs(spark), lex).count() == 0


@pytest.mark.parametrize("text", [
    "zörgon", "ZO\u0301RGON", "zor\u200bgon", "z\u00adorgon", "z.o.r.g.o.n", "z o r g o n", "Z_0_r-g * o, n", "ｚｏｒｇｏｎ", "zоrgοn", "𝐳𝐨𝐫𝐠𝐨𝐧", "(zorgon)",
])
def test_toxicity_folding(text):
    for whole in (text, f"the {text} there", f"ab {text}, cd {text}."):
        assert toxicity.folded_words(whole).count("zorgon") == whole.count(text)
    assert toxicity.folded_words("a plan b of x") == ["a", "pian", "b", "of", "x"]


def test_toxicity_folding_of_long_texts():
    assert len(toxicity.folded_words("a b " * 200_000)) == 1 and len(toxicity.folded_words("ab c " * 200_000)) == 400_000
    assert toxicity.folded_words("a" + "." * 500_000 + "b") == ["a", "b"]


def plain_toxicity(text, lex):
    """Looks every word up, without an automaton."""
    w = toxicity.folded_words(text)
    got = []
    for i, x in enumerate(w):
        terms = [lex.weights[t] for t in {x, *(x[:k] + "*" for k in range(1, len(x) + 1))} if t in lex.weights]
        if terms and not {" ".join(w[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(w) - 1} & lex.exceptions:
            got.append(max(terms))
    z = lex.coef[0] + lex.coef[1] * max(got, default=0.0) + lex.coef[2] * sum(got) / np.sqrt(len(w) + 1.0)
    return 1 / (1 + np.exp(-z))


def test_toxicity_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.fit(docs, labels.filter("crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 <> 2"))
    got = toxicity.op5_toxicity(spark, sf).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    assert len(got) == docs.count() and lex.weights
    want = np.array([plain_toxicity(t, lex) for t in got.text])
    assert np.abs(got.score - want).max() < 1e-6 and (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out].merge(labels.toPandas()[["doc_id", "toxic"]], on="doc_id")
    assert (test.predicted == test.toxic).mean() > 0.9  # some 60 toxic documents to learn from


def test_toxicity_exceptions():
    weights = {"zorgon": 3.0, "zorg*": 2.0}
    assert toxicity.measure("the zorgon is", weights, frozenset()) == (3.0, 3.0, 3)
    assert toxicity.measure("a zorgish not zorgon", weights, frozenset({"not zorgon"})) == (2.0, 2.0, 4)


# 6. packing


@pytest.mark.parametrize("targets", [None, {"s0": 3.0, "s1": 1.0, "s2": 1.0}])
def test_packing_covers_every_token_once(spark, targets):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.choice([3, 50, 900])), f"s{min(2, int(i ** 0.5) % 4)}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd_docs(spark).select("doc_id", "text", "source")).withColumn("part", F.lit(1))
    out = packing.pack(docs.repartition(6), BPE, targets, length=256, quantum=64).toPandas()
    enc = tokens.Encoder(BPE)
    all_rows = [(i, t) for i, t, _ in rows] + ODD
    want = sorted(np.frombuffer(enc.encode(t), enc.dtype).tolist() + [0] for _, t in all_rows)
    assert out.length.sum() == sum(map(len, want))
    once = out[~out.k.isna() & (out.k != 6)].sort_values(["k", "start"])
    got = once.groupby("k").ids.apply(lambda s: np.frombuffer(b"".join(s), "<u4").tolist())
    exp = {i: np.frombuffer(enc.encode(t), enc.dtype).tolist() + [0] for i, t in all_rows if i is not None and list(x for x, _ in all_rows).count(i) == 1}
    for i, ids in exp.items():
        assert got[i] == ids
    out = out.sort_values(["sequence_id", "offset"])
    per = out.groupby("sequence_id")
    assert (out.offset == per.length.cumsum() - out.length).all()
    assert set(per.length.sum()[:-1]) == {256} and per.ngroups == out.sequence_id.max() + 1
    assert packing.pack(empty_docs(spark), BPE).count() == 0


def test_turns_are_a_weighted_merge():
    quanta, weights = np.array([7, 1, 40, 0]), np.array([2.0, 9.0, 5.0, 1.0])
    got = {}
    for s, n in enumerate(quanta):
        for j, p in enumerate(packing.turns_before(s, np.arange(n), quanta, weights)):
            got[int(p)] = (s, j)
    want = sorted(((2 * j + 1) / weights[s], s, j) for s, n in enumerate(quanta) for j in range(n))
    assert [got[i] for i in range(len(want))] == [(s, j) for _, s, j in want]


# 7. lines


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 6) for _ in range(15)] + ["short", ""]
    rows = [(rng.randint(0, 60), "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) for _ in range(rng.randint(0, 9)))) for _ in range(120)] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("doc", F.lit("x"))
    for batches, fanout in ((1, 2), (5, 2), (4, 9)):
        out = lines.dedupe_lines(docs, batches=batches, fanout=fanout).collect()
        got = sorted((r.doc_id or 0, r._n_lines, r._n_dropped, r.text or "") for r in out)
        assert got == sorted((i or 0, *x) for (i, _), x in zip(rows, brute.kept_lines(rows), strict=True))
    assert lines.dedupe_lines(empty_docs(spark)).count() == 0


def test_runs_hold_what_was_added(spark):
    runs = lines.LineRuns(spark, lines.shared_dir(spark, "test-runs"), fanout=2)
    batches = [[(10 * b + i, f"{LONG} {i % 3}\nthe line of batch {b} and no other") for i in range(4)] for b in range(4)]
    fresh = []
    for b in batches:
        out = runs.add_new(spark.createDataFrame(b, "doc_id long, text string")).collect()
        fresh.append({x for r in out for x in r.text.split("\n")})
    assert all(LONG not in x for new in fresh[1:] for x in new)
    assert [f"the line of batch {b} and no other" in new for b, new in enumerate(fresh)] == [True] * 4
    assert len(runs.paths) == 1 and runs.entries().count() == 3 + 4
    assert {r.n for r in runs.entries().collect()} == {4, 8, 4 * 2} | {4}
    assert [(r.n, r.top) for r in runs.entries(5).collect()] == [(8, 33)]


def test_batches_carry_on_the_counts_of_runs(spark):
    runs = lines.LineRuns(spark, lines.shared_dir(spark, "test-runs"), fanout=4)
    for b in range(3):
        runs.add(lines.keyed_lines(spark.createDataFrame([(9 - b, f"{LONG}\nthe line of batch {b} and no other")], "doc_id long, text string")))
    newest = spark.read.parquet(runs.paths[-1][1]).collect()
    assert len(runs.paths) == 3 and sorted((r.n, r.top) for r in newest) == [(1, 7), (3, 9)]  # merged with both earlier runs


# 8. language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = out[out.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 30, a), lang) for i in range(60) for a, lang in (("abcde", "aa"), ("mnopq", "bb"), ("tuvwx", "cc"))]
    model = langid.fit(spark.createDataFrame(rows + [(1, None, "aa"), (2, "abc", None), (3, "123", "bb")], "doc_id long, text string, lang string"), sample=50)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 .."), (4, words(rng, 90, "abcde")), (5, words(rng, 40_000, "tuvwx")), (None, "mnop qom")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs.withColumn("lang_score", F.lit(9)), model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "cc", "bb"] and got[1][1] == 0
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.withColumn("lang", F.lit("zz")))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"und", "zz"}


def test_language_many_languages_in_groups(spark, monkeypatch):
    """More languages than the 500 of old, fitted in several tasks; repeated rows change nothing."""
    monkeypatch.setattr(langid, "GROUP_ROWS", 400)
    rng = random.Random(10)
    own = {f"l{k}": [words(rng, 1, "abcdefghijklmnopqrstuvwxyz") for _ in range(12)] for k in range(520)}
    rows = [(n, " ".join(rng.choice(v) for _ in range(40)), k) for n, (k, v) in enumerate((k, v) for k, v in own.items() for _ in range(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.repartition(3))
    assert model.languages == sorted(own) and model.weights.shape == (langid.DIMS, model.code.shape[1])
    test = spark.createDataFrame([(n, " ".join(rng.choice(v) for _ in range(40)), k) for n, (k, v) in enumerate(own.items())], docs.schema)
    got = langid.identify(test, model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9


def test_language_repeated_rows_count_once(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 20, a), lang) for i in range(30) for a, lang in (("abcde", "aa"), ("mnopq", "bb"))]
    schema = "doc_id long, text string, lang string"
    once, often = (langid.fit(spark.createDataFrame(r, schema)) for r in (rows, rows + rows[:1] * 200))
    assert np.array_equal(once.weights, often.weights) and np.array_equal(once.trust, often.trust)


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 30, 2500])
def test_codewords_differ(k):
    c = langid.codewords(k).astype(int)
    gram = (c.astype(np.float32) @ c.T.astype(np.float32))[np.tril_indices(k, -1)]
    apart = int(c.shape[1] - gram.max()) // 2
    assert apart >= max(1, c.shape[1] // 4) and (np.abs(c.sum(axis=0)) < k).all()


# 9. SimHash


def test_fingerprint_equals_brute_force():
    rng = random.Random(10)
    for t in [None, "", " \t", "One", "a B", "ß É x y z \x1c w", *[words(rng, n) for n in (3, 4, 50)], "x y " * 40_000]:
        for n in (3, 5):
            assert simhash.fingerprint(t, n) == brute.fingerprint(t, n) if len(t or "") < 1000 else simhash.fingerprint(t, n) >= 0


@pytest.mark.parametrize("bucket", [8192, 40, 8])
def test_components_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = []
    for x, span in zip(base, [64, 64, 20, 24, 12, 40], strict=True):
        for _ in range(200):
            f = int(x)
            for b in rng.integers(0, span, rng.integers(0, 6)):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
    assert [got.get(x, x) for x in signed] == brute.components(fps, signed)


def test_near_groups_odd_rows(spark):
    rng = random.Random(12)
    base = words(rng, 400)
    rows = ODD + [(100 + i, base if i % 2 else base + f" tail{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0)).withColumn("id", F.lit("x"))
    got = sorted(((r.id is not None, r.id or 0, r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs).collect()), key=repr)
    fps = [brute.fingerprint(t) for _, t in rows]
    comp = brute.components(fps, [10**9 if i is None else i for i, _ in rows])
    named = [None if c == 10**9 else c for c in comp]  # a group without any id
    assert got == sorted(((i is not None, i or 0, f, c) for (i, _), f, c in zip(rows, fps, named, strict=True)), key=repr)
    kept = simhash.keep_one(docs, shingle=3).collect()
    assert len(kept) == len(set(comp)) and kept[0].asDict().keys() == {"doc_id", "text", "fp", "id"}
    assert simhash.near_groups(empty_docs(spark)).count() == 0 and simhash.keep_one(empty_docs(spark)).count() == 0


# 10. shards


def test_shards_exact_and_whole(spark):
    rows = [(i % 40, None if i % 9 == 0 else "same") for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit(1), "part": F.lit("p"), "slot": F.lit(0)}).repartition(7)
    out = shards.shuffle_into_shards(docs, 8, cell_rows=50).toPandas()
    assert sorted(out.groupby("shard").size()) == [125] * 5 + [126] * 3
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert sorted(map(str, zip(out.doc_id, out.text, strict=True))) == sorted(map(str, rows))
    assert set(out.columns) == {"doc_id", "text", "pos", "part", "shard", "slot"}
    assert shards.shuffle_into_shards(empty_docs(spark)).count() == 0


def test_shuffle_is_uniform(spark):
    docs = spark.createDataFrame([(i,) for i in range(4000)], "doc_id long").repartitionByRange(4, "doc_id")
    out = shards.shuffle_into_shards(docs, 4, seed=3, cell_rows=100).toPandas()
    cells = out.groupby([out.doc_id // 500, out.shard]).size()
    assert len(cells) == 32 and ((cells - 125) ** 2 / 125).sum() < 60  # chi square, 21 degrees of freedom
    deciles = out.groupby([out.doc_id // 1000, out.slot // 250]).size()
    assert ((deciles - 250) ** 2 / 250).sum() < 40


def test_communication_matrix_sums_and_means():
    rng = np.random.default_rng(0)
    held, sizes = [30, 0, 50, 20], [25, 25, 50]
    ms = [shards.communication_matrix(held, sizes, rng) for _ in range(400)]
    assert all((m.sum(axis=0) == sizes).all() and (m.sum(axis=1) == held).all() for m in ms)
    assert np.abs(np.mean(ms, axis=0) - np.outer(held, sizes) / 100).max() < 0.5
    big = [shards._draw(3 * 10**9, 10**9, 1000, rng) for _ in range(2000)]
    assert abs(np.mean(big) - 750) < 2 and abs(np.var(big) - 187.5) < 25


def test_sharding_is_native(spark):
    plan = shards.shuffle_into_shards(odd_docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
