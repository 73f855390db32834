"""Packing with its own defaults: every sequence is mixed to the targets, small sources too."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from footfall.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def mixed(spark):
    """Three large sources and 90 with less than a sequence each."""
    rng = random.Random(21)
    rows = [(i, "word " * rng.randint(20, 900), "abc"[min(2, int(rng.random() ** 2 * 4))]) for i in range(300)]
    rows += [(1000 + i, "word " * rng.randint(10, 700), f"small{i}") for i in range(90)]
    rows.append((2000, "a <|endoftext|> b", "a"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("targets", [None, {"a": 5000.0, "b": 3000.0, "c": 2000.0, **{f"small{i}": 20.0 for i in range(90)}}])
def test_each_sequence_holds_the_target_shares(spark, targets):
    docs, plain = mixed(spark), Tokenizer.from_file(BPE)
    out = packing.pack(docs, BPE, targets).toPandas().merge(docs.select("doc_id", "source").toPandas(), left_on="k", right_on="doc_id")
    out = out.sort_values(["sequence_id", "offset"])
    per = out.groupby("sequence_id").length
    assert (out.offset == per.cumsum() - out.length).all() and set(per.sum()[:-1]) == {packing.LENGTH}
    assert out.length.sum() == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    tokens = pd.pivot_table(out, index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    total = tokens.sum()
    weight = total.astype(float) if targets is None else pd.Series(targets)[total.index]
    large = weight[list("abc")] / weight.sum()
    if targets is not None:  # until one of the large queues has run out
        tokens = tokens[(total - tokens.cumsum())[list("abc")].min(axis=1) > packing.LENGTH]
    away = (tokens[:-1][list("abc")] - packing.LENGTH * large).abs().max()
    assert len(tokens) > 10 and away.drop(large.idxmax()).max() <= 2 * packing.QUANTUM  # an end each
    assert away.max() <= 4 * packing.QUANTUM  # the largest takes up the rounding of 92 others
    if targets is None:
        small = tokens[:-1].drop(columns=list("abc"))
        assert (small - packing.LENGTH * (weight / weight.sum())[small.columns]).abs().to_numpy().max() <= 1.5 * packing.QUANTUM
        assert (small.sum(axis=1) > 0).mean() > 0.95  # spread over the corpus, not laid end to end


def test_tokens_before_is_a_weighted_merge():
    totals, weights, phases = np.array([70, 9, 401, 0, 64]), np.array([2.0, 9.0, 5.0, 1.0, 2.0]), np.array([0.5, 0.12, 0.7, 0.3, 0.9])
    turns = [((2 * j * 8 + 2 * phases[s] * min(8, n - j * 8)) / weights[s], s, j, min(8, n - j * 8)) for s, n in enumerate(totals) for j in range(-(-n // 8))]
    at = 0
    for _, s, j, n in sorted(turns):
        assert packing.tokens_before(s, np.array([j]), totals, 8, weights, phases).tolist() == [at]
        at += n
    assert at == totals.sum()


def test_last_stage_holds_the_ids(spark):
    docs = mixed(spark).selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
    rows = sorted(cp.packing(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start))
    tok, got = Tokenizer.from_file(BPE), {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id], "<u4").tolist() == [*tok.encode(r.text, add_special_tokens=False).ids, 0]


def test_any_number_of_sources(spark, monkeypatch):
    """More sources than queues: the large ones keep their shares, the others follow each other, no token is lost."""
    few = packing.source_queues
    monkeypatch.setattr(packing, "source_queues", lambda q, t, own=3, pools=4: few(q, t, own, pools))
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(200, 900), "abc"[i % 3]) for i in range(90)]
    rows += [(1000 + i, "word " * rng.randint(0, 9), f"host{i}" if i % 50 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    queues = packing.token_queues(docs, BPE)
    bases, dealt = packing.source_queues(queues, None, 3, 4)
    assert bases.count() >= 2900 and len(dealt) == 7 and sum(n for n, _ in dealt) == queues.filter("at is null").agg({"n": "sum"}).first()[0]
    out = packing.pack(docs, BPE).toPandas()
    per = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert set(per.sum()[:-1]) == {packing.LENGTH} and (out.groupby("k").length.sum() == out.groupby("k").doc_tokens.first()).all()
    assert len(out.k.unique()) == len(rows)
    spans = out.sort_values(["sequence_id", "offset"])
    assert (spans.offset == spans.groupby("sequence_id").length.cumsum() - spans.length).all()
    shares = packing.source_queues(queues, {"host7": 9.0, "none": 3.0}, 1, 2)[1]
    assert 9.0 in [w for _, w in shares] and sum(n for n, _ in shares) == sum(n for n, _ in dealt)
