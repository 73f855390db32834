"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import held_out, stored, table

UNDETERMINED = "und"
#: Buckets of hashed n-grams, and the n-gram lengths in bytes.
DIMS = 1 << 13
ORDERS = (1, 2, 3, 4)
#: Documents of each language that a model is fitted on, about.
SAMPLE = 500
#: Sampled documents that one task fits on, about: a matrix of that many rows by DIMS is what it holds.
GROUP_ROWS = 2048
#: Buckets whose weights are one row while the groups' models are added up.
SLICE = 256
#: Languages up to which all pairs of codewords are compared.
COMPARED = 2000
CHUNK = 1 << 16
#: A prediction whose share is below this is flagged.
AMBIGUOUS = 0.4
_LETTER = re.compile(r"[^\W\d_]")


def ngram_codes(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of the lower-cased text, with a blank at both ends, a chunk at a time."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    reach = max(ORDERS) - 1
    for at in range(0, len(raw), CHUNK):
        x = raw[at : at + CHUNK + reach].astype(np.uint32)
        h = np.zeros(len(x), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = min(CHUNK, len(x) - n + 1)
            if m <= 0:
                break
            h = (h[: len(x) - n + 1] * np.uint32(0x01000193)) ^ (x[n - 1 :] + np.uint32(n << 8))
            if n in ORDERS:
                v = h[:m] * np.uint32(0x9E3779B1)
                yield (v >> np.uint32(32 - (DIMS.bit_length() - 1))).astype(np.int64)


def counts(text: str) -> np.ndarray:
    out = np.zeros(DIMS, dtype=np.int64)
    for codes in ngram_codes(text):
        out += np.bincount(codes, minlength=DIMS)
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: all distinct splits of the languages when there are few, else the best of random codes.

    Of more than COMPARED languages the first code without equal rows is taken: random words of 10 log2(k) bits lie far apart."""
    if k <= 5:
        cols = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(2 ** max(0, k - 1) - 1)]
        return np.array(cols, dtype=np.int8).T.reshape(k, -1)
    rng, bits = np.random.default_rng(seed), ceil(10 * log2(k))
    best, most = None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), (k, bits))
        if (np.abs(m.sum(axis=0)) == k).any():
            continue
        if k > COMPARED:
            if len(np.unique(m, axis=0)) == k:
                return m
            continue
        gram = m.astype(np.float32) @ m.T.astype(np.float32)  # whole numbers below 2^24: exact
        np.fill_diagonal(gram, -4 * bits)
        apart = int(bits - gram.max()) // 2
        if apart > most:
            best, most = m, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIMS x bits, float32
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def decide(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """The language whose codeword has the least weighted logistic loss, its share, and whether the next is close."""
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)
        best = int(np.argmin(loss))
        share = 1.0 / np.exp(loss[best] - loss).sum()
        return best, float(share), bool(share < AMBIGUOUS)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for codes in ngram_codes(text):
            total += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(1, n) + self.bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic regressions of all bits at once, by accelerated gradient steps."""
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    vw, vb = w.copy(), b.copy()
    step = 4.0 / max(1e-9, float(np.einsum("ij,ij->i", x, x).max()) + 1)
    for t in range(rounds):
        p = x @ vw + vb
        g = (-y / (1 + np.exp(np.clip(y * p, -50, 50)))) * weight[:, None]
        nw, nb = vw - step * (x.T @ g + 1e-5 * vw), vb - step * g.sum(axis=0)
        momentum = t / (t + 3)
        vw, vb, w, b = nw + momentum * (nw - w), nb + momentum * (nb - b), nw, nb
    return w, b


def _features(chosen: DataFrame) -> DataFrame:
    """lang, key and the counts of n-gram buckets (at most DIMS of them, however long the text) of texts with a letter."""

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, keys, idx, val = [], [], [], []
            for lang, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if _LETTER.search(text):
                    c = counts(text)
                    at = np.flatnonzero(c)
                    langs.append(lang), keys.append(key), idx.append(at.astype("<u2").tobytes()), val.append(c[at].astype("<u4").tobytes())
            cols = [pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "key", "idx", "val"])

    return chosen.select("lang", "key", "text").mapInArrow(featurize, "lang string, key long, idx binary, val binary")


def _fit_rows(rows: pd.DataFrame, languages: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of buckets, biases and the share of rows told right, of every bit, from one group of rows."""
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (idx, val) in enumerate(zip(rows.idx, rows.val, strict=True)):
        x[i, np.frombuffer(idx, "<u2")] = np.frombuffer(val, "<u4")
    x /= x.sum(axis=1, keepdims=True)
    scale = 1.0 / np.sqrt(x.mean(axis=0) + 1e-6)  # common buckets are held back
    x *= scale
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[name] for name in rows.lang])
    y = code[lang].astype(np.float32)
    size = np.bincount(lang, minlength=len(languages))
    weight = (1.0 / size[lang] / np.count_nonzero(size)).astype(np.float32)
    w, b = _logistic(x, y, weight, 300)
    return w * scale[:, None], b, ((np.sign(x @ w + b) == y) * weight[:, None]).sum(axis=0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` documents of each language, chosen by a hash of id and text; repeated rows count once.

    Rows without a language or without a letter are not used. Any number of languages can be told apart. The sampled
    texts, as counts of n-gram buckets, are dealt into groups of about GROUP_ROWS; a task fits all bits on its group, and
    the mean of the groups' weights is the model. The driver gets that mean, DIMS by 10 log2(languages) numbers, and the
    names of the languages.
    """
    space = 1 << 30
    usable = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("fit"), id_col, text_col).alias("key"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    limits = usable.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.expr(f"least({space}L, {space * sample}L div n)").alias("limit"))
    limits = stored(limits, "limits")  # a row a language of known size: Spark broadcasts it up to its own limit, so texts stay where they are
    chosen = usable.join(limits, "lang").filter(F.pmod("key", F.lit(space)) < F.col("limit")).dropDuplicates(["lang", "key"])
    rows = stored(_features(chosen), "features")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    bits = code.shape[1]
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((DIMS, 0), np.float32), np.zeros(0), np.zeros(0))
    total = rows.count()

    def one_group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "key"])  # rows come in any order
        w, b, right = _fit_rows(part, languages, code)
        n = len(part)
        out = [(at, (w[at : at + SLICE] * n).astype("<f8").tobytes()) for at in range(0, DIMS, SLICE)]
        return pd.DataFrame([*out, (-1, (np.stack([b, right]) * n).astype("<f8").tobytes())], columns=["at", "part"])

    def add_up(parts: pd.DataFrame) -> pd.DataFrame:
        added = sum(np.frombuffer(p, "<f8") for p in sorted(parts.part))
        return pd.DataFrame({"at": parts["at"].iloc[:1], "part": [added.tobytes()]})

    group = F.pmod(F.xxhash64(F.lit("group"), "key"), F.lit(-(-total // GROUP_ROWS)))
    fitted = rows.withColumn("group", group).groupBy("group").applyInPandas(one_group, "at int, part binary")
    mean = {r["at"]: np.frombuffer(r.part, "<f8").reshape(-1, bits) / total for r in fitted.groupBy("at").applyInPandas(add_up, "at int, part binary").collect()}
    weights = np.concatenate([mean[at] for at in range(0, DIMS, SLICE)])
    bias, right = mean[-1]
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return Model(languages, code, weights.astype(np.float32), bias.copy(), trust / trust.mean())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_ambiguous``.

    Every text is read whole. A null text or one without a letter is ``und`` with score 0; with no language learned all
    are. Columns of those three names are replaced; equal texts get equal results.
    """

    def predict(texts: pa.Array) -> pa.Array:
        pred, score, doubt = [], [], []
        for text in texts.to_pylist():
            if not model.languages or not text or not _LETTER.search(text):
                pred.append(UNDETERMINED), score.append(0.0), doubt.append(False)
            elif len(model.languages) == 1:
                pred.append(model.languages[0]), score.append(1.0), doubt.append(False)
            else:
                best, share, close = model.decide(model.margins(text))
                pred.append(model.languages[best]), score.append(share), doubt.append(close)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["p", "s", "a"])

    got = F.arrow_udf(predict, "p string, s double, a boolean")
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous", "_lang")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], got(F.col(text_col)).alias("_lang"))
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_lang.p").alias("lang_pred"), F.col("_lang.s").alias("lang_score"), F.col("_lang.a").alias("lang_ambiguous")
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )
