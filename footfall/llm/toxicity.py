"""Toxicity by a weighted lexicon, matched after folding look-alikes."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import held_out, stored, table

#: Labelled documents of each class that a model is fitted on, about.
SAMPLE = 10_000
#: Toxic documents of each half in which a term must occur, and clean documents that an exception needs.
SUPPORT = 3
#: Standard errors by which a term's log odds are lowered; what remains in the worse half, if over 1, is its weight.
SURE = 1.5
#: Lengths of the word beginnings that may be terms.
STEMS = range(4, 9)
#: Words are folded to these: letters of other scripts, digits and signs that stand for Latin letters; l, 1 and i are one.
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "|": "i", "_": " ",
}
_FOLD = str.maketrans(_LOOKS)
#: Accents once they are apart from their letters, soft hyphens, zero-width and direction signs, variation selectors.
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Three or more letters that stand alone, with up to three blanks or signs between them: a word spelled out.
_SPELLED = re.compile(r"\b\w(?:\W{1,3}\w){2,}\b")
_WORD = re.compile(r"\w+")


def folded_words(text: str | None) -> list[str]:
    """The words of a text after folding: compatibility forms and accents to plain letters, hidden signs away, look-alike
    letters, digits and signs to the Latin letters they stand for, words that are spelled out joined."""
    text = text or ""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    folded = text.lower().translate(_FOLD)
    return _WORD.findall(_SPELLED.sub(lambda m: "".join(_WORD.findall(m[0])), folded))


@dataclass
class Lexicon:
    """Weights of terms (``word`` whole, ``stem*`` as a beginning), phrases of two words that do not count, and the
    coefficients that turn a document's sums into a score."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    coef: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in terms:
        pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
        a.add_word(pattern, (len(pattern), weight))
    if len(a):
        a.make_automaton()
    return a


def hits(words: list[str], weights: dict[str, float]) -> dict[int, float]:
    """Word number to weight: the heaviest term at each word that begins one."""
    a = _automaton(tuple(sorted(weights.items())))
    if not len(a) or not words:
        return {}
    text = f" {' '.join(words)} "
    at: dict[int, float] = {}
    for end, (size, weight) in a.iter(text):
        begin = end - size + 1
        if weight > at.get(begin, -1.0):
            at[begin] = weight
    if not at:
        return {}
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    places = sorted(at)
    return {int(i): at[p] for i, p in zip(np.searchsorted(starts, places), places, strict=True)}


def measure(text: str | None, weights: dict[str, float], exceptions: frozenset[str]) -> tuple[float, float, int]:
    """The sum and the largest of the weights of counted hits, and the number of words."""
    words = folded_words(text)
    total = top = 0.0
    for i, w in hits(words, weights).items():
        before = f"{words[i - 1]} {words[i]}" if i else ""
        after = f"{words[i]} {words[i + 1]}" if i + 1 < len(words) else ""
        if before not in exceptions and after not in exceptions:
            total, top = total + w, max(top, w)
    return total, top, len(words)


def _features(got: np.ndarray) -> np.ndarray:
    """Heaviest term, and weight by length, from rows of ``measure``."""
    total, top, words = got.reshape(-1, 3).T
    return np.stack([np.ones(len(total)), top, total / np.sqrt(words + 1.0)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(got: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A ridge logistic regression on the two features, by Newton steps; more weight never lowers a score."""
    x = _features(got)
    use = [0, 1, 2]
    while True:
        z, c = x[:, use], np.zeros(len(use))
        for _ in range(50):
            p = _sigmoid(z @ c)
            ridge = np.diag([1e-6] + [1e-2] * (len(use) - 1))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ c)
            c = c + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        low = [u for u, v in zip(use, c, strict=True) if u and v < 0]
        if not low:
            out = [0.0, 0.0, 0.0]
            for u, v in zip(use, c, strict=True):
                out[u] = float(v)
            return tuple(out)
        use = [u for u in use if u not in low[:1]]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from about ``sample`` labelled documents of each class, chosen by a hash of the id.

    Terms are whole words and word beginnings of 4 to 8 letters that occur in SUPPORT toxic documents or more of either
    half of the sample and whose log odds are surely above one in both; exceptions are pairs of words around a term that
    occur in clean documents and hardly in toxic ones. Both are as many as the sample has. The sampled rows are stored
    once; rows that repeat id and text count once. Labels that are null, repeated (the highest counts) or without a document are allowed; with
    one class or none the lexicon is empty.
    """
    each = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).alias("y"))
    sizes = {r.y: r.n for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        rate = 1.0 if sizes.get(True) else 0.0
        return Lexicon({}, frozenset(), (4.0 if rate else -4.0, 0.0, 0.0))
    space = 1 << 30
    limit = F.when(F.col("y"), F.lit(min(space, space * sample // sizes[True]))).otherwise(F.lit(min(space, space * sample // sizes[False])))
    # About 2 * sample rows of an id and a flag, whatever the table: this is what is broadcast.
    chosen = each.filter(F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(space)) < limit)
    found = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)
    rows = stored(found.distinct().select("_text", "y"), "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, frozenset(), (-4.0, 0.0, 0.0))

    # Two halves by a hash of the text, so that copies stay together: a term has to prove itself in both.
    halves = rows.distinct().withColumn("half", F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int"))
    in_half = {(r.half, r.y): r.n for r in halves.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y, half in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen = set(folded_words(text))
                seen |= {w[:k] + "*" for w in seen for k in STEMS if len(w) > k}
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([y] * n, pa.bool_()), pa.array([half] * n, pa.int32())], ["term", "y", "half"])

    pos, neg = F.col("pos"), F.col("neg")
    counted = halves.select("_text", "y", "half").mapInArrow(terms, "term string, y boolean, half int").groupBy("term").agg(
        *[F.count_if((F.col("half") == h) & (F.col("y") == y)).alias(f"n{h}{int(y)}") for h in (0, 1) for y in (False, True)]
    ).filter((F.col("n01") >= SUPPORT) & (F.col("n11") >= SUPPORT))

    def low(h: int):
        p, q, np_, nq = F.col(f"n{h}1"), F.col(f"n{h}0"), in_half.get((h, True), 0), in_half.get((h, False), 0)
        odds = F.log((p + 0.5) / (np_ - p + 0.5)) - F.log((q + 0.5) / (nq - q + 0.5))
        return odds - SURE * F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))

    sure = counted.select("term", F.least(low(0), low(1)).alias("low")).filter("low > 1")
    weights = {r.term: float(r.low) for r in sure.collect()}

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ys = [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = folded_words(text)
                seen = set()
                for i in hits(words, weights):
                    seen |= {f"{words[j]} {words[j + 1]}" for j in (i - 1, i) if 0 <= j < len(words) - 1}
                out += seen
                ys += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ys, pa.bool_())], ["phrase", "y"])

    near = rows.mapInArrow(phrases, "phrase string, y boolean").groupBy("phrase").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    harmless = near.filter((neg >= SUPPORT) & (neg / n[False] > 4 * pos / n[True]))
    exceptions = frozenset(r.phrase for r in harmless.collect())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t, weights, exceptions) for t in b.column(0).to_pylist()]
            cols = [pa.array([float(g[i]) for g in got], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], ["total", "top", "words", "y"])

    at = rows.mapInArrow(sums, "total double, top double, words double, y boolean").toPandas()  # a row of numbers for each sampled one
    return Lexicon(weights, exceptions, _calibrate(at[["total", "top", "words"]].to_numpy(float), at.y.to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with ``toxicity``, from 0 to 1. Null and empty texts score as texts without a hit; texts are read whole;
    equal texts score alike; a column named toxicity is replaced."""
    weights, exceptions, coef = lexicon.weights, lexicon.exceptions, np.array(lexicon.coef)

    def run(texts: pa.Array) -> pa.Array:
        got = [measure(t, weights, exceptions) for t in texts.to_pylist()]
        return pa.array(_sigmoid(_features(np.array(got, dtype=float)) @ coef))

    return docs.withColumn("toxicity", F.arrow_udf(run, "double")(F.col(text_col)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of rows that are not held out."""
    out_of = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out_of))
    return score(docs, lexicon).select(
        "doc_id", out_of.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted")
    )
