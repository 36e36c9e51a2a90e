"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes one word boundary, and the
n-grams of 2 to 4 characters within words (boundaries included) are hashed to
BUCKETS.  The mean of their embeddings goes through a linear softmax.  Both are
trained by stochastic gradient descent in numpy.  As both are linear, a trained
model is one table of a row per bucket and a column per language, and scoring is
one lookup an n-gram.

Calibration.  A fifth of the sample is not trained on: a temperature is chosen on
it, and the rejection threshold is the lowest confidence above which at most
MOST_WRONG of it is wrong.  Rejected texts keep their best language and are
marked.

Learning is bounded: about PER_LANGUAGE texts of each language, chosen by a hash
of their key.  Every text is judged whole.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so are all texts if no language could be learned; ties go to the language that
sorts first; null languages aren't learned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
DIMENSIONS = 16
PER_LANGUAGE = 400
EPOCHS = 6
RATE = 0.5
MOST_WRONG = 0.01
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets_of(text: str | None) -> np.ndarray | None:
    """The hashed n-grams of a text; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.concatenate((np.zeros(1, np.uint32), np.where(letter, c, 0).astype(np.uint32), np.zeros(1, np.uint32)))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    out, h, inside = [], c.astype(np.uint32), None
    for n in (2, 3, 4):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + c[n - 1 :]
        if n > 2:
            middle = c[n - 2 : -1] != 0
            inside = middle if inside is None else inside[:-1] & middle
            out.append((h ^ np.uint32(n))[inside])
        else:
            out.append(h ^ np.uint32(n))
    g = np.concatenate(out) * np.uint32(0x85EBCA6B)
    return (g ^ (g >> np.uint32(13))) % np.uint32(BUCKETS)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: logits of one n-gram
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, calibrated scores, and whether the model rejects."""
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if self.languages:
            for i, text in enumerate(texts):
                if (g := buckets_of(text)) is not None:
                    p = softmax((self.table[g].mean(axis=0, dtype=np.float64) + self.bias) / self.temperature)
                    best = int(p.argmax())
                    langs[i], scores[i], rejected[i] = self.languages[best], p[best], p[best] < self.threshold
        return langs, scores, rejected


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 1) -> Model:
    """bags: (buckets, counts) of each text."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(x) for x in langs])
    held = np.arange(len(bags)) % 5 == 4
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    order = np.flatnonzero(~held)
    steps, step = EPOCHS * len(order), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            ids, counts = bags[i]
            share = counts / counts.sum()
            x = share @ embed[ids]
            gradient = softmax(x @ weight + bias)
            gradient[label[i]] -= 1
            rate = RATE * (1 - step / steps)
            back = weight @ gradient
            weight -= rate * np.outer(x, gradient)
            bias -= rate * gradient
            embed[ids] -= rate * 10 * share[:, None] * back
            step += 1
    table = embed @ weight
    rest = np.flatnonzero(held)
    if not len(rest):
        return Model(languages, table.astype(np.float32), bias)
    logits = np.array([(bags[i][1] / bags[i][1].sum()) @ table[bags[i][0]] + bias for i in rest])
    temperature = min((0.05 * 1.25**k for k in range(25)), key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(rest)), label[rest]], 1e-12)).mean())
    p = softmax(logits / temperature)
    return Model(languages, table.astype(np.float32), bias, temperature, threshold_for(p.max(axis=1), p.argmax(axis=1) == label[rest]))


def threshold_for(score: np.ndarray, right: np.ndarray, most_wrong: float = MOST_WRONG) -> float:
    """The lowest score such that at most most_wrong of those at it or above are wrong."""
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero((wrong <= most_wrong) & (np.append(score[order][1:] < score[order][:-1], True)))
    return float(score[order][fine[-1]]) if len(fine) else 1.0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, ids, counts = [], [], []
        for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            if (g := buckets_of(text.as_py())) is not None:
                i, n = np.unique(g, return_counts=True)
                langs.append(lang)
                ids.append(i.astype("<u2").tobytes())
                counts.append(n.astype("<u4").tobytes())
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "ids", "counts"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("k")).where("text is not null and lang is not null")
    rates = {r["lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return train([], [])
    rate = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "k", "text"), F.lit(1_000_000)) < F.try_element_at(rate, F.col("lang")) * 1_000_000
    bags = known.where(drawn).select("text", "lang").mapInArrow(_bags, "lang string, ids binary, counts binary").collect()
    bags.sort(key=lambda r: (bytes(r["ids"]), bytes(r["counts"]), r["lang"]))
    bags = [bags[i] for i in np.random.default_rng(0).permutation(len(bags))]
    return train([(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in bags], [r["lang"] for r in bags])


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's key, lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = shared.value.judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], ["key", "lang_pred", "score", "rejected"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def op10(docs: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"))
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
