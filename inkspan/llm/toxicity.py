"""Toxicity by two class-conditional Kneser-Ney models.

A class's Kneser-Ney count c(x) of a word is the number of different words that it
follows in that class's labelled texts, so copied texts add nothing.  With n the sum
of c over all words,

    P(x | class) = max(c(x) - D, 0) / n + L * P(x | both classes)

where L is what the discount takes, the sum of min(c, D) over n.  The shared level
counts by the same rule: a word's count there is the number of classes that it is seen
in, so a word of one class only can't lift the other class's probability of it.  D is
over 1, since most words of a text are seen once or twice in all: those are left to
the shared level in both models.  All words that are not over D in either class,
unseen ones too, have the same ratio L(toxic) / L(ordinary), so that only the others
need be kept; no word is left out of the comparison.

A text's evidence is the log-likelihood under the toxic model less that under the
ordinary one, per word, in those ``window`` consecutive words where it is largest
(shorter texts: all their words).  Over a whole text the mean follows its language and
topic more than a few expressions in it.  A logistic curve fitted on labelled texts
that the models haven't counted turns the evidence into a score.

Learning is bounded: at most about ``toxic_texts`` and ``ordinary_texts`` labelled
texts (chosen by a hash of their key).  Every text is scored whole.

Defined results: null, empty and blank texts, and those of punctuation only, have the
evidence of unseen words; long texts count whole; rows that repeat a key or a text get
the same score each; there are no ties to break; other columns are left out, whatever
their names; without labels of both classes all scores are 0; labels with a null key
or class are ignored, and of several labels of a key the toxic one counts; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXIC_TEXTS = 1500
ORDINARY_TEXTS = 4500
DISCOUNT = 3
WINDOW = 4
EDGES = ".,;:!?\"'()[]{}#*$%&|<>-"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation at their edges."""
    return [x for w in text.lower().split() if (x := w.strip(EDGES))] if text else []


@dataclass(frozen=True)
class Model:
    words: dict[str, float]  # log P(x | toxic) - log P(x | ordinary)
    other: float = 0.0  # that of all other words
    window: int = WINDOW
    slope: float = 0.0
    shift: float = -math.inf

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.shift == -math.inf:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


class _Ratios(dict):
    """Log ratio of a raw token, nan if it isn't a word; remembers those seen, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, token: str) -> float:
        word = token.strip(EDGES)
        r = self.model.words.get(word, self.model.other) if word else math.nan
        if len(self) > 400_000:
            self.clear()
        self[token] = r
        return r


def evidence_of(text: str | None, ratios: _Ratios) -> float:
    """The largest mean ratio of ``window`` consecutive words."""
    r = np.array(list(map(ratios.__getitem__, text.lower().split() if text else [])), float)
    r = r[~np.isnan(r)]
    if not len(r):
        return ratios.model.other
    n = min(ratios.model.window, len(r))
    return float(np.convolve(r, np.ones(n), "valid").max()) / n


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, word before it) once for each text."""
    for b in batches:
        rows: set[tuple[str, int, str]] = set()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text)
            rows.update(zip(words, [toxic] * len(words), ["", *words], strict=False))
            if len(rows) > 200_000:
                yield _rows(rows)
                rows = set()
        if rows:
            yield _rows(rows)


def _rows(rows: set[tuple[str, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["x", "toxic", "before"])


def ratios_of(met: DataFrame, discount: float = DISCOUNT) -> tuple[dict[str, float], float]:
    """Log ratios of the words over the discount in either class, and that of all
    others.  met: (x, toxic, before), each once."""
    by = met.groupBy("x").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).persist()
    try:
        left = [F.sum(F.least(F.col(c), F.lit(discount))).alias(f"left_{c}") for c in "ab"]
        seen = F.sum((F.col("a") > 0).cast("long") + (F.col("b") > 0).cast("long")).alias("seen")
        t = by.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *left, seen).first()
        if not t["a"] or not t["b"]:
            return {}, 0.0
        over = by.where(F.greatest("a", "b") > discount).collect()  # of a bounded number of texts
    finally:
        by.unpersist()
    rest = [t["left_a"] / t["a"], t["left_b"] / t["b"]]
    out = {}
    for r in over:
        shared = ((r["a"] > 0) + (r["b"] > 0)) / t["seen"]
        p = [max(r[c] - discount, 0) / t[c] + share * shared for c, share in zip("ab", rest, strict=True)]
        out[r["x"]] = math.log(p[0] / p[1])
    return out, math.log(rest[0] / rest[1])


def _share(counts: dict[int, int], bounds: dict[int, int]) -> Column:
    """The share of each class's labelled texts to learn from."""
    toxic, ordinary = (F.lit(min(1.0, bounds[c] / max(1, counts.get(c, 0)))) for c in (1, 0))
    return F.when(F.col("toxic") == 1, toxic).otherwise(ordinary)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic_texts: int = TOXIC_TEXTS, ordinary_texts: int = ORDINARY_TEXTS, discount: float = DISCOUNT, window: int = WINDOW) -> Model:
    """The models and the curve from labelled rows."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).where("k is not null and toxic in (0, 1)").groupBy("k").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({})
    share = _share(counts, {1: toxic_texts, 0: ordinary_texts})
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "k"), F.lit(1_000_000)) < share * 1_000_000
    chosen = known.where(drawn).withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "k"), F.lit(4)) == 0).withColumn("weight", 1 / share)
    # about toxic_texts + ordinary_texts short rows, whatever the table's size
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("text", "toxic", "curve", "weight").persist()
    try:
        met = sample.where("not curve").select("text", "toxic").mapInArrow(_contexts, "x string, toxic int, before string").distinct()
        words, other = ratios_of(met, discount)
        model = Model(words, other, window)
        curve = sample.where("curve").select("text", "toxic", "weight").mapInArrow(_evidence(model), "toxic int, evidence double, weight double").collect()
    finally:
        sample.unpersist()
    slope, shift = logistic(*(np.array([r[c] for r in curve], float) for c in ("evidence", "toxic", "weight")))
    return Model(words, other, window, slope, shift)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift by Newton's method, rows weighing w; the ridge bounds a separable fit."""
    if len(set(y.tolist())) < 2:
        return 1.0, -1.0
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta, keep = np.zeros(2), np.array([ridge, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag(keep), design.T @ (w * (y - p)) - keep * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _Ratios(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([evidence_of(t.as_py(), ratios) for t in b.column(0)], pa.float64()), b.column(2)], ["toxic", "evidence", "weight"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's key, evidence, score and predicted class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = _Ratios(shared.value)
        for b in batches:
            evidence = np.array([evidence_of(t.as_py(), ratios) for t in b.column(1)], float)
            p = shared.value.score(evidence)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(evidence), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["key", "evidence", "score", "predicted"])

    scored = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, evidence double, score double, predicted int")
    return scored.withColumnRenamed("key", key)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
