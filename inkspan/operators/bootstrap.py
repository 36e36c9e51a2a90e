"""Bootstrap over whole works, all replicates in one pass.

A replicate draws, of each stratum's works, as many as there are, with replacement.  It
is never built: ``draws`` says how often it takes each work, and every statistic is a
weighted one.  So a replicate costs a number a work, not a copy of the rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (0.025, 0.975)
#: Replicates that one task draws for a stratum.
BLOCK = 50


def _stratum(values: list) -> str:
    return "\x1f".join("" if v is None else str(v) for v in values)


def drawn(works: int, replicates: range, stratum: str, seed: int) -> np.ndarray:
    """How often each replicate (row) takes each of a stratum's works (column)."""
    out = np.zeros((len(replicates), works), np.int32)
    for k, r in enumerate(replicates):
        rng = np.random.default_rng([seed, r, zlib.crc32(stratum.encode())])
        out[k] = np.bincount(rng.integers(0, works, works), minlength=works)
    return out


def draws(rows: DataFrame, strata: list[str], work: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(strata, work, works, block, draws): for each block of replicates, how often each
    of them takes the work, and how many works the stratum has.  The first number of
    block 0 is that of the rows as they are, 1."""
    types = dict(rows.dtypes)
    names = ", ".join(f"`{c}` {types[c]}" for c in [*strata, work])
    starts = list(range(0, replicates + 1, BLOCK))
    spread = rows.select(*strata, work).distinct().withColumn("block", F.explode(F.array(*map(F.lit, range(len(starts))))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(work, kind="stable")
        first = starts[int(pdf["block"].iloc[0])]
        which = range(first, min(first + BLOCK, replicates + 1))
        taken = drawn(len(pdf), which, _stratum(pdf[strata].iloc[0].tolist()), seed)
        if first == 0:
            taken[0] = 1
        return pdf.assign(works=len(pdf), draws=list(taken.T))

    return spread.groupBy(*strata, "block").applyInPandas(run, f"{names}, block int, works long, draws array<int>").select(*strata, work, "works", "block", "draws")


def _interval(values: str) -> tuple:
    return F.percentile(values, F.lit(LEVELS[0])).alias("low"), F.percentile(values, F.lit(LEVELS[1])).alias("high")


def intervals(replicated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, replicate, value) to (keys, value, low, high): replicate 0 is the point."""
    is_point = F.col("replicate") == 0
    by = replicated.withColumn("drawn", F.when(~is_point, F.col("value")))
    return by.groupBy(*keys).agg(F.max(F.when(is_point, F.col("value"))).alias("value"), *_interval("drawn"))


def _numbered():
    return F.col("block") * BLOCK + F.col("_k")


def rates(rows: DataFrame, keys: list[str], author: str, work: str, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, value, low, high, works): mean over authors of the mean over their works
    of the mean of ``value``.  Where nothing varies, at 0 or 1, the side is widened to
    the exact bound of as many works."""
    by_work = rows.groupBy(*keys, author, work).agg(F.avg(F.col(value).cast("double")).alias("_v"))
    taken = draws(by_work, [*keys, author], work, replicates, seed)
    met = by_work.join(taken, [*keys, author, work]).select(*keys, author, "works", "_v", "block", F.posexplode("draws").alias("_k", "_d"))
    by_author = met.groupBy(*keys, author, _numbered().alias("replicate")).agg((F.sum(F.col("_v") * F.col("_d")) / F.first("works")).alias("_v"))
    found = intervals(by_author.groupBy(*keys, "replicate").agg(F.avg("_v").alias("value")), keys)
    n = by_work.groupBy(*keys).agg(F.count("*").alias("works"))
    bound = F.pow(F.lit(LEVELS[0]), 1 / F.col("works"))
    low = F.when(F.col("value") == 1, F.least("low", bound)).otherwise(F.col("low"))
    high = F.when(F.col("value") == 0, F.greatest("high", 1 - bound)).otherwise(F.col("high"))
    return found.join(n, keys).select(*keys, "value", low.alias("low"), high.alias("high"), "works")


def auc_replicates(rows: DataFrame, fold: str, author: str, work: str, score: str, positive: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(fold, replicate, value): the area under the ROC curve of each replicate.

    A work's positives weigh 1 together, and so do its negatives; equal scores count
    half.  Rows are sorted by ranges of (fold, score); a task gives, for all its
    replicates at once, the weights of its positives and negatives and the pairs won
    among its own, and a fold's ranges are put together in order."""
    of_label = rows.groupBy(fold, work, positive).agg(F.count("*").alias("n"))
    weighed = rows.select(fold, author, work, score, positive).join(of_label, [fold, work, positive])
    met = weighed.join(draws(rows, [fold, author], work, replicates, seed), [fold, author, work]).select(F.col(fold).alias("fold"), "block", F.col(score).cast("double").alias("score"), F.col(positive).alias("positive"), (1 / F.col("n")).alias("w"), "draws")
    types = dict(met.dtypes)
    ordered = met.repartitionByRange("fold", "block", "score").sortWithinPartitions("fold", "block", "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        key, score, out = None, None, []
        p = q = won = same_p = same_q = None

        def settle() -> None:
            nonlocal p, q, won
            won = won + same_p * (q + same_q / 2)
            p, q = p + same_p, q + same_q

        def close() -> None:
            settle()
            out.append((*key, at, p, q, won))

        for b in batches:
            starts = np.flatnonzero(np.r_[True, (b["fold"].to_numpy()[1:] != b["fold"].to_numpy()[:-1]) | (b["block"].to_numpy()[1:] != b["block"].to_numpy()[:-1]) | (b["score"].to_numpy()[1:] != b["score"].to_numpy()[:-1])])
            weights = np.stack(b["draws"].to_numpy()) * b["w"].to_numpy()[:, None] if b["draws"].map(len).nunique() == 1 else None
            sign = b["positive"].to_numpy(bool)
            for a, z in zip(starts, [*starts[1:], len(b)], strict=True):
                part = weights[a:z] if weights is not None else np.stack(b["draws"].to_numpy()[a:z]) * b["w"].to_numpy()[a:z, None]
                now, s = (b["fold"].iloc[a], b["block"].iloc[a]), b["score"].iloc[a]
                if now != key:
                    if key is not None:
                        close()
                    p = q = won = same_p = same_q = np.zeros(part.shape[1])
                    key, score = now, s
                elif s != score:
                    settle()
                    same_p = same_q = np.zeros(part.shape[1])
                    score = s
                same_p = same_p + part[sign[a:z]].sum(0)
                same_q = same_q + part[~sign[a:z]].sum(0)
        if key is not None:
            close()
        yield pd.DataFrame(out, columns=["fold", "block", "range", "p", "q", "won"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range")
        below = won = positives = 0
        for p, q, w in zip(pdf["p"], pdf["q"], pdf["won"], strict=True):
            won, positives, below = won + w + np.asarray(p) * below, positives + np.asarray(p), below + np.asarray(q)
        area = np.divide(won, positives * below, out=np.full(len(won), np.nan), where=positives * below > 0)
        first = int(pdf["block"].iloc[0]) * BLOCK
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "replicate": first + np.arange(len(area)), "value": area})

    ranges = ordered.mapInPandas(run, f"fold {types['fold']}, block int, range int, p array<double>, q array<double>, won array<double>")
    out = ranges.groupBy("fold", "block").applyInPandas(together, f"fold {types['fold']}, replicate long, value double")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))  # pandas hands on NaN as null


def auc_intervals(rows: DataFrame, fold: str, author: str, work: str, score: str, positive: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """One row (value, low, high, works): the mean of the folds' areas.  Without two
    works in every stratum of fold and author there is no interval."""
    by = auc_replicates(rows, fold, author, work, score, positive, replicates, seed)
    found = intervals(by.groupBy("replicate").agg(F.avg("value").alias("value")), [])
    strata = rows.groupBy(fold, author).agg(F.countDistinct(work).alias("n"))
    n = strata.agg(F.sum("n").alias("works"), F.min("n").alias("fewest"))
    some = F.col("fewest") >= 2
    return found.crossJoin(n).select("value", F.when(some, F.col("low")).alias("low"), F.when(some, F.col("high")).alias("high"), "works")  # one row each


def _weighted(works: pd.DataFrame, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of vectors and of their squares over an author's works as often as drawn."""
    first, second = (np.stack(works[c].to_numpy()) for c in ("m", "s"))
    n = taken.shape[0]
    return taken.T @ first / n, taken.T @ second / n


def refits(train: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, author, centroid, mean, scale) of training passages (author, work,
    v array): the standardised centroids of every replicate's works.

    All that a refit needs is each work's mean and mean square, so the passages are
    read once; authors, and blocks of replicates, are refitted side by side."""
    entries = train.select("author", "work", F.posexplode("v").alias("i", "x")).groupBy("author", "work", "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("s"))
    vector = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda e: e[c]).alias(c)
    works = entries.groupBy("author", "work").agg(vector("m"), vector("s"))
    types = dict(train.dtypes)
    met = works.join(draws(works, ["author"], "work", replicates, seed), ["author", "work"])

    def of_author(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("work", kind="stable")
        first, second = _weighted(pdf, np.stack(pdf["draws"].to_numpy()))
        at = int(pdf["block"].iloc[0]) * BLOCK
        return pd.DataFrame({"author": pdf["author"].iloc[0], "replicate": at + np.arange(len(first)), "m": list(first), "s": list(second)})

    def of_replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (np.stack(pdf[c].to_numpy()) for c in ("m", "s"))
        mean = first.mean(0)
        scale = np.sqrt(np.maximum(second.mean(0) - mean * mean, 0))
        scale = np.where(scale > 1e-9, scale, 1.0)
        return pd.DataFrame({"replicate": pdf["replicate"], "author": pdf["author"], "centroid": list((first - mean) / scale), "mean": [mean] * len(pdf), "scale": [scale] * len(pdf)})

    by_author = met.groupBy("author", "block").applyInPandas(of_author, f"author {types['author']}, replicate long, m array<double>, s array<double>")
    return by_author.groupBy("replicate").applyInPandas(of_replicate, f"replicate long, author {types['author']}, centroid array<double>, mean array<double>, scale array<double>")


def refit_intervals(train: DataFrame, test: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """One row (value, low, high, works): accuracy on test passages (author, work, v) of
    centroids refitted in every replicate, test works drawn anew as well.

    The models, replicates x authors x dimensions numbers, go to every task; rows are
    scored under all of them at once."""
    models = refits(train, replicates, seed).toPandas().sort_values(["replicate", "author"])
    names = sorted(models["author"].unique())
    shape = (replicates + 1, len(names), -1)
    centres = np.stack(models["centroid"].to_numpy()).reshape(shape)
    mean, scale = (np.stack(models[c].to_numpy()).reshape(shape)[:, 0] for c in ("mean", "scale"))
    centres = centres / np.maximum(np.linalg.norm(centres, axis=2, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                truth = b["author"].map({n: k for k, n in enumerate(names)}).fillna(-1).to_numpy(int)
                hits = np.stack([((x - mean[r]) / scale[r] @ centres[r].T).argmax(1) == truth for r in range(len(centres))], axis=1)
                yield b[["author", "work"]].assign(hits=list(hits.astype(float)))

    types = dict(test.dtypes)
    scored = test.select("author", "work", "v").mapInPandas(run, f"author {types['author']}, work {types['work']}, hits array<double>")
    by_work = scored.select("author", "work", F.posexplode("hits").alias("replicate", "hit")).groupBy("author", "work", "replicate").agg(F.avg("hit").alias("v"))
    taken = draws(test, ["author"], "work", replicates, seed + 1).select("author", "work", "works", "block", F.posexplode("draws").alias("_k", "_d")).select("author", "work", "works", _numbered().alias("replicate"), "_d")
    by_author = by_work.join(taken, ["author", "work", "replicate"]).groupBy("author", "replicate").agg((F.sum(F.col("v") * F.col("_d")) / F.first("works")).alias("v"))
    found = intervals(by_author.groupBy("replicate").agg(F.avg("v").alias("value")), [])
    n = test.select("author", "work").distinct().agg(F.count("*").alias("works"))
    return found.crossJoin(n)  # one row each
