"""Bootstrap intervals over whole works, and stress tests of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators.evaluate import hash_rank


def interval(groups: list[np.ndarray], seed: int = 42, replicates: int = 1000) -> tuple[float, float, float]:
    """(mean, low, high): groups (authors) weigh alike, their works are resampled.
    At 0 and 1, where nothing varies, the side is widened to the exact bound of as
    many works."""
    rng = np.random.default_rng(seed)
    point = float(np.mean([g.mean() for g in groups]))
    draws = np.mean([rng.choice(g, (replicates, len(g))).mean(axis=1) for g in groups], axis=0)
    low, high = np.quantile(draws, [0.025, 0.975])
    bound = 0.025 ** (1 / sum(map(len, groups)))
    return point, float(min(low, bound) if point == 1 else low), float(max(high, 1 - bound) if point == 0 else high)


def rate_intervals(rows: DataFrame, keys: list[str], author: str, work: str, value: str, seed: int = 42) -> DataFrame:
    """Nested mean of ``value`` by key with a 95 % interval over works.  Works are
    averaged in Spark; a key's works (not rows) meet in one task."""
    works = rows.groupBy(*keys, author, work).agg(F.avg(F.col(value).cast("double")).alias("v"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [g["v"].to_numpy() for _, g in pdf.sort_values([author, work]).groupby(author)]
        return pd.DataFrame([[*pdf[keys].iloc[0], *interval(groups, seed), len(pdf)]], columns=[*keys, "rate", "low", "high", "works"])

    types = dict(rows.dtypes)
    return works.groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rate double, low double, high double, works long")


def deleted(words: Column, share: float, seed: str, key: str) -> Column:
    """An array of words without a fixed share of them, chosen by hash."""
    n = F.greatest(F.lit(1), F.floor(F.size(words) * share)).cast("int")
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct(F.xxhash64(F.lit(seed), F.col(key), i).alias("h"), i.alias("i"), w.alias("w"))))
    left = F.slice(ranked, n + 1, F.greatest(F.size(words) - n, F.lit(0)))
    return F.transform(F.array_sort(F.transform(left, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"])


def spliced(words: Column, donor: Column, share: float) -> Column:
    """An array of words with the share after its middle replaced by a donor's first words."""
    n = F.greatest(F.lit(1), F.floor(F.size(words) * share)).cast("int")
    half = F.floor(F.size(words) / 2).cast("int")
    return F.concat(F.slice(words, F.lit(1), half), F.slice(donor, F.lit(1), n), F.slice(words, half + n + 1, F.greatest(F.size(words) - half - n, F.lit(0))))


def centred_units(words: DataFrame, work: str, size: int, most: int) -> DataFrame:
    """At most ``most`` blocks of exactly ``size`` words from the middle of each
    work: (work, block, words)."""
    n = F.floor(F.size("words") / size).cast("int")
    take = F.least(n, F.lit(most))
    first = F.floor((n - take) / 2).cast("int")
    blocks = F.when(take > 0, F.transform(F.sequence(first, first + take - 1), lambda k: F.struct(k.alias("block"), F.slice("words", k * size + 1, F.lit(size)).alias("words"))))
    return words.select(work, F.explode(blocks).alias("b")).select(work, "b.block", "b.words")


def blocks_sample(words: DataFrame, work: str, size: int, most: int) -> DataFrame:
    """Blocks of exactly ``size`` words, at most ``most`` of a work, evenly spaced;
    their ids say nothing of the work."""
    n = F.floor(F.size("words") / size).cast("int")
    picks = F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int")))
    rows = words.select(work, F.explode(picks).alias("block"), "words").select(work, "block", (F.col("block") * size).alias("start"), F.slice("words", F.col("block") * size + 1, F.lit(size)).alias("words"))
    return rows.withColumn("id", F.substring(hash_rank("block", work, "block"), 1, 16))
