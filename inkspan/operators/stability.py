"""How far a partition changes when it is fitted to a part of the rows.

Each repeat fits k-means to the rows it draws, assigns all rows and is compared with the
given labels through their contingency counts.  Rows are drawn in whole blocks, by hash,
so a repeat is a filter; repeats are Spark jobs side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators import evaluate

CRITERIA = {"silhouette": True, "bic": False}  #: whether more is better


def supported_order(table: DataFrame, criterion: str = "silhouette") -> list[int]:
    """The supported numbers of groups of (k, split_supported, criterion), best first
    (ties: fewer groups)."""
    score = F.col(criterion)
    rows = table.where(F.col("split_supported") & score.isNotNull()).orderBy(F.desc(criterion) if CRITERIA[criterion] else F.asc(criterion), "k")
    return [r.k for r in rows.select("k").collect()]


def run_blocks(rows: DataFrame, run: str, place: str, window: int = 5) -> DataFrame:
    """rows with ``block``: stretches of a run that are wide enough for smoothing not to
    reach across one."""
    width = max(20, 2 * window + 1)
    return rows.withColumn("block", F.concat_ws(":", F.col(run).cast("string"), F.floor(F.col(place) / width).cast("string")))


def kept(seed: int, repeat: int, block: str, share: float) -> Column:
    """Whether a repeat takes the block; ``share`` of all blocks is expected."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(repeat), F.col(block)), F.lit(1_000_000)) < int(share * 1_000_000)


def stability(rows: DataFrame, vector: str, label: str, k: int, block: str, repeats: int = 5, share: float = 0.8, seed: int = 0, least_blocks: int = 5) -> DataFrame:
    """(repeat, ari, drawn): agreement of each repeat's partition with the labels on all
    rows; a draw of fewer than k different vectors agrees not at all.  No rows for one
    group, or for fewer blocks than ``least_blocks``."""
    if repeats < 1:
        raise ValueError("at least one repeat is needed")
    spark = rows.sparkSession
    schema = "repeat int, ari double, drawn long"
    if k < 2 or rows.select(block).distinct().limit(least_blocks).count() < least_blocks:
        return spark.createDataFrame([], schema)
    data = rows.select(F.col(label).cast("string").alias("truth"), F.col(block).alias("block"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("f", array_to_vector("v")).persist()

    def one(repeat: int) -> tuple[int, float, int]:
        some = data.where(kept(seed, repeat, "block", share))
        n = some.count()
        if some.select("v").distinct().limit(k).count() < k:
            return repeat, 0.0, n
        fitted = KMeans(featuresCol="f", k=k, seed=seed + repeat + 1, initSteps=5).fit(some)
        found = fitted.transform(data).select("truth", F.col("prediction").alias("found"))
        return repeat, float(evaluate.agreement(found.withColumn("all", F.lit(1)), "truth", "found", ["all"]).first().ari), n

    try:
        with ThreadPoolExecutor(min(repeats, 8)) as pool:
            out = list(pool.map(one, range(repeats)))
    finally:
        data.unpersist()
    return spark.createDataFrame(out, schema)


def summary(found: DataFrame) -> DataFrame:
    """One row (available, repeats, mean_ari, min_ari)."""
    return found.agg((F.count("*") > 0).alias("available"), F.count("*").alias("repeats"), F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))


def stable_order(rows: DataFrame, vector: str, labels: dict[int, str], order: list[int], block: str, least: float = 0.5, repeats: int = 5, seed: int = 0) -> int:
    """The first number of groups in ``order`` whose partition (a column of labels for
    each) has a mean agreement of ``least`` or more; 1 if none has."""
    for k in order:
        row = summary(stability(rows, vector, labels[k], k, block, repeats, seed=seed)).first()
        if row.available and row.mean_ari >= least:
            return k
    return 1
