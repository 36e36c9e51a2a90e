"""Predictions of rows by classifiers that never saw a row of the same work.

Works are left out one by one, or, where they are many, in folds of whole works; what
scales the features is learned in training rows only.  Folds are fitted side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("forest", "svm")


def _stages(kind: str, trees: int, depth: int, seed: int) -> Pipeline:
    scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)
    if kind == "forest":
        return Pipeline(stages=[scale, RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)])
    if kind == "svm":
        return Pipeline(stages=[scale, OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01), featuresCol="x", labelCol="y")])
    raise ValueError(f"unknown classifier {kind!r}: {' or '.join(KINDS)}")


def out_of_fold(rows: DataFrame, key: str, vector: str, label: str, work: str, kind: str = "forest", most_folds: int | None = None, trees: int = 300, depth: int = 8, seed: int = 0) -> DataFrame:
    """(key, work, truth, predicted): predicted is null where the other works have
    one label only.  ``most_folds`` works or more are left out together if there are
    more works than that."""
    _stages(kind, trees, depth, seed)
    works = [r[0] for r in rows.select(work).distinct().orderBy(work).limit(1001).collect()]
    if len(works) < 2:
        raise ValueError("two works or more are needed")
    if most_folds is None and len(works) > 1000:
        raise ValueError("so many works need folds")
    n = len(works) if most_folds is None else min(most_folds, len(works))
    place = F.array_position(F.array(*map(F.lit, works)), F.col(work)) - 1 if len(works) <= 1000 else F.xxhash64(work)
    names = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    data = rows.select(F.col(key).alias("key"), F.col(work).alias("work"), F.col(label).alias("truth"), F.pmod(place, F.lit(n)).cast("int").alias("fold"), (F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw")).persist()
    answer = F.array(*map(F.lit, names))[F.col("prediction").cast("int")]

    def one(fold: int) -> DataFrame:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if train.select("y").distinct().limit(2).count() < 2:
            return test.select("key", "work", "truth", F.lit(None).cast(dict(data.dtypes)["truth"]).alias("predicted"))
        return _stages(kind, trees, depth, seed).fit(train).transform(test).select("key", "work", "truth", answer.alias("predicted"))

    with ThreadPoolExecutor(min(n, 4)) as pool:
        parts = list(pool.map(one, range(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(found: DataFrame) -> DataFrame:
    """One row (n, classes, accuracy, majority_baseline) of the rows with a prediction."""
    by = found.where("predicted is not null").groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("classes"), F.coalesce(F.sum("hits") / F.sum("n"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("majority_baseline"))
