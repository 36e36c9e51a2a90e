"""Distances between documents in long form (doc, feature, value), nearest
neighbours with a held-out group, and word-adjacency networks.

A pair of documents meets on the features, so a distance between all documents
of a block costs (pairs in the block) x (features); ``block`` keeps comparisons
within languages or other groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.operators.frequency import word_pairs

QUIET = 1e-12


def frequencies(counts: DataFrame, doc: str = "doc") -> DataFrame:
    """Relative frequency of each word in its document: (doc, word, value)."""
    total = F.sum("n").over(Window.partitionBy(doc))
    return counts.withColumn("value", F.col("n") / total).drop("n")


def dense(values: DataFrame, docs: DataFrame, features: DataFrame) -> DataFrame:
    """All pairs of a doc and a feature of its block, with 0 where none is given.
    docs: (block, doc, group); features: (block, feature)."""
    return docs.join(features, "block").join(values.select("doc", "feature", "value"), ["doc", "feature"], "left").fillna(0.0, ["value"])


def zscores(values: DataFrame) -> DataFrame:
    """Population z-scores of each feature in its block; a quiet feature is 0."""
    by = Window.partitionBy("block", "feature")
    mean, sd = F.avg("value").over(by), F.stddev_pop("value").over(by)
    return values.withColumn("z", F.when(sd < QUIET, 0.0).otherwise((F.col("value") - mean) / sd))


def pairs(values: DataFrame, value: str, distance: str) -> DataFrame:
    """(block, a, b, distance) for a <> b: ``classic`` (mean absolute difference),
    ``cosine`` (1 - cosine, in [0, 2]), ``euclidean`` or ``jsd`` (base 2, of rows
    normalised to 1)."""
    left = values.select("block", "feature", F.col("doc").alias("a"), F.col(value).alias("x"))
    right = values.select("block", "feature", F.col("doc").alias("b"), F.col(value).alias("y"))
    met = left.join(right, ["block", "feature"]).where("a <> b")
    x, y = F.col("x"), F.col("y")
    if distance == "classic":
        out = F.avg(F.abs(x - y))
    elif distance == "euclidean":
        out = F.sqrt(F.sum((x - y) * (x - y)))
    elif distance == "cosine":
        dot, nx, ny = F.sum(x * y), F.sum(x * x), F.sum(y * y)
        out = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.when((nx > 0) & (ny > 0), 1 - dot / F.sqrt(nx * ny)).otherwise(1.0)))
    elif distance == "jsd":
        m = (x + y) / 2
        part = lambda p: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        out = F.greatest(F.lit(0.0), F.sum(part(x) + part(y)) / 2)
    else:
        raise ValueError(f"unknown distance: {distance}")
    return met.groupBy("block", "a", "b").agg(out.alias("distance"))


def nearest_outside(distances: DataFrame, docs: DataFrame) -> DataFrame:
    """Each document's nearest neighbour that isn't of its own group (ties: the
    smaller id); null where no other group is in the block."""
    of = lambda c: docs.select(F.col("doc").alias(c), F.col("group").alias(f"group_{c}"))
    open_ = distances.join(of("a"), "a").join(of("b"), "b").where("group_a <> group_b")
    best = open_.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
    return docs.select(F.col("doc").alias("a")).join(best, "a", "left").select(F.col("a").alias("doc"), F.col("m.b").alias("nearest"), F.col("m.distance").alias("distance"))


def within_between(distances: DataFrame, docs: DataFrame) -> DataFrame:
    """Mean distance of pairs of the same and of different groups, by block."""
    of = lambda c: docs.select(F.col("doc").alias(c), F.col("group").alias(f"group_{c}"))
    rows = distances.join(of("a"), "a").join(of("b"), "b")
    same = F.col("group_a") == F.col("group_b")
    return rows.groupBy("block").agg(F.avg(F.when(same, F.col("distance"))).alias("within"), F.avg(F.when(~same, F.col("distance"))).alias("between"))


def adjacency(texts: DataFrame, markers: list[str], window: int = 5) -> DataFrame:
    """Marker network (doc, src, dst, weight): a marker pair at distance d within
    the window weighs 1/d.  texts: (doc, words array); only markers' pairs are made."""
    pairs = word_pairs(texts, ["doc"], window, markers)
    return pairs.groupBy("doc", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum(1 / F.col("step")).alias("weight"))


def transitions(edges: DataFrame, docs: DataFrame, markers: list[str], smoothing: float = 0.01) -> DataFrame:
    """Row-normalised networks with every cell smoothed: (doc, src, dst, p)."""
    k = len(markers)
    names = F.array(*map(F.lit, markers))
    cells = docs.select("doc").withColumn("src", F.explode(names)).withColumn("dst", F.explode(names))
    full = cells.join(edges, ["doc", "src", "dst"], "left").fillna(0.0, ["weight"])
    total = F.sum("weight").over(Window.partitionBy("doc", "src"))
    return full.withColumn("p", (F.col("weight") + smoothing) / (total + smoothing * k)).drop("weight")


def divergence(networks: DataFrame, docs: DataFrame) -> DataFrame:
    """Symmetric mean over rows of the divergence of two networks of a block."""
    blocked = networks.join(docs.select("doc", "block"), "doc")
    left = blocked.select("block", "src", "dst", F.col("doc").alias("a"), F.col("p").alias("x"))
    right = blocked.select("block", "src", "dst", F.col("doc").alias("b"), F.col("p").alias("y"))
    x, y = F.col("x"), F.col("y")
    met = left.join(right, ["block", "src", "dst"]).where("a < b")
    return met.groupBy("block", "a", "b").agg((F.sum(x * F.log2(x / y) + y * F.log2(y / x)) / 2 / F.countDistinct("src")).alias("divergence"))


def margins(points: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    """(d_other - d_own) / max(d_own, d_other) of each point to the centroids of
    the labels, which are one row of an array each: a label's vector is of fixed width."""
    parts = points.select(key, label, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(F.col(label).alias("other"), F.col("c.m").alias("c"))
    square = F.aggregate(F.zip_with(vector, "c", lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, d: a + d)
    known = centroids.agg(F.collect_list(F.struct("other", "c")).alias("known"))  # one row
    met = points.select(key, label, vector).crossJoin(F.broadcast(known)).select(key, label, vector, F.explode("known").alias("k")).select(key, label, vector, "k.other", "k.c").select(key, label, "other", F.sqrt(square).alias("d"))
    own = F.max(F.when(F.col(label) == F.col("other"), F.col("d")))
    rest = F.min(F.when(F.col(label) != F.col("other"), F.col("d")))
    by = met.groupBy(key, label).agg(own.alias("own"), rest.alias("rest"))
    return by.select(key, label, ((F.col("rest") - F.col("own")) / F.greatest(F.lit(1e-9), "own", "rest")).alias("margin"))


def block_of(*columns: str) -> Column:
    return F.concat_ws("|", *columns).alias("block")
