"""What sets groups of units apart: their features, their middle, their tags and makers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 200


def group_sizes(units: DataFrame, group: str, confidence: str) -> DataFrame:
    """(group, n, share, mean_confidence) of units that have a group."""
    by = units.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select(group, "n", (F.col("n") / F.col("total")).alias("share"), "mean_confidence")


def group_values(units: DataFrame, group: str, column: str, most: int = 15) -> DataFrame:
    """(group, value, n, place): the most frequent values of a group (ties: smaller)."""
    counts = units.where(F.col(group).isNotNull() & F.col(column).isNotNull()).groupBy(group, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def effects(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, feature, effect): a feature's mean in a group in spreads of the whole
    table from the mean of the whole; a feature without spread has effect 0.  rows hold
    arrays of one width, so a sum has as many values as they do."""
    each = rows.where(F.col(group).isNotNull()).select(group, F.posexplode(vector).alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    by = each.groupBy(group, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")  # a row a group
    n, mean = F.sum("n").over(w), F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    # variance of the whole: within groups and between their means
    whole = by.withColumn("mean", mean).withColumn("var", F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))).over(w) / n)
    return whole.select(group, "feature", F.when(F.col("var") > 1e-18, F.try_divide(F.col("m") - F.col("mean"), F.sqrt("var"))).otherwise(0.0).alias("effect"))


def markers(effect: DataFrame, group: str, high: int = 15, low: int = 10) -> DataFrame:
    """(group, side, place, feature, effect): the features that a group has most and
    least of (ties: the earlier feature)."""
    rounded = F.round("effect", 9)
    top = lambda side, order, most: effect.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, "feature"))).where(F.col("place") <= most).select(group, F.lit(side).alias("side"), "place", "feature", "effect")
    return top("high", rounded.desc(), high).unionByName(top("low", rounded.asc(), low))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def representatives(rows: DataFrame, group: str, vector: str, key: str, most: int = 5, text: str | None = None) -> DataFrame:
    """(group, place, key, distance, text): the units next to the centroid of their group
    (ties: smaller key).  Ranks are cut in each input partition before rows are moved."""
    given = rows.where(F.col(group).isNotNull())
    means = given.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("centre"))
    met = given.join(centres, group).withColumn("distance", _distance(F.col(vector), F.col("centre")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.round("distance", 9), key))
    shown = [] if text is None else [F.substring(text, 1, SHOWN).alias("text")]
    return met.withColumn("place", place).where(F.col("place") <= most).select(group, "place", key, "distance", *shown)


def tag_lift(units: DataFrame, group: str, tags: str, least_all: int = 5, least_own: int = 3, most: int = 15) -> DataFrame:
    """(group, place, tag, n, lift): tags whose share in a group is largest against their
    share in all units that have a group (ties: smaller tag).  A unit's tags are an array,
    and each occurrence counts."""
    given = units.where(F.col(group).isNotNull())
    sizes = given.groupBy(group).agg(F.count("*").alias("units"))
    counts = given.select(group, F.explode(tags).alias("tag")).groupBy(group, "tag").agg(F.count("*").alias("n"))
    of_all = F.sum("n").over(Window.partitionBy("tag"))  # a row a group
    total = sizes.agg(F.sum("units").alias("total"))  # one row
    met = counts.withColumn("all", of_all).where((F.col("all") >= least_all) & (F.col("n") >= least_own)).join(sizes, group).crossJoin(F.broadcast(total))
    # as one division of whole numbers: equal lifts are equal
    lift = (F.col("n").cast("double") * F.col("total")) / (F.col("all").cast("double") * F.col("units"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.round("lift", 9).desc(), "tag"))
    return met.withColumn("lift", lift).withColumn("place", place).where(F.col("place") <= most).select(group, "place", "tag", "n", "lift")
