"""Attribution by marker networks: to the nearest document outside one's own group, or to
the author whose other texts, pooled into one network, are nearest.

docs: (block, doc, group, label); edges: (doc, src, dst, weight) as ``adjacency`` makes
them.  A network is an array of markers x markers, so its size is fixed and one row a
network travels.  A document is compared with one network a label, not with every other
document: a label's pool for a group is the label's sum less the group's own part of it,
which is small to keep beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators import distances

#: Divergences are compared to this many places, so that the order of sums decides no tie.
PLACES = 12


def _dense(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, w): the weights by cell, 0 where none is given."""
    by = rows.groupBy(*keys, "cell").agg(F.sum("weight").alias("weight")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "weight"))).alias("m"))
    return by.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("w"))


def _shares(weights: Column, markers: int, smoothing: float) -> Column:
    """The network's rows, each smoothed and made 1 in sum, one after another."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(markers - 1)), lambda r: F.slice(weights, r * markers + 1, markers))
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x) + smoothing * markers
    return F.flatten(F.transform(rows, lambda row: F.transform(F.array(total(row)), lambda t: F.transform(row, lambda x: (x + smoothing) / t))[0]))


def _divergence(a: str, b: str, markers: int) -> Column:
    cells = F.zip_with(a, b, lambda x, y: x * F.log2(x / y) + y * F.log2(y / x))
    return F.round(F.aggregate(cells, F.lit(0.0), lambda s, v: s + v) / (2 * markers), PLACES)


def _cells(edges: DataFrame, markers: list[str]) -> DataFrame:
    place = lambda c: F.array_position(F.array(*map(F.lit, markers)), F.col(c)) - 1
    return edges.select("doc", (place("src") * len(markers) + place("dst")).cast("int").alias("cell"), "weight").where("cell is not null")


def attributed(edges: DataFrame, docs: DataFrame, markers: list[str], smoothing: float = 0.01) -> DataFrame:
    """(doc, nearest, predicted, distance): each document's nearest one of another group
    in its block (ties: smaller name) and that one's label; nulls where there is none."""
    both = distances.divergence(distances.transitions(edges, docs, markers, smoothing), docs).select("a", "b", F.round("divergence", PLACES).alias("distance"))
    either = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    found = distances.nearest_outside(either, docs)
    return found.join(docs.select(F.col("doc").alias("nearest"), F.col("label").alias("predicted")), "nearest", "left").select("doc", "nearest", "predicted", "distance")


def attributed_pooled(edges: DataFrame, docs: DataFrame, markers: list[str], smoothing: float = 0.01) -> DataFrame:
    """(doc, predicted, distance): the label of the nearest pool of texts (ties: smaller
    label).  Nothing of a document's own group is in any pool it is compared with, and a
    label with no other text isn't a candidate; nulls where there is none."""
    k, size = len(markers), len(markers) ** 2
    known = docs.select("block", "doc", "group", "label")
    cells = _cells(edges, markers)
    by = cells.join(known.where("label is not null"), "doc")
    own = _dense(by, ["block", "label", "group"], size).withColumnRenamed("w", "less")
    have = known.where("label is not null").groupBy("block", "label", "group").agg(F.count("*").alias("n"))
    of_label = have.groupBy("block", "label").agg(F.sum("n").alias("all")).join(_dense(by, ["block", "label"], size), ["block", "label"], "left")
    zero = F.array_repeat(F.lit(0.0), size)
    each = known.join(_dense(cells, ["doc"], size), "doc", "left").select("block", "doc", "group", _shares(F.coalesce("w", zero), k, smoothing).alias("p"))
    met = each.join(of_label.withColumnRenamed("w", "pool"), "block").join(have, ["block", "label", "group"], "left").join(own, ["block", "label", "group"], "left")
    # what floating-point subtraction leaves of an emptied cell is nothing
    rest = F.transform(F.zip_with(F.coalesce("pool", zero), F.coalesce("less", zero), lambda a, b: a - b), lambda x: F.when(x > 1e-9, x).otherwise(0.0))
    scored = met.where(F.col("all") > F.coalesce("n", F.lit(0))).withColumn("q", _shares(rest, k, smoothing)).select("doc", "label", _divergence("p", "q", k).alias("distance"))
    best = scored.groupBy("doc").agg(F.min(F.struct("distance", "label")).alias("m"))
    return known.select("doc").join(best, "doc", "left").select("doc", F.col("m.label").alias("predicted"), F.col("m.distance").alias("distance"))
