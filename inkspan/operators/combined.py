"""One space from three kinds of evidence, none of which can outvote the others by having
more columns: rates of frequent words, transitions between marker words, and repetition.

Every kind is standardised by feature and then scaled to a total variance of its weight
squared.  Rows are (block, doc, kind, feature, value): the matrix in long form, whose column
spans are the kinds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.operators import distances, frequency

KINDS = ("rate", "placement", "repetition")
#: Measures whose range is extreme and is taken as log(1 + x).
HEAVY = ("yule_k", "honore_r", "brunet_w")
MEASURES = (*HEAVY, "simpson_d", "sichel_s", "hapax_ratio", "mattr", "top_share", "repeat_rate")


def rates(words: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """Relative frequencies of a block's most frequent words.  words: (block, doc, text,
    pos, word); docs: (block, doc)."""
    return rates_of(words.groupBy("block", "doc", "word").agg(F.count("*").alias("n")), docs, most)


def rates_of(counts: DataFrame, docs: DataFrame, most: int = 500) -> DataFrame:
    """``rates`` from counts (block, doc, word, n)."""
    totals = counts.groupBy("block", "word").agg(F.sum("n").alias("n"))
    features = frequency.top_words(totals, ["block"], most).select("block", F.col("word").alias("feature"))
    values = distances.frequencies(counts.select("doc", F.col("word").alias("feature"), "n"))
    return distances.dense(values, docs, features).select("block", "doc", F.lit("rate").alias("kind"), "feature", "value")


def placements(texts: DataFrame, docs: DataFrame, markers: list[str], window: int = 10, keep: int = 500) -> DataFrame:
    """Shares of a document's transitions between markers, of the block's heaviest
    transitions.  texts: (doc, words array)."""
    edges = distances.adjacency(texts, markers, window).select("doc", F.concat_ws(">", "src", "dst").alias("feature"), "weight").join(docs, "doc")
    order = Window.partitionBy("block").orderBy(F.desc(F.round("weight", 6)), "feature")
    heaviest = edges.groupBy("block", "feature").agg(F.sum("weight").alias("weight")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("block", "feature")
    share = edges.withColumn("value", F.col("weight") / F.sum("weight").over(Window.partitionBy("doc"))).select("doc", "feature", "value")
    return distances.dense(share, docs, heaviest).select("block", "doc", F.lit("placement").alias("kind"), "feature", "value")


def repetition(words: DataFrame, docs: DataFrame, window: int = 100) -> DataFrame:
    """Measures of vocabulary richness of each document, its texts one after another."""
    lengths = words.groupBy("doc", "text").agg((F.max("pos") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = words.join(lengths.select("doc", "text", before.alias("before")), ["doc", "text"]).select("doc", (F.col("before") + F.col("pos")).alias("pos"), "word")
    counts = words.groupBy("doc", "word").agg(F.count("*").alias("n"))
    return _measured(frequency.richness(counts, ["doc"]), frequency.mattr(placed, ["doc"], window), docs)


def repetition_of(counts: DataFrame, texts: DataFrame, docs: DataFrame, window: int = 100) -> DataFrame:
    """``repetition`` from counts (doc, word, n) and texts (doc, text, words array), without
    a row a word."""
    return _measured(frequency.richness(counts, ["doc"]), frequency.mattr_texts(texts, ["doc"], "text", window), docs)


def _measured(rich: DataFrame, ratio: DataFrame, docs: DataFrame) -> DataFrame:
    rich = rich.join(ratio, "doc")
    value = lambda m: F.log1p(F.greatest(F.col(m), F.lit(0.0))) if m in HEAVY else F.col(m)
    each = rich.select("doc", F.explode(F.array(*[F.struct(F.lit(m).alias("feature"), value(m).alias("value")) for m in MEASURES])).alias("e"))
    return docs.join(each.select("doc", "e.feature", "e.value"), "doc").select("block", "doc", F.lit("repetition").alias("kind"), "feature", "value")


def equalised(values: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """values with ``z``; kinds of weight 0 are left out."""
    weights = {k: 1.0 for k in KINDS} | (weights or {})
    if any(w < 0 or not math.isfinite(w) for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must be finite, none negative and one positive")
    by = Window.partitionBy("block", "kind", "feature")
    sd = F.stddev_pop("value").over(by)
    z = F.when(sd < distances.QUIET, 0.0).otherwise((F.col("value") - F.avg("value").over(by)) / sd)
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[F.col("kind")]
    known = values.where(F.col("kind").isin([k for k, w in weights.items() if w > 0])).withColumn("z", z).withColumn("live", sd >= distances.QUIET)
    loud = known.groupBy("block", "kind").agg(F.countDistinct(F.when(F.col("live"), F.col("feature"))).alias("loud"))
    return known.join(loud, ["block", "kind"]).select("block", "doc", "kind", F.concat_ws(":", "kind", "feature").alias("feature"), F.when(F.col("loud") > 0, F.col("z") * weight / F.sqrt("loud")).otherwise(0.0).alias("z"))


def attributed(values: DataFrame, docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each document's nearest one outside its group by cosine distance over all kinds;
    docs: (block, doc, group)."""
    space = equalised(values, weights)
    apart = distances.pairs(space, "z", "cosine").withColumn("distance", F.round("distance", 5))
    return distances.nearest_outside(apart, docs)
