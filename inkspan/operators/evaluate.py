"""Agreement of two labellings, accuracies with nested weights, thresholds,
rejection, AUROC, gates, hash-ranked roles and samples."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from inkspan.operators.gallery import running


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(rows: DataFrame, truth: str, found: str, keys: list[str]) -> DataFrame:
    """Adjusted Rand index, normalized mutual information (arithmetic mean of the
    entropies) and purity, from the contingency table of each key."""
    cell = rows.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(*keys, truth, found).agg(F.count("*").cast("double").alias("n"))
    side = lambda c: cell.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias(f"pairs_{c}"), F.sum(F.col("n") * F.log("n")).alias(f"h_{c}"), F.count("*").alias(f"count_{c}"))
    both = cell.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("pairs"), F.sum(F.col("n") * F.log("n")).alias("h"))
    best = cell.groupBy(*keys, found).agg(F.max("n").alias("m")).groupBy(*keys).agg(F.sum("m").alias("best"))
    x = both.join(side(truth), keys).join(side(found), keys).join(best, keys)
    a, b = F.col(f"pairs_{truth}"), F.col(f"pairs_{found}")
    expected, most = a * b / _pairs(F.col("n")), (a + b) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("pairs") - expected) / (most - expected))
    n = F.col("n")
    ha, hb = F.log(n) - F.col(f"h_{truth}") / n, F.log(n) - F.col(f"h_{found}") / n
    mutual = F.log(n) + (F.col("h") - F.col(f"h_{truth}") - F.col(f"h_{found}")) / n
    nmi = F.when((F.col(f"count_{truth}") == 1) & (F.col(f"count_{found}") == 1), 1.0).when(ha + hb <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), mutual) / ((ha + hb) / 2))
    return x.select(*keys, n.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"), (F.col("best") / n).alias("purity"), F.col(f"count_{truth}").alias("truth_count"), F.col(f"count_{found}").alias("found_count"))


def nested_mean(rows: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """Mean of means: rows within order[0], those within order[1], and so on; each
    level counts its members alike."""
    left = list(order)
    now = rows.groupBy(*left).agg(F.avg(value).alias("value"), F.count("*").alias("rows"))
    while len(left) > 1:
        left = left[:-1]
        now = now.groupBy(*left).agg(F.avg("value").alias("value"), F.sum("rows").alias("rows"))
    return now


def equal_weights(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Weights that give each outer group, each inner group in it, and each row in
    that the same mass; they add up to the number of rows."""
    outers = rows.groupBy(outer).agg(F.countDistinct(inner).alias("inners"), F.count("*").alias("m"))
    whole = outers.agg(F.count("*").alias("outers"), F.sum("m").alias("all"))
    inners = rows.groupBy(outer, inner).agg(F.count("*").alias("size"))
    one_row = F.broadcast(whole)
    table = inners.join(outers.drop("m"), outer).crossJoin(one_row)
    return rows.join(table, [outer, inner]).withColumn("weight", F.col("all") / (F.col("outers") * F.col("inners") * F.col("size"))).drop("inners", "size", "outers", "all")


def macro_recall(rows: DataFrame, truth: str, found: str, keys: list[str]) -> DataFrame:
    """Accuracy and mean recall over the truth's classes that occur."""
    by = rows.groupBy(*keys, truth).agg(F.avg((F.col(truth) == F.col(found)).cast("double")).alias("recall"), F.count("*").alias("n"), F.sum((F.col(truth) == F.col(found)).cast("long")).alias("hits"))
    return by.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("macro_recall"))


def vote(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each group; ties: smallest label."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("n")).select(*keys, F.col("b.label").alias("voted"), (-F.col("b.m")).alias("votes"), "n")


def order_quantile(rows: DataFrame, keys: list[str], score: str, q: float, upper: bool = True) -> DataFrame:
    """The q-quantile that is one of the scores: the next higher or lower one."""
    order = Window.partitionBy(*keys).orderBy(score)
    at = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    place = (F.col("n") - 1) * q
    want = F.ceil(place) if upper else F.floor(place)
    return at.where(F.col("k") == want).select(*keys, F.col(score).alias("threshold"))


def auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half.  Counts by score come
    first, so the window runs over distinct scores."""
    by = rows.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = by.withColumn("won", F.col("p") * (below + F.col("q") / 2)).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return out.where("positives > 0 and negatives > 0").select(*keys, "positives", "negatives", (F.col("won") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def calibrate_rejection(rows: DataFrame, score: str, genuine: str, most_false: float) -> DataFrame:
    """The smallest threshold at which at most ``most_false`` of the impostors are
    accepted (score >= threshold), with the share of the genuine it accepts.  All
    rows of a score are accepted or rejected together."""
    by = rows.groupBy(score).agg(F.sum(F.col(genuine).cast("long")).alias("g"), F.sum((~F.col(genuine)).cast("long")).alias("i"))
    whole = by.agg(F.sum("g").alias("genuine"), F.sum("i").alias("impostors"))  # one row
    curve = running(by, score, ["g", "i"]).crossJoin(F.broadcast(whole)).withColumnRenamed(score, "threshold")
    feasible = curve.where(F.col("at_least_i") <= most_false * F.col("impostors"))
    return feasible.orderBy("threshold").limit(1).select("threshold", (F.col("at_least_g") / F.col("genuine")).alias("accepted_share"), (F.col("at_least_i") / F.col("impostors")).alias("false_share"))


def decisions(scores: DataFrame, query: str, candidate: str, score: str, threshold: float) -> DataFrame:
    """The one best candidate at or above the threshold, else null; ties abstain."""
    best = scores.groupBy(query).agg(F.max(score).alias("best"))
    top = scores.join(best, query).where(F.col(score) == F.col("best")).groupBy(query).agg(F.count("*").alias("n"), F.min(candidate).alias("winner"), F.first("best").alias("best"))
    return top.select(query, F.when((F.col("n") == 1) & (F.col("best") >= threshold), F.col("winner")).alias("decision"), "best")


def hash_rank(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def hash_buckets(rows: DataFrame, keys: list[str], item: str, buckets: int, seed: str, least: int = 0) -> DataFrame:
    """Items of each group in hash order, dealt round-robin to buckets; groups of
    fewer than ``least`` items are left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_rank(seed, *keys, item), item)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.select(*keys, item).distinct().withColumn("n", n).withColumn("bucket", (place % buckets).cast("long")).where(F.col("n") >= least).drop("n")


#: Passages of a work that a task holds against as many of another.
PASSAGES_AT_ONCE = 4096


def pair_sample(passages: DataFrame, work: str, item: str, group: str, most: int, seed: str, offered: int | None = None) -> DataFrame:
    """For each two works of a group, the ``most`` passage pairs of lowest hash.

    All pairs are tried, which grows with the square of the passages; with ``offered``
    each work offers only so many passages of lowest hash."""
    if offered is None:
        return lowest_pairs(passages, work, item, group, most, seed)
    rows = passages.select(group, work, item)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, work).orderBy(hash_rank(seed, item), item))).where(F.col("k") <= offered).drop("k")
    left = rows.select(group, F.col(work).alias("work_a"), F.col(item).alias("a"))
    right = rows.select(group, F.col(work).alias("work_b"), F.col(item).alias("b"))
    pairs = left.join(right, group).where("work_a < work_b")
    rank = F.row_number().over(Window.partitionBy(group, "work_a", "work_b").orderBy(hash_rank(seed, "a", "b"), "a", "b"))
    return pairs.withColumn("place", rank).where(F.col("place") <= most)


def lowest_pairs(passages: DataFrame, work: str, item: str, group: str, most: int, seed: str) -> DataFrame:
    """``pair_sample`` of all pairs.  Works are dealt to parts of about PASSAGES_AT_ONCE
    passages, parts meet in tasks, and a task gives back a cell's ``most`` pairs only, so
    no row is a pair that isn't among the lowest of its cell."""
    rows = passages.select(F.col(group).alias("g"), F.col(work).alias("w"), F.col(item).alias("i")).where("g is not null and w is not null")
    sizes = rows.groupBy("g", "w").agg(F.ceil(F.count("*") / PASSAGES_AT_ONCE).alias("parts"))
    dealt = rows.join(sizes, ["g", "w"]).withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")))
    blocks = dealt.groupBy("g", "w", "part").agg(F.collect_list(F.struct("i")).alias("items"))
    side = lambda s: [F.col("w").alias(f"work_{s}"), F.col("part").alias(f"part_{s}")]
    held = lambda s: blocks.select("g", *side(s), F.col("items").alias(f"items_{s}"))
    cells = blocks.select("g", *side("a")).join(blocks.select("g", *side("b")), "g").where("work_a < work_b")
    met = cells.join(held("a"), ["g", "work_a", "part_a"]).join(held("b"), ["g", "work_b", "part_b"])
    # as many tasks whatever the bytes, since the work is in the hashes
    met = met.repartition(8 * passages.sparkSession.sparkContext.defaultParallelism, "g", "work_a", "part_a", "work_b", "part_b").select("g", "work_a", "work_b", "items_a", "items_b")
    types = dict(rows.dtypes)
    fields = pa.schema([(f.name, f.type) for f in to_arrow_schema(rows.select("g", F.col("w").alias("work_a"), F.col("w").alias("work_b"), F.col("i").alias("a"), F.col("i").alias("b")).schema)] + [("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = batch.slice(k, 1).to_pylist()[0]
                best = lowest(seed, *([e["i"] for e in cell[s]] for s in ("items_a", "items_b")), most)
                yield pa.RecordBatch.from_pylist([{"g": cell["g"], "work_a": cell["work_a"], "work_b": cell["work_b"], "a": a, "b": b, "digest": d} for d, a, b in best], fields)

    found = met.mapInArrow(run, f"g {types['g']}, work_a {types['w']}, work_b {types['w']}, a {types['i']}, b {types['i']}, digest binary")
    rank = F.row_number().over(Window.partitionBy("g", "work_a", "work_b").orderBy("digest", "a", "b"))
    return found.withColumn("place", rank).where(F.col("place") <= most).select(F.col("g").alias(group), "work_a", "a", "work_b", "b", "place")


def lowest(seed: str, left: list, right: list, most: int) -> list[tuple]:
    """The ``most`` (digest, a, b) of lowest ``hash_rank`` among all pairs; nothing else is
    kept, and only those at or below the last of them are looked at again."""
    told = lambda x: b"" if x is None else f":{x}".encode()  # noqa: E731  as concat_ws, which skips nulls
    others = [(told(b), b) for b in right]
    order = lambda e: (e[0], *((x is not None, x) for x in e[1:]))
    best: list[tuple] = []
    last = b"\xff" * 32
    for a in left:
        start = seed.encode() + told(a)
        new = [(d, a, b) for t, b in others if (d := sha256(start + t).digest()) <= last]
        if new:
            best = sorted(best + new, key=order)[:most]
            last = best[-1][0] if len(best) == most else last
    return best


def cycle_roles(rows: DataFrame, keys: list[str], item: str, seed: str) -> DataFrame:
    """Items in hash order with the next one as impostor, the last with the first."""
    order = Window.partitionBy(*keys).orderBy(hash_rank(seed, item), item)
    items = rows.select(*keys, item).distinct()
    return items.withColumn("impostor", F.coalesce(F.lead(item).over(order), F.first(item).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).withColumn("place", F.row_number().over(order))


def front(rows: DataFrame, keys: list[str], item: str, cost: str, score: str) -> DataFrame:
    """Items that no other one beats in cost and score (at least equal in both,
    better in one): by cost, those whose score is above all cheaper ones."""
    same = Window.partitionBy(*keys, cost)
    ranked = rows.withColumn("top", F.max(score).over(same)).withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(cost)))
    before = F.max(score).over(Window.partitionBy(*keys).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("before", before).where((F.col(score) == F.col("top")) & (F.col("before").isNull() | (F.col(score) > F.col("before")))).drop("top", "rank", "before")


def gate(measured: DataFrame, target: float, low: str = "low", high: str = "high", at_least: bool = True) -> DataFrame:
    """Whether a whole interval clears the target; an unmeasured one fails."""
    clear = F.col(low) >= target if at_least else F.col(high) <= target
    return measured.withColumn("passed", F.coalesce(clear, F.lit(False)))


def split_share(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """eta squared: the share of each dimension's variance that lies between groups."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(d).alias(f"m_{d}") for d in dims], *[F.var_pop(d).alias(f"v_{d}") for d in dims])
    parts = []
    for d in dims:
        mean = F.sum(F.col("n") * F.col(f"m_{d}")) / F.sum("n")
        second = F.sum(F.col("n") * F.col(f"m_{d}") * F.col(f"m_{d}")) / F.sum("n")
        within = F.sum(F.col("n") * F.col(f"v_{d}")) / F.sum("n")
        between = second - mean * mean
        parts.append(by.agg(F.lit(d).alias("dimension"), F.when(between + within > 0, between / (between + within)).otherwise(0.0).alias("eta_squared")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
