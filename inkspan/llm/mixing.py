"""Mixing sources to target weights by Pareto order sampling.

Targets.  The sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3 and
so on, and share the total size by weight; a target stops at ``most_copies``
times its source's size, and what is above that is shared again by weight among
the others until none is above.  In closed form: by ascending size / weight the
stopped sources come first, and a source is stopped if its limit lies below its
share of what the stopped ones before it leave.

Copies.  A document's expected copies grow with its ``weight`` (1 if not given):
level * weight, but ``most_copies`` at most, where the source's level is such that the
expected words of all its documents add up to its target; what the limit takes from
heavy documents is thus shared again among the lighter ones.  The whole part is
certain.  For the rest, every document has an inclusion probability p (the fraction)
and a fixed uniform number u, an md5 of its key, text and place among equal rows, and
is ranked by the ratio of random odds to inclusion odds, (u / (1 - u)) / (p / (1 - p)).
The first in that order are taken while their sizes fill what the certain copies leave
of the target: a fixed-size sample with unequal probabilities.

Rows.  A row is told from another by key, text and source; rows equal in all three are
counted first (so that a row that is repeated very often is one row until then) and
drawn one by one.

Scale.  The level comes from the sums by source and weight, so weights must have few
different values.  The cut in the order is found without sorting a source in one task:
the sizes are summed by 4096 ranges of the rank, the range that holds the cut is split
into 4096 again, and only the documents inside one range of that are put in order.  A
source with a third of all rows is thus pre-aggregated everywhere, and one window holds
a sixteen-millionth of it.

Defined results: null and empty texts have size 0, a certain number of copies and no
extra one, and take 0 words; long texts count whole; null, repeated or equal keys are
no obstacle to reaching the target, as the text goes into u; equal ranks are ordered by
text; a null source is a source; a null weight is 1; other columns are left out,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_of, word_array

MOST_COPIES = 3
WEIGHTS = 3
RANGES = 4096
#: Parts into which a source's rows are dealt where they meet its row.
PARTS = 16


def targets(sizes: DataFrame, most_copies: int = MOST_COPIES, weights: int = WEIGHTS) -> DataFrame:
    """(source, source_size) to those with weight and target.

    One row a source: the windows below run over sources, not over rows."""
    named = sizes.withColumn("weight", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    limit = most_copies * F.col("source_size")
    order = Window.partitionBy(F.lit(0)).orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - most_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left.cast("double") / F.sum("weight").over(after)  # of weight 1, if all before are stopped
    marked = named.withColumn("share", share).withColumn("stopped", limit <= F.col("weight") * F.col("share"))
    # the first that isn't stopped sets the share of all that follow; theirs are smaller
    level = F.max(F.when(~F.col("stopped"), F.col("share"))).over(whole)
    target = F.when(F.col("stopped") | level.isNull(), limit.cast("double")).otherwise(F.col("weight") * level)
    return marked.select("source", "source_size", "weight", target.alias("target"))


def uniform(parts: list[Column], seed: str) -> Column:
    """A fixed number in (0, 1) for some values: 52 bits of an md5."""
    texts = [F.coalesce(x.cast("string"), F.lit("")) for x in parts]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *texts)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def levels(classes: DataFrame, most_copies: int) -> DataFrame:
    """(source, target, w, words: those of its documents of weight w) to the level of
    each source; null where the limit stops every weight."""
    order = Window.partitionBy("source").orderBy(F.desc("w"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("target") - most_copies * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("w") * F.col("words")).over(after)
    open_ = classes.withColumn("level", level).withColumn("stopped", F.col("level") * F.col("w") >= most_copies)
    # the heaviest weight that isn't stopped sets the level of all that follow; theirs are lower
    return open_.groupBy("source").agg(F.max(F.when(~F.col("stopped"), F.col("level"))).alias("level"))


def _cut_range(rows: DataFrame, by: list[str], ranges: Column) -> DataFrame:
    """For each of ``by``: the range in which the running size passes ``room``,
    and the room left at its start."""
    sums = rows.groupBy(*by, ranges.alias("range")).agg(F.sum("size").alias("in_range"), F.first("room").alias("room"))
    running = F.sum("in_range").over(Window.partitionBy(*by).orderBy("range"))
    passed = sums.withColumn("until", running).where(F.col("until") > F.col("room"))
    return passed.groupBy(*by).agg(F.min(F.struct("range", (F.col("room") - F.col("until") + F.col("in_range")).alias("room"))).alias("at")).select(*by, F.col("at.range").alias("range"), F.col("at.room").alias("room_there"))


def _with_source(rows: DataFrame, by_source: DataFrame, name: str) -> DataFrame:
    """rows joined to the one row of their source, whose column ``name`` holds it.
    The source's row is repeated for PARTS parts, so that a source with a third of
    all rows isn't one task's work."""
    parts = by_source.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("u"), F.lit(PARTS)).cast("int")
    dealt = rows.withColumn("of_part", part)
    return dealt.join(parts, F.col("source").eqNullSafe(F.col(name)) & (F.col("of_part") == F.col("part"))).drop(name, "of_part", "part")


def size_digits(size: Column) -> Column:
    """A weight for documents: the binary digits of their size, so that long ones are
    likelier and yet the weights have few values."""
    return F.length(F.bin(size)).cast("double")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weight: Column | Callable[[Column], Column] | None = None, seed: str = "mix-1", most_copies: int = MOST_COPIES, weights: int = WEIGHTS, ranges: int = RANGES) -> DataFrame:
    """Each row's key, source, digest, size, source_size, target, copies and taken.
    ``weight`` is a Column of docs, or a function that gets the size's Column."""
    own = F.lit(1.0) if weight is None or callable(weight) else F.coalesce(weight.cast("double"), F.lit(1.0))
    base = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), digest_of(F.col(text)).alias("digest"), F.size(word_array(F.col(text))).cast("long").alias("size"), own.alias("w"))
    counted = base.groupBy("key", "source", "digest", "size", "w").agg(F.count("*").alias("rows"))
    if callable(weight):
        counted = counted.withColumn("w", F.coalesce(weight(F.col("size")).cast("double"), F.lit(1.0)))
    counted = cut(counted)
    sized = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows").withColumn("u", uniform([F.col("key"), F.col("digest"), F.col("k")], seed))
    by_weight = cut(counted.groupBy("source", "w").agg(F.sum(F.col("size") * F.col("rows")).alias("words")))
    aimed = targets(by_weight.groupBy("source").agg(F.sum("words").alias("source_size")), most_copies, weights).drop("weight").withColumnRenamed("source", "s")
    classes = by_weight.where("w > 0 and words > 0").join(aimed, F.col("source").eqNullSafe(F.col("s"))).select("source", "target", "w", "words")
    level = levels(classes, most_copies).withColumnRenamed("source", "l")
    of_source = cut(aimed.join(level, F.col("s").eqNullSafe(F.col("l")), "left").drop("l"))
    rows = _with_source(sized, of_source, "s")
    full = F.lit(float(most_copies))
    expected = F.when((F.col("source_size") == 0) | (F.col("w") <= 0), F.lit(0.0)).when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("w")))
    certain = F.floor(expected)
    p = F.col("expected") - F.col("certain")
    odds = F.when((p > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    ranked = rows.withColumn("expected", expected).withColumn("certain", certain).withColumn("q", odds).withColumn("tie", F.concat_ws(":", "digest", F.col("k").cast("string"), F.col("key").cast("string")))
    # in (0, 1) and in the order of q: the range's number comes from it
    ranked = cut(ranked.withColumn("place", F.col("q") / (1 + F.col("q"))).select("key", "source", "digest", "size", "source_size", "target", "certain", "u", "q", "place", "tie"))
    room = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("room")).withColumnRenamed("source", "s")
    drawn = _with_source(ranked.where("q is not null").select("source", "size", "u", "q", "place", "tie"), room, "s")

    first = F.floor(F.col("place") * ranges).cast("long")
    second = F.floor((F.col("place") * ranges - F.floor(F.col("place") * ranges)) * ranges).cast("long")
    cut1 = cut(_cut_range(drawn, ["source"], first)).select(F.col("source").alias("s1"), F.col("range").alias("r1"), F.col("room_there").alias("room1"))
    in1 = drawn.join(cut1, F.col("source").eqNullSafe(F.col("s1")) & (first == F.col("r1"))).withColumn("room", F.col("room1"))
    cut2 = cut(_cut_range(in1, ["source"], second)).select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.col("room_there").alias("room2"))
    in2 = in1.join(cut2, F.col("source").eqNullSafe(F.col("s2")) & (second == F.col("r2")))
    # the document that reaches over the target is taken if half of it fits
    until = F.sum("size").over(Window.partitionBy("source").orderBy("q", "tie"))
    last = in2.withColumn("until", until).where(F.col("until") - F.col("size") / 2 <= F.col("room2"))
    cut3 = last.groupBy("source").agg(F.max(F.struct("q", "tie")).alias("last")).select(F.col("source").alias("s3"), F.col("last.q").alias("last_q"), F.col("last.tie").alias("last_tie"))

    edges = room.join(cut1, F.col("s").eqNullSafe(F.col("s1")), "left").join(cut2, F.col("s").eqNullSafe(F.col("s2")), "left").join(cut3, F.col("s").eqNullSafe(F.col("s3")), "left").select("s", "room", "r1", "r2", "last_q", "last_tie")
    out = _with_source(ranked, cut(edges), "s")
    below = (
        F.when(F.col("q").isNull(), F.lit(False))
        .when(F.col("r1").isNull(), F.col("room") > 0)  # all of them fit
        .when(first != F.col("r1"), first < F.col("r1"))
        .when(second != F.col("r2"), second < F.col("r2"))
        .when(F.col("q") != F.col("last_q"), F.col("q") < F.col("last_q"))
        .otherwise(F.coalesce(F.col("tie") <= F.col("last_tie"), F.lit(False)))
    )
    copies = F.col("certain").cast("long") + F.coalesce(below, F.lit(False)).cast("long")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "digest", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _identity(key: Column, source: Column, digest: Column) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-")) for x in (key, source)]
    return F.md5(F.concat_ws(":", digest, *parts))


def taken_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **more) -> DataFrame:
    """The rows of docs as often as the mix takes them.  Of equal rows each gets the
    like number of copies, the first ones in the order of their other columns one more."""
    mixed = mix(docs, text, key, source, **more).groupBy(_identity(F.col(key), F.col(source), F.col("digest")).alias("of_row")).agg(F.sum("copies").alias("all_copies"), F.count("*").alias("equal_rows"))
    met = docs.withColumn("of_row", _identity(F.col(key), F.col(source), digest_of(F.col(text)))).join(mixed.where("all_copies > 0"), "of_row")
    others = [c for c in docs.columns if c not in (text, key, source)]
    place = F.row_number().over(Window.partitionBy("of_row").orderBy(*(others or ["of_row"]))) - 1
    share = F.floor(F.col("all_copies") / F.col("equal_rows")) + (place < F.col("all_copies") % F.col("equal_rows")).cast("long")
    counted = met.withColumn("share", F.when(F.col("equal_rows") == 1, F.col("all_copies")).otherwise(share)).where("share > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "share"))).select(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source"), weight=size_digits).select("doc_id", "size", "source_size", "target", "taken")
