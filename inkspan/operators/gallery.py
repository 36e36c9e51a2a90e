"""Decisions of a gallery of candidates with a threshold that bounds two errors.

The decision is the one best candidate if its score passes the threshold; several best
ones abstain.  Known passages give correct and wrong decisions, unknown authors' false
ones; authors weigh alike, then their works, then a work's passages.  A threshold is one
of the distinct best scores, so its rates are cumulative sums over these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: str, values: list[str], ranges: int = 64) -> DataFrame:
    """rows with ``at_least_<value>``: the sum of the value over rows with the same order
    or a greater one.

    Sums over ranges come first, so no task has all rows; the cuts between ranges are
    approximate quantiles, whose errors move rows between tasks and nothing else."""
    cuts = rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = rows.withColumn("_range", part)
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    totals = cut.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]).select("_range", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"_above_{v}") for v in values])
    inside = Window.partitionBy("_range").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.join(F.broadcast(totals), "_range")
    return met.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"_above_{v}")).alias(f"at_least_{v}") for v in values])


def best_candidates(scores: DataFrame) -> DataFrame:
    """(query, candidate, score) to (query, candidate, score, several): the best one."""
    top = scores.groupBy("query").agg(F.max(F.struct("score", "candidate")).alias("t"), F.max("score").alias("score"))
    ties = scores.join(top.select("query", F.col("score").alias("best")), "query").where("score = best").groupBy("query").agg((F.count("*") > 1).alias("several"))
    return top.select("query", F.col("t.candidate").alias("candidate"), "score").join(ties, "query")


def weights(rows: DataFrame) -> DataFrame:
    """rows (author, work, ...) with ``weight``: one over authors, their works and a
    work's rows, so that all weigh 1 together."""
    works = rows.groupBy("author", "work").agg(F.count("*").alias("n"))
    authors = works.groupBy("author").agg(F.count("*").alias("works"))
    whole = authors.agg(F.count("*").alias("authors"))
    table = works.join(authors, "author").crossJoin(F.broadcast(whole))  # one row
    return rows.join(table.select("author", "work", (1 / (F.col("authors") * F.col("works") * F.col("n"))).alias("weight")), ["author", "work"])


def checked(known: DataFrame, unknown: DataFrame, candidates: list[str]) -> str | None:
    """Why the passages can't calibrate, or None; contradictions are a ValueError."""
    names = [r.author for r in known.select("author").distinct().limit(len(candidates) + 1).collect()]
    if set(names) - set(candidates):
        raise ValueError("known authors must be candidates")
    if unknown.where(F.col("author").isin(candidates)).limit(1).count():
        raise ValueError("unknown authors must not be candidates")
    if known.select("work").distinct().join(unknown.select("work").distinct(), "work").limit(1).count():
        raise ValueError("known and unknown works must be disjoint")
    if set(names) != set(candidates) or unknown.select("author").distinct().limit(2).count() < 2:
        return "insufficient_calibration"
    return None


def curve(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """(threshold, correct, wrong, false_accepted): rates if scores of the threshold or more are
    accepted, for each distinct best score.

    known and unknown: (author, work, candidate, score, several)."""
    k = weights(known).select("score", F.when(~F.col("several") & (F.col("candidate") == F.col("author")), F.col("weight")).otherwise(0.0).alias("correct"), F.when(~F.col("several") & (F.col("candidate") != F.col("author")), F.col("weight")).otherwise(0.0).alias("wrong"), F.lit(0.0).alias("false_accepted"))
    u = weights(unknown).select("score", F.lit(0.0).alias("correct"), F.lit(0.0).alias("wrong"), F.when(~F.col("several"), F.col("weight")).otherwise(0.0).alias("false_accepted"))
    names = ["correct", "wrong", "false_accepted"]
    by_score = k.unionByName(u).groupBy("score").agg(*[F.sum(c).alias(c) for c in names])
    return running(by_score, "score", names).select(F.col("score").alias("threshold"), *[F.round(f"at_least_{c}", 12).alias(c) for c in names])


def calibrate(known: DataFrame, unknown: DataFrame, candidates: list[str], most_false: float = 0.05, most_wrong: float = 0.05, least_correct: float = 0.8) -> DataFrame:
    """One row (status, threshold, correct, wrong, false_accepted): of the thresholds that keep
    both limits the one with most correct decisions (then the lowest).

    Status: feasible; no_feasible_threshold, whose threshold, if any, is a diagnosis and
    must not be applied; insufficient_calibration."""
    spark = known.sparkSession
    reason = checked(known, unknown, candidates)
    if reason:
        return spark.createDataFrame([(reason, None, None, None, None)], "status string, threshold double, correct double, wrong double, false_accepted double")
    allowed = curve(known, unknown).where((F.col("false_accepted") <= most_false) & (F.col("wrong") <= most_wrong))
    best = allowed.agg(F.max(F.struct("correct", (-F.col("threshold")).alias("low"), "wrong", "false_accepted")).alias("b"))
    status = F.when(F.col("b.correct") >= least_correct, "feasible").otherwise("no_feasible_threshold")
    return best.select(F.coalesce(status, F.lit("no_feasible_threshold")).alias("status"), (-F.col("b.low")).alias("threshold"), "b.correct", "b.wrong", "b.false_accepted")


def apply_threshold(scores: DataFrame, status: str, threshold: float | None) -> DataFrame:
    """(query, decision, score) of (query, candidate, score): null where it abstains,
    which it always does unless the calibration was feasible."""
    best = best_candidates(scores)
    accept: Column = ~F.col("several") & (F.col("score") >= threshold) if status == "feasible" and threshold is not None else F.lit(False)
    return best.select("query", F.when(accept, F.col("candidate")).alias("decision"), "score")
