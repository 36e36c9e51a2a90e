"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges a task of a round at least; fewer, larger tasks leave fewer small files.
TASK_EDGES = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node hands its larger neighbours its smallest one."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, its smallest one."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (src long, dst long) to (src, dst): every node but the smallest of
    its component, with that smallest node.  Directions don't matter, loops go.

    Stars whose hub has very many leaves are joined, not gathered, so that
    Spark can split a hot hub; a round's edges are checkpointed.  The number of tasks
    follows the number of edges."""
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    tasks = 1 + now.count() // TASK_EDGES
    now = now.coalesce(tasks)
    seen = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now, tasks), tasks))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return now
        seen = mark
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
