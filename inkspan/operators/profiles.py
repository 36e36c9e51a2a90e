"""Agreement, ensembles and pooling of tagged profiles (numeric scales, classes,
tags), evaluation groups, and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(a: DataFrame, b: DataFrame, key: str, scales: list[str], classes: list[str], tags: str | None = None) -> DataFrame:
    """One row: for each scale the correlation and mean absolute difference, for
    each class the share of equal values, and the mean Jaccard share of the tags."""
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key]), key)
    out: list[Column] = [F.count("*").alias("n")]
    for s in scales:
        out += [F.corr(f"a_{s}", f"b_{s}").alias(f"r_{s}"), F.avg(F.abs(F.col(f"a_{s}") - F.col(f"b_{s}"))).alias(f"mad_{s}")]
    out += [F.avg(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("double")).alias(f"same_{c}") for c in classes]
    if tags:
        x, y = F.col(f"a_{tags}"), F.col(f"b_{tags}")
        union = F.size(F.array_union(x, y))
        out.append(F.avg(F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(1.0)).alias("tag_jaccard"))
    return both.agg(*out)


def ensemble(members: DataFrame, key: str, member: str, scales: list[str], classes: list[str]) -> DataFrame:
    """Mean scales and majority classes (ties: the value of the first member)."""
    base = members.groupBy(key).agg(*[F.avg(s).alias(s) for s in scales], F.count("*").alias("members"))
    for c in classes:
        votes = members.groupBy(key, c).agg(F.count("*").alias("n"), F.min(member).alias("first"))
        won = votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", F.col(c).alias("v"))).alias("w")).select(key, F.col("w.v").alias(c))
        base = base.join(won, key)
    return base


def consensus_without_self(members: DataFrame, key: str, member: str, scale: str) -> DataFrame:
    """Each member's mean distance to the mean of the others."""
    by = Window.partitionBy(key)
    n, total = F.count("*").over(by), F.sum(scale).over(by)
    others = F.when(n > 1, (total - F.col(scale)) / (n - 1))
    return members.withColumn("gap", F.abs(F.col(scale) - others)).groupBy(member).agg(F.count("gap").alias("n"), F.avg("gap").alias("mean_gap"))


def pooled(profiles: DataFrame, membership: DataFrame, scales: list[str], classes: list[str], tags: str | None = None, coverage: float = 0.8, most_tags: int = 8) -> DataFrame:
    """Unit profiles pooled to passages: means, modes (ties: the smallest; nulls
    have no vote) and the most
    frequent tags, if asked for, for passages of which enough tokens have a profile.
    Means and modes come from one shuffle.

    membership: (passage_id, id, n_tokens); profiles: (id, ...)."""
    rows = membership.join(profiles, "id", "left").withColumn("has", F.col(scales[0]).isNotNull())
    modes = [F.mode(F.when(F.col("has"), F.col(c)), True).alias(c) for c in classes]
    base = rows.groupBy("passage_id").agg(*[F.avg(s).alias(s) for s in scales], (F.sum(F.when(F.col("has"), F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens")).alias("coverage"), *modes)
    base = base.where(F.col("coverage") >= coverage)
    if tags is None:
        return base
    each = rows.select("passage_id", F.explode(tags).alias("tag")).groupBy("passage_id", "tag").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("passage_id").orderBy(F.desc("n"), "tag"))
    top = each.withColumn("place", place).where(F.col("place") <= most_tags).groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias(tags))
    return base.join(top, "passage_id", "left")


def coerced(records: DataFrame, scales: list[str], classes: dict[str, tuple[str, ...]], tags: str, phrases: str, signature: str) -> DataFrame:
    """Only the records that keep every rule: scales in [0, 1], classes of the
    listed values, 1 to 8 tags, 4 phrases at most, a signature."""
    ok = F.lit(True)
    for s in scales:
        ok = ok & F.col(s).between(0, 1)
    for c, values in classes.items():
        ok = ok & F.col(c).isin(*values)
    ok = ok & F.size(tags).between(1, 8) & (F.size(phrases) <= 4) & (F.trim(signature) != "")
    return records.where(F.coalesce(ok, F.lit(False)))


def groups_by_shared(items: DataFrame, key: str, shared: list[str], rounds: int = 50) -> DataFrame:
    """(key, group): items that share a value of any listed column, directly or
    through others, are one group, named by its smallest key.

    The smallest key known to a value and the smallest known to an item are passed
    to and fro; each round also jumps to the group of the group."""
    from inkspan.operators.graph import smallest_reachable

    links = None
    for c in shared:
        hubs = items.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias("hub"))
        pairs = items.join(hubs, c).select(F.col(key).alias("src"), F.col("hub").alias("dst"))
        links = pairs if links is None else links.unionByName(pairs)
    found = smallest_reachable(links, rounds)
    return items.select(key).distinct().join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("group"))


def estimated_cost(units: DataFrame, price_in: float, price_out: float, overhead: int = 400, answer: int = 250, chars_a_token: float = 4.0) -> DataFrame:
    """What tagging the units through a priced interface would cost."""
    tokens_in = F.sum(overhead + F.ceil(F.length("text") / chars_a_token))
    return units.agg(F.count("*").alias("requests"), tokens_in.alias("tokens_in"), (F.count("*") * answer).alias("tokens_out")).withColumn("cost", F.col("tokens_in") * price_in / 1e6 + F.col("tokens_out") * price_out / 1e6)


def manifest_difference(current: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that were added, removed or changed between two manifests."""
    both = current.select(key, F.col(value).alias("now")).join(stored.select(key, F.col(value).alias("before")), key, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return both.withColumn("kind", kind).where("kind is not null")
