"""Expected writers against found styles, by words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The suras that count as revealed after the hijra.
MEDINAN = (2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110)
#: Collections of one hand, and of hands that can't be known.
ONE_HAND = {"Bukhari": "al-Bukhari's compilation", "Hadith Qudsi": "The Prophet's wording"}
UNKNOWN_HANDS = {"DSS": "Unknown scribe", "inscriptions": "Unknown hand"}


def _lookup(column: str, values: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def sura(book: str = "book") -> Column:
    return F.expr(f"try_cast(regexp_replace({book}, '[^0-9]', '') as int)")


def revelation_place(book: str = "book") -> Column:
    return F.when(sura(book).isin(*MEDINAN), "Medinan").when(sura(book).isNotNull(), "Meccan")


def with_writer(units: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """units with ``writer`` and ``known``.

    groups: (book, group) received attributions; a group that only repeats the
    book, or none, leaves the work disputed."""
    joined = units.join(groups.select("book", F.col("group").alias("received")), "book", "left") if groups is not None else units.withColumn("received", F.lit(None).cast("string"))
    title = F.coalesce("book_title", "book")
    named = lambda what: F.concat(what, F.lit(" ("), title, F.lit(")"))
    author = F.when(F.trim("reference_author") != "", F.col("reference_author"))
    unknown, hand = _lookup("collection", UNKNOWN_HANDS), _lookup("collection", ONE_HAND)
    quran = F.coalesce(F.concat(revelation_place(), F.lit(" revelation")), F.lit("Quran"))
    received = F.when(F.col("received") != F.col("book"), F.col("received"))
    apocryphal = F.col("collection") == "noncanonical"
    writer = F.coalesce(author, F.when(unknown.isNotNull(), named(unknown)), hand, F.when(F.col("collection") == "Quran", quran), received, named(F.when(apocryphal, F.lit("Anonymous")).otherwise(F.lit("Disputed"))))
    known = author.isNotNull() | (unknown.isNull() & (hand.isNotNull() | (F.col("collection") == "Quran") | received.isNotNull()))
    return joined.withColumn("writer", writer).withColumn("known", known).drop("received")


def ranked_shares(counts: DataFrame, keys: list[str], name: str, amount: str, most: int) -> DataFrame:
    """Ranked shares of each key; all names after the first ``most`` are one row."""
    order = Window.partitionBy(*keys).orderBy(F.desc(amount), name)
    ranked = counts.withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= most)
    label = F.when(F.col("kept"), F.col(name))
    folded = ranked.withColumn("label", label).groupBy(*keys, "kept", "label").agg(F.sum(amount).alias("words"), F.count("*").alias("n"), F.min("place").alias("place"))
    total = F.sum("words").over(Window.partitionBy(*keys))
    text = F.when(F.col("kept"), F.col("label")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" further")))
    return folded.select(*keys, F.least("place", F.lit(most + 1)).alias("place"), text.alias("name"), "words", F.when(total > 0, F.col("words") / total).otherwise(0.0).alias("share"), (~F.col("kept")).alias("remainder"))


def cells(units: DataFrame) -> DataFrame:
    """Words and books by (language, collection, writer, style)."""
    rows = units.where("style_id is not null")
    amount = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(0)
    return rows.groupBy("language", "collection", "writer", "style_id").agg(F.sum(amount).cast("long").alias("words"), F.max_by("known", "seq").alias("known"), F.max("seq").alias("last"))


def style_verdicts(table: DataFrame, share: float = 0.8, most: int = 12) -> DataFrame:
    """Each style over its whole language: one writer, dominated or merged, with
    its top writer (collection · writer)."""
    named = table.withColumn("name", F.concat("collection", F.lit(" · "), "writer")).groupBy("language", "style_id", "name").agg(F.sum("words").alias("words"))
    spread = ranked_shares(named, ["language", "style_id"], "name", "words", most)
    rows = spread.groupBy("language", "style_id").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min_by("name", "place").alias("top_writer"), F.min_by("share", "place").alias("top_share"))
    verdict = F.when(F.col("n") == 1, "one writer").when(F.col("top_share") >= share, "dominated").otherwise("merged")
    return rows.select("language", "style_id", "words", "top_writer", "top_share", verdict.alias("verdict"))


def writer_verdicts(table: DataFrame, share: float = 0.8, most: int = 12) -> DataFrame:
    """Each expected writer in a collection: recovered, split, merged or unscored."""
    keys = ["language", "collection", "writer"]
    total = F.sum("words").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("words"), "style_id"))
    known = F.max_by("known", "last").over(Window.partitionBy(*keys))
    mine = table.withColumn("total", total).withColumn("place", place).withColumn("known", known).where("place = 1").withColumn("share", F.when(F.col("total") > 0, F.col("words") / F.col("total")).otherwise(0.0))
    styles = style_verdicts(table, share, most).select("language", "style_id", "top_writer", "top_share")
    both = mine.join(styles, ["language", "style_id"])
    own = F.col("top_writer") == F.concat("collection", F.lit(" · "), "writer")
    verdict = F.when(~F.col("known"), "unscored").when(F.col("share") < share, "split").when(own & (F.col("top_share") >= share), "recovered").otherwise("merged")
    return both.select(*keys, "known", F.col("total").alias("words"), F.col("style_id").alias("top_style"), F.col("share").alias("top_style_share"), verdict.alias("verdict"))


def collection_agreement(table: DataFrame) -> DataFrame:
    """Best case: each style is credited to the writer it mostly covers there."""
    top = table.groupBy("language", "collection", "style_id").agg(F.max("words").alias("best"), F.sum("words").alias("words"))
    rows = top.groupBy("language", "collection").agg(F.sum("best").alias("agreed"), F.sum("words").alias("words"), F.count("*").alias("style_count"))
    return rows.select("language", "collection", "words", "style_count", F.when(F.col("words") > 0, F.col("agreed") / F.col("words")).otherwise(0.0).alias("agreement"))


def two_sided_agreement(units: DataFrame, side: Column) -> DataFrame:
    """How far styles follow a division of the text in two, against always
    guessing the larger side."""
    amount = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(0)
    table = units.withColumn("side", side).where("side is not null and style_id is not null").groupBy("language", "style_id", "side").agg(F.sum(amount).cast("long").alias("words"))
    best = table.groupBy("language", "style_id").agg(F.max("words").alias("best"))
    agreed = best.groupBy("language").agg(F.sum("best").alias("agreed"), F.count("*").alias("styles"))
    sides = table.groupBy("language", "side").agg(F.sum("words").alias("words")).groupBy("language").agg(F.sum("words").alias("total"), F.max("words").alias("largest"), F.count("*").alias("sides")).where("sides >= 2 and total > 0")
    return agreed.join(sides, "language").select("language", "styles", "total", (F.col("agreed") / F.col("total")).alias("agreement"), (F.col("largest") / F.col("total")).alias("baseline"))
