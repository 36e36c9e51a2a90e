"""Text units: the ordered records (verses, lines, paragraphs) that all else reads.

A unit has id, seq (its place in source order), language, collection, book,
book_title, chapter, verse, text, source, has_gap and optionally witness and
reference_author.  Readers return DataFrames with that schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from inkspan.functions.tokens import count_words, folded_words

REQUIRED = ("id", "language", "collection", "book", "book_title", "chapter", "verse", "source")
#: The languages of the manuscript corpus.
LANGUAGES = ("eng", "grc", "hbo", "arb")
LINES_A_BOOK = 1 << 20

UNIT_SCHEMA = StructType(
    [StructField(x, StringType()) for x in ("id", "language", "collection", "book", "book_title", "chapter", "verse", "text", "source")]
    + [StructField("has_gap", BooleanType()), StructField("reference_author", StringType()), StructField("witness", StringType()), StructField("seq", LongType())]
)


def document_units(docs: DataFrame) -> DataFrame:
    """Lines of documents as units: ten lines a chapter; a line of digits is a gap."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    line = F.col("at") + 1
    book = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    return lines.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), line.cast("string")).alias("id"), (F.col("doc_id") * LINES_A_BOOK + line).alias("seq"),
        F.col("lang").alias("language"), F.col("source").alias("collection"), book.alias("book"), book.alias("book_title"),
        F.floor(F.col("at") / 10 + 1).cast("string").alias("chapter"), line.cast("string").alias("verse"), "text",
        F.lit("documents").alias("source"), F.col("text").rlike("^[0-9]+$").alias("has_gap"), "doc_id",
    )


def conversation_units(conversations: DataFrame) -> DataFrame:
    """Turns as units: the role is the collection, the conversation the book; a
    missing turn is a gap before the next one."""
    step = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    book = F.concat(F.lit("C"), F.col("conv_id").cast("string"))
    return conversations.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") * LINES_A_BOOK + F.col("turn")).alias("seq"),
        F.lit("en").alias("language"), F.col("role").alias("collection"), book.alias("book"), book.alias("book_title"), F.lit("1").alias("chapter"),
        F.col("turn").cast("string").alias("verse"), F.coalesce("text", F.lit("")).alias("text"), F.lit("conversations").alias("source"),
        (F.coalesce(step, F.lit(1)) != 1).alias("has_gap"), "conv_id", "turn",
    )


def with_tokens(units: DataFrame, any_script: bool = False) -> DataFrame:
    return units.withColumn("n_tokens", count_words(folded_words(F.col("text"), any_script)))


def tagged_units(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Units with a style from a known label, in place of a fitted one: quality and
    toxicity make up to four styles a language; unlabelled documents have none."""
    units = with_tokens(document_units(docs)).withColumnRenamed("n_tokens", "token_count")
    style = F.concat(F.col("language"), F.lit("-S00"), (1 + F.col("quality") + 2 * F.col("toxic")).cast("string"))
    status = F.when(style.isNull(), "insufficient_text").when(F.col("token_count") < 10, "low_evidence").otherwise("assigned")
    author = F.when(F.col("language") == "en", F.concat(F.lit("A"), (F.col("doc_id") % 5).cast("string")))
    tagged = units.join(labels, "doc_id", "left")
    return tagged.select(*[c for c in units.columns], style.alias("style_id"), status.alias("status"), author.alias("reference_author"))


def violations(units: DataFrame, languages: tuple[str, ...] = LANGUAGES, author_language: str = "eng") -> DataFrame:
    """Each broken rule of the unit schema: (rule, id, n)."""
    present = set(units.columns)
    rules: list[tuple[str, Column]] = [(f"{c} must be a nonempty string", (F.col(c).isNull() | (F.trim(F.col(c)) == "")) if c in present else F.lit(True)) for c in REQUIRED]
    rules.append(("text must be a string", F.col("text").isNull()))
    rules.append(("unsupported language", F.col("language").isNotNull() & ~F.col("language").isin(*languages)))
    rules.append(("has_gap must be boolean", F.col("has_gap").isNull()))
    if "reference_author" in present:
        rules.append(("reference_author must be text or null", F.trim("reference_author") == ""))
        rules.append(("reference authors are for one language", F.col("reference_author").isNotNull() & (F.col("language") != author_language)))
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    rows = units.select("id", F.explode(broken).alias("rule")).groupBy("rule", "id").agg(F.count("*").alias("n"))
    twice = units.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("rule"), "id", "n")
    return rows.unionByName(twice)


def load_corpus(spark: SparkSession, path: str, languages: tuple[str, ...] = LANGUAGES, author_language: str = "eng") -> DataFrame:
    """JSON lines to valid units in file order; raises on the first broken record."""
    fields = [f for f in UNIT_SCHEMA.fields if f.name != "seq"]
    raw = spark.read.schema(StructType(fields)).option("mode", "FAILFAST").json(path)
    units = raw.withColumn("seq", F.monotonically_increasing_id()).fillna({"source": "custom", "has_gap": False})
    bad = violations(units, languages, author_language).orderBy("rule", "id").first()
    if bad:
        raise ValueError(f"{path}: {bad['id']}: {bad['rule']}")
    if not units.head(1):
        raise ValueError("the corpus contains no units")
    return units


def write_corpus(units: DataFrame, path: str) -> None:
    units.orderBy("seq").drop("seq").write.mode("overwrite").json(path)
