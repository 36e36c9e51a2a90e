"""Readers of corpora kept as a graph of numbered nodes with a file for each feature.

A feature file has a head (``@node`` or ``@edge``, then ``@key=value`` lines), an empty
line, and data lines of tab-separated fields.  A line may leave out its node: it is then
the one after the line before.  A node may also be a list of numbers and ranges (1,3-5),
to all of which the line applies.  Slots are the smallest nodes, numbered from 1 in the
order of the text; the edges ``oslots`` say which slots each other node covers.

A file is read line by line in one task, files side by side; what follows are joins on
node and slot numbers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = "feature string, kind string, node long, other long, value string"
_SCHEMA = pa.schema([("feature", pa.string()), ("kind", pa.string()), ("node", pa.int64()), ("other", pa.int64()), ("value", pa.string())])
BATCH = 50_000


def numbers(spec: str) -> Iterator[int]:
    """The nodes of '1,3-5'."""
    for part in spec.split(","):
        first, dash, last = part.partition("-")
        yield from range(int(first), int(last if dash else first) + 1)


def plain(value: str) -> str:
    """A value with \\t, \\n and \\\\ as what they stand for."""
    if "\\" not in value:
        return value
    return value.replace("\\\\", "\x00").replace("\\t", "\t").replace("\\n", "\n").replace("\x00", "\\")


def parsed(lines: Iterator[str]) -> Iterator[tuple[str, int, int | None, str | None]]:
    """(kind, node, other, value) of a feature file's lines; other is an edge's end."""
    kind = next(lines, "").strip().lstrip("@")
    if kind not in ("node", "edge"):
        return
    valued = False
    for line in lines:
        if not line.startswith("@"):
            break
        valued |= line.strip() == "@edgeValues"
    last = 0
    for line in lines:
        fields = line.rstrip("\n").split("\t")
        value = None
        if kind == "node" or (valued and len(fields) > 1):
            value = plain(fields.pop())
        ends = fields.pop() if kind == "edge" else None
        nodes = list(numbers(fields[0])) if fields else [last + 1]
        last = max(nodes)
        for node in nodes:
            if ends is None:
                yield kind, node, None, value
            else:
                for end in numbers(ends):
                    yield kind, node, end, value


def features(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(feature, kind, node, other, value) of the named features' files."""
    files = spark.read.format("binaryFile").load([f"{folder}/{n}.tf" for n in names]).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1].removesuffix(".tf")
                held: list = []
                for row in parsed(iter(io.TextIOWrapper(io.BytesIO(content.as_py()), "utf-8", newline="\n"))):
                    held.append((name, *row))
                    if len(held) >= BATCH:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return files.mapInArrow(run, FIELDS)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def node_values(rows: DataFrame, *names: str) -> DataFrame:
    """(node, names...): each node's values of the named features."""
    wanted = rows.where(F.col("feature").isin(*names) & (F.col("kind") == "node"))
    return wanted.groupBy("node").agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])


def covered(rows: DataFrame) -> DataFrame:
    """(node, type, slot): the slots that every node covers, slots themselves included."""
    types = rows.where("feature = 'otype'").select("node", F.col("value").alias("type"))
    edges = rows.where("feature = 'oslots'").select("node", F.col("other").alias("slot"))
    own = types.join(edges.select("node").distinct(), "node", "left_anti").select("node", F.col("node").alias("slot"))
    return edges.unionByName(own).join(types, "node")


def inside(slots: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, at): nodes of type ``inner`` all of whose slots lie in a node of
    type ``outer``, by number of the first slot."""
    sizes = slots.where(F.col("type") == inner).groupBy(F.col("node").alias("inner")).agg(F.count("*").alias("size"), F.min("slot").alias("at"))
    own = slots.where(F.col("type") == inner).select(F.col("node").alias("inner"), "slot")
    others = slots.where(F.col("type") == outer).select(F.col("node").alias("outer"), "slot")
    met = own.join(others, "slot").groupBy("outer", "inner").agg(F.count("*").alias("shared"))
    return met.join(sizes, "inner").where("shared = size").select("outer", "inner", "at")


def verses(rows: DataFrame, text: str, trailer: str) -> DataFrame:
    """(node, place, book, chapter, verse, text) of verse nodes: the values of their words in
    order, each with what trails it (blank trailers are one space).  A book or chapter
    that the verse doesn't name is that of the node that holds it."""
    slots = covered(rows)
    own = slots.where("type = 'verse'").groupBy("node").agg(F.min("slot").alias("place"))
    named = own.join(node_values(rows, "book", "chapter", "verse"), "node")
    for kind in ("book", "chapter"):
        above = inside(slots, kind, "verse").join(node_values(rows, kind).select(F.col("node").alias("outer"), F.col(kind).alias("above")), "outer").groupBy(F.col("inner").alias("node")).agg(F.min("above").alias("above"))
        named = named.join(above, "node", "left").withColumn(kind, F.coalesce(kind, "above")).drop("above")
    words = inside(slots, "verse", "word").join(node_values(rows, text, trailer).withColumnRenamed("node", "inner"), "inner")
    after = F.when(F.coalesce(trailer, F.lit("")) == "", "").when(F.trim(F.regexp_replace(trailer, r"\s+", " ")) == "", " ").otherwise(F.col(trailer))
    pieces = F.array_sort(F.collect_list(F.struct("at", "inner", F.concat(F.coalesce(text, F.lit("")), after).alias("t"))))
    texts = words.groupBy(F.col("outer").alias("node")).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"))
    return named.where("book is not null and chapter is not null and verse is not null").join(texts, "node")


def samaritan(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the Samaritan Pentateuch: verses of words, sof pasuq as a space; verses
    without a letter are left out."""
    rows = features(spark, folder, ["otype", "oslots", "g_cons_utf8", "book", "chapter", "verse", "trailer"]).persist()
    found = verses(rows, "g_cons_utf8", "trailer")
    text = F.trim(F.regexp_replace(F.replace("text", F.lit("׃"), F.lit(" ")), r"\s+", " "))
    units = found.withColumn("text", text).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("book").orderBy("place")
    return units.select(F.lit("hbo").alias("language"), F.lit("Tanakh").alias("collection"), F.upper("book").alias("book"), F.col("book").alias("book_title"), "chapter", "verse", "text", F.lit("samaritan").alias("source"), F.lit("SP").alias("witness"), F.row_number().over(order).cast("long").alias("place"))
