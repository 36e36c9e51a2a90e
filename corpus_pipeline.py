"""The corpus pipeline: quality rules, exact dedup, near-dedup (SimHash with Golay
keys, then 5-word shingles with a Jaccard similarity of 0.8 or more), mixing sources to
target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet to the shared folder and reads it again as the next stage's docs, so a
lost executor costs at most the tasks of one stage; a result is deleted when the next
one is written, but for the last, which the returned rows are computed from.

Defined results: verdicts belong to rows, which are told apart by their texts, so that
keys may be null or repeat; null and empty texts go with the quality rules; long texts
count whole; of equal texts one row stays, that with the largest key, and of a group of
near copies that with the smallest; a document that the mix takes several times appears
as several equal rows; other columns than those of ``documents`` are dropped, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import exact_dedup, mixing, packing, quality, similar
from inkspan.llm.common import delete_path, scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest key."""
    return exact_dedup.survivors(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest key."""
    return similar.representatives(docs.select(*COLUMNS), size=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; long ones are likelier."""
    return mixing.taken_rows(docs.select(*COLUMNS), weight=mixing.size_digits)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fingerprints and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        now = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before is not None:
            delete_path(spark, before)
        before, docs = now, spark.read.parquet(now)
    return STAGES[-1][1](spark, docs, sf_dir)
