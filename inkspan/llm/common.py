"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
NOT_WORD_BREAK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary folder where that is unset (one machine, as in tests)."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        own = sc.getCheckpointDir()
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint: the lineage ends there, and
    every executor can read it again after another one is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished, checkpointed steps now.  It does so
    when the driver collects what named them, which may otherwise be long after.  Python's
    cycles name them first; they fall with a collection after that, so there are two.  The
    step that ended last may stay until the next call."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often body uses it.

    A plain Column that a higher-order function mentions would be computed for
    each element; a lambda's variable is not."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def digest_of(text: Column) -> Column:
    """What names a text: an md5, that of the empty text if it is null."""
    return F.md5(F.coalesce(text, F.lit("")))
