"""Checksums of raw files and of a corpus, and coverage of witnesses."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(folder, files, bytes, digest): the digest covers names and contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    each = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat(x["name"], F.lit(":"), x["sha256"])), "\n")
    return each.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(listed, 256).alias("digest"))


def witness_table(units: DataFrame) -> DataFrame:
    return units.groupBy("language", "witness", "source").agg(F.count("*").alias("units"), F.sum("n_tokens").alias("tokens"), F.countDistinct("book").alias("books"))


def missing_sources(table: DataFrame, required: list[str]) -> list[str]:
    """Required sources without a unit; the list is as short as ``required``."""
    present = {r["source"] for r in table.where(F.col("source").isin(required)).select("source").distinct().collect()}
    return sorted(set(required) - present)


def _crypto() -> ctypes.CDLL | None:
    for name in ("libcrypto.so.3", ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name) if name else None
            if lib is not None and lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final:
                return lib
        except (OSError, AttributeError):
            pass
    return None


class Chained:
    """A SHA-256 that one task hands on to the next: ``state`` is OpenSSL's SHA256_CTX as
    bytes, which hashlib doesn't give away."""

    def __init__(self, state: bytes | None = None) -> None:
        self.lib = _crypto()
        self.held = ctypes.create_string_buffer(state or bytes(112), 112)
        if state is None:
            self.lib.SHA256_Init(self.held)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.held, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state, 112)
        self.lib.SHA256_Final(out, last)
        return out.raw.hex()


def _taken(state: bytes, pieces: Iterator) -> list[bytes]:
    digest = Chained(state)
    for p in pieces:
        digest.update(bytes(p[0]))
    return [digest.state]


def corpus_fingerprint(units: DataFrame) -> str:
    """SHA-256 over every unit's id and text, each ended by a zero byte, in order of
    ``seq``, then id.  Rows are sorted by ranges side by side.  The digest is one sequence by
    nature: a range is one task's work, which begins with the state that the range before
    it ended with, so no task reads more than a range.  Where OpenSSL's library isn't found,
    one task reads all ranges, a batch at a time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece = "".join(f"{i}\0{t or ''}\0" for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).encode()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for b in joined(batches):
            digest.update(b.column(0)[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["sha256"])

    ordered = units.select("seq", "id", "text").repartitionByRange("seq", "id").sortWithinPartitions("seq", "id").select("id", "text")
    if _crypto() is None:
        row = ordered.coalesce(1).mapInArrow(run, "sha256 string").first()
        return row[0] if row else hashlib.sha256().hexdigest()
    pieces = ordered.mapInArrow(joined, "piece binary").rdd  # its shuffle is done once and read range by range
    state = Chained().state
    for part in range(pieces.getNumPartitions()):
        state = units.sparkSession.sparkContext.runJob(pieces, partial(_taken, state), [part])[0]
    return Chained(state).hexdigest()


def write_account(spark: SparkSession, path: str, account: dict, units: DataFrame) -> dict:
    """The account of a build with the fingerprint of what it built, as JSON."""
    whole = account | {"corpus_sha256": corpus_fingerprint(units)}
    spark.createDataFrame([(json.dumps(whole, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return whole


def read_account(spark: SparkSession, path: str, units: DataFrame) -> dict | None:
    """The account at a path if it is that of these units, else None."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    account = json.loads(spark.read.text(path).first()[0])
    return account if account.get("corpus_sha256") == corpus_fingerprint(units) else None
