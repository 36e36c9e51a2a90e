"""Exact deduplication by Grace hashing.

A bucket of records goes into an open-addressing table that compares complete
contents.  A bucket whose distinct contents exceed the memory limit is dealt to
spill files by the next bits of the hash, and each file is treated the same way
one level deeper, until every bucket fits (or one content alone remains).

Two rounds keep hot groups apart.  Each input partition first reduces its own
copies to one record per content (largest key, number of rows), so a content
that holds a third of all rows is shuffled once per input partition, not once
per row.  The reduced records are then partitioned by content hash and pass
through the same table.  Last, rows and groups meet on the digest; the row side
of that join is plain enough for Spark to split a hot digest over many tasks.

Spill files belong to one task: they lie in that task's own temporary folder, on
the executor's own disks where Spark names them, and go when the bucket is done; a
lost executor's task starts again from its input.

``survivors`` gives whole rows in place of verdicts: the same two rounds, but a
record takes its row's other columns along, so that exactly one row of each text
comes out, whatever keys repeat or are missing, and no join follows.

Defined results: null text counts as empty, and empty texts are copies of each
other; texts count whole, however long; rows that repeat a key with the same text
share its verdict (``survivors`` keeps one of them: of equal keys the row whose other
columns are greater as text); a null key never outranks another (a group of null keys
only has keep_id null and keeps its rows; ``survivors`` keeps one); other columns are
ignored by ``exact_dedup`` and kept by ``survivors``, whatever their names; an empty
table gives an empty result.  Keys are numbers.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY_BYTES = 64 << 20
FAN_OUT = 16
_HEAD = struct.Struct("<?qqII")
Record = tuple[bytes, int | None, int, bytes]  # content, largest key, rows, the row's other columns


class OpenAddressing:
    """Linear probing over a power-of-two array of entry numbers; an entry
    matches only if its hash and its complete content are equal."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keys: list[int | None] = []
        self.rows: list[int] = []
        self.rests: list[bytes] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, key: int | None, rows: int, rest: bytes = b"") -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.rows[e] += rows
                held = self.keys[e]
                if (key is not None, key or 0, rest) > (held is not None, held or 0, self.rests[e]):
                    self.keys[e], self.rests[e] = key, rest
                return
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.keys.append(key)
        self.rows.append(rows)
        self.rests.append(rest)
        self.bytes += len(content) + len(rest) + 250
        if 2 * len(self.contents) > len(slots):
            self._grow()

    def _grow(self) -> None:
        slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = e
        self.slots = slots

    def records(self) -> Iterator[Record]:
        return zip(self.contents, self.keys, self.rows, self.rests, strict=True)


def content_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


def _read(file) -> Iterator[Record]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        known, key, rows, n, m = _HEAD.unpack(head)
        yield file.read(n), key if known else None, rows, file.read(m)


def _disk() -> str | None:
    """The first of the executor's local folders; the system's where Spark names none."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", os.environ.get("LOCAL_DIRS", "")).split(",") if os.path.isdir(d)), None)


def grace(records: Iterable[Record], memory: int = MEMORY_BYTES, fan_out: int = FAN_OUT, hash_of: Callable[[bytes], int] = content_hash, depth: int = 0) -> Iterator[Record]:
    """One record per distinct content: its largest key, the sum of rows, and the
    other columns of the row with that key."""
    table, source = OpenAddressing(), iter(records)
    for content, key, rows, rest in source:
        table.add(hash_of(content), content, key, rows, rest)
        # hashes that agree in all their bits can't be dealt further
        if table.bytes > memory and len(table.contents) > 1 and fan_out ** (depth + 1) < 1 << 62:
            break
    else:
        yield from table.records()
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=_disk()) as folder:
        files = [open(f"{folder}/{i}", "w+b") for i in range(fan_out)]  # noqa: SIM115
        try:
            for part in (table.records(), source):
                for content, key, rows, rest in part:
                    file = files[hash_of(content) // fan_out**depth % fan_out]
                    file.write(_HEAD.pack(key is not None, key or 0, rows, len(content), len(rest)) + content + rest)
                table = None
            for file in files:
                yield from grace(_read(file), memory, fan_out, hash_of, depth + 1)
                file.truncate(0)
        finally:
            for file in files:
                file.close()


_RECORDS = "content binary, content_hash long, digest string, keep_id long, group_size long"


def _reduce(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), [b""] * b.num_rows, strict=True)

        out, size = [], 0
        for content, key, rows, _ in grace(records(), memory):
            h = content_hash(content)
            out.append((content, h - (1 << 63), hashlib.sha256(content).hexdigest(), key, rows))
            size += len(content)
            if size > 8 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["content", "content_hash", "digest", "keep_id", "group_size"])


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", memory: int = MEMORY_BYTES) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")
    reduced = docs.select(content, F.col(key).cast("long").alias("key"), F.lit(1).cast("long").alias("rows")).mapInArrow(_reduce(memory), _RECORDS)
    dealt = reduced.select("content", "keep_id", "group_size", "content_hash").repartition("content_hash").drop("content_hash")
    return dealt.mapInArrow(_reduce(memory), _RECORDS).select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", memory: int = MEMORY_BYTES) -> DataFrame:
    """Each row's key with text_sha256, keep_id (largest key of equal texts),
    group_size and kept."""
    rows = docs.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    found = groups(docs, text, key, memory).withColumnRenamed("digest", "text_sha256")
    kept = F.col(key).eqNullSafe(F.col("keep_id"))
    return rows.join(found, "text_sha256", "left").select(key, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id", memory: int = MEMORY_BYTES) -> DataFrame:
    """One whole row of docs per distinct text: that with the largest key."""
    columns = docs.columns
    at, key_at = columns.index(text), columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def records() -> Iterator[Record]:
            nonlocal schema
            for b in batches:
                schema = b.schema
                values = [c.to_pylist() for c in b.columns]
                for row in zip(*values[:-1], strict=True):
                    content = row[at]
                    # a null text is told from an empty one by the rest of its record
                    yield (content or "").encode("utf-8", "surrogatepass"), row[key_at], 1, pickle.dumps((content is None, row[:at] + row[at + 1 :]), 5)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            by = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(by, schema, strict=True)], schema=schema)

        out, size = [], 0
        for content, _, _, rest in grace(records(), memory):
            null, others = pickle.loads(rest)
            out.append((*others[:at], None if null else content.decode("utf-8", "surrogatepass"), *others[at:], content_hash(content) - (1 << 63)))
            size += len(content)
            if size > 8 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    mark = "content_hash"
    while mark in columns:
        mark += "_"
    kind = docs.withColumn(mark, F.lit(0).cast("long")).schema
    once = docs.withColumn(mark, F.lit(0).cast("long")).mapInArrow(run, kind)
    return once.repartition(mark).mapInArrow(run, kind).drop(mark)


def op6(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text"))
