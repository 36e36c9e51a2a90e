"""Token ids as fixed-stride binary shards in training order.

Sequences.  A document's ids (then id 0) are cut into sequences of LENGTH ids,
the last one shorter.  The sequences are numbered densely in the order of the
input's partitions: a first pass counts them by partition, a second one writes
them.  The second pass holds its counts against the first one's and fails rather
than number anything twice.

Order.  A keyed Feistel network permutes the next larger power of four; walking
its cycles until the value is below the number of sequences N makes that a
permutation of 0..N-1.  It gives each sequence its global slot without a sort,
and can be inverted.

Shards.  Slots s*PER_SHARD up to the next multiple form shard s, which one task
writes.  As every record has the same stride, a record's place follows from its
slot: the task copies what arrives, in any order, to its place.  A shard is
written under its attempt's name and only the names of finished tasks are read.

Reading.  ``iterate(fs, paths, slot)`` goes on from any slot: shard and offset
are one division.

File: a 32-byte head (magic, stride, first slot, records, all sequences), then
the records: doc_id (int64), piece (uint32), length (uint32), LENGTH ids (uint16
or uint32, by the vocabulary's size), 0 beyond the length.

Defined results: null and empty texts are one sequence of one id; rows that
repeat a document are written one by one; a null key is written as the smallest
int64; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, delete_path, scratch_path

LENGTH = 512
PER_SHARD = 16_384
MAGIC = b"IDSHARD1"
HEAD = "<8sIqIq"
NO_KEY = -(1 << 63)


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: str, rounds: int = 6) -> None:
        self.n = n
        self.half = max(1, -(-max(1, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return left << half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self._once(np.asarray(x).astype(np.uint64), back)
            while len(out := np.flatnonzero(x >= self.n)):
                x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def record_type(wide: bool, length: int = LENGTH) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("length", "<u4"), ("ids", "<u4" if wide else "<u2", (length,))])


def _records(doc_ids: list[int | None], texts: pa.Array, path: str, kind: np.dtype) -> np.ndarray:
    parts, length = [], kind["ids"].shape[0]
    for doc_id, text in zip(doc_ids, texts, strict=True):
        ids = tokens.document_ids(text.as_py(), path)
        n = -(-len(ids) // length)
        r = np.zeros(n, kind)
        flat = np.zeros(n * length, kind["ids"].base)
        flat[: len(ids)] = ids
        r["ids"] = flat.reshape(n, length)
        r["doc_id"] = NO_KEY if doc_id is None else doc_id
        r["piece"] = np.arange(n)
        r["length"] = length
        r["length"][-1] = len(ids) - (n - 1) * length
        parts.append(r)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def write(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", order_key: str = "order-1", vocabulary: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes the shards to folder: (shard, path, records)."""
    path = vocabulary or tokens.default_vocabulary()
    kind = record_type(tokens.vocabulary_size(path) > 1 << 16, length)
    rows = docs.select(F.col(key).cast("long"), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(-(-(len(tokens.plain_ids(t.as_py(), path)) + 1) // length) for b in batches for t in b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], ["part", "n"])

    counted = dict(sorted((r["part"], r["n"]) for r in rows.mapInArrow(count, "part long, n long").collect()))
    first, whole = {}, 0
    for part, n in counted.items():
        first[part] = whole
        whole += n
    order = Feistel(whole, order_key)
    # what a task hands over: blocks of records for one shard
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, end, press = first.get(part, 0), first.get(part, 0) + counted.get(part, 0), zstandard.ZstdCompressor(level=1)
        held, size = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal at, size
            records = np.concatenate(held)
            if at + len(records) > end:
                raise RuntimeError("the input's partitions changed between two passes")
            slots = order.slots(np.arange(at, at + len(records)))
            at += len(records)
            by = np.argsort(slots, kind="stable")
            shards, starts = np.unique(slots[by] // per_shard, return_index=True)
            cuts = [*starts.tolist(), len(by)]
            blobs = [press.compress(slots[by[a:z]].astype("<i8").tobytes() + records[by[a:z]].tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            sizes = np.diff(cuts)
            held.clear()
            size = 0
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(sizes), pa.array(blobs, pa.binary())], ["shard", "records", "block"])

        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                piece = b.slice(lo, 2000)
                held.append(_records(piece.column(0).to_pylist(), piece.column(1), path, kind))
                size += held[-1].nbytes
                if size > 32 << 20:
                    yield from blocks()
        if held:
            yield from blocks()
        if at != end:
            raise RuntimeError("the input's partitions changed between two passes")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, body, n, got = None, None, 0, 0
        for b in batches:
            for s, k, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if shard is None:
                    shard = s
                    n = min(per_shard, whole - shard * per_shard)
                    body = np.zeros(n, kind)
                if s != shard:
                    raise RuntimeError("two shards in a task")
                data = zstandard.ZstdDecompressor().decompress(block.as_py())
                slots = np.frombuffer(data, "<i8", k)
                body[slots - shard * per_shard] = np.frombuffer(data, kind, k, 8 * k)
                got += k
        if shard is None:
            return
        if got != n:
            raise RuntimeError(f"shard {shard} got {got} of {n} records")
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{shard:08d}-{uuid.uuid4().hex}.ids"
        with fs.open_output_stream(name) as out:
            out.write(struct.pack(HEAD, MAGIC, kind.itemsize, shard * per_shard, n, whole))
            out.write(body.data.cast("B"))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], ["shard", "path", "records"])

    shards = max(1, -(-whole // per_shard))
    dealt = rows.mapInArrow(deal, "shard int, records long, block binary").repartitionById(shards, "shard")
    return cut(dealt.mapInArrow(put, "shard int, path string, records long"))


def iterate(fs: pafs.FileSystem, paths: list[str], slot: int = 0, wide: bool = False, length: int = LENGTH, batch: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, records) from a slot on; paths: of all shards, in order."""
    kind = record_type(wide, length)
    per_shard = None
    shard = 0
    while shard < len(paths):
        with fs.open_input_file(paths[shard]) as f:
            magic, stride, first, n, _ = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
            if magic != MAGIC or stride != kind.itemsize or f.size() != struct.calcsize(HEAD) + n * stride:
                raise ValueError(f"{paths[shard]} is no whole shard of this kind")
            if per_shard is None:
                per_shard = n
                if slot >= n and shard == 0:
                    shard = slot // n
                    continue
            at = max(0, slot - first)
            f.seek(struct.calcsize(HEAD) + at * stride)
            while at < n:
                k = min(batch, n - at)
                yield first + at, np.frombuffer(f.read(k * stride), kind)
                at += k
        shard += 1


def read(shards: DataFrame, folder: str, wide: bool = False, length: int = LENGTH) -> DataFrame:
    """A row for each sequence: slot, shard, doc_id, piece, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for slot, r in iterate(fs, [path], 0, wide, length):
                    wide_ids, n = r["ids"].astype("<u4"), r["length"].tolist()
                    crc = [zlib.crc32(ids[:k].tobytes()) for ids, k in zip(wide_ids, n, strict=True)]
                    doc_id = r["doc_id"].astype(np.int64)
                    arrays = [pa.array(np.arange(slot, slot + len(r))), pa.array(np.full(len(r), shard, np.int32)), pa.array(doc_id, mask=doc_id == NO_KEY), pa.array(r["piece"].astype(np.int32)), pa.array(r["length"].astype(np.int64)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["slot", "shard", "doc_id", "piece", "length", "ids_crc32"])

    return shards.select("shard", "path").mapInArrow(run, "slot long, shard int, doc_id long, piece int, length long, ids_crc32 long")


def op4(docs: DataFrame) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "shards")
    try:
        shards = write(docs.select("doc_id", "text"), folder)
        return cut(read(shards, folder))
    finally:
        delete_path(docs.sparkSession, folder)
