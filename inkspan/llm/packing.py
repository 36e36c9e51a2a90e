"""Best-fit packing of documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is decided on the
histogram of lengths, whose size doesn't depend on the number of documents:

* Items above a third of the capacity stand at most two to a bin.  Greedy
  matching takes the longest one and the longest partner that fits beside it.
* Smaller items, longest first, go to the bin with the smallest gap that holds
  them; the bins that hold nothing else are opened last.

Equal bins are one group with a count, so the plan is a table of a few thousand
runs "the documents of length L with ranks r to r+n go to the sequences from s
at offset o".  Each document's rank among those of its length comes from a range
partitioning by (length, key): an offset for each partition and length, which is
all that is gathered besides the histogram (partitions + capacity rows at most).

Defined results: null and empty texts are documents of one id; rows that repeat
a document are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut

CAPACITY = 2048
Run = tuple[int, int, int, int, int]  # length, first rank, count, first sequence, offset


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """The plan for counts of documents by length."""
    left = {length: n for length, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # gap -> (bins, (length, first rank) of each item)
    gaps: list[int] = []

    def put(n: int, gap: int, items: list[tuple[int, int]]) -> None:
        if n:
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append((n, items))

    def take(length: int, n: int) -> int:
        rank = used[length]
        used[length] += n
        left[length] -= n
        return rank

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] < 2:
            at -= 1
            b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
            put(n, capacity - a, [(a, take(a, n))])
        elif b == a:
            n = left[a] // 2
            put(n, capacity - 2 * a, [(a, take(a, n)), (a, take(a, n))])
        else:
            n = min(left[a], left[b])
            put(n, capacity - a - b, [(a, take(a, n)), (b, take(b, n))])
        large = [x for x in large if left[x]] if not left[a] or (b is not None and not left[b]) else large

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while c := left[s]:
            at = bisect_left(gaps, s)
            if at < len(gaps):
                gap = gaps[at]
                bins, items = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            else:
                gap, bins, items = capacity, c, []
            each = gap // s
            full = min(bins, c // each)
            if full:
                put(full, gap - each * s, items + [(s, take(s, full)) for _ in range(each)])
            rest = left[s] if full < bins and left[s] < each else 0
            if rest:
                at_bin = [(length, rank + full) for length, rank in items]
                put(1, gap - rest * s, at_bin + [(s, take(s, 1)) for _ in range(rest)])
            over = bins - full - bool(rest)
            if items:
                put(over, gap, [(length, rank + full + bool(rest)) for length, rank in items])

    runs, sequence = [], 0
    for gap in sorted(by_gap):
        for n, items in by_gap[gap]:
            offset = 0
            for length, rank in items:
                runs.append((length, rank, n, sequence, offset))
                offset += length
            sequence += n
    return runs


class Places:
    """Looks up (sequence, offset) of the documents of a length by rank."""

    def __init__(self, runs: list[Run]) -> None:
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for length, rank, _, sequence, offset in runs:
            by[length].append((rank, sequence, offset))
        self.by = {length: np.array(sorted(x), np.int64) for length, x in by.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.by[length]
        at = np.searchsorted(table[:, 0], ranks, side="right") - 1
        return table[at, 1] + ranks - table[at, 0], table[at, 2]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document, without their ids."""
    path = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokens.document_ids(value.as_py(), path)
                for i, (start, n) in enumerate(tokens.pieces(len(ids), capacity)):
                    rows.append((doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, _PIECES)


def best_fit(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    dealt = cut(cut_pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece"))
    dealt = dealt.withColumn("part", F.spark_partition_id())
    histogram = sorted((r["part"], r["length"], r["n"]) for r in dealt.groupBy("part", "length").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = defaultdict(int)
    first: dict[tuple[int, int], int] = {}
    for part, length, n in histogram:
        first[part, length] = counts[length]
        counts[length] += n
    spark = cut_pieces.sparkSession
    shared = spark.sparkContext.broadcast((first, Places(pack(counts, capacity))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places = shared.value
        seen: dict[int, int] = {}
        for b in batches:
            length, part = b.column("length").to_numpy(), b.column("part").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            cuts = np.concatenate(([0], np.nonzero(np.diff(length))[0] + 1, [len(length)])) if len(length) else np.zeros(1, np.int64)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                size = int(length[a])
                rank = seen.setdefault(size, first.get((int(part[a]), size), 0))
                sequence[a:z], offset[a:z] = places.of(size, np.arange(rank, rank + z - a))
                seen[size] += z - a
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return dealt.mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return best_fit(cut(tokenised(docs, text, key, vocabulary, capacity)), capacity)


def op3(docs: DataFrame) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"))
