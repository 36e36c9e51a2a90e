"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprint.  Bit b of a text's 64-bit fingerprint is set if it is set in over
half of the XXH64 values (seed 42) of its word shingles.

Keys.  A fingerprint is cut into segments of 22, 21 and 21 bits, each padded to
the 23 bits of the perfect Golay code.  The fuzzy keys of a segment are the
codewords at distance 4 or less: one or six of them.  Two words at distance 2 or
less have a word m halfway between; the codeword nearest to m (3 or less away)
is within 4 of both, so they share a key.  If two fingerprints differ in at most
2 bits, then by pigeonhole one segment is free of errors, and the segment after
it has at most 2: the pair (a segment exactly, a fuzzy key of the next one)
meets for some segment.

Join and verify.  Equal keys are brought together, and the pairs of a bucket are
verified by their exact Hamming distance.  Only distinct fingerprints take part,
each with a number of its own, so exact copies never meet.

Large buckets.  No pairs are formed in a bucket of more than BUCKET fingerprints.
Its members are linked exactly another way: each one is listed under itself and
under the 64 words at distance 1.  Fingerprints at distance 2 or less share such
a word, and those that share one are at distance 2 or less, so linking each to
the smallest under the word gives the same components, in linear work.

Components come from large-star/small-star rounds, which stay distributed.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer words than a shingle has form one shingle; long texts
count whole; equal fingerprints are linked, so repeated rows are; the component is the
smallest key reachable, also through rows without a key, which are never the smallest,
and null where there is no other; other columns are ignored, whatever their names; an
empty table gives an empty result.  Keys are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SEED = 42
#: The Golay keys and the half-way words are both for this distance.
DISTANCE = 2
BUCKET = 16
#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)
#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GOLAY_POLYNOMIAL = 0b101011100011


def _fold_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes; counts: the hashes of each text, not 0."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.zeros(len(counts), np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        bits = np.unpackbits(octets[:, byte : byte + 1], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        for bit in range(8):
            out |= (2 * ones[:, bit] > counts).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -size])).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], size: int = 3) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    rows: list[int] = []
    counts: list[int] = []
    hashes: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        if rows:
            out[rows] = _fold_bits(np.concatenate(hashes), np.array(counts, np.int64))
            rows.clear()
            counts.clear()
            hashes.clear()

    for i, text in enumerate(texts):
        if h := shingle_hashes(text or "", size):
            rows.append(i)
            counts.append(len(h))
            hashes.append(np.array(h, np.uint64))
            held += len(h)
            if held > 200_000:
                flush()
                held = 0
    flush()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(key, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["key", "fp"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, fp long")


@lru_cache(1)
def _golay() -> np.ndarray:
    """For each of the 2^11 syndromes, the error patterns of weight 4 or less
    that have it: one or six (-1 fills up)."""
    by: list[list[int]] = [[] for _ in range(1 << 11)]
    single = [_remainder(1 << i) for i in range(23)]

    def go(start: int, weight: int, error: int, syndrome: int) -> None:
        by[syndrome].append(error)
        if weight < 4:
            for i in range(start, 23):
                go(i + 1, weight + 1, error | 1 << i, syndrome ^ single[i])

    go(0, 0, 0, 0)
    table = np.full((1 << 11, max(map(len, by))), -1, np.int64)
    for s, errors in enumerate(by):
        table[s, : len(errors)] = errors
    return table


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY_POLYNOMIAL << (i - 11)
    return word


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, 12-bit codeword indices) of 23-bit words."""
    syndrome = np.zeros(len(segment), np.int64)
    for i in range(23):
        syndrome ^= np.where(segment >> i & 1, _remainder(1 << i), 0)
    errors = _golay()[syndrome]
    rows, which = np.nonzero(errors >= 0)
    return rows, (segment[rows] ^ errors[rows, which]) >> 11  # systematic: the upper 12 bits name the codeword


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of uint64 fingerprints: for each segment, its exact
    bits with the fuzzy keys of the next segment."""
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append((fps >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1))
        at += bits
    rows, keys = [], []
    for i in range(3):
        r, index = golay_keys(parts[(i + 1) % 3])
        rows.append(r)
        keys.append((i << 40) | (parts[i][r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(pairs_src: np.ndarray, pairs_dst: np.ndarray, parent: dict[int, int]) -> Iterator[tuple[int, int]]:
    """The links that join two trees of this task so far; the rest say nothing new."""

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for a, b in zip(pairs_src.tolist(), pairs_dst.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            yield a, b


def _verify(bucket: int, most_parents: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: links of small buckets, members of large ones."""
        parent: dict[int, int] = {}
        last, large = None, False
        kept_fp = np.empty(0, np.uint64)
        kept_rep = np.empty(0, np.int64)
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            rep = b.column(2).to_numpy(zero_copy_only=False)
            src, dst, wide = [], [], []
            if len(key) and last is not None and key[0] == last and large:  # goes on with a bucket known as large
                n = int(np.searchsorted(key, last, side="right"))
                wide.append(np.stack([fp[:n].view(np.int64), rep[:n]]))
                key, fp, rep = key[n:], fp[n:], rep[n:]
                large = not len(key)
            elif len(kept_fp):  # the last bucket of the batch before isn't complete
                key, fp, rep = np.concatenate((np.full(len(kept_fp), last), key)), np.concatenate((kept_fp, fp)), np.concatenate((kept_rep, rep))
            if len(key):
                cuts = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
                last = key[-1]
                sizes = np.diff(cuts)
                if sizes[-1] > bucket:
                    large, kept_fp, kept_rep, whole = True, fp[:0], rep[:0], len(sizes)
                else:
                    large, kept_fp, kept_rep, whole = False, fp[cuts[-2] :], rep[cuts[-2] :], len(sizes) - 1
                _links(fp, rep, cuts[: whole + 1], sizes[:whole], bucket, src, dst, wide)
            yield from _emit(src, dst, wide, parent)
            if len(parent) > most_parents:
                parent.clear()
        src, dst, wide = [], [], []
        _links(kept_fp, kept_rep, np.array([0, len(kept_fp)]), np.array([len(kept_fp)]), bucket, src, dst, wide)
        yield from _emit(src, dst, wide, parent)

    return run


def _links(fp, rep, cuts, sizes, bucket, src, dst, wide) -> None:
    starts = cuts[:-1]
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size > bucket:
            for a in at:
                wide.append(np.stack([fp[a : a + size].view(np.int64), rep[a : a + size]]))
            continue
        grid = at[:, None] + np.arange(size)
        for step in range(1, size):
            left, right = grid[:, :-step].ravel(), grid[:, step:].ravel()
            near = np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE
            src.append(rep[left[near]])
            dst.append(rep[right[near]])


def _emit(src, dst, wide, parent) -> Iterator[pa.RecordBatch]:
    names = ["src", "dst", "fp"]
    if src:
        links = list(_forest(np.concatenate(src), np.concatenate(dst), parent))
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names)
    if wide:
        both = np.concatenate(wide, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.nulls(both.shape[1], pa.int64()), pa.array(both[0])], names)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct (fp, rep) to links (src, dst) between reps: enough of them for
    the components of all pairs at DISTANCE or less."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 10_000):
                part = fp[at : at + 10_000]
                rows, keys = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(rep[at : at + 10_000][rows])], ["gkey", "fp", "rep"])

    dealt = distinct.select("fp", "rep").mapInArrow(keyed, "gkey long, fp long, rep long").repartition("gkey").sortWithinPartitions("gkey")
    met = cut(dealt.mapInArrow(_verify(bucket), "src long, dst long, fp long"))
    small = met.where("fp is null").select("src", "dst")

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
        for b in batches:
            fp, rep = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            words = fp[:, None] ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(words.ravel().view(np.int64)), pa.array(np.repeat(rep, words.shape[1]))], ["word", "rep"])

    under = met.where("fp is not null").select("fp", F.col("src").alias("rep")).distinct().mapInArrow(halfway, "word long, rep long")
    hubs = under.groupBy("word").agg(F.min("rep").alias("dst"), F.count("*").alias("n")).where("n > 1").select("word", "dst")
    large = under.join(hubs, "word").where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct()
    return small.unionByName(large)


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Each row's key with fingerprint (16 hex digits) and component_id."""
    fps = cut(fingerprints(docs, text, key, size))
    # fingerprints are numbered, not named by keys: some may have null keys only
    distinct = cut(fps.groupBy("fp").agg(F.min("key").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    found = components(links(distinct, bucket))
    rooted = distinct.join(found.select(F.col("src").alias("rep"), F.col("dst").alias("root")), "rep", "left").select("fp", "least", F.coalesce("root", "rep").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5(docs: DataFrame) -> DataFrame:
    return near_dedup(docs.select("doc_id", "text"))
