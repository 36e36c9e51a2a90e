"""Near-duplicates by Jaccard similarity, found by Golay-code fuzzy hashing.

The operator of ``simhash`` for a similarity in place of a distance in bits: the
fingerprint only finds candidates, and every candidate pair is verified on whole
texts.

Sets.  A text is the set of the XXH64 values (seed 42) of its word shingles.  Texts
with equal sets are one node with a number of its own, so that nothing below depends
on the documents' keys.

Fingerprint.  SimHash over the text's different words, SEGMENTS segments of 23 bits,
the length of the perfect Golay code.  Words, not shingles: a changed word spoils
``size`` shingles but one word, so that texts whose shingle sets agree to 0.8 differ
in about a twentieth of the bits and not in a seventh.

Keys.  Each segment is decoded to the codewords near it, one or six (``simhash``); two
segments within 2 errors of each other share one.  A key is a pair of segments with
one codeword of each.  By pigeonhole two fingerprints that differ in at most
3 * SEGMENTS - 4 bits have two segments with at most 2 errors and so share a key; of
those further apart most still do.

Join and verify.  Keys come in rounds, first the nearest codewords of the first pair of
segments alone, then all keys of that pair, then those of the other pairs, ROUND pairs at a
time, so that only a round's keys are on disk at once.  Under a key a node is tried with the
first node and with the one before it if their labels differ, a label being first a nearest
codeword's first node and then the component that the first pair's tries give; so a group of
near copies is not tried again under each of its keys.  In a bucket of more than three nodes, near
ones that these tries don't reach are found by a search through the bucket.  So the tries'
components hold together all nodes that share a key and are near each other in bits, by a
number of rows that is linear in the nodes.  A try is verified in three steps, the cheap ones
first: sizes, parity bits (two sets differ in at least as many shingles as in parities)
and the exact intersection.  Last, the links' components are compared with each other
inside the tries' component, all members, in cells of at most 2 * CELL rows, by bits
alone, and what passes is verified exactly.  So a large group of near copies is linked
in linear work, and no two similar texts that share a key stay apart.

Defined results: null, empty and blank texts have the empty set and are linked; fewer
words than a shingle has form one shingle; long texts count whole; the component is
the smallest key reachable; rows that repeat a key or text share nothing but what
their texts share; a null key is never the smallest, and a component of null keys only
has a null name; other columns are left out by ``near_dedup`` and kept by
``representatives``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_of, free_shuffles
from .components import components
from .exact_dedup import _disk
from .simhash import SEED, _remainder, golay_keys, shingle_hashes

SEGMENTS = 5
#: Bits of 115 in which candidates may differ; unrelated texts differ in about half, similar ones in 20 at most.
DISTANCE = 28
PARITIES = 2048
CELL = 4096
#: Pairs of segments whose keys are on disk at once.
ROUND = 3
#: Buckets up to this size are looked through for pairs beyond the first tries.
SMALL = 64
#: Rows of a bucket that are looked through at once; larger buckets are cut into parts.
PART = 100_000
_LONGS = PARITIES // 64


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or "", size), np.uint64)).view(np.int64)


def word_fingerprint(text: str | None, segments: int = SEGMENTS) -> np.ndarray:
    """The segments' bits, as numbers of 23 bits."""
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return np.zeros(segments, np.int64)
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, SEED) for w in words), np.uint8).reshape(len(words), 16)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(words), 50_000):
        ones += np.unpackbits(digests[at : at + 50_000], axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(words))[: 23 * segments].reshape(segments, 23)
    return (bits * (1 << np.arange(23))).sum(1)


def name_of(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes(), SEED)


def parities(s: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount(s & (PARITIES - 1), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _arrays(lists: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.empty(0, np.int64), *lists])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), pa.array(flat))


def _described(docs: DataFrame, size: int, segments: int) -> DataFrame:
    """(key, digest, node, n, fp, bits): the text's digest, and name, size,
    fingerprint and parities of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, ns, fps, bits = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text, size)
                nodes.append(name_of(s))
                ns.append(len(s))
                fps.append(word_fingerprint(text, segments))
                bits.append(parities(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.string()), pa.array(ns, pa.int64()), _arrays(fps), _arrays(bits)], ["key", "digest", "node", "n", "fp", "bits"])

    return docs.mapInArrow(run, "key long, digest string, node string, n long, fp array<long>, bits array<long>")


def _list_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@lru_cache(1)
def _codewords() -> np.ndarray:
    return np.array([i << 11 | _remainder(i << 11) for i in range(1 << 12)], np.int64)


def keys_of(fps: np.ndarray, pairs: list[int], nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of fingerprints, a row a fingerprint and a column a segment,
    for the numbered pairs of segments; with ``nearest`` those of the nearest codewords only."""
    near = []
    for part in fps.T:
        rows, index = golay_keys(part)
        if nearest:  # the code is perfect: one codeword within 3 errors
            fine = np.bitwise_count(part[rows] ^ _codewords()[index]) <= 3
            rows, index = rows[fine], index[fine]
        begin = np.searchsorted(rows, np.arange(len(fps)))
        table = np.full((len(fps), 6), -1, np.int64)
        table[rows, np.arange(len(rows)) - begin[rows]] = index
        near.append(table)
    out_rows, out_keys = [], []
    for k, (i, j) in enumerate(combinations(range(fps.shape[1]), 2)):
        if k not in pairs:
            continue
        a, b = near[i][:, :, None], near[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        out_rows.append(row)
        out_keys.append((k << 24) | (near[i][row, x] << 12) | near[j][row, y])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_rows]), np.concatenate([none, *out_keys])


def _packed(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint in two longs: two segments each, and the halves of a fifth."""
    out = [np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)]
    for i, part in enumerate(fps.T[:4]):
        out[i // 2] |= part << (23 * (i % 2))
    for part in fps.T[4:]:
        out[0] |= (part & 0xFFF) << 46
        out[1] |= (part >> 12) << 46
    return out[0], out[1]


def _keyed(batches: Iterator[pa.RecordBatch], segments: int, pairs: list[int], nearest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        fps = _list_matrix(b.column(2), segments)
        for at in range(0, len(rep), 2000):
            part = fps[at : at + 2000]
            rows, keys = keys_of(part, pairs, nearest)
            f, g = _packed(part)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, rep[at : at + 2000][rows], label[at : at + 2000][rows], f[rows], g[rows])], ["gkey", "rep", "label", "f", "g"])


class Rule:
    """When sizes, fingerprints and parities allow the similarity."""

    def __init__(self, least: Fraction, distance: int) -> None:
        self.up, self.down, self.distance = least.numerator, least.denominator, distance

    def sizes(self, a, b):
        return (a * self.down >= b * self.up) & (b * self.down >= a * self.up)

    def near(self, f, g, i, j):
        return np.bitwise_count(f[i] ^ f[j]).astype(np.int16) + np.bitwise_count(g[i] ^ g[j]) <= self.distance

    def may(self, a: Column, b: Column, n: Column, m: Column) -> Column:
        apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return self.sizes(n, m) & (apart * (self.down + self.up) <= (n + m) * (self.down - self.up))


class _Joined:
    """Labels that tries have joined so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def tops(self, label: np.ndarray) -> np.ndarray:
        each, at = np.unique(label, return_inverse=True)
        return np.array([self.top(x) for x in each.tolist()], np.int64)[at]

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _search(rule: Rule, rep, label, f, g, joined: _Joined | None = None) -> list[tuple[int, int]]:
    """Near pairs of one bucket, enough of them to join what near pairs can join."""
    joined = _Joined() if joined is None else joined
    out, left, queue = [], np.arange(len(rep)), []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        hit = rule.near(f, g, np.full(len(left), i), left)
        for j in left[hit].tolist():
            if joined.join(int(label[i]), int(label[j])):
                out.append((max(int(rep[i]), int(rep[j])), min(int(rep[i]), int(rep[j]))))
        queue += left[hit].tolist()
        left = left[~hit]
    return out


def _between(rule: Rule, earlier: list[np.ndarray], later: list[np.ndarray], joined: _Joined) -> list[tuple[int, int]]:
    """Near pairs of two parts of a bucket, enough to join what they can join.  Only
    rows that aren't joined yet are compared, so a large group of near rows costs no
    more than its size."""
    rep, label, f, g = (np.concatenate(x) for x in zip(earlier, later, strict=True))
    n, out = len(earlier[0]), []
    for c in np.unique(joined.tops(later[1])).tolist():
        tops = joined.tops(label)
        own, other = n + np.flatnonzero(tops[n:] == joined.top(c)), np.flatnonzero(tops[:n] != joined.top(c))
        few, many = (own, other) if len(own) < len(other) else (other, own)
        for i in few.tolist():
            for j in many[rule.near(f, g, np.full(len(many), i), many)].tolist():
                if joined.join(int(label[i]), int(label[j])):
                    out.append((max(int(rep[i]), int(rep[j])), min(int(rep[i]), int(rep[j]))))
    return out


class _LargeBucket:
    """A bucket that is larger than one part: its parts, on the task's own disk, each
    searched through and compared with all earlier ones."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.joined, self.sizes = rule, _Joined(), []
        self.file = tempfile.TemporaryFile(prefix="bucket-", dir=_disk())

    def add(self, part: list[np.ndarray]) -> list[tuple[int, int]]:
        out = _search(self.rule, *part, self.joined)
        self.file.seek(0)
        for size in self.sizes:
            earlier = list(np.frombuffer(self.file.read(4 * 8 * size), np.int64).reshape(4, size))
            out += _between(self.rule, earlier, part, self.joined)
        self.file.write(np.stack(part).astype(np.int64).tobytes())
        self.sizes.append(len(part[0]))
        return out


def _tries(rule: Rule):
    """Rows sorted by key to near pairs (src, dst) of different labels."""

    def of(gkey, rep, label, f, g) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.nonzero(gkey[1:] != gkey[:-1])[0] + 1))
        sizes = np.diff(np.concatenate((starts, [len(gkey)])))
        first, place = np.repeat(starts, sizes), np.arange(len(gkey)) - np.repeat(starts, sizes)
        found = []
        for least, other in ((1, first), (2, np.arange(len(gkey)) - 1)):
            at = np.nonzero(place >= least)[0]
            at = at[(label[at] != label[other[at]]) & rule.near(f, g, at, other[at]) & (rep[at] != rep[other[at]])]
            found.append(np.stack([np.maximum(rep[at], rep[other[at]]), np.minimum(rep[at], rep[other[at]])]))
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        again = [np.nonzero(mixed & (sizes > SMALL))[0]]
        for size in np.unique(sizes[(sizes > 3) & (sizes <= SMALL)]):
            which = np.nonzero(mixed & (sizes == size))[0]
            grid = starts[which][:, None] + np.arange(size)
            met = np.zeros(len(which), bool)
            for step in range(2, size):  # a step of 1 and the first row are tried above
                x, y = grid[:, 1:-step].ravel(), grid[:, 1 + step :].ravel()
                if len(x):
                    met |= ((label[x] != label[y]) & rule.near(f, g, x, y)).reshape(len(which), -1).any(1)
            again.append(which[met])
        for k in np.concatenate(again).tolist():
            z = slice(starts[k], starts[k] + sizes[k])
            if more := _search(rule, rep[z], label[z], f[z], g[z]):
                found.append(np.array(more, np.int64).T)
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["src", "dst"])

    def pairs(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            src, dst = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, key = None, None, None  # rows of the last key; if it is a large one, what went before them
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(rows[0]):
                continue
            if large is not None and rows[0][-1] != key:
                end = int(np.searchsorted(rows[0], key, side="right"))
                yield from pairs(large.add([x[:end] for x in rows[1:]]))
                large, rows = None, [x[end:] for x in rows]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            if last:
                yield from of(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
            if len(held[0]) >= PART:
                large, key = _LargeBucket(rule) if large is None else large, held[0][0]
                yield from pairs(large.add(held[1:]))
                held = [x[:0] for x in held]
        if held is not None and len(held[0]):
            if large is None:
                yield from of(*held)
            else:
                yield from pairs(large.add(held[1:]))

    return run


def _cells(rule: Rule, segments: int):
    """Rows sorted by cell: pairs of different components that bits allow."""

    def of(rows: list[np.ndarray]) -> np.ndarray:
        lo, hi, block, rep, root, n, f, g, bits = rows
        out = []
        left = np.nonzero(block == lo)[0]
        right = left if lo[0] == hi[0] else np.nonzero(block == hi)[0]
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            x, y = np.nonzero((root[i][:, None] != root[right][None, :]) & ((i[:, None] < right[None, :]) if left is right else True))
            x, y = i[x], right[y]
            ok = rule.sizes(n[x], n[y]) & rule.near(f, g, x, y)
            x, y = x[ok], y[ok]
            for k in range(0, len(x), 50_000):
                p, q = x[k : k + 50_000], y[k : k + 50_000]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
                ok = apart * (rule.down + rule.up) <= (n[p] + n[q]) * (rule.down - rule.up)
                p, q = p[ok], q[ok]
                out.append(np.stack([np.maximum(rep[p], rep[q]), np.minimum(rep[p], rep[q]), np.minimum(root[p], root[q]), np.maximum(root[p], root[q])]))
        return np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns[:-2]]
            now += [*_packed(_list_matrix(b.column(b.num_columns - 2), segments)), _list_matrix(b.column(b.num_columns - 1), _LONGS).view(np.uint64)]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(rows[0]):
                continue
            cuts = np.nonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))[0] + 1
            cuts = np.concatenate(([0], cuts))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                yield _pairs(of([x[a:z] for x in rows[1:]]))
            held = [x[cuts[-1] :] for x in rows]
        if held is not None:
            yield _pairs(of(held[1:]))

    def _pairs(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["src", "dst", "root_a", "root_b"])

    return run


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(text, size) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(name_of, sets), pa.string()), _arrays(sets)], ["node", "shingles"])

    return docs.mapInArrow(run, "node string, shingles array<long>")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """Each row's key (a long) with its text's digest and ``class``: a number that
    texts share if a chain of pairs leads from one to the other, each of which shares
    a fuzzy key and has a Jaccard similarity of ``similarity`` or more between its
    shingle sets.  ``segments`` is 2 to 5."""
    rule = Rule(Fraction(str(similarity)), distance)
    docs = docs.select(F.col(key).cast("long").alias("key"), digest_of(F.col(text)).alias("digest"), F.col(text).alias("text"))
    rows = cut(_described(docs, size, segments))
    found = rows.groupBy("node").agg(F.first("digest").alias("digest"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
    nodes = cut(found.withColumn("rep", F.monotonically_increasing_id()))  # the checkpoint fixes the numbers

    def tried(labelled: DataFrame, pairs: list[int], nearest: bool = False) -> DataFrame:
        keyed = labelled.select("rep", "label", "fp").mapInArrow(lambda b: _keyed(b, segments, pairs, nearest), "gkey long, rep long, label long, f long, g long")
        return cut(keyed.repartition("gkey").sortWithinPartitions("gkey", "rep").mapInArrow(_tries(rule), "src long, dst long").distinct())

    def relabelled(label: DataFrame, tries: DataFrame) -> DataFrame:
        """Labels after tries, which lead from label to label."""
        a, b = (label.select(F.col("rep").alias(k), F.col("label").alias(f"label_{k}")) for k in ("src", "dst"))
        tops = components(tries.join(a, "src").join(b, "dst").select(F.col("label_src").alias("src"), F.col("label_dst").alias("dst")))
        return cut(label.join(tops.select(F.col("src").alias("label"), F.col("dst").alias("top")), "label", "left").select("rep", F.coalesce("top", "label").alias("label")))

    pairs = list(range(segments * (segments - 1) // 2))
    tries = tried(nodes.withColumn("label", F.col("rep")), pairs[:1], nearest=True)
    label = cut(nodes.select("rep").join(tries.groupBy(F.col("src").alias("rep")).agg(F.min("dst").alias("least")), "rep", "left").select("rep", F.coalesce("least", "rep").alias("label")))
    tries = tries.unionByName(tried(nodes.join(label, "rep"), pairs[:1]))
    label = relabelled(label, tries)
    more = []
    for at in range(1, len(pairs), ROUND):
        free_shuffles(docs.sparkSession)
        more.append(tried(nodes.join(label, "rep"), pairs[at : at + ROUND]))
    if more:
        more = reduce(DataFrame.unionByName, more).distinct()
        tries, label = tries.unionByName(more), relabelled(label, more)
    free_shuffles(docs.sparkSession)
    near = nodes.join(label, "rep").select("rep", F.col("label").alias("near"), "n", "fp", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        p, q = (nodes.select(F.col("rep").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}")) for k in ("src", "dst"))
        allowed = cut(pairs.join(p, "src").join(q, "dst").where(rule.may(F.col("bits_src"), F.col("bits_dst"), F.col("n_src"), F.col("n_dst"))).select("src", "dst"))
        free_shuffles(docs.sparkSession)
        wanted = nodes.select("rep", "digest", "node").join(allowed.select(F.explode(F.array("src", "dst")).alias("rep")).distinct(), "rep")
        texts = docs.join(wanted.select("digest"), "digest", "left_semi").select("text")
        sets = cut(_sets(texts, size)).dropDuplicates(["node"]).join(wanted.select("rep", "node"), "node")
        free_shuffles(docs.sparkSession)  # whole texts went through that shuffle
        a, b = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(x)) for k, x in (("src", "x"), ("dst", "y")))
        shared = allowed.join(a, "src").join(b, "dst").select("src", "dst", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("m"))
        return cut(shared.where(F.col("m") * rule.down >= (F.col("nx") + F.col("ny") - F.col("m")) * rule.up).select("src", "dst"))

    links = verified(tries)
    free_shuffles(docs.sparkSession)
    found = components(links).select(F.col("src").alias("rep"), F.col("dst").alias("root"))
    labelled = cut(near.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    several = labelled.groupBy("near").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("near", "members")
    numbered = labelled.join(several, "near").withColumn("block", F.floor((F.row_number().over(Window.partitionBy("near").orderBy("rep")) - 1) / CELL))
    dealt = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / CELL))))
    cells = dealt.select("near", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "root", "n", "fp", "bits")
    rest = cells.repartition("near", "lo", "hi").sortWithinPartitions("near", "lo", "hi").mapInArrow(_cells(rule, segments), "src long, dst long, root_a long, root_b long")
    rest = cut(rest.distinct().join(tries, ["src", "dst"], "left_anti"))
    free_shuffles(docs.sparkSession)

    def merged(pairs: DataFrame) -> DataFrame:
        """(root, higher): the components of roots that verified pairs join."""
        of_roots = pairs.join(rest, ["src", "dst"]).select(F.greatest("root_a", "root_b").alias("src"), F.least("root_a", "root_b").alias("dst"))
        return components(of_roots).select(F.col("src").alias("root"), F.col("dst").alias("higher"))

    # a pair for any two components first; all others only where these are still apart
    one = rest.groupBy("root_a", "root_b").agg(F.min(F.struct("src", "dst")).alias("p")).select("p.src", "p.dst")
    more = verified(one)
    free_shuffles(docs.sparkSession)
    higher = merged(more)
    left = rest
    for side in ("root_a", "root_b"):
        left = left.join(higher.select(F.col("root").alias(side), F.col("higher").alias(f"top_{side}")), side, "left")
    apart = F.coalesce("top_root_a", "root_a") != F.coalesce("top_root_b", "root_b")
    left = cut(left.where(apart).select("src", "dst").join(one, ["src", "dst"], "left_anti"))
    if not left.isEmpty():
        higher = merged(more.unionByName(verified(left)))
    free_shuffles(docs.sparkSession)
    whole = labelled.select("rep", "root").join(higher, "root", "left").select("rep", F.coalesce("higher", "root").alias("root"))
    roots = nodes.select("node", "rep").join(whole, "rep", "left").select("node", F.coalesce("root", "rep").alias("class"))
    return cut(rows.select("key", "digest", "node").join(roots, "node").select("key", "digest", "class"))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """Each row's key with component_id, the smallest key of its class."""
    found = classes(docs, text, key, size, similarity, segments, distance)
    least = found.groupBy("class").agg(F.min("key").alias("component_id"))
    return found.join(least, "class").select(F.col("key").alias(key), "component_id")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """One whole row of docs per class: that with the smallest key (null: last; then
    by the text's digest).  Rows are told apart by their texts, so keys may repeat."""
    found = classes(docs, text, key, size, similarity, segments, distance)
    free_shuffles(docs.sparkSession)  # the rows' texts are shuffled next
    best = found.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("best"))
    # a null key is told by a column of its own, so that the rows' texts are shuffled once
    # for the join and for repeated rows
    by = ["kept", "none", "digest"]
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias("kept")
    kept = best.select(number(F.col("best.key")), F.col("best.none").alias("none"), F.col("best.digest").alias("digest"))
    held = docs.select(F.struct("*").alias("row"), number(F.col(key).cast("long")), F.col(key).cast("long").isNull().alias("none"), digest_of(F.col(text)).alias("digest"))
    return held.join(kept, by).dropDuplicates(by).select("row.*")
