import random
import time
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa

from inkspan.llm import common, similar


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    m = len(a & b)
    return a == b or 10 * m >= 8 * len(a | b)


def brute(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in sets:
            if j < i and alike(sets[i], sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def drifting(seed=3):
    """Texts in chains of changes, single texts, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        now = [word() for _ in range(rng.choice([6, 30, 120, 200]))]
        for _ in range(rng.choice([1, 4, 30])):
            rows.append((len(rows), " ".join(now)))
            now = list(now)
            for at in rng.sample(range(len(now)), rng.choice([1, 1, 2, 5]) * len(now) // 100 + 1):
                now[at] = word()
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(rng.randrange(25))])) for k in range(60)]
    return rows


def test_components_equal_brute_force(spark, edge_docs):
    rows = drifting()
    for given in (rows, [(r.doc_id, r.text) for r in edge_docs.collect()]):
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        got = similar.near_dedup(docs).collect()
        assert {r.doc_id: r.component_id for r in got} == brute(given) and len(got) == len(given)


def test_representatives_are_told_apart_by_text(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base + " end"
    rows = [(None, base, 1), (None, near, 2), (None, "other " * 9, 3), (4, "one two three", 4), (4, "four five six", 5), (4, "four five six", 5), (None, None, 6), (8, "", 7), (9, near, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)
    got = {tuple(r) for r in similar.representatives(docs).collect()}
    assert got == {(9, near, 8), (None, "other " * 9, 3), (4, "one two three", 4), (4, "four five six", 5), (8, "", 7)}


def test_popcounts_of_parities_bound_the_difference():
    rng = random.Random(5)
    for n in (10, 400, 3000):
        a = {rng.getrandbits(64) - 2**63 for _ in range(n)}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) - 2**63 for _ in range(n // 10)}
        p, q = (similar.parities(np.array(sorted(x), np.int64)).view(np.uint64) for x in (a, b))
        assert int(np.bitwise_count(p ^ q).sum()) <= len(a ^ b)


def bucket_of(rows, cuts=1):
    """Rows (key, rep, label, f, g) as batches."""
    for part in np.array_split(np.array(rows, np.int64), cuts):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["gkey", "rep", "label", "f", "g"])


def joined(rule, rows, cuts=1):
    found = [(a, b) for batch in similar._tries(rule)(bucket_of(rows, cuts)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    root = {r[1]: r[1] for r in rows}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in found:
        root[top(a)] = top(b)
    return {r[1]: min(q[1] for q in rows if top(q[1]) == top(r[1])) for r in rows}, found


def test_buckets_larger_than_a_part_lose_no_link(monkeypatch):
    rng = random.Random(6)
    rule = similar.Rule(Fraction("0.8"), similar.DISTANCE)
    far = (1 << 58) - 1  # differs from 0 in 58 bits
    first_far = [(1, 0, 0, far, 0)] + [(1, i, i, 0, 0) for i in range(1, 250)]
    chain = [(1, i, i, (1 << (i * 20 % 58)) - 1 if i % 7 else rng.getrandbits(58), (1 << (i % 58)) - 1) for i in range(300)]
    several = [(k, 1000 * k + i, 1000 * k + i, (far if (i + k) % 3 == 0 else 0) ^ (1 << rng.randrange(50)), 0) for k in (1, 2, 3) for i in range(120)]
    for rows in (first_far, chain, several):
        monkeypatch.setattr(similar, "PART", 100_000)
        whole, _ = joined(rule, rows)
        for part, cuts in ((40, 1), (40, 9), (7, 5), (1000, 30)):
            monkeypatch.setattr(similar, "PART", part)
            assert joined(rule, rows, cuts)[0] == whole
    near = {r[1]: {q[1] for q in chain if (r[3] ^ q[3]).bit_count() + (r[4] ^ q[4]).bit_count() <= similar.DISTANCE} for r in chain}
    monkeypatch.setattr(similar, "PART", 30)
    got, _ = joined(rule, chain, 4)
    assert all(got[a] == got[b] for a, others in near.items() for b in others)


def test_a_bucket_of_equal_rows_is_linear():
    rule = similar.Rule(Fraction("0.8"), similar.DISTANCE)
    began = time.perf_counter()
    n = 40_000
    ids = np.arange(n, dtype=np.int64)
    assert len(similar._search(rule, ids, ids, np.zeros(n, np.int64), np.zeros(n, np.int64))) == n - 1
    assert time.perf_counter() - began < 20


def test_components_above_a_cell(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL", 8)
    rows = drifting(4)
    got = similar.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)


def test_empty_table(no_docs):
    assert similar.near_dedup(no_docs).count() == 0


def test_nearest_keys_spare_tries_of_near_copies():
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(w if j not in (i % 200, i * 7 % 200) else f"v{i}" for j, w in enumerate(base)) for i in range(300)]
    fps, n = np.array([similar.word_fingerprint(t) for t in texts]), len(texts)
    f, g = similar._packed(fps)

    def tried(label, **how):
        rows, keys = similar.keys_of(fps, [0], **how)
        order = np.lexsort((rows, keys))
        rows, keys = rows[order], keys[order]
        tries = similar._tries(similar.Rule(Fraction("0.8"), similar.DISTANCE))
        cuts = np.flatnonzero(np.diff(keys)) + 1  # each key in a task of its own
        tasks = [pa.RecordBatch.from_arrays([pa.array(c) for c in (k, r, label[r], f[r], g[r])], ["gkey", "rep", "label", "f", "g"]) for k, r in zip(np.split(keys, cuts), np.split(rows, cuts), strict=True)]
        return [p for t in tasks for b in tries(iter([t])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    own = np.arange(n)
    rows, _ = similar.keys_of(fps, [0], nearest=True)
    assert rows.tolist() == own.tolist()  # one nearest codeword of each segment
    first, label = tried(own, nearest=True), own.copy()
    for a, b in first:
        label[a] = min(label[a], b)
    assert 2 * (len(first) + len(tried(label))) < len(tried(own))
    every = similar.keys_of(fps, list(range(10)))
    rounds = [similar.keys_of(fps, p) for p in ([0], [1, 2, 3], [4, 5, 6], [7, 8, 9])]
    assert sorted(zip(*every, strict=True)) == sorted(zip(*(np.concatenate(x) for x in zip(*rounds, strict=True)), strict=True))


def test_shuffle_files_of_finished_steps_are_freed(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before, made, kept = files(), [], []
    for _ in range(2):
        rows = spark.range(20_000).selectExpr("id", "id % 100 as g").mapInArrow(lambda b: b, "id long, g long")
        kept.append(common.cut(rows.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: b, "id long, g long").distinct()))
        made.append(files() - before.union(*made))
        common.free_shuffles(spark)
    time.sleep(1)
    assert all(made) and not made[0] & files()  # the last step's may stay until the next call
    assert [k.count() for k in kept] == [20_000, 20_000]


def test_representatives_shuffle_texts_once(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (0, "g h i j k l", "y"), (0, "g h i j k l", "y"), (0, "m n o p q", None), (2, None, "z"), (1, "", "z")]
    got = similar.representatives(spark.createDataFrame(rows, "doc_id long, text string, none string"))
    assert sorted(got.collect(), key=str) == sorted([(None, "a b c d e f", "x"), (0, "g h i j k l", "y"), (0, "m n o p q", None), (1, "", "z")], key=str)
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3  # classes, kept keys and, once, the rows
