import random
import re

import numpy as np
import xxhash

from inkspan.llm import simhash


def fingerprint(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, seen, out = sorted(fps), set(), {}
    for i in ids:
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            x = todo.pop()
            near = {j for j in ids if j not in group and (fps[x] ^ fps[j]).bit_count() <= 2}
            group |= near
            todo += near
        seen |= group
        out |= dict.fromkeys(group, min(group))
    return out


def test_golay_keys_meet_within_two_errors():
    rng = random.Random(5)
    for _ in range(3000):
        v = rng.getrandbits(23)
        w = v
        for b in rng.sample(range(23), rng.randint(0, 2)):
            w ^= 1 << b
        keys = [set(simhash.golay_keys(np.array([x]))[1].tolist()) for x in (v, w)]
        assert keys[0] & keys[1] and {len(k) for k in keys} <= {1, 6}


def test_pairs_within_two_bits_share_a_key():
    rng = random.Random(6)
    for _ in range(1000):
        v = rng.getrandbits(64)
        w = v
        for b in rng.sample(range(64), rng.randint(0, 2)):
            w ^= 1 << b
        a, b = (set(simhash.keys_of(np.array([x], np.uint64))[1].tolist()) for x in (v, w))
        assert a & b


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_dedup(docs, **more).collect()
    fps = {i: fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    assert len(got) == len(rows)


def test_edge_cases_equal_brute_force(spark, edge_docs):
    check(spark, [(r.doc_id, r.text) for r in edge_docs.collect()])


def test_documents_equal_brute_force(spark, small):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_large_buckets_equal_brute_force(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(400), rng.randint(0, 3)):
            w[at] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    for bucket in (2, 16):
        check(spark, rows, bucket=bucket)


def test_rows_without_a_key_still_link(spark, monkeypatch):
    """A chain of fingerprints two bits apart whose middle has no key."""
    chain = [(1, 0b0), (None, 0b11), (3, 0b1111), (None, 0b1111), (None, 0xFF << 40), (8, 0xFF << 50), (8, 0xFF << 50)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("key", "fp"))
    got = simhash.near_dedup(spark.createDataFrame(chain, "key long, fp long").repartition(3)).collect()
    assert sorted(((r.doc_id or 0, r.component_id) for r in got), key=str) == sorted([(1, 1), (0, 1), (3, 1), (0, 1), (0, None), (8, 8), (8, 8)], key=str)


def test_empty_table(no_docs):
    assert simhash.op5(no_docs).count() == 0
