import hashlib
import re
from collections import defaultdict

import pytest

from inkspan.llm import mixing


def reshared(sizes, weights, most=3):
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in stopped]
        if not open_:
            return stopped
        left = total - sum(stopped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


def check(docs, **more):
    rows = docs.collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    by = defaultdict(int)
    for r, n in zip(rows, size):
        by[r.source] += n
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    target = reshared(dict(by), {s: i % 3 + 1 for i, s in enumerate(names)})
    got = mixing.mix(docs, **more).collect()
    assert len(got) == len(rows)
    source = {r.doc_id: r.source for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in by:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5), **more).collect()}
    return got


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_documents_and_coarse_ranges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fine = check(docs)
    coarse = check(docs, ranges=2)
    assert {(r.doc_id, r.taken) for r in fine} == {(r.doc_id, r.taken) for r in coarse}


def test_pareto_order_takes_the_smallest_ratios(spark):
    rows = [(i, "w " * 10, s) for i in range(400) for s in "ab"]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}

    def u(i):
        digest = hashlib.md5(("w " * 10).encode()).hexdigest()
        return (int(hashlib.md5(f"mix-1:{i}:{digest}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    extra = [i for i in got if rows[i][2] == "a" and got[i].copies > got[i].target // got[i].source_size]
    rest = [i for i in got if rows[i][2] == "a" and i not in set(extra)]
    assert max(map(u, extra)) < min(map(u, rest))


def test_weights_shift_the_copies(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weight=F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0)).collect()
    light, heavy = (sum(r.copies for r in got if (r.doc_id < 2000) == h and r.doc_id % 2) for h in (False, True))
    assert 2.0 < heavy / light < 4.0


def totals(rows):
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    return taken, target


def test_null_and_repeated_keys_reach_the_targets(spark):
    for key in (lambda i: None, lambda i: i if i % 2 else None, lambda i: i % 7, lambda i: 5):
        for text in (lambda i: f"t{i} " * 10, lambda i: "w " * 10):
            docs = spark.createDataFrame([(key(i), text(i), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
            got = mixing.mix(docs).collect()
            taken, target = totals(got)
            assert len(got) == 400 and all(abs(taken[s] - target[s]) <= 5 for s in "ab"), (taken, target)
            rows = mixing.taken_rows(docs.withColumn("extra", mixing.F.lit(1))).groupBy("source").count().collect()
            assert {r["source"]: 10 * r["count"] for r in rows} == dict(taken)


def test_heavy_documents_stop_at_the_limit_and_the_rest_is_shared(spark):
    rows = [(i, "w " * (400 if i < 10 else 10), "ab"[i % 2]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weight=lambda size: mixing.F.when(size > 100, 50.0).otherwise(1.0)).collect()
    taken, target = totals(got)
    assert all(abs(taken[s] - target[s]) <= 200 for s in "ab")
    assert {r.copies for r in got if r.size == 400 and r.source == "b"} == {3}


def test_sizes_change_the_odds_of_op7(spark):
    docs = spark.createDataFrame([(i, "w " * (8 if i % 4 < 2 else 1024), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = [r for r in mixing.op7(docs).collect() if r.target < r.source_size]
    short, long_ = (sum(r.taken / r.size for r in got if (r.size == 8) == s) for s in (True, False))
    assert long_ > 1.5 * short


def test_empty_table(no_docs):
    assert mixing.op7(no_docs).count() == 0
