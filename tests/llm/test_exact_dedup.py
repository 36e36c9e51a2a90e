import hashlib
from collections import defaultdict

from inkspan.llm import exact_dedup


def test_equals_brute_force(edge_docs):
    docs = edge_docs.union(edge_docs.withColumn("doc_id", edge_docs.doc_id + 1000)).collect()
    by = defaultdict(list)
    for r in docs:
        by[r.text or ""].append(r.doc_id)
    spark = edge_docs.sparkSession
    frame = spark.createDataFrame(docs, edge_docs.schema).repartition(3)
    for memory in (exact_dedup.MEMORY_BYTES, 300):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame, memory=memory).collect()}
        assert len(got) == len(docs)
        for text, ids in by.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
                assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_spilling_recurses_and_compares_contents():
    records = [(b"%d" % (i % 50), i, 1, b"row %d" % i) for i in range(400)]
    for hash_of in (exact_dedup.content_hash, lambda c: 7, lambda c: len(c)):  # the latter two collide
        got = {c: (k, n, r) for c, k, n, r in exact_dedup.grace(records, memory=600, fan_out=4, hash_of=hash_of)}
        assert got == {b"%d" % i: (350 + i, 8, b"row %d" % (350 + i)) for i in range(50)}


def test_null_keys_and_empty_table(spark, no_docs):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {(None, None, 2, True), (3, 3, 2, True), (None, 3, 2, False)}
    assert exact_dedup.op6(no_docs).count() == 0


def test_survivors_are_whole_rows_one_per_text(spark, edge_docs, no_docs):
    rows = [(5, "A", 1), (5, "B", 2), (9, "B", 3), (7, "C", 4), (7, "C", 5), (None, "D", 6), (None, "D", 7), (None, "A", 8), (3, "", 9), (2, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content_hash int").repartition(3)
    for memory in (exact_dedup.MEMORY_BYTES, 300):
        got = {tuple(r) for r in exact_dedup.survivors(docs, memory=memory).collect()}
        assert got == {(5, "A", 1), (9, "B", 3), (7, "C", 5), (None, "D", 7), (3, "", 9)}
    both = edge_docs.union(edge_docs)
    assert len(exact_dedup.survivors(both).collect()) == len({r.text or "" for r in both.collect()})
    assert exact_dedup.survivors(no_docs).count() == 0 and exact_dedup.survivors(no_docs).columns == no_docs.columns
