import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs
from inkspan.llm import token_output, tokens
from inkspan.llm.common import delete_path, scratch_path


def test_feistel_is_a_permutation_and_inverts():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        f = token_output.Feistel(n, "k")
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert f.sequences(slots).tolist() == list(range(n))
    assert token_output.Feistel(1000, "a").slots(np.arange(1000)).tolist() != token_output.Feistel(1000, "b").slots(np.arange(1000)).tolist()


def expected(docs, length):
    out = {}
    for r in docs.collect():
        ids = tokens.document_ids(r.text, tokens.default_vocabulary())
        out[r.doc_id] = [ids[i : i + length] for i in range(0, len(ids), length)]
    return out


def test_shards_round_trip_and_resume(spark, small, edge_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(edge_docs.select(edge_docs.doc_id + 10**6, "text"))
    want = expected(docs, 64)
    folder = scratch_path(spark, "test-shards")
    try:
        shards = sorted(token_output.write(docs, folder, length=64, per_shard=300).collect(), key=lambda r: r.shard)
        fs, _ = pafs.FileSystem.from_uri(folder)
        paths = [r.path for r in shards]
        whole = sum(map(len, want.values()))
        assert [r.records for r in shards] == [300] * (whole // 300) + [whole % 300] * bool(whole % 300)
        got = defaultdict(dict)
        slots = []
        for slot, records in token_output.iterate(fs, paths, length=64):
            slots += range(slot, slot + len(records))
            for r in records:
                got[int(r["doc_id"])][int(r["piece"])] = r["ids"][: r["length"]].tolist()
        assert slots == list(range(whole))
        assert {d: [p[i] for i in range(len(p))] for d, p in got.items()} == {d: [x.tolist() for x in p] for d, p in want.items()}
        for at in (0, 1, 299, 300, 777, whole - 1):
            rest = list(token_output.iterate(fs, paths, at, length=64))
            assert rest[0][0] == at and sum(len(r) for _, r in rest) == whole - at
    finally:
        delete_path(spark, folder)


def test_query_equals_brute_force(spark, edge_docs, no_docs):
    want = expected(edge_docs, token_output.LENGTH)
    got = token_output.op4(edge_docs).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == {(d, i, len(x), zlib.crc32(x.tobytes())) for d, p in want.items() for i, x in enumerate(p)}
    assert token_output.op4(no_docs).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.length) for r in token_output.op4(rows).collect()) == [(0, 2), (0, 2), (2, 1)]
