import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkspan.llm import packing


def test_plan_is_whole_and_tight():
    rng = random.Random(3)
    for capacity, n in ((12, 40), (100, 3000), (2048, 5000)):
        counts = Counter(min(capacity, max(1, int(rng.lognormvariate(0, 1) * capacity / 4))) for _ in range(n))
        runs = packing.pack(counts, capacity)
        fill, ranks = defaultdict(list), defaultdict(set)
        for length, rank, k, sequence, offset in runs:
            for i in range(k):
                fill[sequence + i].append((offset, length))
                assert rank + i not in ranks[length]
                ranks[length].add(rank + i)
        assert {x: len(r) for x, r in ranks.items()} == dict(counts)
        assert all(r == set(range(len(r))) for r in ranks.values())
        for items in fill.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        large = sum(k for x, k in counts.items() if 2 * x > capacity)
        bound = max(large, -(-sum(x * k for x, k in counts.items()) // capacity))
        assert len(fill) <= 1.02 * bound + 1


def test_query_equals_the_tokenizer(spark, small, edge_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(edge_docs.select(edge_docs.doc_id + 10**6, "text"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    by, bins = defaultdict(list), defaultdict(list)
    for r in packing.op3(docs.repartition(3)).collect():
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert by.keys() == ids.keys()
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) == len(ids[i]) and all(r.length == 2048 for r in rows[1:])
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:]))
        assert sum(n for _, n in items) <= 2048
    bound = max(sum(2 * r.length > 2048 for rows in by.values() for r in rows), -(-sum(map(len, ids.values())) // 2048))
    assert len(bins) <= 1.02 * bound + 1


def test_empty_and_repeated(spark, no_docs):
    assert packing.op3(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "a b c")] * 5 + [(None, None)], "doc_id long, text string")
    assert packing.op3(rows).count() == 6


def test_white_space_runs_take_the_full_pattern():
    from inkspan.llm import tokens

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(8)
    parts = ["a", "Bé", "1", "?", "'s", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "日"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert tokens.plain_ids(text, tokens.default_vocabulary()) == t.encode(text, add_special_tokens=False).ids
