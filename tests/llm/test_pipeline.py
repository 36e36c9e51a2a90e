import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from inkspan.llm import mixing, tokens

from .test_quality import brute
from .test_similar import brute as brute_groups


def passes(text):
    n, chars, symbols, dup, repeat = brute(text)
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    alpha = sum(any(c.isalpha() for c in w) for w in words)
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 12 * n or 2 * dup > len(lines) or 10 * alpha < 7 * n or 2 * upper > letters)


def test_each_stage_equals_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").limit(40)
    copies = first.withColumn("doc_id", first.doc_id + 10**6)
    near = first.withColumn("doc_id", first.doc_id + 2 * 10**6).selectExpr("doc_id", "concat(text, ' end') as text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, "w " * 80, "en", None, 1), (5 * 10**6, None, None, None, None), (6 * 10**6, "", "en", "src0", 0)], docs.schema)
    docs = docs.union(copies).union(near).union(odd).withColumns({"copies": docs.n_chars, "kept": docs.lang})
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    out = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)

    want = {i: t for i, t in rows.items() if passes(t)}
    got = out["quality_rules"].collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)  # the row without a key repeats one word

    by = defaultdict(list)
    for i, t in want.items():
        by[t].append(i)
    want = {max(ids): t for t, ids in by.items()}
    got = out["exact_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)

    groups = brute_groups(list(want.items()))
    want = {i: t for i, t in want.items() if groups[i] == i}
    got = out["near_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)

    taken = {r.doc_id: r.copies for r in mixing.mix(out["near_dedup"], weight=mixing.size_digits).collect() if r.copies}
    got = out["mixing"].collect()
    assert Counter(r.doc_id for r in got) == taken and all(r.text == want[r.doc_id] for r in got)

    lengths = defaultdict(int)
    for r in out["packing"].collect():
        lengths[r.doc_id] += r.length
    vocabulary = tokens.default_vocabulary()
    assert lengths == {i: n * len(tokens.document_ids(want[i], vocabulary)) for i, n in taken.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_a_key_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in ("alpha", "beta", "gamma"))
    rows = [(5, a), (5, b), (9, b), (7, c), (7, c), (None, a), (None, b + " end")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    assert pipeline.quality_stage(spark, docs, "").count() == 7
    assert sorted((str(r.doc_id), r.text) for r in pipeline.exact_stage(spark, docs, "").collect()) == sorted([("5", a), ("9", b), ("7", c), ("None", b + " end")])
    assert sorted((str(r.doc_id), r.text) for r in pipeline.near_stage(spark, docs, "").collect()) == sorted([("5", a), ("5", b), ("7", c)])


def test_repeated_rows_are_not_multiplied(spark):
    rows = [(i, "words of text number " + " ".join(f"w{i}x{j}" for j in range(60)), "en", "ab"[i % 2], 1) for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.doc_id for r in pipeline.mixing_stage(spark, docs, "").collect())
    want = Counter()
    for r in mixing.mix(docs, weight=mixing.size_digits).collect():
        want[r.doc_id] += r.copies
    assert got == {i: n for i, n in want.items() if n} and max(got.values()) <= 6


def test_run_equals_its_stages_and_takes_empty_tables(spark, small, tmp_path, no_docs):
    assert pipeline.run(spark, small).count() > 0
    no_docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0
