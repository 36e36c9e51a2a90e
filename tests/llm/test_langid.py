import zlib

import numpy as np
from inkspan.llm import langid
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.op10(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_languages_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.op10(x).collect()) for x in (docs, other))
    assert a == b


def test_buckets_are_those_of_the_subwords():
    def slow(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        stream = "\0" + "\0".join(words) + "\0"
        out = []
        for n in (2, 3, 4):
            for i in range(len(stream) - n + 1):
                g = stream[i : i + n]
                if "\0" in g[1:-1]:
                    continue
                h = ord(g[0])
                for c in g[1:]:
                    h = (h * 0x9E3779B1 + ord(c)) % 2**32
                h = ((h ^ n) * 0x85EBCA6B) % 2**32
                out.append((h ^ (h >> 13)) % langid.BUCKETS)
        return sorted(out)

    for text in ("Hello, wörld 12 a", "x", "日本 語", "a-b-c " * 5):
        assert sorted(langid.buckets_of(text).tolist()) == slow(text)
    assert langid.buckets_of("") is None and langid.buckets_of("12 !?") is None and langid.buckets_of(None) is None


def test_rejection_threshold():
    score, right = np.array([0.9, 0.8, 0.7, 0.6]), np.array([True, True, False, True])
    assert langid.threshold_for(score, right, 0.0) == 0.8
    assert langid.threshold_for(score, right, 0.3) == 0.6
    assert langid.threshold_for(score, ~right, 0.0) == 1.0


def test_judgement_equals_plain_loops():
    rng = np.random.default_rng(2)
    model = langid.Model(("de", "en", "fr"), rng.normal(0, 1, (langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, -0.2, 0.0]), 0.7, 0.5)
    texts = ["Hello wörld", "x", "12 !?", None, "", "lange Wörter und kurze", "a " * 5000]
    langs, scores, rejected = model.judge(texts)
    for text, lang, score, no in zip(texts, langs, scores, rejected, strict=True):
        ids = langid.buckets_of(text)
        if ids is None:
            assert (lang, score, no) == ("und", 0.0, True)
            continue
        logits = [(sum(float(model.table[i, k]) for i in ids) / len(ids) + model.bias[k]) / 0.7 for k in range(3)]
        odds = np.exp(np.array(logits) - max(logits))
        best = int(odds.argmax())
        assert lang == model.languages[best] and abs(score - odds[best] / odds.sum()) < 1e-6 and no == (score < 0.5)


def test_training_separates_what_differs():
    bags = [(np.array([k, 10 + k], np.uint16), np.array([3, 1], np.uint32)) for k in [1, 2, 3] * 20]
    model = langid.train(bags, ["a", "b", "c"] * 20)
    for (ids, counts), lang in zip(bags, ["a", "b", "c"] * 20, strict=True):
        logits = (counts / counts.sum()) @ model.table[ids] + model.bias
        assert model.languages[int(logits.argmax())] == lang
    assert langid.train([], []).judge(["text"])[0] == ["und"]


def test_rows_without_a_key_are_drawn_by_their_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda bags, langs: seen.append(langs))
    rows = [(None, f"words {i} " + chr(97 + i % 26) * (1 + i % 9), "en") for i in range(2000)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert 50 <= len(seen[0]) <= 160


def test_edges(edge_docs, no_docs):
    got = {r.doc_id: r for r in langid.op10(edge_docs).collect()}
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for i, t in texts.items():
        assert (got[i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert langid.op10(no_docs).count() == 0
    unknown = langid.op10(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
