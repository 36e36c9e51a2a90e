import random

import numpy as np
from inkspan.llm import toxicity


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vile,", "nasty", f"grub{rng.randrange(200)}"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), {r[0]: r[2] for r in rows}


def test_held_out_documents_and_rare_expressions(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.op8(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 60 < len(held) < 180
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.op8(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def brute_log_likelihoods(texts, discount):
    """P(word | class) of every word, straight from the definition."""
    follows = {0: {}, 1: {}}
    for text, toxic in texts:
        before = ""
        for w in toxicity.words_of(text):
            follows[toxic].setdefault(w, set()).add(before)
            before = w
    count = {c: {w: len(s) for w, s in follows[c].items()} for c in (0, 1)}
    n = {c: sum(count[c].values()) for c in (0, 1)}
    share = {c: sum(min(k, discount) for k in count[c].values()) / n[c] for c in (0, 1)}
    classes = {w: sum(w in count[c] for c in (0, 1)) for w in {**count[0], **count[1]}}
    whole = sum(classes.values())
    return {c: {w: max(count[c].get(w, 0) - discount, 0) / n[c] + share[c] * classes[w] / whole for w in classes} for c in (0, 1)}, share


def test_log_likelihoods_against_brute_force(spark):
    docs, _, truth = corpus(spark, 150)
    texts = [(r.text, truth[r.doc_id]) for r in docs.collect()]
    frame = spark.createDataFrame(texts + texts[:20], "text string, toxic int")
    met = frame.mapInArrow(toxicity._contexts, "x string, toxic int, before string").distinct()
    for discount in (1, 3):
        got, other = toxicity.ratios_of(met, discount)
        p, share = brute_log_likelihoods(texts, discount)
        assert all(abs(sum(x.values()) - 1) < 1e-9 for x in p.values())
        assert abs(other - np.log(share[1] / share[0])) < 1e-9
        assert all(abs(got.get(w, other) - np.log(p[1][w] / p[0][w])) < 1e-9 for w in p[0])


def test_evidence_is_that_of_the_worst_window():
    m = toxicity.Model({"vile": 3.0, "calm": -1.0}, 0.5, 2, 1.0, -1.0)
    r = toxicity._Ratios(m)
    assert toxicity.evidence_of("VILE, -- calm plain plain", r) == 1.0
    assert toxicity.evidence_of("calm " * 50_000 + "plain vile", r) == 1.75
    assert toxicity.evidence_of("vile", r) == 3.0
    assert toxicity.evidence_of(None, r) == toxicity.evidence_of(" ", r) == toxicity.evidence_of("?!", r) == 0.5
    assert m.score(np.array([1.0]))[0] == 0.5


def test_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs, labels, _ = corpus(spark, 200)
    wide = docs.union(docs).select("*", *(F.lit(9).alias(c) for c in ("key", "k", "toxic", "evidence", "score", "held_out", "curve", "weight")))
    got = toxicity.op8(wide, labels).collect()
    assert len(got) == 400 and len({(r.doc_id, r.score) for r in got}) == 200


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.op8(edge_docs, labels).collect()} == {0.0}
    assert toxicity.op8(no_docs, labels).count() == 0
    _, labels, _ = corpus(spark, 100)
    docs, _, _ = corpus(spark, 100)
    both = docs.union(edge_docs.select(edge_docs.doc_id + 10**6, "text"))
    assert toxicity.op8(both, labels).count() == 100 + edge_docs.count()
