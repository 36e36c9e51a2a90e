"""Steps whose cost must follow the input."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from inkspan.operators import frequency, lexical, passages as packing, profiles, rolling, spaces, supervised, verifier, witness
from inkspan.sources import manifest


def test_ratio_over_texts_equals_ratio_over_words(spark):
    rng = random.Random(3)
    texts = [(d, t, [f"w{int(rng.expovariate(0.1))}" for _ in range(rng.choice([0, 1, 3, 40, 200]))]) for d in ("a", "b", "c") for t in range(12)] + [("d", 0, ["x", "y", "x"]), ("d", 1, ["y"])]
    frame = spark.createDataFrame(texts, "doc string, text int, words array<string>")
    words = []
    for d in "abcd":
        flat = [w for name, _, own in texts if name == d for w in own]
        words += [(d, i, w) for i, w in enumerate(flat)]
    plain = {r.doc: r.mattr for r in frequency.mattr(spark.createDataFrame(words, "doc string, pos int, word string"), ["doc"], 10).collect()}
    for part in (4, 16, 8192):
        assert {r.doc: r.mattr for r in frequency.mattr_texts(frame, ["doc"], "text", 10, part).collect()} == pytest.approx(plain)


def test_listed_pairs_make_no_row_of_other_words(spark):
    frame = spark.createDataFrame([(1, "the a of b c d the the".split()), (2, ["x"] * 500), (3, [])], "doc int, words array<string>")
    pairs = frequency.word_pairs(frame, ["doc"], 4, ["the", "of"])
    assert sorted(map(tuple, pairs.collect())) == [(1, "of", "the", 4), (1, "the", "of", 2), (1, "the", "the", 1)]
    assert frequency.word_pairs(frame.where("doc > 1"), ["doc"], 4, ["the"]).agg(F.count("*").alias("n")).first().n == 0


def test_character_runs_are_taken_in_one_pass(spark):
    texts = [(1, "ab\ncd"), (2, "a"), (3, ""), (4, "x😀y😀z"), (5, "été " * 40_000)]
    got = {r.id: r.g for r in spark.createDataFrame(texts, "id int, text string").select("id", frequency.char_ngrams(F.col("text"), 4).alias("g")).collect()}
    for i, t in texts:
        padded = f" {t} "
        assert got[i] == [padded[k : k + 4] for k in range(len(padded) - 3)]


def passages(spark, n=12):
    words = lambda i: [f"w{(i * k) % 17}ing" for k in range(1, 30 + i)]
    rows = [(str(i), f"k{i % 6}", f"a{i % 3}", "en", "g", "t", words(i)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, work string, author string, language string, genre string, topic string, words array<string>")


def test_vectors_are_made_where_the_passage_is(spark):
    p = passages(spark)
    space = lexical.gram_space(p, 50)
    for frame in (lexical.static_vectors(p, ["w1ing"], ["ing"]), lexical.gram_vectors(p, space, ("work",))):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    row = lexical.static_vectors(p.where("id = '1'"), ["w1ing"], ["ing", "w1ing"], ("work",)).first()
    own = p.where("id = '1'").first().words
    assert row.work == "k1" and row.static == pytest.approx([own.count("w1ing") * 100 / len(own), 100.0, sum(w.endswith("w1ing") and len(w) > 6 for w in own) * 100 / len(own), sum(map(len, own)) / len(own), 0.0, len(set(own)) / len(own)])
    counts = {(r.id, r.gram): r.n for r in lexical.gram_counts(p, "id").collect()}
    known = {r.gram: (r.i, r.idf) for r in space.table.collect()}
    for r in lexical.gram_vectors(p, space).collect():
        want = {i: (1 + math.log(counts[r.id, g])) * idf for g, (i, idf) in known.items() if (r.id, g) in counts}
        norm = math.sqrt(sum(v * v for v in want.values()))
        assert list(r["at"]) == sorted(want) and r.x == pytest.approx([want[i] / norm for i in sorted(want)])


def test_vectors_are_made_few_at_a_time(spark):
    words = [[f"w{(i * k) % 17}ing" for k in range(i % 40)] for i in range(lexical.AT_ONCE * 3 + 5)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(len(words))], "words": words})
    parts = list(lexical.gram_rows([batch], {"ing": 0, " w1": 1}, np.array([1.0, 2.0]), ("id",)))
    assert [len(at) for _, at, _ in parts] == [256, 256, 256, 6] and [i for kept, _, _ in parts for i in kept[0].to_pylist()] == batch["id"].to_pylist()
    p = passages(spark)
    space = lexical.gram_space(p, 50)
    plain = {r.id: (r["at"], r.x) for r in lexical.gram_vectors(p, space).collect()}
    for r in lexical.sparse_vectors(p, space, ("id", "work")).collect():
        assert r.x.size == space.size and (list(r.x.indices), list(r.x.values)) == plain[r.id]


def test_only_passages_of_pairs_are_described(spark):
    p = passages(spark)
    pairs = spark.createDataFrame([("1", "2"), ("2", "3")], "a string, b string")
    assert {r.id for r in verifier._paired(p, pairs).collect()} == {"1", "2", "3"}


def test_blocks_learn_what_one_matrix_does(spark):
    texts = [("the red fox ran home", 0), ("a red fox slept", 0), ("blue whales sing deep", 1), ("the blue sea sings", 1), ("grey stones", 2)] * 3
    idf = np.ones(supervised.HASHED)
    raw = [supervised.hashed_counts(t) for t, _ in texts]
    rows = [(at, supervised._weighed(at, x[at], idf)) for x in raw for at in [np.flatnonzero(x)]]
    y = np.array([c for _, c in texts])
    blocks = spark.sparkContext.parallelize([(rows[:7], y[:7]), (rows[7:], y[7:])], 2)
    got = supervised.fit_shared(blocks, np.bincount(y).astype(float), 60)
    want = supervised.fit_linear(np.array([supervised.hashed_features(t, idf) for t, _ in texts]), y, 3, 300)
    x = supervised._dense(rows)
    assert np.abs(x @ got - x @ want).max() < 0.05 and ((x @ got).argmax(1) == y).all()


def test_few_rounds_reach_the_minimum(spark):
    rng = np.random.default_rng(8)
    y = np.repeat([0, 1, 2], [150, 40, 10])
    rows = [(at, v / np.linalg.norm(v)) for c in y for at in [np.unique([*range(20), *rng.integers(20, 120, 30), *rng.integers(100 * c, 100 * c + 150, 6)])] for v in [rng.uniform(0.5, 2, len(at)) * np.where(at < 20, 4, 1)]]
    sizes, x = np.bincount(y).astype(float), supervised._dense(rows)
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "rounds")
    try:
        w = supervised.fit_shared(sc.parallelize([(rows[:120], y[:120]), (rows[120:], y[120:])], 2), sizes)
        jobs = sc.statusTracker().getJobIdsForGroup("rounds")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sign = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    weight = np.where(sign > 0, 200 / (2 * sizes), 200 / (2 * (200 - sizes)))
    slope = lambda w: w - 2 * x.T @ (weight * sign * np.maximum(0, 1 - sign * (x @ w)))
    assert len(jobs) < 150 and (np.abs(slope(w)).max(0) <= 0.0101 * np.abs(slope(0 * w)).max(0)).all()


def test_equal_pairs_of_texts_are_compared_once(spark):
    texts = ["a b c", "a b c", "a x c", "", "q r", None]
    rows = [("en", "B", w, "s", "1", str(v % 2), texts[(v + k) % 6], 3) for w, n in (("S", 9), ("X", 7)) for v in range(n) for k in (0, 3)]
    units = spark.createDataFrame(rows, "language string, book string, witness string, source string, chapter string, verse string, text string, n_tokens int")
    chosen = witness.choices(units)
    plain = witness.similarity_by_book(witness.compared(witness.aligned(units, chosen))).collect()
    got = witness.similarity(units, chosen).collect()
    assert [r.asDict() for r in got] == [pytest.approx(r.asDict()) for r in plain] and plain[0].aligned > 50


def test_suffixes_are_counted_in_the_row(spark):
    rows = [(1, ["going", "ing", "xing", "being", "ended", "the"]), (1, ["singing"]), (2, []), (2, None), (3, ["word"]), (None, ["going"])]
    texts = spark.createDataFrame(rows, "doc long, words array<string>")
    suffixes = ["ing", "ed"]
    got = frequency.suffix_rates_texts(texts, ["doc"], suffixes)
    words = texts.select("doc", F.explode("words").alias("word"))
    want = frequency.suffix_rates(frequency.word_counts(words, ["doc"]), ["doc"], suffixes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "ed", 100 / 7), (1, "ing", 300 / 7)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 0  # no row is a word


def test_pairs_are_measured_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(supervised, "BLOCK", (2, 3))
    vectors = [[1.0, 2.0], [0.0, 0.0], [3.0, -1.0], [0.5, 0.5], [1.0, None], [1.0], [2.0, 2.0], [-1.0, 4.0]]
    e = spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(vectors)] + [(8, None, 0), (9, [1.0, 1.0], None), (6, [7.0, 1.0], 0)], "key long, v array<float>, label int")
    q = e.where("key % 3 = 0")
    plain = q.select("label", F.col("key").alias("a"), F.col("v").alias("l")).join(e.select("label", F.col("key").alias("b"), F.col("v").alias("r")), "label").where("a <> b and l is not null and r is not null")
    want = supervised.pair_features(plain, "l", "r").drop("l", "r")
    got = supervised.pair_blocks(q, e, "key", "v", "label")
    order = lambda x: sorted(map(tuple, x.select("label", "a", "b", "absolute", "rms", "cosine").collect()), key=str)
    assert order(got) == order(want) and want.count() > 10
    assert "v" not in got.columns and "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no vector goes with a pair


def test_gallery_means_make_no_pairs(spark):
    rows = [(k, [float(k % 5), float(k % 3), 1.0 - k % 2], k % 2, k % 3) for k in range(40)] + [(12, [1.0, 5.0, 2.0], 0, 0), (41, [0.0, 0.0, 0.0], 1, 2), (42, None, 0, 0), (50, [1.0, 1.0, 1.0], 7, 2)]
    e = spark.createDataFrame(rows, "key long, v array<float>, label int, work int")
    q = e.where("key % 6 = 0 or key > 40")
    pairs = q.select("label", F.col("key").alias("query"), F.col("v").alias("l")).join(e.select("label", "work", F.col("key").alias("b"), F.col("v").alias("r")), "label").where("query <> b and l is not null and r is not null")
    plain = supervised.pair_features(pairs, "l", "r").select("query", F.col("label").alias("author"), "work", F.col("cosine").alias("score"))
    key = ("query", "author", "works")
    want = {tuple(r[k] for k in key): r.score for r in supervised.gallery_scores(plain).collect()}
    found = supervised.gallery_means(q, e, "key", "v", "label", "work")
    assert {tuple(r[k] for k in key): r.score for r in found.collect()} == pytest.approx(want) and len(want) > 7
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_exact_windows_need_no_row_a_token(spark):
    rng = random.Random(5)
    rows = [(book, f"{book}{k}", k, [f"w{i}" for i in range(rng.choice([0, 1, 3, 4, 9, 23]))]) for book, n in (("a", 30), ("b", 2), ("c", 1)) for k in range(n)] + [(None, "x", 1, ["w"] * 11)]
    u = spark.createDataFrame(rows, "book string, id string, seq long, words array<string>")
    want = packing.exact(u.select("book", "id", "seq", F.posexplode("words").alias("pos", "word")), 5, ("book",))
    got = packing.exact_units(u.select("book", "id", "seq", F.size("words").alias("n")), 5, ("book",))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str) and got.count() > 30


def test_series_are_measured_many_at_a_time(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, [rng.choice(["a", "bb", "ccc", "dddd", "eeeeé"]) for _ in range(n)]) for k, n in enumerate([0, 3, 20, 45, 45, 80])] + [(None, ["x"] * 30)], "doc long, words array<string>")
    wide = rolling.windows(docs, "words", 6, 3).select("doc", "start", "window")
    shape = "doc long, start int, mean_length double, short double, variety double"
    names = ["mean_length", "short", "variety"]
    plain = wide.mapInPandas(rolling.text_features, shape).toPandas()
    rows = wide.mapInArrow(rolling.text_features_arrow, shape)
    assert sorted(map(tuple, rows.fillna(-1).collect())) == sorted(tuple(r) for r in plain.fillna({"doc": -1}).itertuples(index=False))
    found = rolling.change_points(rows, ["doc"], "start", names, permutations=50)
    got = {r.doc: tuple(r)[1:] for r in found.collect()}
    for doc, part in plain.fillna({"doc": -1}).groupby("doc"):
        x = part.sort_values("start")[names].to_numpy(float)
        # a small block takes the orders one after another, as before
        assert got[None if doc == -1 else int(doc)] == (len(x), *rolling.change_point(x, permutations=50, block=1))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_are_pooled_in_one_shuffle(spark):
    member = spark.createDataFrame([("p", str(k), 1 + k % 3) for k in range(9)] + [("q", "20", 4), ("q", "21", 1), ("r", "30", 5)], "passage_id string, id string, n_tokens int")
    own = spark.createDataFrame([(str(k), k / 10, "ab"[k % 2], ["t", f"u{k % 4}"]) for k in range(8)] + [("20", 1.0, "z", ["t"])], "id string, x double, kind string, tags array<string>")
    got = profiles.pooled(own, member, ["x"], ["kind"])
    assert [(r.passage_id, round(r.x, 6), round(r.coverage, 6), r.kind) for r in got.orderBy("passage_id").collect()] == [("p", 0.35, round(15 / 18, 6), "a"), ("q", 1.0, 0.8, "z")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    tags = {r.passage_id: r.tags for r in profiles.pooled(own, member, ["x"], ["kind"], "tags").collect()}
    assert tags == {"p": ["t", "u0", "u1", "u2", "u3"], "q": ["t"]}


def test_fingerprint_goes_from_task_to_task(spark):
    rows = [(k % 70, f"i{k}", None if k % 11 == 0 else f"text ü {k} " * (k % 5)) for k in range(500)]
    units = spark.createDataFrame(rows, "seq long, id string, text string").repartition(7)
    want = hashlib.sha256("".join(f"{i}\0{t or ''}\0" for _, i, t in sorted(rows, key=lambda r: r[:2])).encode()).hexdigest()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    group = "fingerprint"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert manifest.corpus_fingerprint(units) == want
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) > 4  # a job a range, so no task reads all
    assert manifest.corpus_fingerprint(units.limit(0)) == hashlib.sha256().hexdigest()


def test_vocabulary_is_what_the_vectorizer_learns(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([([f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(30))],) for _ in range(80)], "words array<string>")
    for least, most in ((3.0, 0.5), (0.05, 60.0)):
        want = CountVectorizer(inputCol="words", outputCol="c", minDF=least, maxDF=most).fit(docs).vocabulary
        got = spaces.vocabulary(docs, "words", least, most)
        assert sorted(got) == sorted(want) and len(got) > 5
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    spaces.topics(docs, "words", k=2).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
