import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import discovery, distances, evaluate, expectation, frequency, rolling, supervised


def test_mattr_equals_sliding(spark):
    rng = random.Random(2)
    texts = {k: [f"w{rng.randrange(30)}" for _ in range(n)] for k, n in (("a", 5), ("b", 100), ("c", 263))}
    rows = spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t)], "doc string, pos int, word string")
    got = {r.doc: r.mattr for r in frequency.mattr(rows, ["doc"]).collect()}
    for k, t in texts.items():
        n = min(100, len(t))
        assert got[k] == pytest.approx(np.mean([len(set(t[i : i + n])) / n for i in range(len(t) - n + 1)]))
    with pytest.raises(ValueError):
        frequency.mattr(rows, ["doc"], 1)


def test_richness_extremes(spark):
    counts = spark.createDataFrame([("same", "x", 9)] + [("new", f"w{i}", 1) for i in range(10)], "doc string, word string, n long")
    got = {r.doc: r for r in frequency.richness(counts, ["doc"]).collect()}
    assert got["same"].repeat_rate == 1 and got["new"].hapax_ratio == 1 and got["new"].yule_k == 0 and got["same"].simpson_d == 1
    assert got["new"].honore_r == pytest.approx(100 * math.log(10) / math.sqrt(1e-9))


def test_distances_are_symmetric_and_zero_to_themselves(spark):
    rows = [("b", d, f, float(v)) for d, vs in (("x", (1, 2, 3)), ("y", (1, 2, 3)), ("z", (3, 0, 1))) for f, v in zip("pqr", vs)]
    v = spark.createDataFrame(rows, "block string, doc string, feature string, value double")
    for kind in ("classic", "euclidean", "cosine"):
        got = {(r.a, r.b): r.distance for r in distances.pairs(v, "value", kind).collect()}
        assert got["x", "y"] == pytest.approx(0, abs=1e-9) and got["x", "z"] == pytest.approx(got["z", "x"]) and got["x", "z"] > 0.1
    with pytest.raises(ValueError):
        distances.pairs(v, "value", "other")


def test_nearest_is_of_another_group(spark):
    d = spark.createDataFrame([("b", "x", "y", 0.1), ("b", "x", "z", 0.5), ("b", "y", "x", 0.1)], "block string, a string, b string, distance double")
    docs = spark.createDataFrame([("x", "g1"), ("y", "g1"), ("z", "g2")], "doc string, group string")
    assert {r.doc: r.nearest for r in distances.nearest_outside(d, docs).collect()} == {"x": "z", "y": None, "z": None}


def test_agreement_of_equal_and_independent_labels(spark):
    rows = spark.createDataFrame([("k", str(i % 3), str(i % 3), str(i % 2)) for i in range(60)], "k string, a string, b string, c string")
    same = evaluate.agreement(rows, "a", "b", ["k"]).first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1) and same.purity == 1
    other = evaluate.agreement(rows, "a", "c", ["k"]).first()
    assert abs(other.ari) < 0.05 and other.nmi < 0.01


def test_thresholds_and_ties(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.8, False), (0.5, True), (0.2, False)], "s double, g boolean")
    r = evaluate.calibrate_rejection(rows, "s", "g", 0.0).first()
    assert (r.threshold, r.accepted_share) == (0.9, pytest.approx(1 / 3))
    s = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.9), ("p", "a", 0.9), ("p", "b", 0.1), ("o", "a", 0.3)], "query string, candidate string, score double")
    assert {x.query: x.decision for x in evaluate.decisions(s, "query", "candidate", "score", 0.5).collect()} == {"q": None, "p": "a", "o": None}


def test_weights_are_equal_at_each_level(spark):
    rows = spark.createDataFrame([("A", "w1"), ("A", "w1"), ("A", "w2"), ("B", "w3")], "author string, work string")
    got = evaluate.equal_weights(rows, "author", "work").groupBy("author").agg(F.sum("weight").alias("w")).collect()
    assert {r.author: r.w for r in got} == {"A": 2.0, "B": 2.0}


def test_expected_writers(spark):
    rows = [("eng", "c", "b", "T", "Ann"), ("grc", "DSS", "b", "T", None), ("arb", "Bukhari", "b", "T", None), ("arb", "Quran", "Q002", "T", None), ("arb", "Quran", "Q001", "T", None), ("grc", "NT", "ROM", "T", None), ("grc", "NT", "X", "T", None), ("grc", "noncanonical", "Y", "T", None)]
    df = spark.createDataFrame(rows, "language string, collection string, book string, book_title string, reference_author string")
    got = expectation.with_writer(df, spark.createDataFrame([("ROM", "Paul"), ("X", "X")], "book string, group string")).collect()
    assert {(r.collection, r.book, r.writer, r.known) for r in got} == {
        ("c", "b", "Ann", True), ("DSS", "b", "Unknown scribe (T)", False), ("Bukhari", "b", "al-Bukhari's compilation", True), ("Quran", "Q002", "Medinan revelation", True),
        ("Quran", "Q001", "Meccan revelation", True), ("NT", "ROM", "Paul", True), ("NT", "X", "Disputed (T)", False), ("noncanonical", "Y", "Anonymous (T)", False),
    }


def table(spark, cells):
    return spark.createDataFrame([("grc", c, w, s, n, True, i) for i, (c, w, s, n) in enumerate(cells)], "language string, collection string, writer string, style_id string, words long, known boolean, last long")


def test_verdicts(spark):
    t = table(spark, [("NT", "Paul", "S001", 1000), ("NT", "Matthew", "S002", 500)])
    assert {r.writer: r.verdict for r in expectation.writer_verdicts(t).collect()} == {"Paul": "recovered", "Matthew": "recovered"}
    assert expectation.collection_agreement(t).first().agreement == 1
    t = table(spark, [("NT", "Paul", "S001", 500), ("NT", "Paul", "S002", 500), ("NT", "Matthew", "S002", 500)])
    assert {r.writer: r.verdict for r in expectation.writer_verdicts(t).collect()} == {"Paul": "split", "Matthew": "merged"}
    t = table(spark, [("NT", "Paul", "S001", 100), ("LXX", "Genesis", "S001", 900)])
    assert expectation.style_verdicts(t).first().verdict == "dominated"
    assert {r.writer: r.verdict for r in expectation.writer_verdicts(t).collect()} == {"Paul": "merged", "Genesis": "recovered"}


def test_the_remainder_is_one_row(spark):
    counts = spark.createDataFrame([("k", f"w{i:02d}", 10) for i in range(20)], "k string, name string, words long")
    got = expectation.ranked_shares(counts, ["k"], "name", "words", 5).orderBy("place").collect()
    assert len(got) == 6 and (got[-1].name, got[-1].words, got[-1].share, got[-1].remainder) == ("15 further", 150, 0.75, True)


def test_mixture_finds_separate_groups():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 0.3, (60, 3)) for m in (-4, 0, 4)])
    scores = {k: discovery.fit_mixture(x, k, 42).bic(x) for k in range(1, 6)}
    assert min(scores, key=scores.get) == 3
    labels = discovery.fit_mixture(x, 3, 42).labels(x)
    assert discovery.rand_index(labels, np.repeat([0, 1, 2], 60)) == 1.0
    assert discovery.silhouette(np.vstack([np.zeros((2000, 2)), np.full((3, 2), 2.0)]), np.array([0] * 2000 + [1] * 3), np.random.default_rng(0)) > 0.99


def test_few_or_equal_passages_are_one_group():
    config = discovery.Config()
    assert discovery.fit_language(["a"], 5, config).mixture is None
    assert "identical" in discovery.fit_language(["same text"] * 9, 9, config).reason
    for bad in ({"min_tokens": 5}, {"passage_tokens": 100}, {"max_styles": 0}, {"fit_passages": 3}):
        with pytest.raises(ValueError):
            discovery.Config(**bad)


def test_separations_equal_those_of_each_split():
    rng = np.random.default_rng(3)
    for n in (8, 9, 40):
        x = rng.normal(0, 1, (3, n, 2))
        got = rolling.separations(x, 4)
        assert np.allclose(got, [[rolling.separation(s, i) for i in range(4, n - 3)] for s in x])
    flat = rolling.change_point(np.ones((20, 2)), 4, 50)
    assert flat == (4, 0.0, 1.0)


def test_change_point_is_found():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.2, (12, 2)), rng.normal(3, 0.2, (10, 2))])
    split, _, p = rolling.change_point(x, 4, 99, 1)
    assert split == 12 and p <= 0.02
    assert rolling.change_point(x[:5], 4) == (0, 0.0, 1.0)


def test_known_authors_and_holdout(spark):
    names = ["Ann", " ", "disputed", "Ann and Bob", "Ann/Bob", None, "Unknown hand", "Sandy"]
    df = spark.createDataFrame([(n,) for n in names], "a string")
    assert [r.x for r in df.select(supervised.known_author(F.col("a")).alias("x")).collect()] == ["Ann", None, None, None, None, None, None, "Sandy"]
    books = spark.createDataFrame([("c", f"{a}{i}", a) for a in "AB" for i in range(6)] + [("c", "lone", "C")], "collection string, book string, author string")
    got = supervised.holdout(books, 1).groupBy("author", "role").count().collect()
    assert {(r.author, r.role): r["count"] for r in got} == {("A", "test"): 2, ("A", "train"): 4, ("B", "test"): 2, ("B", "train"): 4}


def test_held_out_books_are_attributed(spark):
    rng = random.Random(5)
    vocabulary = {a: [f"{a.lower()}{rng.choice('xyz')}{rng.choice('klm')}{i % 17}".replace("0", "o") for i in range(40)] for a in ("Ann", "Bob")}
    letters = str.maketrans("123456789", "abcdefghi")
    rows, seq = [], 0
    for a, v in vocabulary.items():
        for b in range(4):
            for u in range(6):
                seq += 1
                rows.append((seq, "C", f"{a}{b}", "1", " ".join(rng.choice(v).translate(letters) for _ in range(60)), a))
    units = spark.createDataFrame(rows, "seq long, collection string, book string, chapter string, text string, reference_author string")
    got = supervised.held_out_predictions(units, 120).collect()
    assert got and all(r.actual_author == r.predicted_author for r in got)
