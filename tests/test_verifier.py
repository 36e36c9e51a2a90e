import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import evaluate, lexical, verifier

STYLES = ("kai de logos kai te", "men oun polis gar oun", "hoti de anthropos hoti gar")
WORDS, SUFFIXES = ["kai", "de", "oun", "gar", "hoti"], ["os", "is"]
SCHEMA = "id string, work string, author string, language string, genre string, topic string, words array<string>"


def fixture(authors=3, works=3, passages=3):
    rows = []
    for a, w, p in product(range(authors), range(works), range(passages)):
        text = f"{STYLES[a % 3]} idion{a}{w}{p} {' '.join(STYLES[(a + p) % 3].split()[: 1 + w])} {STYLES[a % 3]}"
        rows.append((f"a{a}-w{w}-p{p}", f"a{a}-w{w}", f"author{a}", "grc", "oratory" if a < 2 else "dialogue", "ethics", text.split()))
    return rows


def plain_fit(rows):
    """The same model by plain loops and Newton steps."""
    works = sorted({r[1] for r in rows})
    by_work = {w: [r for r in rows if r[1] == w] for w in works}
    chosen = []
    for a, b in combinations(works, 2):
        pairs = sorted(product(by_work[a], by_work[b]), key=lambda p: hashlib.sha256(f"42:{p[0][0]}:{p[1][0]}".encode()).hexdigest())
        chosen += [(a, b, x, y, min(8, len(pairs))) for x, y in pairs[:8]]
    strata = defaultdict(lambda: defaultdict(set))
    kind = lambda x, y: "same" if x[2] == y[2] else "genre" if x[4] == y[4] else "other"
    for a, b, x, y, _ in chosen:
        strata[kind(x, y)][tuple(sorted((x[2], y[2])))].add((a, b))
    weights = []
    for _, _, x, y, n in chosen:
        k = kind(x, y)
        mass = len(works) / 2 / (1 if k == "same" else len(strata) - 1)
        weights.append(mass / len(strata[k]) / len(strata[k][tuple(sorted((x[2], y[2])))]) / n)

    def static(words):
        n = Counter(words)
        t = len(words)
        sfx = [sum(c for w, c in n.items() if w.endswith(s) and len(w) > len(s) + 1) for s in SUFFIXES]
        return [100 * n[w] / t for w in WORDS] + [100 * s / t for s in sfx] + [sum(map(len, words)) / t, sum(len(w) >= 8 for w in words) / t, len(n) / t]

    def grams(words):
        out = Counter()
        for w in words:
            p = f" {w} "
            out.update(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))
        return out

    authors = Counter(x for x, _ in {(r[2], r[1]) for r in rows})
    pw = np.array([len(works) / len(authors) / authors[r[2]] / len(by_work[r[1]]) for r in rows])
    s = np.array([static(r[6]) for r in rows])
    mean = np.average(s, axis=0, weights=pw)
    sd = np.sqrt(np.average((s - mean) ** 2, axis=0, weights=pw))
    z = dict(zip([r[0] for r in rows], (s - mean) / np.where(sd > 1e-12, sd, 1), strict=True))
    df = Counter(g for w in works for g in grams([t for r in by_work[w] for t in r[6]]))
    vec = {}
    for r in rows:
        v = {g: (1 + math.log(n)) * (math.log((1 + len(works)) / (1 + df[g])) + 1) for g, n in grams(r[6]).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[r[0]] = {g: x / norm for g, x in v.items()}

    def features(x, y):
        d = abs(z[x] - z[y])
        cos = z[x] @ z[y] / np.linalg.norm(z[x]) / np.linalg.norm(z[y])
        return [*d, cos, math.sqrt((d**2).mean()), sum(v * vec[y].get(g, 0) for g, v in vec[x].items())]

    w = np.array(weights)
    f = np.array([features(x[0], y[0]) for _, _, x, y, _ in chosen])
    m = np.average(f, axis=0, weights=w)
    q = np.sqrt(np.average((f - m) ** 2, axis=0, weights=w))
    q = np.where(q > 1e-12, q, 1)
    X = np.hstack([(f - m) / q, np.ones((len(f), 1))])
    y = np.array([x[2] == y[2] for _, _, x, y, _ in chosen], float)
    beta = np.zeros(X.shape[1])
    ridge = np.diag([1.0] * (X.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        beta -= np.linalg.solve(X.T @ (X * (w * p * (1 - p))[:, None]) + ridge, X.T @ (w * (p - y)) + ridge @ beta)
    return beta, weights, lambda a, b: float(np.append((np.array(features(a, b)) - m) / q, 1) @ beta)


@pytest.fixture(scope="module")
def trained(spark):
    rows = fixture()
    passages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, passages, verifier.fit(passages, WORDS, SUFFIXES, tol=1e-11)


def test_equals_a_plain_fit(trained):
    rows, _, model = trained
    beta, _, _ = plain_fit(rows)
    assert np.abs(np.array([*model.weights, model.bias]) - beta).max() < 1e-6
    assert len(model.feature_names()) == len(model.weights)


def test_pairs_cross_works_and_masses_are_nested(trained):
    rows, passages, _ = trained
    pairs = verifier.pair_weights(verifier.training_pairs(passages)).collect()
    assert len(pairs) == 36 * 8 and all(p.work_a < p.work_b for p in pairs)
    assert Counter(p.same_author for p in pairs) == {True: 72, False: 216}
    mass = lambda test: sum(p.weight for p in pairs if test(p))
    assert mass(lambda p: p.same_author) == pytest.approx(4.5) and mass(lambda p: not p.same_author) == pytest.approx(4.5)
    assert mass(lambda p: p.stratum == "same_genre") == pytest.approx(2.25)
    assert sorted(p.weight for p in pairs) == pytest.approx(sorted(plain_fit(rows)[1]))


def test_scores_are_symmetric_and_equal_the_plain_ones(trained, spark):
    rows, passages, model = trained
    ids = [(rows[0][0], rows[4][0]), (rows[4][0], rows[12][0]), (rows[15][0], rows[21][0])]
    score = lambda pairs: {(r.a, r.b): r.score for r in verifier.score_pairs(model, passages, spark.createDataFrame(pairs, "a string, b string")).collect()}
    there, back = score(ids), score([(b, a) for a, b in ids])
    plain = plain_fit(rows)[2]
    for a, b in ids:
        assert there[a, b] == pytest.approx(back[b, a], abs=1e-9) == pytest.approx(plain(a, b), abs=1e-5)


def test_what_is_no_evidence_is_refused(trained, spark):
    rows, passages, model = trained
    frame = lambda more: spark.createDataFrame([*rows, *more], SCHEMA)
    new = ("n", "n", "author9", "grc", "unknown", "unknown", ["kai", "oun"])
    cases = {"work of two authors": (*new[:1], rows[0][1], *new[2:]), "repeated id": (rows[0][0], *new[1:]), "repeated text": (*new[:6], rows[0][6]), "several languages": (*new[:3], "eng", *new[4:]), "blank field": (*new[:4], " ", *new[5:])}
    for kind, row in cases.items():
        with pytest.raises(ValueError, match=kind):
            lexical.guarded(frame([row]))
    lexical.guarded(frame([new]))
    same_text = frame([(*new[:6], rows[0][6])])
    bad = [(rows[0][0], rows[1][0], "one work"), (rows[0][0], "n", "one text"), (rows[0][0], "nobody", "unknown passage")]
    got = verifier.refused(spark.createDataFrame([b[:2] for b in bad] + [(rows[0][0], rows[9][0])], "a string, b string"), same_text).collect()
    assert {tuple(r) for r in got} == set(bad)
    with pytest.raises(ValueError, match="one work"):
        verifier.score_pairs(model, passages, spark.createDataFrame([bad[0][:2]], "a string, b string"))
    with pytest.raises(ValueError, match="two authors"):
        verifier.fit(passages.where("author = 'author0'"), WORDS, SUFFIXES)


def test_all_pairs_of_two_works_are_tried(spark, monkeypatch):
    rows = [("grc", f"w{k % 3}", f"p{k}") for k in range(75)] + [("grc", "w0", None), ("grc", None, "x"), (None, "w1", "y"), ("lat", "w0", "z")]
    passages = spark.createDataFrame(rows, "language string, work string, id string")
    want = set()
    for a, b in combinations(["w0", "w1", "w2"], 2):
        ids = [[r[2] for r in rows if r[:2] == ("grc", w)] for w in (a, b)]
        name = lambda p: ":".join(["7", *[x for x in p if x is not None]])
        pairs = sorted(product(*ids), key=lambda p: hashlib.sha256(name(p).encode()).hexdigest())
        want |= {("grc", a, x, b, y, k) for k, (x, y) in enumerate(pairs[:8], 1)}
    for size in (4, 4096):  # many parts a work, and one
        monkeypatch.setattr(evaluate, "PASSAGES_AT_ONCE", size)
        assert {tuple(r) for r in evaluate.pair_sample(passages, "work", "id", "language", 8, "7").collect()} == want
    assert len({x for w in want if w[1] == "w0" for x in w[2:5:2]}) > 16  # more than 8 of each work
    numbers = passages.select("language", "work", F.expr("try_cast(substring(id, 2) as bigint)").alias("id")).where("id is not null")
    assert evaluate.pair_sample(numbers, "work", "id", "language", 2, "7").count() == 6
