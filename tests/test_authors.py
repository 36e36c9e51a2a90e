import math
import random
from collections import Counter

import numpy as np
import pytest

from inkspan.operators import authors, lexical

SCHEMA = "id string, work string, author string, language string, genre string, topic string, words array<string>"
WORDS, SUFFIXES = ["the", "of", "and", "to"], ["ing", "ed"]


def fixture(seed=5, works=4, passages=3, size=60):
    rng = random.Random(seed)
    taste = {"A": [8, 2, 1, 1], "B": [1, 8, 2, 1], "C": [1, 1, 2, 8]}
    stems = {"A": ["grav", "walk"], "B": ["lumin", "walk"], "C": ["fort", "walk"]}
    rows = []
    for a, odds in taste.items():
        for w in range(works):
            for p in range(passages):
                words = [rng.choices(WORDS, odds)[0] if rng.random() < 0.5 else rng.choice(stems[a]) + rng.choice(["ing", "ed", "s", "er"]) for _ in range(size)]
                rows.append((f"{a}{w}{p}", f"{a}{w}", a, "eng", "g", "t", words))
    return rows


def split(rows):
    return [r for r in rows if r[1][1] != "0"], [r for r in rows if r[1][1] == "0"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["function", "morphology"])
def test_centroids_equal_plain_loops(spark, kind):
    train, test = split(fixture())
    train = [r for r in train if r[0] not in ("A10", "A11", "C20")]  # uneven works
    model = authors.fit_centroids(frame(spark, train), kind, WORDS, SUFFIXES)

    def rates(r):
        w, n = r[6], len(r[6])
        c = Counter(w)
        pairs = Counter(f"{x}|{y}" for x, y in zip(w, w[1:], strict=False) if x in WORDS and y in WORDS)
        out = [100 * c[x] / n for x in WORDS]
        if kind == "morphology":
            out += [100 * sum(k for x, k in c.items() if x.endswith(s) and len(x) > len(s) + 1) / n for s in SUFFIXES]
            out += [sum(map(len, w)) / n, sum(len(x) >= 8 for x in w) / n, len(c) / n]
            out += [100 * pairs[p] / (n - 1) for p in model.pairs]
        return out

    works = Counter(r[1] for r in train)
    per = Counter(w[0] for w in works)
    weight = np.array([len(works) / len(per) / per[r[2]] / works[r[1]] for r in train])
    x = np.array([rates(r) for r in train])
    mean = np.average(x, axis=0, weights=weight)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    z = lambda v: (np.array(v) - mean) / np.where(sd > 1e-12, sd, 1)
    centre = {a: np.average([z(rates(r)) for r in train if r[2] == a], axis=0, weights=[w for r, w in zip(train, weight, strict=True) if r[2] == a]) for a in per}
    if kind == "morphology":
        assert len(model.pairs) == len(set(model.pairs)) == 16
    got = {(r.id, r.candidate): r.score for r in authors.scores(model, frame(spark, test)).collect()}
    assert len(got) == len(test) * 3
    for r in test:
        for a, c in centre.items():
            v = z(rates(r))
            assert got[r[0], a] == pytest.approx(v @ c / np.linalg.norm(v) / np.linalg.norm(c), abs=1e-8)


def test_characters_recover_held_out_works_and_minimise_the_loss(spark):
    train, test = split(fixture())
    passages = frame(spark, train)
    model = authors.fit_characters(passages, most_grams=400, tol=1e-12)
    found = {r.id: r.predicted for r in authors.predicted(authors.scores(model, frame(spark, test))).collect()}
    assert found == {r[0]: r[2] for r in test}
    # at the minimum the gradient of the weighted loss with half the squared weights vanishes
    vectors = {r.id: r for r in lexical.gram_vectors(passages, model.space).collect()}
    weights = {r.id: r.weight for r in lexical.passage_weights(passages).collect()}
    x = np.zeros((len(train), model.space.size))
    for k, r in enumerate(train):
        x[k, vectors[r[0]].at] = vectors[r[0]].x
        assert np.linalg.norm(x[k]) == pytest.approx(1)
    w, b = model.fitted.coefficientMatrix.toArray(), model.fitted.interceptVector.toArray()
    logits = x @ w.T + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    y = np.array([[r[2] == a for a in model.authors] for r in train], float)
    gradient = ((p - y) * np.array([weights[r[0]] for r in train])[:, None]).T @ x + w
    assert np.abs(gradient).max() < 1e-4


def test_vocabulary_is_of_whole_works(spark):
    train, _ = split(fixture(size=12))
    space = lexical.gram_space(frame(spark, train), 50)
    counts, works = Counter(), {}
    for r in train:
        for word in r[6]:
            p = f" {word} "
            for g in [p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1)]:
                counts[g] += 1
                works.setdefault(g, set()).add(r[1])
    top = sorted(counts, key=lambda g: (-counts[g], g))[:50]
    want = {g: (i, math.log(10 / (1 + len(works[g]))) + 1) for i, g in enumerate(sorted(top))}
    got = {r.gram: (r.i, r.idf) for r in space.table.collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1]) for g in got)


def test_guards(spark):
    train, test = split(fixture())
    with pytest.raises(ValueError, match="two authors"):
        authors.fit_characters(frame(spark, [r for r in train if r[2] == "A"]))
    with pytest.raises(ValueError, match="work of two authors"):
        authors.fit_centroids(frame(spark, [*train, ("x", train[0][1], "Z", "eng", "g", "t", ["the"])]), "function", WORDS, SUFFIXES)
    model = authors.fit_centroids(frame(spark, train), "function", WORDS, SUFFIXES)
    with pytest.raises(ValueError, match="another language"):
        authors.scores(model, frame(spark, [(*r[:3], "grc", *r[4:]) for r in test]))
    repeated = frame(spark, [*train, ("again", *train[0][1:])])
    assert authors.training(repeated).count() == len(train) + 1
    ties = authors.predicted(spark.createDataFrame([("p", "B", 1.0), ("p", "A", 1.0)], "id string, candidate string, score double")).first()
    assert ties.predicted == "A"
