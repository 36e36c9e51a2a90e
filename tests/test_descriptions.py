from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import describe, distances, networks, query

MARKERS = ["a", "b", "c"]


def network(words, window=5):
    m = np.zeros((3, 3))
    for i, w in enumerate(words):
        for d in range(1, window + 1):
            if i + d < len(words) and w in MARKERS and words[i + d] in MARKERS:
                m[MARKERS.index(w), MARKERS.index(words[i + d])] += 1 / d
    return m


def shares(m):
    return (m + 0.01) / (m.sum(1, keepdims=True) + 0.03)


def apart(p, q):
    return (p * np.log2(p / q) + q * np.log2(q / p)).sum() / 6


def corpus():
    rng = np.random.default_rng(3)
    habits = {"x": [0.6, 0.2, 0.1, 0.1], "y": [0.1, 0.2, 0.6, 0.1], "z": [0.2, 0.6, 0.1, 0.1]}
    rows = [(f"{k}{i}", f"g{i % 2}{k}" if i < 4 else "shared", k, [("a", "b", "c", "-")[j] for j in rng.choice(4, 80, p=p)]) for k, p in habits.items() for i in range(5)]
    return [*rows, ("none", "alone", None, ["-"] * 9), ("once", "only", "w", ["a", "b"] * 20)]


def test_attribution_by_networks_against_plain_loops(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc string, group string, label string, words array<string>")
    docs = frame.select(F.lit("en").alias("block"), "doc", "group", "label")
    edges = distances.adjacency(frame, MARKERS)
    nets = {d: network(w) for d, _, _, w in rows}
    label, group = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    single = {r.doc: r for r in networks.attributed(edges, docs, MARKERS).collect()}
    pooled = {r.doc: r for r in networks.attributed_pooled(edges, docs, MARKERS).collect()}
    assert set(single) == set(pooled) == set(label)
    for d in label:
        near = min((round(apart(shares(nets[d]), shares(nets[o])), 12), o) for o in label if group[o] != group[d])
        assert (single[d].nearest, single[d].predicted) == (near[1], label[near[1]]) and single[d].distance == pytest.approx(near[0])
        pools = {}
        for o in label:
            if label[o] is not None and group[o] != group[d]:
                pools[label[o]] = pools.get(label[o], 0) + nets[o]
        best = min((round(apart(shares(nets[d]), shares(p)), 12), k) for k, p in pools.items())
        assert pooled[d].predicted == best[1] and pooled[d].distance == pytest.approx(best[0], abs=1e-9)
    assert pooled["once"].predicted != "w"  # its label has no other text
    lone = networks.attributed_pooled(edges, docs.where("doc = 'once'"), MARKERS).collect()
    assert [(r.doc, r.predicted, r.distance) for r in lone] == [("once", None, None)]


def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else f"A{i % 3}", [float(x) for x in rng.normal(i % 3, 1, 6)[:5]] + [2.0], i / 100, f"t{i} " * 90) for i in range(90)]
    return rows, spark.createDataFrame(rows, "id long, author string, v array<double>, confidence double, text string")


def test_what_sets_groups_apart(spark):
    rows, frame = points(spark)
    known = [r for r in rows if r[1]]
    x, names = np.array([r[2] for r in known]), np.array([r[1] for r in known])
    spread = x.std(0)
    z = np.where(spread > 1e-9, (x - x.mean(0)) / np.where(spread > 1e-9, spread, 1), 0)
    found = describe.effects(frame, "author", "v")
    got = {(r.author, r.feature): r.effect for r in found.collect()}
    for a in set(names):
        assert [got[a, i] for i in range(6)] == pytest.approx(z[names == a].mean(0), abs=1e-9)
    marks = describe.markers(found, "author", 2, 1).where("author = 'A2'").orderBy("side", "place").collect()
    order = np.argsort(-z[names == "A2"].mean(0))
    assert [(r.side, r.feature) for r in marks] == [("high", order[0]), ("high", order[1]), ("low", order[-1])]
    sizes = {r.author: (r.n, r.share, r.mean_confidence) for r in describe.group_sizes(frame, "author", "confidence").collect()}
    assert sum(n for n, _, _ in sizes.values()) == len(known) and sum(s for _, s, _ in sizes.values()) == pytest.approx(1)
    for a in set(names):
        own = [r for r in known if r[1] == a]
        far = {r[0]: np.linalg.norm(np.array(r[2]) - x[names == a].mean(0)) for r in own}
        assert sizes[a][2] == pytest.approx(np.mean([r[3] for r in own]))
        near = describe.representatives(frame, "author", "v", "id", 3, "text").where(F.col("author") == a).orderBy("place").collect()
        assert [r.id for r in near] == sorted(far, key=far.get)[:3] and all(len(r.text) == 200 for r in near)


def test_values_and_tags_of_groups(spark):
    rows = [("A", ["p", "q", "p"], "W1"), ("A", ["p"], "W2"), ("A", None, "W1"), ("B", ["p", "r", "r"], None), ("B", ["r", "q"], "W1"), (None, ["r"] * 9, "W9")]
    frame = spark.createDataFrame(rows, "g string, tags array<string>, work string")
    own = {g: Counter(t for a, ts, _ in rows if a == g for t in ts or []) for g in "AB"}
    total = own["A"] + own["B"]
    got = {(r.g, r.tag): (r.place, r.n, r.lift) for r in describe.tag_lift(frame, "g", "tags", 3, 1).collect()}
    size = {"A": 3, "B": 2}
    want = {(g, t): (n / size[g]) / (total[t] / 5) for g in "AB" for t, n in own[g].items() if total[t] >= 3}
    assert {k: v[2] for k, v in got.items()} == pytest.approx(want) and got["B", "r"][0] == 1
    assert [(r.value, r.n) for r in describe.group_values(frame, "g", "work").where("g = 'A'").orderBy("place").collect()] == [("W1", 2), ("W2", 1)]
    assert describe.tag_lift(frame.limit(0), "g", "tags").count() == 0


def test_scopes(spark):
    rows = [("1", "grc", "LXX", "s", "none", "Gen"), ("2", "grc", None, "sinaiticus", "none", "barn"), ("3", "hbo", "Tanakh", "s", None, "Gen"), ("4", None, "Quran", "s", None, None)]
    units = spark.createDataFrame(rows, "id string, language string, collection string, source string, canon string, work string")
    ids = lambda *a, **k: {r.id for r in query.scoped(units, *a, **k).collect()}
    assert ids("all") == {"1", "2", "3", "4"} and ids() == ids("christian") == {"2"} and ids("noncanonical") == {"1", "2"} and ids("quran") == {"4"}
    assert ids("all", ["gen", "BARN"]) == {"1", "2", "3"} and ids("all", ["gen"], "hbo") == {"3"} and ids("all", []) == {"1", "2", "3", "4"}
    with pytest.raises(ValueError, match="unknown scope"):
        ids("latin")
