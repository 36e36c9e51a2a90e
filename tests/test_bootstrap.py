import math
import random
from collections import defaultdict

import numpy as np
import pytest

from inkspan.operators import bootstrap


def records(seed=1):
    rng = random.Random(seed)
    rows = []
    for fold in (0, 1):
        for author in "AB":
            for w in range(rng.choice([2, 3, 4])):
                for _ in range(rng.choice([1, 3, 6])):
                    positive = rng.random() < 0.5
                    rows.append((fold, author, f"{author}{w}", round(rng.gauss(1.0 if positive else 0.0, 1.0), 1), positive))
    return rows


SCHEMA = "fold int, author string, work string, score double, positive boolean"


def taken_of(rows, replicates, seed=42):
    """{(fold, author, work): draws of each replicate}; replicate 0 takes each work once."""
    strata = defaultdict(set)
    for fold, author, work, *_ in rows:
        strata[fold, author].add(work)
    out = {}
    for (fold, author), works in strata.items():
        d = bootstrap.drawn(len(works), range(replicates + 1), f"{fold}\x1f{author}", seed)
        d[0] = 1
        for k, w in enumerate(sorted(works)):
            out[fold, author, w] = d[:, k]
    return out


def test_draws_are_as_many_as_works(spark):
    rows = records()
    got = bootstrap.draws(spark.createDataFrame(rows, SCHEMA).repartition(3), ["fold", "author"], "work", 120).collect()
    want = taken_of(rows, 120)
    for r in got:
        first = r.block * bootstrap.BLOCK
        assert r.draws == want[r.fold, r.author, r.work][first : first + bootstrap.BLOCK].tolist()
    totals = defaultdict(lambda: np.zeros(bootstrap.BLOCK))
    for r in got:
        totals[r.fold, r.author, r.block, r.works][: len(r.draws)] += r.draws
    assert all(set(v) <= {0.0, float(k[3])} for k, v in totals.items())


def test_areas_equal_resampled_rows(spark):
    rows = records()
    replicates = 60
    got = {(r.fold, r.replicate): r.value for r in bootstrap.auc_replicates(spark.createDataFrame(rows, SCHEMA).repartition(5), "fold", "author", "work", "score", "positive", replicates).collect()}
    taken = taken_of(rows, replicates)
    n = defaultdict(int)
    for fold, _, work, _, positive in rows:
        n[fold, work, positive] += 1
    for fold in (0, 1):
        for r in range(replicates + 1):
            own = [(s, y, taken[f, a, w][r] / n[f, w, y]) for f, a, w, s, y in rows if f == fold]
            won = sum(u * v * (1.0 if s > t else 0.5 if s == t else 0.0) for s, y, u in own if y for t, z, v in own if not z)
            all_pairs = sum(u for _, y, u in own if y) * sum(u for _, y, u in own if not y)
            if all_pairs:
                assert got[fold, r] == pytest.approx(won / all_pairs)
            else:
                assert (fold, r) not in got


def test_one_work_in_a_stratum_has_no_interval(spark):
    frame = spark.createDataFrame(records(), SCHEMA)
    whole = bootstrap.auc_intervals(frame, "fold", "author", "work", "score", "positive", 100).first()
    assert whole.low <= whole.value <= whole.high and whole.works > 4
    single = bootstrap.auc_intervals(frame.where("author = 'A' or work = 'B0'"), "fold", "author", "work", "score", "positive", 60).first()
    assert single.low is None and single.high is None and single.value is not None


def test_rates_cover_the_truth(spark):
    """Works with rates around a known mean, 400 times: percentiles over 2 x 12 works are
    somewhat too narrow (plain resampling of such worlds covers the mean in 91 %)."""
    rng = np.random.default_rng(8)
    rows = [(world, a, f"{a}{w}", float(v)) for world in range(400) for a in "AB" for w in range(12) for v in rng.binomial(1, np.clip(rng.normal(0.6, 0.15), 0, 1), 6)]
    found = bootstrap.rates(spark.createDataFrame(rows, "world int, author string, work string, v double"), ["world"], "author", "work", "v", 200).collect()
    assert len(found) == 400 and all(r.works == 24 for r in found)
    assert 0.87 <= np.mean([r.low <= 0.6 <= r.high for r in found]) <= 1.0
    ends = bootstrap.rates(spark.createDataFrame([(1, "A", "x", 1.0), (1, "A", "y", 1.0), (0, "A", "x", 0.0)], "k int, author string, work string, v double"), ["k"], "author", "work", "v", 20)
    by = {r.k: r for r in ends.collect()}
    assert by[1].low == pytest.approx(math.sqrt(0.025)) and by[1].high == 1.0 and by[0].high == pytest.approx(0.975)


def test_refits_equal_fits_of_resampled_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(a, f"{a}{w}", (rng.normal(0, 1, 3) + k).tolist()) for k, a in enumerate("ABC") for w in range(3) for _ in range(int(rng.integers(1, 4)))]
    test = [(a, f"t{a}{w}", (rng.normal(0, 1, 3) + k).tolist()) for k, a in enumerate("ABC") for w in range(2) for _ in range(2)]
    schema = "author string, work string, v array<double>"
    replicates = 55
    got = {(r.replicate, r.author): r for r in bootstrap.refits(spark.createDataFrame(rows, schema).repartition(3), replicates).collect()}
    accuracy = []
    tests = {a: bootstrap.drawn(2, range(replicates + 1), a, 43) for a in "ABC"}
    for r in range(replicates + 1):
        copies = []
        for a in "ABC":
            works = sorted({w for x, w, _ in rows if x == a})
            taken = bootstrap.drawn(len(works), range(replicates + 1), a, 42)[r] if r else np.ones(len(works), int)
            copies += [(a, (w, c), v) for w, n in zip(works, taken, strict=True) for c in range(n) for x, y, v in rows if y == w]
        weight = np.array([1 / len({c[1] for c in copies if c[0] == a}) / sum(c[1] == w for c in copies) for a, w, _ in copies]) / 3
        x = np.array([c[2] for c in copies])
        mean = weight @ x
        scale = np.sqrt(weight @ (x - mean) ** 2)
        centre = {a: np.average((x - mean) / scale, axis=0, weights=weight * [c[0] == a for c in copies]) for a in "ABC"}
        for a in "ABC":
            assert np.allclose(got[r, a].centroid, centre[a]) and np.allclose(got[r, a].scale, scale)
        best = lambda v: max("ABC", key=lambda a: ((np.array(v) - mean) / scale) @ centre[a] / np.linalg.norm(centre[a]))  # noqa: B023, E731
        by_author = []
        for a in "ABC":
            n = tests[a][r] if r else [1, 1]
            hits = [np.mean([best(v) == a for x, y, v in test if y == f"t{a}{w}"]) for w in range(2)]
            by_author.append(np.dot(hits, n) / 2)
        accuracy.append(np.mean(by_author))
    row = bootstrap.refit_intervals(spark.createDataFrame(rows, schema), spark.createDataFrame(test, schema), replicates).first()
    assert row.value == pytest.approx(accuracy[0]) and row.works == 6
    assert (row.low, row.high) == pytest.approx(tuple(np.quantile(accuracy[1:], [0.025, 0.975])))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bootstrap.rates(none, ["fold"], "author", "work", "score", 20).count() == 0
    assert bootstrap.auc_replicates(none, "fold", "author", "work", "score", "positive", 20).count() == 0
