import random
from collections import Counter
from fractions import Fraction

import pytest

from inkspan.operators import gallery

SCHEMA = "author string, work string, candidate string, score double, several boolean"
NAMES = ["A", "B", "C"]


def fixture(seed, n=200):
    rng = random.Random(seed)
    known, unknown = [], []
    for _ in range(n):
        a = rng.choice(NAMES)
        right = rng.random() < 0.9
        known.append((a, f"{a}{rng.randrange(3)}", a if right else rng.choice(NAMES), round(rng.gauss(0.8 if right else 0.4, 0.15), 2), rng.random() < 0.03))
        u = rng.choice("XYZ")
        unknown.append((u, f"{u}{rng.randrange(2)}", rng.choice(NAMES), round(rng.gauss(0.45, 0.15), 2), False))
    return known, unknown


def brute(known, unknown, limit, least=0.8):
    def weights(rows):
        per, works = Counter(r[1] for r in rows), {r[1]: r[0] for r in rows}
        authors = Counter(works.values())
        return [Fraction(1, len(authors) * authors[r[0]] * per[r[1]]) for r in rows]

    kw, uw = weights(known), weights(unknown)
    found = []
    for t in sorted({r[3] for r in known + unknown}):
        ok = [r[3] >= t and not r[4] for r in known]
        correct = sum(w for r, w, y in zip(known, kw, ok, strict=True) if y and r[2] == r[0])
        wrong = sum(w for r, w, y in zip(known, kw, ok, strict=True) if y and r[2] != r[0])
        false = sum(w for r, w in zip(unknown, uw, strict=True) if r[3] >= t and not r[4])
        if false <= limit and wrong <= limit:
            found.append((correct, -t, wrong, false))
    if not found:
        return "no_feasible_threshold", None, None, None, None
    correct, low, wrong, false = max(found)
    return ("feasible" if correct >= Fraction(str(least)) else "no_feasible_threshold"), -low, float(correct), float(wrong), float(false)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_thresholds_tried(spark, seed):
    known, unknown = fixture(seed)
    for limit in (0.05, 0.2):
        want = brute(known, unknown, Fraction(str(limit)))
        got = gallery.calibrate(spark.createDataFrame(known, SCHEMA), spark.createDataFrame(unknown, SCHEMA), NAMES, limit, limit).first()
        assert got.status == want[0]
        assert [got.threshold, got.correct, got.wrong, got["false_accepted"]] == pytest.approx(list(want[1:]), abs=1e-9)


def test_running_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(40)), rng.randrange(5)) for _ in range(500)]
    frame = spark.createDataFrame(rows, "x double, v int").repartition(4)
    for ranges in (1, 2, 7, 64):
        got = gallery.running(frame, "x", ["v"], ranges).collect()
        assert len(got) == 500 and all(r.at_least_v == sum(v for x, v in rows if x >= r.x) for r in got)


def test_guards_ties_and_abstention(spark):
    known, unknown = (spark.createDataFrame(x, SCHEMA) for x in fixture(1))
    assert gallery.calibrate(known, unknown, [*NAMES, "D"]).first().status == "insufficient_calibration"
    assert gallery.calibrate(known, unknown.where("author = 'X'"), NAMES).first().status == "insufficient_calibration"
    with pytest.raises(ValueError, match="must be candidates"):
        gallery.calibrate(known, unknown, ["A", "B"])
    with pytest.raises(ValueError, match="must not be"):
        gallery.checked(known.where("author <> 'C'"), known.where("author = 'C'"), ["A", "B", "C"])
    with pytest.raises(ValueError, match="disjoint"):
        gallery.checked(known, spark.createDataFrame([("X", "A0", "A", 0.1, False)], SCHEMA), NAMES)
    scores = spark.createDataFrame([("p", "A", 0.9), ("p", "B", 0.9), ("q", "A", 0.7), ("q", "B", 0.8), ("r", "A", 0.2)], "query string, candidate string, score double")
    taken = lambda *a: {r.query: r.decision for r in gallery.apply_threshold(scores, *a).collect()}
    assert taken("feasible", 0.8) == {"p": None, "q": "B", "r": None}
    assert set(taken("no_feasible_threshold", 0.1).values()) == {None}
