import pytest

from inkspan.operators import classify


@pytest.mark.parametrize("kind", ["forest", "svm"])
def test_no_work_is_on_both_sides(spark, kind):
    # the second number names the work; only it would tell the labels of works 0 and 1
    rows = [(i, ["A", "B", "C"][i % 3], i % 4, [float(i % 3 == k) * 5 + (i * 7 % 10) / 10 for k in range(3)]) for i in range(48)]
    rows += [(100 + i, "only here", 4, [50.0, 50.0, 50.0 + i]) for i in range(6)]
    found = classify.out_of_fold(spark.createDataFrame(rows, "id long, label string, work int, v array<double>"), "id", "v", "label", "work", kind, 2, trees=10, depth=4).collect()
    assert sorted(r.key for r in found) == sorted(r[0] for r in rows)
    assert all(r.predicted == r.truth for r in found if r.work != 4)
    assert all(r.predicted not in (None, "only here") for r in found if r.work == 4)
    row = classify.summary(spark.createDataFrame([(r.truth, r.predicted) for r in found], "truth string, predicted string")).first()
    assert (row.n, row.classes, row.accuracy, row.majority_baseline) == (54, 4, pytest.approx(48 / 54), pytest.approx(16 / 54))


def test_folds_and_single_labels(spark):
    schema = "id long, label string, work int, v array<double>"
    two = spark.createDataFrame([(1, "A", 1, [0.0]), (2, "A", 1, [1.0]), (3, "B", 2, [2.0])], schema)
    assert {r.predicted for r in classify.out_of_fold(two, "id", "v", "label", "work").collect()} == {None}
    with pytest.raises(ValueError, match="two works"):
        classify.out_of_fold(two.where("work = 1"), "id", "v", "label", "work")
    with pytest.raises(ValueError, match="unknown classifier"):
        classify.out_of_fold(two, "id", "v", "label", "work", kind="guess")
