import numpy as np
import pytest

from inkspan.operators import stability

SCHEMA = "id long, run string, place int, label string, v array<double>"


def points(apart, seed=3, n=160):
    rng = np.random.default_rng(seed)
    return [(i, f"r{i // 40}", i % 40, f"A{1 + i % 2}", (rng.normal(0, 1, 4) + apart * (i % 2)).tolist()) for i in range(n)]


def test_planted_groups_are_stable_and_noise_is_not(spark):
    for apart, least, most in ((8.0, 0.98, 1.0), (0.0, -0.2, 0.5)):
        rows = stability.run_blocks(spark.createDataFrame(points(apart), SCHEMA), "run", "place")
        found = stability.stability(rows, "v", "label", 2, "block")
        row = stability.summary(found).first()
        assert row.available and row.repeats == 5 and least <= row.min_ari <= row.mean_ari <= most
        assert all(0 < r.drawn <= 160 for r in found.collect())


def test_blocks_are_drawn_whole_and_differ_by_repeat(spark):
    rows = stability.run_blocks(spark.createDataFrame(points(1.0, n=2000), SCHEMA), "run", "place")
    drawn = [{r.block for r in rows.where(stability.kept(0, k, "block", 0.8)).select("block").distinct().collect()} for k in range(2)]
    assert drawn[0] != drawn[1] and rows.select("block").distinct().count() == 100
    assert all(65 <= len(d) <= 95 for d in drawn)


def test_order_of_supported_numbers(spark):
    table = spark.createDataFrame([(2, True, 0.3, 10.0), (3, True, 0.5, 9.0), (4, False, 0.9, 1.0), (5, True, 0.5, 12.0), (6, True, None, None)], "k int, split_supported boolean, silhouette double, bic double")
    assert stability.supported_order(table) == [3, 5, 2] and stability.supported_order(table, "bic") == [3, 2, 5]
    rows = stability.run_blocks(spark.createDataFrame(points(8.0), SCHEMA), "run", "place")
    assert stability.stable_order(rows.withColumn("three", rows.id % 3), "v", {3: "three", 2: "label"}, [3, 2], "block", 0.9, 2) == 2
    assert stability.stable_order(rows.withColumn("three", rows.id % 3), "v", {3: "three"}, [3], "block", 0.9, 2) == 1


def test_what_has_no_stability(spark):
    rows = spark.createDataFrame(points(1.0), SCHEMA)
    assert stability.stability(rows, "v", "label", 1, "id").count() == 0
    assert stability.stability(rows.where("run = 'r0'"), "v", "label", 2, "run").count() == 0
    assert not stability.summary(stability.stability(rows.limit(0), "v", "label", 2, "id")).first().available
    constant = spark.createDataFrame([(i, "r", i, "A", [1.0, 1.0]) for i in range(30)], SCHEMA)
    assert stability.summary(stability.stability(constant, "v", "label", 2, "id", repeats=2)).first().mean_ari == 0.0
    with pytest.raises(ValueError, match="repeat"):
        stability.stability(rows, "v", "label", 2, "id", repeats=0)
