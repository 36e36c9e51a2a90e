import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import combined


def values(spark):
    rng = random.Random(1)
    rows = [("en", f"d{d}", kind, f"f{f}", 0.0 if (kind, f) == ("rate", 0) else rng.gauss(f, 1 + f)) for d in range(9) for kind, n in (("rate", 30), ("placement", 5), ("repetition", 1)) for f in range(n)]
    return spark.createDataFrame(rows, "block string, doc string, kind string, feature string, value double")


def test_every_kind_has_its_weight_as_total_variance(spark):
    rows = combined.equalised(values(spark), {"placement": 2.0}).collect()
    by = {}
    for r in rows:
        by.setdefault(r.kind, {}).setdefault(r.feature, []).append(r.z)
    total = {k: sum(np.var(z) for z in f.values()) for k, f in by.items()}
    assert total == pytest.approx({"rate": 1.0, "placement": 4.0, "repetition": 1.0})
    assert set(by["rate"]["rate:f0"]) == {0.0} and all(abs(np.mean(z)) < 1e-9 for f in by.values() for z in f.values())
    assert {r.kind for r in combined.equalised(values(spark), {"rate": 0.0}).select("kind").distinct().collect()} == {"placement", "repetition"}
    for bad in ({"rate": -1.0}, {"rate": float("nan")}, dict.fromkeys(combined.KINDS, 0.0)):
        with pytest.raises(ValueError, match="weights"):
            combined.equalised(values(spark), bad)


def test_nearest_is_of_another_group(spark):
    rows = values(spark)
    docs = rows.select("block", "doc").distinct().withColumn("group", F.expr("cast(substr(doc, 2) as int) % 3"))
    found = {r.doc: r.nearest for r in combined.attributed(rows, docs).collect()}
    assert len(found) == 9 and all(int(a[1:]) % 3 != int(b[1:]) % 3 for a, b in found.items())


def test_repetition_runs_over_a_documents_texts(spark):
    words = [("en", "d", text, pos, w) for text, own in ((2, "a b a".split()), (1, "a c".split())) for pos, w in enumerate(own)]
    frame = spark.createDataFrame(words, "block string, doc string, text int, pos int, word string")
    got = {r.feature: r.value for r in combined.repetition(frame, frame.select("block", "doc").distinct(), 3).collect()}
    seen = "a c a b a".split()
    assert got["mattr"] == pytest.approx(np.mean([len(set(seen[i : i + 3])) / 3 for i in range(3)]))
    assert set(got) == set(combined.MEASURES) and got["hapax_ratio"] == pytest.approx(2 / 3)
