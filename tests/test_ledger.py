import hashlib

import pytest
from pyspark.sql import functions as F

from inkspan.sources import ledger, manifest


def requests(spark, n, settings="high"):
    rows = spark.range(n).select(F.col("id").cast("int").alias("unit"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(settings).alias("settings"))
    return rows.withColumn("request", ledger.request_key("unit", "text", "settings"))


def answered(rows):
    return rows.select("request", "unit", F.upper("text").alias("answer"))


def test_each_request_once(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "profiles"))
    assert book.read() is None and book.append(requests(spark, 0), answered) == 0
    twice = requests(spark, 7).union(requests(spark, 7))
    assert book.append(twice, answered) == 7 and book.append(twice, answered) == 0
    assert book.append(requests(spark, 10), answered) == 3
    assert book.append(requests(spark, 2, "low"), answered) == 2  # other settings are other requests
    got = book.read().collect()
    assert len(got) == 12 == len({r.request for r in got}) and len(book.batches()) == 3


def test_a_killed_run_appends_nothing_and_a_new_one_all(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "profiles"))
    book.append(requests(spark, 3), answered)

    def killed(rows):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        book.append(requests(spark, 9), killed)
    (tmp_path / "profiles" / f"_staged-{'0' * 32}").mkdir()  # written, never committed
    assert book.read().count() == 3
    again = ledger.Ledger(spark, str(tmp_path / "profiles"))
    assert again.append(requests(spark, 9), lambda r: answered(r).where("unit <> 5")) == 5
    assert again.append(requests(spark, 9), answered) == 1  # the one without an answer
    assert sorted(r.unit for r in again.read().collect()) == list(range(9))


def test_two_writers_at_a_time(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "profiles"))
    other = ledger.Ledger(spark, str(tmp_path / "profiles"))

    def slow(rows):
        found = answered(rows).collect()
        other.append(requests(spark, 4), answered)  # the other commits first
        return spark.createDataFrame(found, "request string, unit int, answer string")

    assert book.append(requests(spark, 6), slow) == 6
    got = book.read().collect()
    assert sorted(r.unit for r in got) == list(range(6)) and len(book.batches()) == 2


def test_fingerprint_equals_the_plain_loop_and_guards_accounts(spark, tmp_path):
    rows = [(i * 3 % 101, f"u{i}", None if i % 17 == 0 else f"text ü {i}\n") for i in range(101)]
    units = spark.createDataFrame(rows, "seq long, id string, text string").repartition(5)
    digest = hashlib.sha256()
    for _, i, t in sorted(rows):
        digest.update(f"{i}\0{t or ''}\0".encode())
    assert manifest.corpus_fingerprint(units) == digest.hexdigest()
    path = str(tmp_path / "account")
    assert manifest.read_account(spark, path, units) is None
    manifest.write_account(spark, path, {"sources": 3}, units)
    assert manifest.read_account(spark, path, units)["sources"] == 3
    changed = units.withColumn("text", F.when(F.col("id") == "u7", "other").otherwise(F.col("text")))
    assert manifest.read_account(spark, path, changed) is None
    assert manifest.corpus_fingerprint(units.limit(0)) == hashlib.sha256().hexdigest()


