import numpy as np
from pyspark.sql import functions as F

from inkspan.operators import intervals, spaces, transmission
from inkspan.sources import importers, manifest


def test_chain_is_cut_before_the_report():
    r = transmission.split("حدثنا الحميدي قال حدثنا سفيان عن عمر رضي الله عنه قال قال رسول الله صلى الله عليه وسلم \"إنما الأعمال بالنيات\"")
    assert r["report"].startswith("قال رسول الله") and "عليه" not in r["report"] and r["chain_words"] > 0
    assert r["speaker"] == "prophet" and r["spoken"] == ["إنما الأعمال بالنيات"]
    assert transmission.split("كلام بلا سند")["chain_words"] == 0 and transmission.split(None)["report"] == ""
    assert transmission.quoted('a "b') == [(2, "b")] and transmission.split('"x"')["speaker"] == "other"
    assert transmission.without_source_note("text here (Bukhari, Muslim)") == "text here"


def test_reports_in_spark(spark):
    u = spark.createDataFrame([("1", "عن انس قال نص"), ("2", None)], "id string, text string")
    assert transmission.split_reports(u).count() == 2


def test_intervals_hold_the_mean_and_widen_at_the_ends():
    p, low, high = intervals.interval([np.array([0.2, 0.8, 0.5]), np.array([0.4, 0.6])])
    assert low <= p <= high and p == 0.5
    assert intervals.interval([np.ones(4)])[1] == 0.025 ** (1 / 4)
    assert intervals.interval([np.zeros(4)])[2] == 1 - 0.025 ** (1 / 4)


def test_controls(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(100)], ["x"] * 50)], "k long, words array<string>, donor array<string>")
    r = df.select(intervals.deleted(F.col("words"), 0.02, "s", "k").alias("d"), intervals.spliced(F.col("words"), F.col("donor"), 0.2).alias("s")).first()
    assert len(r.d) == 98 and r.d == sorted(r.d, key=int)
    assert r.s[:50] == [str(i) for i in range(50)] and r.s[50:70] == ["x"] * 20 and r.s[70:] == [str(i) for i in range(70, 100)]


def test_blocks(spark):
    df = spark.createDataFrame([("a", [str(i) for i in range(1050)]), ("b", ["x"] * 5)], "work string, words array<string>")
    assert sorted(r.start for r in intervals.blocks_sample(df, "work", 100, 4).collect()) == [0, 300, 600, 900]
    assert sorted(r.block for r in intervals.centred_units(df, "work", 100, 4).collect()) == [3, 4, 5, 6]


def test_partition_finds_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(10 * (i % 3), 0.1, 4).tolist()) for i in range(60)]
    got = spaces.partition(spark.createDataFrame(rows, "k long, v array<double>"), "v", "k", 3).collect()
    assert len({(r.k % 3, r.cluster) for r in got}) == 3
    assert {r.k: r.silhouette > 0.9 for r in spaces.scores_by_k(spark.createDataFrame(rows, "k long, v array<double>"), "v", "k", range(2, 4)).collect()} == {2: False, 3: True}


def test_codex_keeps_the_first_hand(spark, tmp_path):
    xml = """<TEI><text><div type="book" xml:id="B-MK" title="Mark"><div type="chapter" n="1"><ab n="0"><w>head</w></ab><ab xml:id="V-B2K1V1-1-MK"><w>αρ<lb/>
χη</w><pc>.</pc><app><rdg type="orig"><w>του</w></rdg><rdg type="corr"><w>no</w></rdg></app><supplied><w>ευ</w></supplied><note><w>no</w></note><gap/></ab></div></div></text></TEI>"""
    p = tmp_path / "sinaiticus_full_v1.xml"
    p.write_text(xml, encoding="utf-8")
    r = importers.codex(spark, f"file://{p}").collect()
    assert [(x.book, x.chapter, x.verse, x.text, x.has_gap, round(x.supplied_frac, 2)) for x in r] == [("MK", "1", "1", "αρχη. του ευ", True, 0.33)]


def test_manifest(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("x")
    first = manifest.checksums(spark, f"file://{tmp_path}/s").first()
    (tmp_path / "s" / "a.txt").write_text("y")
    second = manifest.checksums(spark, f"file://{tmp_path}/s").first()
    assert (first.files, first.bytes) == (1, 1) and first.digest != second.digest
    t = manifest.witness_table(spark.createDataFrame([("grc", "S", "a", "B", 3)], "language string, witness string, source string, book string, n_tokens long"))
    assert manifest.missing_sources(t, ["a", "b"]) == ["b"]
