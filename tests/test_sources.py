import json

from pyspark.sql import functions as F

from inkspan.sources import importers, sinks
from inkspan.streaming import arrivals


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return f"file://{p}"


def test_manuscripts_keep_the_first_hand(spark, tmp_path):
    p = put(tmp_path, "P45.txt", "41001001 αρχη /του ευαγ%γελιου x{ιησου}a{χριστου}\n41001002 ^ καθωσ\nnoise\n99001001 no such book\n")
    got = importers.manuscripts(spark, p).orderBy("place").collect()
    assert [(r.book, r.chapter, r.verse, r.text, r.has_gap, r.witness) for r in got] == [("MARK", "1", "1", "αρχη του ευαγγελιου ιησου", False, "P45"), ("MARK", "1", "2", "καθωσ", True, "P45")]


def test_tokens_join_by_verse(spark, tmp_path):
    p = put(tmp_path, "39.Joel.txt", "39.1.1 λόγος\n39.1.2 ἀκούσατε\n39.1.1 Κυρίου\n")
    assert [(r.book, r.verse, r.text) for r in importers.token_lines(spark, p).orderBy("place").collect()] == [("JOEL", "1", "λόγος Κυρίου"), ("JOEL", "2", "ἀκούσατε")]


def test_referenced_lines_drop_headings(spark, tmp_path):
    p = put(tmp_path, "003-didache.txt", "1.1 ὁδοὶ δύο\n1.2 ARGUMENTUM\n2 ἐντολή\n")
    assert [(r.book, r.chapter, r.verse, r.text) for r in importers.referenced_lines(spark, p).orderBy("place").collect()] == [("DIDACHE", "1", "1", "ὁδοὶ δύο"), ("DIDACHE", "2", "1", "ἐντολή")]


def test_inscriptions_count_reconstruction(spark, tmp_path):
    p = put(tmp_path, "ketef.txt", "=== KH1 (first) ===\n01 אב[גד] <- note\n02 ה/ו ז\n=== KH2\n01 חט\n")
    got = importers.inscriptions(spark, p).orderBy("place").collect()
    assert [(r.book, r.text, r.has_gap, round(r.supplied_frac, 3)) for r in got] == [("KH1", "אבגד ה ז", True, 0.333), ("KH2", "חט", True, 0.0)]


def test_piped_json_and_osis(spark, tmp_path):
    assert importers.piped(spark, put(tmp_path, "q.txt", "2|1|الم\n# note\n")).first().book == "Q002"
    data = {"hadiths": [{"hadithnumber": 1.0, "reference": {"book": 0}, "text": "<p>نص</p>"}, {"hadithnumber": 2.5, "reference": {"book": 3}, "text": "آخر"}]}
    got = importers.json_reports(spark, put(tmp_path, "bukhari.json", json.dumps(data))).orderBy("place").collect()
    assert [(r.book, r.book_title, r.verse, r.text) for r in got] == [("BUKH00", "Unassigned", "1", "نص"), ("BUKH03", "Book 3", "2.5", "آخر")]
    xml = '<osis><div><verse osisID="Gen.1.1"><w>א/ב</w><seg>־</seg><w>ג</w><note>n <w>no</w></note><w>ד</w></verse></div></osis>'
    assert importers.osis(spark, put(tmp_path, "Gen.xml", xml)).first().text == "אב־ג ד"


def test_prose_and_papers(spark, tmp_path):
    text = "junk\n*** START OF THE BOOK ***\n\nCHAPTER I\n\nFirst one.\n\nSecond [Illustration: x] one.\n\nCHAPTER II\n\nCHAPTER III\n\nThird.\n\n*** END OF THE BOOK ***\nlicence"
    got = importers.prose(spark, put(tmp_path, "pg1.txt", text)).orderBy("place").collect()
    assert [(r.chapter, r.verse, r.text) for r in got] == [("1", "1", "First one."), ("1", "2", "Second one."), ("2", "1", "Third.")]
    text = "FEDERALIST No. 1\n\nTo the People.\n\nFEDERALIST No. 10\n\nAmong.\n\nFEDERALIST No. 18\n\nBoth.\n\nFEDERALIST No. 50\n\nWho."
    got = importers.federalist(spark, put(tmp_path, "federalist.txt", text)).orderBy("place").collect()
    assert [(r.book, r.reference_author) for r in got] == [("FED01", "Hamilton"), ("FED10", "Madison"), ("FED18", None), ("FED50", None)]


def test_tei_and_sentence_packing(spark, tmp_path):
    assert [len(x.split()) for x in importers.packed_sentences(("a b c d e. " * 13).strip())] == [25, 25, 15]
    assert [len(x.split()) for x in importers.packed_sentences(("a b c d e. " * 6).strip())] == [30]
    xml = '<TEI><text><body><div n="1"><div n="2"><p>λόγος <note>x</note>πρῶτος.</p></div></div></body></text></TEI>'
    r = importers.tei(spark, put(tmp_path, "t.xml", xml)).first()
    assert (r.chapter, r.text) == ("2", "λόγος πρῶτος.")


def test_build_accounts_for_every_source(spark, tmp_path):
    put(tmp_path, "cntr/class1/03.txt", "41001001 αρχη του ευαγγελιου\n")
    put(tmp_path, "cntr/class1/P45.txt", "41001001 αρχη\n")
    put(tmp_path, "quran/q.txt", "1|1|بسم الله\n")
    units, report, chosen = importers.build_corpus(spark, f"file://{tmp_path}")
    got = {r.source_dir: (r.status, r.parsed_units, r.selected_units, r.alternate_units) for r in report.collect()}
    assert got["cntr"] == ("ok", 2, 1, 1) and got["quran"] == ("ok", 1, 1, 0) and got["oshb"] == ("missing", 0, 0, 0)
    assert {(r.book, r.witness) for r in chosen.where("chosen").collect()} == {("MARK", "03"), ("Q001", "T")}
    assert {r.id for r in units.collect()} == {"grc:NT:MARK:03:1:1", "arb:Quran:Q001:T:1:1"}


def test_csv_keeps_text_and_fixed_columns(spark, tmp_path):
    df = spark.createDataFrame([(" =1+1 \"q\", x", ["a"], None)], "t string, l array<string>, n int")
    sinks.write_csv(df, f"file://{tmp_path}/o", ("t", "l", "n", "absent"))
    r = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(f"file://{tmp_path}/o").first()
    assert r.t == ' =1+1 "q", x' and r.l == '["a"]' and r.n is None and r.absent is None


def test_page_text(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><p>One &amp; two</p><script>x<y</script><p>Three</p></body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(importers.html_text(F.col("h")).alias("t")).first().t == "One & two\nThree"


def test_stream_packs_as_units_arrive(spark, tmp_path):
    source = spark.createDataFrame([("b", i, 40) for i in range(10)], "book string, seq long, n_tokens long")
    source.where("seq < 5").coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    source.where("seq >= 5").coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = arrivals.incremental_passages(stream, 100).writeStream.format("memory").queryName("passages_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.passage, r.units, r.tokens) for r in spark.table("passages_out").collect())
    assert got == [(0, 3, 120), (1, 3, 120), (2, 3, 120)]
