import pytest
from pyspark.sql import functions as F

from inkspan.operators import morphology
from inkspan.sources import graph_features, importers

FILES = {
    "otype": "@node\n@valueType=str\n\n1-9\tsign\nword\nword\n12-13\tword\nverse\nverse\n16\tchapter\nbook\n",
    "oslots": "@edge\n@valueType=str\n\n10\t1-3\n4,5\n6\n7-9\n14\t1-5\n6-9\n16\t1-9\n1-9\n",
    "g_cons_utf8": "@node\n@valueType=str\n\n10\tבראשית\nברא\nאלהים\n13\tאת\\\\ה\\tx\n",
    "trailer": "@node\n@valueType=str\n\n10\t \n\n׃ \n13\t־\n",
    "book": "@node\n@valueType=str\n\n17\tGenesis\n",
    "chapter": "@node\n@valueType=int\n\n16\t1\n",
    "verse": "@node\n@valueType=int\n\n14\t1\n2\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("graph")
    for name, text in FILES.items():
        (path / f"{name}.tf").write_text(text, encoding="utf-8")
    return str(path)


def test_lines_specs_and_edges():
    parse = lambda text: list(graph_features.parsed(iter(text.splitlines(keepends=True))))
    assert list(graph_features.numbers("1,3-5,9")) == [1, 3, 4, 5, 9]
    assert parse("@node\n@x=y\n\na\nb\n7\tc\n\nd\n") == [("node", 1, None, "a"), ("node", 2, None, "b"), ("node", 7, None, "c"), ("node", 8, None, ""), ("node", 9, None, "d")]
    assert parse("@node\n\n2,4-5\tx\ny\n") == [("node", 2, None, "x"), ("node", 4, None, "x"), ("node", 5, None, "x"), ("node", 6, None, "y")]
    assert parse("@edge\n\n3\t1-2\n9\n") == [("edge", 3, 1, None), ("edge", 3, 2, None), ("edge", 4, 9, None)]
    assert parse("@edge\n@edgeValues\n\n3\t1\tgoes\\tto\n2\tvia\n") == [("edge", 3, 1, "goes\tto"), ("edge", 4, 2, "via")]
    assert parse("@config\n@x\n\n1\tz\n") == [] and parse("") == []
    assert graph_features.plain("a\\\\tb\\n") == "a\\tb\n"


def test_nodes_are_joined_by_slots(spark, folder):
    rows = graph_features.features(spark, folder, list(FILES))
    slots = graph_features.covered(rows)
    got = {(r.outer, r.inner): r.at for r in graph_features.inside(slots, "verse", "word").collect()}
    assert got == {(14, 10): 1, (14, 11): 4, (15, 12): 6, (15, 13): 7}
    assert {(r.outer, r.inner) for r in graph_features.inside(slots, "book", "chapter").collect()} == {(17, 16)}
    assert slots.where("type = 'sign'").count() == 9


def test_samaritan_units(spark, folder):
    units = graph_features.samaritan(spark, folder).orderBy("place").collect()
    assert [(u.book, u.chapter, u.verse, u.place) for u in units] == [("GENESIS", "1", "1", 1), ("GENESIS", "1", "2", 2)]
    assert units[0].text == "בראשית ברא" and units[1].text == "אלהים את\\ה x־"
    assert {u.witness for u in units} == {"SP"} and {u.language for u in units} == {"hbo"}


def test_codes_to_parts_of_speech(spark):
    golden = {"HC/Vqw3ms": ["conjunction", "verb"], "HR/Ncfsa": ["preposition", "noun"], "HTd/Ncmpa": ["particle", "noun"], "HNcmsc/Sp3ms": ["noun", "suffix"], "HVqp3ms": ["verb"], "AC/X/Aamsa": ["conjunction", "adjective"], "N": ["noun"], "": [], None: [], "h/?": [], "HD": ["adverb"], "HPp3ms": ["pronoun"]}
    rows = spark.createDataFrame(list(enumerate(golden)), "i int, morph string").withColumn("tags", morphology.tags_of(F.col("morph"))).collect()
    assert {r.morph: r.tags for r in rows} == golden


def test_rates_of_a_verse(spark, tmp_path):
    xml = """<osis xmlns="o"><verse osisID="Gen.1.1"><w morph="HR/Ncfsa">a</w><note><w morph="HVqp3ms">x</w></note><seg><w morph="HVqp3ms">b</w></seg><w morph="HNcmpa">c</w><w>d</w></verse><verse osisID="Gen.1.2"><w>e</w></verse></osis>"""
    (tmp_path / "Gen.xml").write_text(xml)
    words = importers.morphology(spark, str(tmp_path / "*.xml"))
    units = morphology.unit_tags(words, ["book", "chapter", "verse"]).withColumn("v", morphology.rates(F.col("tags")))
    by = {r.verse: r for r in units.collect()}
    assert by["1"].tags == ["preposition", "noun", "verb", "noun"] and by["2"].tags == []
    named = dict(zip(morphology.feature_names(), by["1"].v, strict=True))
    assert (named["pos:noun"], named["pos:verb"], named["pos:suffix"]) == (50.0, 25.0, 0.0)
    assert named["posbi:preposition>noun"] == pytest.approx(100 / 3) == named["posbi:noun>verb"] == named["posbi:verb>noun"] and named["posbi:noun>noun"] == 0
    assert set(by["2"].v) == {0.0}
