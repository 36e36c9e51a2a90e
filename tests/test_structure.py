import random
import time

import pytest
from pyspark.sql import functions as F

from inkspan.functions import tokens
from inkspan.operators import continuity, passages, query, rollups, witness
from inkspan.plans import structure
from inkspan.sources import units as source


def unit_rows(spark, rows):
    """(id, book, text[, has_gap[, collection]])"""
    full = [(r[0], i, "eng", r[4] if len(r) > 4 else "One", r[1], r[1], "1", str(i + 1), r[2], "s", bool(r[3]) if len(r) > 3 else False) for i, r in enumerate(rows)]
    return source.with_tokens(spark.createDataFrame(full, "id string, seq long, language string, collection string, book string, book_title string, chapter string, verse string, text string, source string, has_gap boolean"))


def w(n):
    return " ".join(["word"] * n)


def packed(spark, rows, p, floor, joinable=()):
    out = passages.greedy(unit_rows(spark, rows), p, floor, joinable)
    return sorted((r.tokens, r.book_count, r.eligible, tuple(r.unit_ids)) for r in passages.passage_rows(out).collect()), out


def test_gaps_empties_and_books_bound_passages(spark):
    got, out = packed(spark, [("a", "B1", w(30)), ("b", "B1", w(10), True), ("c", "B1", w(30)), ("d", "B2", w(20)), ("e", "B2", "")], 60, 20)
    members = [x[3] for x in got]
    assert sorted(i for m in members for i in m) == list("abcde")
    assert ("b",) in members and ("e",) in members and all(x[1] == 1 for x in got)
    assert {x[3]: x[2] for x in got}[("b",)] is False
    assert {r.id: r.n_tokens for r in out.collect()}["e"] == 0


def test_a_short_tail_joins_the_passage_before(spark):
    assert [x[0] for x in packed(spark, [("a", "B", w(60)), ("b", "B", w(5))], 60, 20)[0]] == [65]


def test_a_lone_short_unit_stays(spark):
    assert packed(spark, [("a", "B", "two words")], 60, 20)[0] == [(2, 1, False, ("a",))]


@pytest.mark.parametrize(
    ("sizes", "joined", "apart"),
    [([40, 40, 40, 300, 30, 30], ([3, 1, 2], [True, True, False]), [False, False, False, True, False, False]), ([60] * 8, ([2] * 4, [True] * 4), [False] * 8), ([60, 60, 20, 500, 30, 500], ([3, 1, 1, 1], [True, True, False, True]), None)],
)
def test_short_books_join_only_in_continuous_works(spark, sizes, joined, apart):
    rows = [(f"u{i}", f"Q{i:03d}", w(n), False, "Quran") for i, n in enumerate(sizes)]
    by_first = lambda got: sorted(got, key=lambda x: int(min(x[3], key=lambda i: int(i[1:]))[1:]))
    got = by_first(packed(spark, rows, 600, 100, ("Quran",))[0])
    assert ([x[1] for x in got], [x[2] for x in got]) == joined
    if apart is not None:
        assert [x[2] for x in by_first(packed(spark, rows, 600, 100)[0])] == apart


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        passages.greedy(unit_rows(spark, [("a", "B", "x")]), 10, 20)


def test_tokenizers(spark):
    df = spark.createDataFrame([("L’Été d'un jour-là 12 x'y'z ß",)], "t string")
    r = df.select(tokens.folded_words(F.col("t")).alias("a"), tokens.surface_words(F.col("t")).alias("b"), tokens.folded_words(F.col("t"), True).alias("c")).first()
    assert r.a == ["l’ete", "d'un", "jour", "la", "x'y", "z", "ss"] == r.c
    assert r.b == ["L’Été", "d'un", "jour", "là", "x'y'z", "ß"]


def test_other_scripts(spark):
    df = spark.createDataFrame([("ἐν ἀρχῇ", "grc"), ("בְּרֵאשִׁית בָּרָא", "hbo"), ("بِسْمِ ٱللَّهِ", "arb")], "t string, l string")
    got = [r.w for r in df.select(tokens.script_words(F.col("t"), F.col("l"), True).alias("w")).collect()]
    assert got[0] == ["εν", "αρχη"] and got[1][0][-1] == "ת" and [len(x) for x in got] == [2, 2, 2]


def test_natural_order(spark):
    values = ["a10", "a2", "B1", "10", "9", "a02"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").orderBy(tokens.natural_key(F.col("v")), "v").collect()
    assert [r.v for r in rows] == ["9", "10", "a02", "a2", "a10", "B1"]


def test_violations(spark):
    good = unit_rows(spark, [("a", "B", "x"), ("b", "B", "")])
    assert source.violations(good, ("eng",)).count() == 0
    bad = good.withColumn("id", F.lit("a")).withColumn("collection", F.lit(" ")).withColumn("text", F.lit(None).cast("string")).withColumn("has_gap", F.lit(None).cast("boolean")).withColumn("language", F.lit("xx"))
    assert {r.rule for r in source.violations(bad, ("eng",)).collect()} == {"collection must be a nonempty string", "text must be a string", "has_gap must be boolean", "unsupported language", "duplicate id"}


def test_corpus_round_trip(spark, tmp_path):
    u = unit_rows(spark, [("a", "B", 'quote " and, comma'), ("b", "B", "")]).drop("n_tokens")
    source.write_corpus(u, f"file://{tmp_path}/c")
    back = source.load_corpus(spark, f"file://{tmp_path}/c")
    assert {(r.id, r.text, r.has_gap) for r in back.collect()} == {("a", 'quote " and, comma', False), ("b", "", False)}
    source.write_corpus(u.withColumn("id", F.lit("same")), f"file://{tmp_path}/d")
    with pytest.raises(ValueError, match="same"):
        source.load_corpus(spark, f"file://{tmp_path}/d")


def test_witness_needs_coverage_before_priority(spark):
    rows = [("a", 0, "S", 2), ("b", 1, "L", 10), ("c", 2, "L", 10)]
    u = spark.createDataFrame([(i, s, "grc", "NT", "MARK", "1", "1", wit, "src", n) for i, s, wit, n in rows], "id string, seq long, language string, collection string, book string, chapter string, verse string, witness string, source string, n_tokens long")
    c = witness.choices(u)
    assert {r.witness: r.chosen for r in c.collect()} == {"S": False, "L": True}
    ids = [r.id for r in witness.numbered(witness.primary(u, c), ["language", "book", "witness", "chapter", "verse"]).orderBy("seq").collect()]
    assert ids == ["grc:MARK:L:1:1", "grc:MARK:L:1:1#2"]


def test_witnesses_are_compared_by_words(spark):
    pairs = spark.createDataFrame([("grc", "M", "P", "one two three", "one 2 three"), ("grc", "M", "Q", "one two", "one two")], "language string, book string, witness string, primary_text string, other_text string")
    got = {r.witness: r for r in witness.compared(pairs).collect()}
    assert got["P"].similarity < 1 and "[-two-]" in got["P"].marked and "{+2+}" in got["P"].marked
    assert got["Q"].similarity == 1


def tagged(spark, rows):
    cols = "id string, seq long, language string, collection string, book string, book_title string, chapter string, text string, style_id string, status string, token_count long"
    return spark.createDataFrame(rows, cols)


def test_reach_and_rollups_of_two_styles(spark):
    spread = [("A", "1", "1"), ("A", "1", "2"), ("A", "2", "1"), ("B", "3", "1"), ("B", "3", "2"), ("B", "4", "1")]
    rows = [(f"{c}{b}{ch}{s}", i * 2 + int(s[-1]), "eng", c, b, b, ch, "t", s, "assigned", 10) for i, (c, b, ch) in enumerate(spread) for s in ("S001", "S002")]
    t = tagged(spark, rows)
    s = {r.style_id: (r.chapter_count, r.book_count, r.collection_count, r.unit_count, r.token_count) for r in rollups.style_summary(t).collect()}
    assert s == {"S001": (6, 4, 2, 6, 60), "S002": (6, 4, 2, 6, 60)}
    levels = rollups.levels(t).collect()
    assert {r.level: r.style_counts for r in levels if r.level == "language"} == {"language": "S001=6,S002=6"}
    assert [sum(r.level == x for r in levels) for x in ("language", "collection", "book", "chapter")] == [1, 2, 4, 6]


def test_selection_drills_without_widening():
    s = query.Selection(collection="A", query=" x ")
    d = s.drill({"level": "collection", "language": "eng", "collection": "Z", "book": None, "chapter": None, "id": None})
    assert (d.language, d.collection, d.level, d.query) == ("eng", "A", "book", " x ")
    assert query.Selection(language="eng", collection="A").start_level() == "book"
    path = [{"level": "language", "language": "eng"}, {"level": "collection", "language": "eng", "collection": "A"}]
    assert query.path_selection(path).collection == "A" and query.grouping_path(path, "collection") == path[:1]
    assert s.with_style("S1", "grc").language == "grc"


def test_selection_filters(spark):
    t = tagged(spark, [("u1", 1, "eng", "A", "b1", "Title", "1", "Hello World", "S1", "assigned", 5), ("u2", 2, "eng", "A", "b2", "Other", "1", None, None, "insufficient_text", None)])
    pick = lambda **k: [r.id for r in query.select(t, query.Selection(**k)).collect()]
    assert pick(query=" WORLD ") == ["u1"] and pick(query="title") == ["u1"] and pick(status="insufficient_text") == ["u2"] and pick(style="S1", language="grc") == [] and pick(focus_id="u2") == ["u2"] and pick() == ["u1", "u2"]
    share = {r.style_id: r for r in rollups.breakdown(t, "language").collect()}
    assert share["S1"].share == 1.0 and share[None].missing_words == 1 and share[None].share == 0.0


def test_exact_windows_and_even_picks(spark):
    u = spark.createDataFrame([("x", "a", 0, i) for i in range(7)] + [("x", "b", 1, i) for i in range(6)], "book string, id string, seq long, pos int")
    got = {(r.window, r.id): (r.token_start, r.token_end) for r in passages.exact(u, 5, ("book",)).collect()}
    assert got == {(0, "a"): (0, 5), (1, "a"): (5, 7), (1, "b"): (0, 3)}
    rows = spark.createDataFrame([(0, i) for i in range(57)], "g int, o int")
    want = sorted({int(i * 56 / 19) for i in range(20)})
    assert sorted(r.o for r in passages.evenly(rows, 20, ("g",), "o").collect()) == want


def test_even_picks_of_large_groups_by_ranges(spark):
    rows = spark.createDataFrame([(g, i, "n") for g, n in ((None, 57), ("a", 1), ("b", 20), ("c", 21), ("d", 5000)) for i in range(n)], "g string, o int, at string").repartition(7)
    got, want = (sorted(((r.g or "", r.o) for r in f(rows, 20, ("g",), "o").collect())) for f in (passages.evenly_ranged, lambda x, *a: passages.evenly(x.drop("at"), *a)))
    assert got == want and len(got) == 81
    tied = passages.evenly_ranged(spark.range(5000).selectExpr("1 as g", "id div 100 as o", "id"), 20, ("g",), "o").collect()
    assert [sorted(r.o for r in tied), len({r.id for r in tied})] == [sorted(int(i * 4999 / 19) // 100 for i in range(20)), 20]
    assert passages.evenly_ranged(rows.limit(0), 20, ("g",), "o").count() == 0
    plan = structure.passage_sample20(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "row_number" in x and "part" not in x]  # no task numbers a whole language


def test_runs_break_at_gaps(spark):
    u = spark.createDataFrame([("x", 1, 1, False), ("x", 2, 2, False), ("x", 3, 4, False), ("x", 4, 5, True), ("x", 5, 6, False)], "book string, seq long, n int, has_gap boolean")
    got = continuity.runs(u, continuity.follows_by_number("n", ("book",)), ("book",)).orderBy("seq").collect()
    assert [r.run for r in got] == [1, 1, 2, 3, 4]


def test_packing_is_linear_in_one_segment(spark):
    def seconds(n):
        units = spark.range(n).selectExpr("'s' as k", "id as seq", "cast(20 + id % 11 as long) as n_tokens").repartition(4).cache()
        units.count()
        began = time.perf_counter()
        got = passages.packed(units, ["k"], 1200, 200).groupBy("block").count().count()
        assert got > n // 60
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(80_000), seconds(320_000)
    assert large < 8 * small + 2, (small, large)


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(0, 700)) for k in "abcd" for i in range(rng.choice([1, 2, 60]))] + [(None, 0, 5), (None, 1, 2000), (None, 2, 10)]
    want = {}
    for k in {r[0] for r in rows}:
        block, total, mine = 0, 0, []
        for _, i, n in (r for r in rows if r[0] == k):
            mine.append((i, block))
            total += n
            if total >= 1200:
                block, total = block + 1, 0
        last = block - 1 if block and total < 200 else block
        want |= {(k, i): min(b, last) for i, b in mine}
    got = passages.packed(spark.createDataFrame(rows, "k string, seq long, n_tokens long").repartition(3), ["k"], 1200, 200).collect()
    assert {(r.k, r.seq): r.block for r in got} == want and len(got) == len(rows)


def test_ids_are_percent_encoded(spark):
    from urllib.parse import quote

    parts = ["a b", "x*y~z", "q+r/s", "É:1", "plain-._"]
    rows = spark.createDataFrame([(p,) for p in parts], "p string").select(witness.quoted(F.col("p")).alias("q"))
    assert [r.q for r in rows.collect()] == [quote(p, safe="-.") for p in parts]
