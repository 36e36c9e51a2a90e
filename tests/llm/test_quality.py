import re
from collections import Counter

from inkspan.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    places = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_signals_equal_brute_force(spark, small, edge_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(edge_docs.select(edge_docs.doc_id + 10**6, "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op1(docs).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict(spark, edge_docs):
    forward = quality.quality_rules(edge_docs, quality.RULES)
    alone = edge_docs.select("doc_id", quality.cascade(edge_docs.text, quality.RULES[::-1]).isNull().alias("kept"))
    assert {(r.doc_id, r.kept) for r in forward.collect()} == {(r.doc_id, r.kept) for r in alone.collect()}
    assert "lang" in forward.columns and dict(forward.dtypes)["kept"] == "boolean"


def test_rules_that_reject_much_of_what_is_left_for_little_come_first():
    a, b, c, d = (quality.Rule(x, (y,), None) for x, y in (("a", "n_letters"), ("b", "n_upper"), ("c", "n_symbols"), ("d", "n_words")))
    seconds = {"n_letters": 1.0, "n_upper": 0.1, "n_symbols": 0.1, "words": 5.0, "n_words": 0.0}
    rows = [frozenset("abd"), frozenset("abd"), frozenset("ad"), frozenset()]
    got = quality.order(quality.Measured(seconds, rows), [a, b, c, d])
    assert [r.name for r in got] == ["b", "a", "c", "d"]  # a leaves d nothing to reject
    got = quality.order(quality.Measured(seconds, rows), [a, b, c, d], ["words", "n_words"])
    assert [r.name for r in got] == ["d", "a", "b", "c"]  # what is there already costs nothing


def test_steps_are_taken_once_and_in_order():
    assert quality.steps_of(("n_words", "n_repeat_words")) == ["words", "n_words", "n_repeat_words"]
    assert quality.steps_of(("n_words", "n_repeat_words"), {"words", "n_words"}) == ["n_repeat_words"]


def test_reason_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "w " * 60, "x"), (None, " ".join(f"word{i}" for i in range(60)), "y"), (1, None, "z")], "doc_id long, text string, rejected_by string")
    got = {tuple(r) for r in quality.quality_rules(docs, reason=True, ordered=quality.RULES).select("doc_id", "rejected_by", "kept").collect()}
    assert got == {(None, "repeated_windows", False), (None, None, True), (1, "few_words", False)}


def test_empty_table(no_docs):
    assert quality.op1(no_docs).count() == 0
