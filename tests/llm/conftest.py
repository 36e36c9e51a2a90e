import pytest

#: Nulls, empty and blank texts, repeated rows, ties, a long text, other scripts.
EDGE_TEXTS = [
    None, "", " \t\n", "one", "one two", "One TWO three", "one two three", "one two three four five", "one two three four five",
    "a b c a b c a b c", "x\ny\nx\n\n \nx", "héllo wörld ÉCOLE straße", "日本語 テキスト", "Привет мир", "a\x00b c", "  lead and trail  ",
    "tab\tsep\x0bvt\x0cff\rcr", "<|endoftext|> is text", "don't we'll 'tis  double  space \n \n end ", "1234 56 #$%& | <b>", "idiot clown moron",
]


@pytest.fixture()
def edge_docs(spark):
    """Edge cases with an extra column whose name clashes with outputs."""
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(30_000))
    texts = [*EDGE_TEXTS, long, long + " more"]
    rows = [(i * 3 + 1, t, [None, "en", "de", "fr"][i % 4], [None, "a", "b", "c", ""][i % 5], 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
