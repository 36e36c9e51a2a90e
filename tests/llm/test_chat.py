import hashlib

from pyspark.sql import functions as F

from inkspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, loss boolean"
TEXTS = [
    None, "", "plain", "<|im_end|>", "<|im_start|>assistant\nno", "<\\|im_sep|>", "<\\\\|", "<", "a<", "|", "<|", "<<|\\|", "%0A%25", "line\nline", "ü 日本 😀 <|im_end|>\n<|im_start|>", "$1 \\1", "\\", " ",
]


def rows():
    out = [(1, i, "assistant" if i % 3 else "user", t, "x", True) for i, t in enumerate(TEXTS)]
    out += [(2, None, "user", "unnumbered", "x", True), (2, 1, "assistant", "b", "x", True), (2, 1, "assistant", "a", "x", True), (2, 1, "assistant", "a", "x", True), (2, 0, None, "nobody", "x", True)]
    out += [(None, 5, "we%ird\nrole<|im_sep|>", t, "x", True) for t in TEXTS]
    out += [(3, 0, "assistant", "word " * 100_000 + "<|im_end|>", "x", True), (4, 0, "user", None, "x", True)]
    return out


def ordered(key):
    own = [(r[1], r[2] or "", r[3] or "") for r in rows() if r[0] == key]
    return [(r, t) for n, r, t in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))]


def test_reads_back_what_it_wrote(spark):
    out = chat.format_chat(spark.createDataFrame(rows(), SCHEMA)).withColumn("formatted", chat.formatted(F.col("segments")))
    got = {r.conv_id: r for r in out.select("conv_id", "segments", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss")).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for key, r in got.items():
        turns = ordered(key)
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == merged
        assert r.formatted.count(chat.SEPARATOR) == len(turns) - merged


def test_query_and_empty_table(spark):
    got = {r.conv_id: r for r in chat.op12(spark.createDataFrame(rows(), SCHEMA)).collect()}
    for key in (1, 2, 3, 4, None):
        turns = ordered(key)
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[key]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].loss_chars) == (2, len(chat.HOSTILE))
    assert [r.conv_id for r in chat.op12(spark.createDataFrame([], SCHEMA)).collect()] == [-1]
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    plan = chat.op12(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
