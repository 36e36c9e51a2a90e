"""Quality rules as a short-circuit cascade.

Each rule asks for signals of the text.  A sample of rows is measured in two ways: what
a step (a signal, or the words or lines that several signals share) costs a row, and
which rows each rule rejects.  The order is then chosen greedily: next comes the rule
that rejects most of the rows still alive per cost of the steps that no rule before it
has taken.  The rules are chained in one CASE in which a step is taken when the first
rule that asks for it is reached, once a row, and its value is bound for all later ones.
Signals that are computed for every row anyway cost the rules nothing.

The order depends on the clock and so may differ between runs; verdicts don't, as a row
stays if and only if no rule rejects it.  For the same reason the name of the first rule
that rejected a row is given on request only.

Defined results: a null or empty text has no words and is rejected by ``few_words``;
long texts count whole; repeated rows are judged one by one; rules of equal worth come
in the order of their names; an empty table gives an empty result; columns of the input
are kept unless they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD_BREAK, let, word_array

SYMBOLS = "[#*$%&|<>]"

def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(got) -> Column:
    return word_array(got("text"))


def lines(got) -> Column:
    return F.filter(F.split(_text(got("text")), "\n"), lambda x: x.rlike(NOT_WORD_BREAK))


def n_words(got) -> Column:
    return F.size(got("words")).cast("long")


def word_chars(got) -> Column:
    return F.length(F.array_join(got("words"), "")).cast("long")


def n_symbols(got) -> Column:
    return F.regexp_count(_text(got("text")), F.lit(SYMBOLS)).cast("long")


def n_lines(got) -> Column:
    return F.size(got("lines")).cast("long")


def n_dup_lines(got) -> Column:
    return (F.size(got("lines")) - F.size(F.array_distinct(got("lines")))).cast("long")


def n_repeat_words(got) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    The windows' hashes are sorted with their places, so that equal windows are
    neighbours: n log n for a text of n words, whatever it repeats."""
    w = got("words")
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def of_windows(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(hashes, of_windows).cast("long")


def n_alpha_words(got) -> Column:
    return F.size(F.filter(got("words"), lambda x: x.rlike(r"\p{L}"))).cast("long")


def n_letters(got) -> Column:
    return F.length(F.regexp_replace(_text(got("text")), r"\P{L}+", "")).cast("long")


def n_upper(got) -> Column:
    return F.length(F.regexp_replace(_text(got("text")), r"\P{Lu}+", "")).cast("long")


Got = Callable[[str], Column]
#: The steps and those that each needs before it.
STEPS: dict[str, Callable[[Got], Column]] = {f.__name__: f for f in (words, lines, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_alpha_words, n_letters, n_upper)}
NEEDS: dict[str, tuple[str, ...]] = {"n_words": ("words",), "word_chars": ("words",), "n_repeat_words": ("words",), "n_alpha_words": ("words",), "n_lines": ("lines",), "n_dup_lines": ("lines",)}


@dataclass(frozen=True)
class Rule:
    """``asks`` names the signals that ``rejects`` gets, by a function from the name."""

    name: str
    asks: tuple[str, ...]
    rejects: Callable[[Got], Column]


BASE_RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda s: s("n_words") < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
)
#: Wide limits, as a clean text must pass every one of them.
RULES: tuple[Rule, ...] = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda s: 10 * s("n_symbols") > s("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 12 * s("n_words"))),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda s: 2 * s("n_dup_lines") > s("n_lines")),
    Rule("words_without_letters", ("n_words", "n_alpha_words"), lambda s: 10 * s("n_alpha_words") < 7 * s("n_words")),
    Rule("shouting", ("n_letters", "n_upper"), lambda s: 2 * s("n_upper") > s("n_letters")),
)


def steps_of(asks: Sequence[str], have: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """The steps that asks need and have lacks, each after those it needs."""
    out: list[str] = []
    for name in asks:
        out += [s for s in (*NEEDS.get(name, ()), name) if s not in have and s not in out]
    return out


def bound(steps: Sequence[str], got: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """body(values) with the steps taken in turn and each value bound once."""
    if not steps:
        return body(got)
    return let(STEPS[steps[0]](got.__getitem__), lambda v: bound(steps[1:], got | {steps[0]: v}, body))


def signals_of(text: Column, names: Sequence[str]) -> Column:
    """A struct of signals, whose shared steps are taken once."""
    return bound(steps_of(names), {"text": text}, lambda v: F.struct(*[v[n].alias(n) for n in names]))


@dataclass(frozen=True)
class Measured:
    """Seconds a row of each step, and for each row of the sample the rules that reject it."""

    seconds: dict[str, float]
    rejected: list[frozenset[str]]


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000, repeats: int = 1) -> Measured:
    """Costs and verdicts on about sample_rows rows drawn at random.

    A step's time is that of a job which takes it and what it needs, on every row of
    the sample ``repeats`` times, less the time of the job without it."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text).alias("text")).sample(share, seed=7).limit(2 * sample_rows).repartition(4).persist()
    try:
        rows = sample.count()
        rejects = F.array_compact(F.array(*[F.when(r.rejects(lambda n: F.col("s")[n]), F.lit(r.name)) for r in rules]))
        asked = sorted({a for r in rules for a in r.asks})
        verdicts = [frozenset(r["by"]) for r in sample.select(signals_of(F.col("text"), asked).alias("s")).select(rejects.alias("by")).collect()]  # 2 * sample_rows at most

        def took(steps: Sequence[str]) -> float:
            again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) if repeats > 1 else sample
            value = bound(steps, {"text": F.col("text")}, lambda v: F.hash(v[steps[-1]]) if steps else F.length(v["text"]))
            best = float("inf")
            for _ in range(2):  # the first run compiles
                began = time.perf_counter()
                again.agg(F.max(value)).collect()
                best = min(best, time.perf_counter() - began)
            return best

        times: dict[str, float] = {"": took(())}
        for step in steps_of(asked):
            times[step] = took((*NEEDS.get(step, ()), step))
        least = 1e-9
        seconds = {s: max(least, (t - times[(NEEDS.get(s) or ("",))[-1]]) / max(1, rows * repeats)) for s, t in times.items() if s}
        return Measured(seconds, verdicts)
    finally:
        sample.unpersist()


def order(measured: Measured, rules: Sequence[Rule] = RULES, have: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejection per cost on the rows that the ones before leave alive;
    ``have`` are the steps that cost nothing."""
    taken, alive, left, out = set(have), list(measured.rejected), sorted(rules, key=lambda r: r.name), []
    while left:

        def worth(rule: Rule) -> float:
            cost = 1e-9 + sum(measured.seconds[s] for s in steps_of(rule.asks, taken))
            return sum(rule.name in x for x in alive) / cost

        best = max(left, key=worth)  # the first by name if several are equal
        left.remove(best)
        taken |= {*best.asks, *steps_of(best.asks)}
        alive = [x for x in alive if best.name not in x]
        out.append(best)
    return out


def cascade(text: Column, rules: Sequence[Rule], given: dict[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects the text, or null."""
    none = F.lit(None).cast("string")

    def go(rest: Sequence[Rule], got: dict[str, Column]) -> Column:
        if not rest:
            return none
        rule = rest[0]
        return bound(steps_of(rule.asks, set(got)), got, lambda v: F.when(rule.rejects(v.__getitem__), F.lit(rule.name)).otherwise(go(rest[1:], v)))

    return go(list(rules), {"text": text} | (given or {}))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000, signals: Sequence[str] = (), ordered: Sequence[Rule] | None = None, reason: bool = False) -> DataFrame:
    """docs with ``kept`` and the signals asked for.  These are computed for every row
    and the rules reuse them; the others are computed as far as the cascade gets.
    ``ordered`` takes an order from before in place of measuring; ``reason`` adds
    ``rejected_by``, the first rule in that order that rejects (null: none)."""
    if ordered is None:
        ordered = order(measure(docs, rules, text, sample_rows), rules, signals)
    if signals:
        mark = "signals"
        while mark in docs.columns:
            mark += "_"
        with_signals = docs.withColumn(mark, signals_of(F.col(text), signals))
        docs = with_signals.withColumns({s: F.col(mark)[s] for s in signals}).drop(mark)
    first = cascade(F.col(text), ordered, {s: F.col(s) for s in signals})
    if reason:
        return docs.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())
    return docs.withColumn("kept", first.isNull())


def op1(docs: DataFrame) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules(docs.select("doc_id", "text"), signals=base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")
