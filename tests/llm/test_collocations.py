import random
import re
from collections import Counter

from inkspan.llm import collocations

SCHEMA = "doc_id long, text string, lang string, f long, phrase string"


def brute(rows, least, first=2000):
    counts, totals = {}, Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, c in counts.items():
        c = {p: f for p, f in c.items() if f >= least}
        found = []
        for p, a in c.items():
            if len(p) < 2:
                continue
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if any(100 * f >= 100 * a and inside(q) for q, f in c.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, r, totals[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


def corpus():
    rng = random.Random(13)
    common = ["the", "of", "and", "Quick", "brown", "fox", "é", "Élan", "zwölf", "日本"]
    rows = [(i, " ".join(rng.choice(common) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), 1, "x") for i in range(150)]
    rows += [(1000 + i, "same passage of nine words that many documents share\nrare%d" % i, "en", 1, "x") for i in range(40)]
    rows += [(1000, "same passage of nine words that many documents share", "en", 1, "x")] * 3
    rows += [(None, None, "en", 1, "x"), (None, "", None, 1, "x"), (5, " ,.;\t", "fr", 1, "x"), (6, "a a a a a a a a a a", "fr", 1, "x"), (7, "the of " * 20_000, "de", 1, "x")]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, first, chunk in ((10, 2000, collocations.CHUNK_BYTES), (4, 25, 500)):
        monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
        got = sorted(map(tuple, collocations.collocations(docs, least=least, first=first).collect()))
        assert got == brute(rows, least, first) and len(got) > 20


def test_scores_beyond_64_bits(spark):
    big = 10**12
    counts = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    row = collocations.scored(counts, totals).first()
    assert row.score == 1000 * big * 9 * 10**13 // (6 * big * big)


def test_empty_table(spark, no_docs):
    assert collocations.op13(no_docs).count() == 0
