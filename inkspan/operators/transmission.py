"""Transmitted reports: the chain of transmitters before a report, eulogies, and
whose speech is quoted.  Words are compared in their import form (``bare_text``)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from inkspan.functions.tokens import bare_text

# Verbs of transmission (alone or after waw or fa), verbs that
# introduce a report, eulogies, names and cues of the speaker, and limits.
CHAIN = (
    "حدثنا", "حدثني", "حدثتنا", "حدثتني", "حدثه", "حدثهم", "حدثوا", "يحدث", "نحدث", "اخبرنا", "اخبرني", "اخبرهم",
    "اخبره", "انبانا", "انباني", "اخبرتنا", "اخبرتني", "ثنا", "سمعت", "سمعه", "سمع", "سمعنا", "عن", "باسناده",
    "بهذا", "مثله",
)
HINGE = {
    "قال", "قالت", "قالوا", "قالا", "يقول", "تقول", "انه", "انها", "انهم", "ان", "فقال", "سمع", "يحدث",
}
EULOGIES = (
    "صلي الله عليه وسلم", "صلي الله عليه و سلم", "رضي الله عنهما", "رضي الله عنهم", "رضي الله عنها", "رضي الله عنه",
    "رضي الله عنهن", "عليه السلام", "عليها السلام", "عليهما السلام", "رحمه الله", "تبارك وتعالي", "عز وجل",
    "سبحانه وتعالي",
)
NAMES = {
    "رسول", "النبي", "نبي", "القاسم",
}
CUES = {
    "قال", "يقول", "فقال", "قالت", "سمعت", "سمع", "نادي", "دعا", "امر", "قرا", "اجاب",
}
GAP, SHARE, NAME_WORDS, LOOK_BEHIND = 10, 0.9, 8, 9

VERBS = frozenset(p + v for v in CHAIN for p in ("", "و", "ف"))
_EULOGY_BY_FIRST: dict[str, list[tuple[str, ...]]] = {}
for _phrase in (tuple(e.split()) for e in EULOGIES):
    _EULOGY_BY_FIRST.setdefault(_phrase[0], []).append(_phrase)


def letters(word: str) -> str:
    return "".join(re.findall("[ء-ي]+", bare_text(word, "arb")))


def without_eulogies(words: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(letters, display) pairs without the eulogies among them."""
    keys = [k for k, _ in words]
    drop: set[int] = set()
    for i, k in enumerate(keys):
        if i not in drop:
            hit = next((p for p in _EULOGY_BY_FIRST.get(k, ()) if tuple(keys[i : i + len(p)]) == p), ())
            drop.update(range(i, i + len(hit)))
    return [w for i, w in enumerate(words) if i not in drop]


def chain_end(keys: list[str]) -> int:
    """Where the report begins: after the last verb of transmission before a gap of
    more than GAP words, and after the name that follows it."""
    places = [i for i, k in enumerate(keys[: max(1, int(len(keys) * SHARE))]) if k in VERBS]
    if not places or places[0] > GAP:
        return 0
    last = places[0]
    for p in places[1:]:
        if p - last > GAP + 1:
            break
        last = p
    begin = next((i for i in range(last + 1, min(len(keys), last + 1 + NAME_WORDS)) if keys[i] in HINGE), last + 1)
    return begin + (keys[begin : begin + 2] == ["قال", "قال"])


def quoted(text: str) -> list[tuple[int, str]]:
    """(place, text) of quoted speech; one quotation mark alone opens to the end."""
    marks = [i for i, c in enumerate(text) if c == '"']
    spans = list(zip(marks[::2], marks[1::2], strict=False)) or [(i, len(text)) for i in marks]
    return [(a, s) for a, z in spans if (s := text[a + 1 : z].strip())]


def split(text: str) -> dict[str, object]:
    """The report without its chain, the words taken off, and who is quoted:
    prophet, other, or report (no direct speech)."""
    clean = " ".join(re.sub("[‎‏‪-‮⁦-⁩]", "", text or "").split())
    words = without_eulogies([(k, d) for d in clean.split() if (k := letters(d))])
    at = chain_end([k for k, _ in words])
    spans = quoted(clean)
    his = [s for a, s in spans if (before := {letters(x) for x in clean[:a].split()[-LOOK_BEHIND:]}) & NAMES and before & CUES]
    return {"report": " ".join(d for _, d in words[at:]), "chain_words": at, "speaker": "prophet" if his else "other" if spans else "report", "spoken": his}


def split_reports(units: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame([split(t) for t in b["text"]], columns=["report", "chain_words", "speaker", "spoken"])], axis=1)

    return units.select("id", "text").mapInPandas(run, "id string, text string, report string, chain_words long, speaker string, spoken array<string>")


def without_source_note(text: str, most: int = 12) -> str:
    """A report without the bracketed list of sources at its end."""
    m = re.search(r"\s*[(\[]([^()\[\]]*)[)\]]\s*\.?\s*$", text)
    return text[: m.start()].rstrip() if m and len(m[1].split()) <= most else text
