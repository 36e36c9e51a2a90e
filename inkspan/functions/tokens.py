"""The three tokenizers, which stay apart: folded words (discovery), surface words
(held-out evaluation) and words of a language's own letters (import).

Column forms run in the JVM.  ``fold`` maps the accented Latin letters; texts in
other scripts go through ``fold_any``, an Arrow UDF with full NFKD case folding.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTER = r"[\p{L}\p{Nl}\p{No}]"
FOLDED_WORD = rf"{LETTER}+(?:['’]{LETTER}+)?"
SURFACE_WORD = rf"{LETTER}+(?:['’]{LETTER}+)*"
#: Words of each language at import, after ``bare``.
SCRIPTS = {"eng": "[a-z]+(?:'[a-z]+)*", "grc": r"[\x{0370}-\x{03FF}]+", "hbo": r"[\x{05D0}-\x{05EA}]+", "arb": r"[\x{0621}-\x{064A}]+"}
#: Letters that count as another one, by language.
VARIANTS = {
    "grc": {"ϲ": "σ", "Ϲ": "Σ", "ϐ": "β", "ϑ": "θ", "ϰ": "κ", "ϱ": "ρ", "ϕ": "φ", "ϖ": "π", "ς": "σ"},
    "hbo": {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ"},
    "arb": {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ؤ": "و", "ئ": "ي", "ـ": ""},
}
_ACCENTED = "".join(chr(c) for c in range(0xE0, 0x180) if chr(c).islower() and len(unicodedata.normalize("NFD", chr(c))) > 1)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin text."""
    return F.replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit("ß"), F.lit("ss"))


def fold_any_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def fold_any(text: pd.Series) -> pd.Series:
    return text.map(fold_any_text, na_action="ignore")


def folded_words(text: Column, any_script: bool = False) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(fold_any(plain) if any_script else fold(plain), F.lit(FOLDED_WORD), F.lit(0))


def surface_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SURFACE_WORD), F.lit(0))


#: What one letter becomes at import, by language: its variants, and lower case and
#: straight apostrophes where the script has them.
_BARE = {
    "hbo": str.maketrans(VARIANTS["hbo"]),
    "arb": str.maketrans(VARIANTS["arb"]),
    "grc": {c: VARIANTS["grc"].get(chr(c).lower(), chr(c).lower()) for block in (range(0x370, 0x400), range(0x41, 0x5B)) for c in block},
    "eng": {ord("’"): "'", ord("‘"): "'"},
}


def bare_text(text: str, language: str) -> str:
    """A text without marks, its variant letters made one, for counting words."""
    letters = _BARE.get(language, _BARE["eng"])
    unmarked = filter(lambda c: unicodedata.category(c) != "Mn", unicodedata.normalize("NFKD", text))
    mapped = "".join(unmarked).translate(letters)
    return mapped if language in ("hbo", "arb", "grc") else mapped.lower()


@F.pandas_udf(StringType())
def bare(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else bare_text(t, lang) for t, lang in zip(text, language, strict=True)], dtype="object")


def script_words(text: Column, language: Column, any_script: bool = False) -> Column:
    """Words in the language's own letters; Latin ones where none are known."""
    given = F.coalesce(text, F.lit(""))
    plain = bare(given, language) if any_script else F.translate(F.translate(F.lower(given), _ACCENTED, _PLAIN), "’‘", "''")
    out = F.regexp_extract_all(plain, F.lit(SCRIPTS["eng"]), F.lit(0))
    for code in ("grc", "hbo", "arb"):
        out = F.when(language == code, F.regexp_extract_all(plain, F.lit(SCRIPTS[code]), F.lit(0))).otherwise(out)
    return out


def count_words(words: Column) -> Column:
    return F.size(words).cast("long")


def natural_key(value: Column) -> Column:
    """Sorts digit runs by number and the rest without case: each digit run is
    led by its length, so that longer numbers come later."""
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda x: F.ltrim(x, F.lit("0"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 4, "0"), digits(x))).otherwise(F.concat(F.lit("1"), F.lower(x)))), "\x01")
