"""The exploration query: a selection of units by hierarchy, style, status and
text, the facets that remain, paging, and how a click changes the selection."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.tokens import natural_key

HIERARCHY = ("language", "collection", "book", "chapter")
SEARCHED = ("text", "book_title", "book", "id", "style_id")


@dataclass(frozen=True)
class Selection:
    language: str = ""
    collection: str = ""
    book: str = ""
    chapter: str = ""
    style: str = ""
    status: str = ""
    focus_id: str = ""
    query: str = ""
    level: str = "language"

    def predicate(self, without: tuple[str, ...] = ()) -> Column:
        """All that is set must hold; the query is a case-blind substring of any
        searched field.  Plain comparisons, so Spark can push them to the scan."""
        out = F.lit(True)
        for name, column in [*((k, k) for k in HIERARCHY), ("style", "style_id"), ("status", "status"), ("focus_id", "id")]:
            if (value := getattr(self, name)) and name not in without:
                out = out & (F.col(column) == value)
        if (q := self.query.strip().lower()) and "query" not in without:
            hit = F.lit(False)
            for c in SEARCHED:
                hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
            out = out & hit
        return out

    def with_style(self, style: str, language: str) -> Selection:
        return replace(self, language=self.language or language, style=style, focus_id="")

    def drill(self, row: dict) -> Selection:
        """Fills what is unset from a node and goes one level down; never widens."""
        levels = (*HIERARCHY, "verse")
        filled = {k: str(row[k]) for k in HIERARCHY if not getattr(self, k) and row.get(k) is not None}
        down = levels[min(levels.index(row["level"]) + 1, 4)]
        return replace(self, **filled, focus_id=str(row["id"]) if row["level"] == "verse" else "", level=down)

    def at_level(self, level: str) -> Selection:
        return replace(self, level=level, focus_id="")

    def start_level(self) -> str:
        return next((k for k in HIERARCHY if not getattr(self, k)), "verse")


def path_selection(path: list[dict]) -> Selection:
    """The selection of the last node of a path of nodes."""
    if not path:
        return Selection()
    last = path[-1]
    names = {f.name for f in fields(Selection)}
    return Selection(**{k: str(last[k]) for k in HIERARCHY if last.get(k) is not None and k in names}, focus_id=str(last["id"]) if last["level"] == "verse" else "")


def grouping_path(path: list[dict], level: str) -> list[dict]:
    """The nodes of a path above a level."""
    levels = (*HIERARCHY, "verse")
    cut = next((i for i, row in enumerate(path) if levels.index(row["level"]) >= levels.index(level)), len(path))
    return path[:cut]


def select(units: DataFrame, selection: Selection) -> DataFrame:
    return units.where(selection.predicate())


def facets(units: DataFrame, selection: Selection) -> DataFrame:
    """(facet, value, place): the values that each list offers, given what is
    selected above it, in natural order."""
    parts = []
    for i, facet in enumerate((*HIERARCHY, "style_id")):
        above = Selection(**{k: getattr(selection, k) for k in HIERARCHY[:i]}, status=selection.status if facet == "style_id" else "")
        value = F.col(facet).cast("string")
        parts.append(units.where(above.predicate()).where(value.isNotNull() & (value != "")).select(F.lit(facet).alias("facet"), value.alias("value")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(natural_key(F.col("value")), "value")))


def page(units: DataFrame, selection: Selection, number: int, size: int = 50) -> DataFrame:
    """The number-th page of the selected units in source order."""
    return select(units, selection).orderBy("seq").offset(number * size).limit(size)


#: Named scopes of a corpus, as conditions on a unit.
SCOPES = {
    "all": "true",
    "sinaiticus": "source <=> 'sinaiticus'",
    "lxx": "collection <=> 'LXX'",
    "nt": "collection <=> 'NT'",
    "christian": "language <=> 'grc' and not (collection <=> 'LXX')",
    "noncanonical": "language <=> 'grc' and canon <=> 'none'",
    "greek": "language <=> 'grc'",
    "hebrew": "language <=> 'hbo'",
    "arabic": "language <=> 'arb'",
    "tanakh": "language <=> 'hbo' and collection <=> 'Tanakh'",
    "quran": "collection <=> 'Quran'",
}


def scoped(units: DataFrame, scope: str = "christian", works: list[str] | None = None, language: str | None = None, scopes: dict[str, str] = SCOPES) -> DataFrame:
    """The units of a named scope, of some works only (by code, whatever its case; none
    given: all) and of one language."""
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope!r}; choose from {', '.join(sorted(scopes))}")
    out = units.where(F.expr(scopes[scope]))
    if works:
        out = out.where(F.upper("work").isin(sorted({w.upper() for w in works})))
    return out if language is None else out.where(F.col("language") == language)
