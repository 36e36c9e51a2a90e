"""Writers of results: CSV with fixed columns, JSON lines, and a report folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_COLUMNS = ("id", "language", "collection", "book", "book_title", "chapter", "verse", "text", "source", "witness", "style_id", "status", "passage_id", "evidence_tokens", "token_count", "distance_margin", "reference_author")
ROLLUP_COLUMNS = ("level", "language", "collection", "book", "chapter", "id", "unit_count", "assigned_count", "insufficient_count", "low_evidence_count", "style_count", "style_counts", "dominant_style")


def as_text(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns as strings: nested values as JSON, null and absent ones empty."""
    types = dict(df.dtypes)
    one = lambda c: F.lit("") if c not in types else F.coalesce(F.to_json(c) if types[c].split("<")[0] in ("array", "map", "struct") else F.col(c).cast("string"), F.lit(""))
    return df.select(*[one(c).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """CSV with a header in each part; quotes are doubled, text is kept as it is."""
    as_text(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(analysis, path: str) -> None:
    """units and rollups as CSV and Parquet, passages and styles as JSON lines."""
    analysis.units.write.mode("overwrite").partitionBy("language").parquet(f"{path}/units.parquet")
    write_csv(analysis.units, f"{path}/units.csv", UNIT_COLUMNS)
    write_csv(analysis.rollups, f"{path}/rollups.csv", ROLLUP_COLUMNS)
    analysis.passages.write.mode("overwrite").json(f"{path}/passages.json")
    analysis.styles.write.mode("overwrite").json(f"{path}/styles.json")
