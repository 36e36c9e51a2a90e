"""The registry of queries: name, function of (spark, sf_dir), and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query twice: {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Lines of documents as units, with their folded words counted.
SQL_UNITS = r"""WITH d AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lang, source, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line FROM d),
units AS (SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(line AS VARCHAR) AS id, doc_id * 1048576 + line AS seq, lang AS language, source AS collection, 'D' || CAST(doc_id AS VARCHAR) AS book, 'D' || CAST(doc_id AS VARCHAR) AS book_title,
  CAST((line - 1) // 10 + 1 AS VARCHAR) AS chapter, CAST(line AS VARCHAR) AS verse, text, 'documents' AS source, regexp_full_match(text, '[0-9]+') AS has_gap, doc_id,
  CAST(len(regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)?')) AS BIGINT) AS n_tokens FROM l)
"""
#: Units with a style from known labels.
SQL_TAGGED = SQL_UNITS + """, tagged AS (SELECT u.* EXCLUDE (n_tokens), n_tokens AS token_count, language || '-S00' || CAST(1 + quality + 2 * toxic AS VARCHAR) AS style_id,
  CASE WHEN quality IS NULL OR toxic IS NULL THEN 'insufficient_text' WHEN n_tokens < 10 THEN 'low_evidence' ELSE 'assigned' END AS status, CASE WHEN language = 'en' THEN 'A' || CAST(u.doc_id % 5 AS VARCHAR) END AS reference_author
  FROM units u LEFT JOIN labels USING (doc_id))
"""
