"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, exact_dedup, langid, licenses, mixing, packing, quality, repair, simhash, sql, token_output, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": _over("documents", quality.op1),
    "op2_license_scan": _over("documents", licenses.op2),
    "op3_best_fit_packing": _over("documents", packing.op3),
    "op4_token_output": _over("documents", token_output.op4),
    "op5_simhash_near_dedup": _over("documents", simhash.op5),
    "op6_exact_dedup": _over("documents", exact_dedup.op6),
    "op7_mixing": _over("documents", mixing.op7),
    "op8_toxicity": lambda spark, sf_dir: toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_warc": _over("pages", warc.op9),
    "op10_language_id": _over("documents", langid.op10),
    "op11_conversation_repair": _over("conversations", repair.op11),
    "op12_chat_formatting": _over("conversations", chat.op12),
    "op13_collocations": _over("documents", collocations.op13),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _license_sql() -> str:
    rows, idf, other = licenses.weights()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    weights = ", ".join(f"({quoted(t)}, {i}, {w!r}::DOUBLE)" for t, i, w in rows)
    terms = ", ".join(f"({quoted(t)}, {w!r}::DOUBLE)" for t, w in sorted(idf.items()))
    names = ", ".join(f"({i}, {quoted(name)})" for i, (name, _) in enumerate(licenses.TEMPLATES))
    speaks = licenses.SPEAKS.replace("'", "''")
    return rf"""
WITH weights(term, template, weight) AS (VALUES {weights}), idf(term, idf) AS (VALUES {terms}), names(template, license) AS (VALUES {names}),
d AS (SELECT doc_id, coalesce(source, '_') || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR)
             || CASE WHEN doc_id % 10 = 0 THEN '' ELSE '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) END AS dir, text,
             list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{speaks}')),
                            lambda x: regexp_replace(x, '(?i)^.*(spdx-license-identifier)', '\1')) AS lines,
             -- a line without letter or digit is marked, and blocks lie between marks
             string_split(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i > 1 AND NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN chr(1) ELSE x END), chr(10)), chr(10) || chr(1)) AS parts FROM documents),
p AS (SELECT *, dir || CASE WHEN doc_id % 10 = 0 THEN '/LICENSE-' ELSE '/' END || CAST(doc_id AS VARCHAR) AS path, list_filter(parts, lambda x: contains(trim(x, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AND regexp_matches(x, '{speaks}')) AS blocks FROM d),
v AS (SELECT doc_id, list_concat(CASE WHEN len(lines) > 0 THEN list_concat(lines, blocks) ELSE [] END, CASE WHEN doc_id % 10 = 0 THEN [coalesce(text, '')] ELSE [] END) AS units FROM p),
u AS (SELECT doc_id, unnest(range(len(units))) AS unit, unnest(units) AS line FROM v),
w AS (SELECT doc_id, unit, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM u),
t AS (SELECT doc_id, unit, term, count(*) AS tf FROM w GROUP BY ALL),
x AS (SELECT t.*, tf * coalesce(idf, {other!r}::DOUBLE) AS x FROM t LEFT JOIN idf USING (term)),
m AS (SELECT *, sqrt(sum(x * x) OVER z) AS norm FROM x WINDOW z AS (PARTITION BY doc_id, unit)),
c AS (SELECT doc_id, unit, template, round(sum(x * weight) / first(norm), 6) AS cosine FROM m JOIN weights USING (term) GROUP BY doc_id, unit, template),
h AS (SELECT * FROM c JOIN names USING (template) WHERE cosine >= {licenses.COSINE}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY cosine DESC, license, template) AS k FROM h),
o AS (SELECT doc_id, first(license ORDER BY cosine DESC, license, unit) AS license, max(cosine) AS cosine FROM b WHERE k = 1 GROUP BY doc_id),
f AS (SELECT p.doc_id, dir, path, license, cosine, doc_id % 10 = 0 AS is_file FROM p LEFT JOIN o USING (doc_id)),
held AS (SELECT dir, first(license ORDER BY cosine DESC, path) AS license, max(cosine) AS cosine, first(path ORDER BY cosine DESC, path) AS path FROM f WHERE is_file AND license IS NOT NULL GROUP BY dir),
wanting AS (SELECT DISTINCT dir FROM f WHERE license IS NULL),
ancestor AS (SELECT dir, k, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS up FROM wanting, range(0, 5) t(k) WHERE k <= len(string_split(dir, '/'))),
near AS (SELECT a.dir, first(h.license ORDER BY k DESC) AS license, first(h.cosine ORDER BY k DESC) AS cosine, first(h.path ORDER BY k DESC) AS path FROM ancestor a JOIN held h ON a.up = h.dir GROUP BY a.dir)
SELECT f.doc_id, f.path, coalesce(f.license, near.license) AS license, coalesce(f.cosine, near.cosine) AS cosine,
       CASE WHEN f.license IS NOT NULL AND f.is_file THEN 'file' WHEN f.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN f.license IS NOT NULL THEN f.path ELSE near.path END AS license_path
FROM f LEFT JOIN near ON f.dir = near.dir
"""


SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines
             OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 7 * n_words
             OR 2 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS bad
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM f
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER t AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""",
    "op7_mixing": rf"""
WITH b AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest ORDER BY digest) - 1 AS k, length(bin(size)) AS w FROM b),
v AS (SELECT *, (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || CAST(k AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS stop,
             CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
      FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN stop <= weight * share OR level IS NULL THEN CAST(stop AS DOUBLE) ELSE weight * level END AS target
      FROM (SELECT *, max(CASE WHEN stop <= weight * share THEN NULL ELSE share END) OVER () AS level FROM l)),
c AS (SELECT source, w, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, w HAVING sum(size) > 0),
y AS (SELECT c.source, w, (target - CAST(3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / CAST(sum(w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY w DESC)),
z AS (SELECT source, max(CASE WHEN level * w >= 3 THEN NULL ELSE level END) AS level FROM y GROUP BY source),
e AS (SELECT v.*, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN level IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, level * w) END AS expected
      FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON v.source IS NOT DISTINCT FROM z.source),
q AS (SELECT *, floor(expected) AS certain, expected - floor(expected) AS p FROM e),
r AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(certain * size) OVER (PARTITION BY source) AS room FROM q),
x AS (SELECT *, CASE WHEN q IS NULL THEN NULL ELSE sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, digest, k) END AS until FROM r)
SELECT doc_id, size, source_size, target,
       CAST(certain AS BIGINT) * size + CASE WHEN until - size / 2.0 <= room THEN size ELSE 0 END AS taken
FROM x
""",
    "op2_license_scan": _license_sql(),
    "op11_conversation_repair": sql.REPAIR,
    "op12_chat_formatting": sql.CHAT,
    "op13_collocations": sql.COLLOCATIONS,
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
r AS (SELECT page_id, p.html, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, lower(sha1(p.html)) AS d FROM p JOIN g ON p.html = g.html),
-- base32: 40 hexadecimal digits are 160 bits, read five at a time
n AS (SELECT DISTINCT html, d FROM r),
c AS (SELECT html, k, list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda j: CAST(strpos('0123456789abcdef', substr(d, 8 * k + j + 1, 1)) - 1 AS BIGINT) << (28 - 4 * j))) AS word FROM n, range(5) t(k)),
f AS (SELECT html, string_agg(printf('%032b', CAST(word AS BIGINT)), '' ORDER BY k) AS bits FROM c GROUP BY html),
e AS (SELECT html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
        + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1), '' ORDER BY i) AS payload_digest FROM f, range(32) t(i) GROUP BY html)
SELECT page_id, CAST(strlen(r.html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r JOIN e ON r.html = e.html
""",
}
