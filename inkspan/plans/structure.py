"""Registered queries on units, passages, rollups, selections and expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import tokens
from inkspan.operators import continuity, evaluate, expectation, passages, query, rollups, witness
from inkspan.sources import units as source

from .registry import SQL_TAGGED, SQL_UNITS, register, table

PASSAGE, FLOOR = 120, 20


def units(spark: SparkSession, sf: str) -> DataFrame:
    return source.document_units(table(spark, sf, "documents"))


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return source.with_tokens(units(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return source.tagged_units(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("unit_scan", SQL_UNITS + "SELECT id, seq, language, collection, book, chapter, verse, text, has_gap FROM units")
def unit_scan(spark, sf):
    return units(spark, sf).select("id", "seq", "language", "collection", "book", "chapter", "verse", "text", "has_gap")


@register("token_counts", SQL_UNITS + r"""SELECT id, n_tokens AS folded, CAST(len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*')) AS BIGINT) AS surface,
 CAST(len(regexp_extract_all(translate(lower(strip_accents(text)), '’‘', ''''''), '[a-z]+(?:''[a-z]+)*')) AS BIGINT) AS script FROM units""")
def token_counts(spark, sf):
    u = counted(spark, sf)
    return u.select("id", F.col("n_tokens").alias("folded"), tokens.count_words(tokens.surface_words(F.col("text"))).alias("surface"), tokens.count_words(tokens.script_words(F.col("text"), F.col("language"))).alias("script"))


@register("corpus_violations", SQL_UNITS + """, v AS (SELECT CAST(doc_id % 900 AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE collection END AS collection, language, text, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE has_gap END AS has_gap FROM units)
SELECT 'collection must be a nonempty string' AS rule, id, count(*) AS n FROM v WHERE trim(collection) = '' GROUP BY id
UNION ALL SELECT 'unsupported language', id, count(*) FROM v WHERE language NOT IN ('en', 'fr', 'de') GROUP BY id
UNION ALL SELECT 'has_gap must be boolean', id, count(*) FROM v WHERE has_gap IS NULL GROUP BY id
UNION ALL SELECT 'duplicate id', id, count(*) FROM v GROUP BY id HAVING count(*) > 1""")
def corpus_violations(spark, sf):
    u = units(spark, sf)
    dirty = u.withColumn("id", (F.col("doc_id") % 900).cast("string")).withColumn("collection", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("collection"))).withColumn("has_gap", F.when(F.col("doc_id") % 11 != 0, F.col("has_gap")))
    return source.violations(dirty, ("en", "fr", "de"), "en")


_WITNESSED = SQL_UNITS + """, w AS (SELECT *, 'B' || CAST(doc_id % 40 AS VARCHAR) AS wbook, ['S', 'B', 'L', 'Q', 'X1', 'X2'][CAST(doc_id % 6 AS INT) + 1] AS witness FROM units),
sizes AS (SELECT language, wbook AS book, witness, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS units FROM w GROUP BY language, wbook, witness, source),
f AS (SELECT *, tokens >= 0.9 * max(tokens) OVER (PARTITION BY language, book) AS fit,
      coalesce(nullif(list_position(['S', 'B', 'L', 'A', 'SP', 'Swete', 'Lake', 'Bonnet', 'T', 'H', 'Q', 'G'], witness), 0) - 1, 12) AS rank FROM sizes),
c AS (SELECT language, book, witness, source, tokens, units, fit, row_number() OVER (PARTITION BY language, book ORDER BY fit DESC, rank, tokens DESC, witness, source) = 1 AS chosen FROM f)
"""


def _witnessed(spark, sf):
    letters = F.array(*map(F.lit, ("S", "B", "L", "Q", "X1", "X2")))
    return counted(spark, sf).withColumn("book", F.concat(F.lit("B"), (F.col("doc_id") % 40).cast("string"))).withColumn("witness", F.element_at(letters, (F.col("doc_id") % 6 + 1).cast("int")))


@register("witness_choice", _WITNESSED + "SELECT * FROM c")
def witness_choice(spark, sf):
    return witness.choices(_witnessed(spark, sf))


@register("repeat_ids", _WITNESSED + """, p AS (SELECT w.* FROM w JOIN c ON w.language = c.language AND w.wbook = c.book AND w.witness = c.witness AND w.source = c.source WHERE chosen),
o AS (SELECT *, language || ':' || collection || ':' || wbook || ':' || witness || ':' || chapter || ':' || verse AS base, row_number() OVER (PARTITION BY language, collection, wbook, witness, chapter, verse ORDER BY seq) AS occurrence FROM p)
SELECT seq, CASE WHEN occurrence = 1 THEN base ELSE base || '#' || CAST(occurrence AS VARCHAR) END AS id, CAST(occurrence AS BIGINT) AS occurrence FROM o""")
def repeat_ids(spark, sf):
    u = _witnessed(spark, sf)
    kept = witness.primary(u, witness.choices(u))
    return witness.numbered(kept, ["language", "collection", "book", "witness", "chapter", "verse"]).select("seq", "id", F.col("occurrence").cast("long").alias("occurrence"))


@register("witness_similarity")
def witness_similarity(spark, sf):
    u = _witnessed(spark, sf)
    return witness.similarity(u, witness.choices(u))


_ISLANDS = SQL_UNITS + """, b AS (SELECT *, has_gap OR n_tokens = 0 AS breaks FROM units),
i AS (SELECT *, CAST(sum(CASE WHEN breaks OR coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY language, collection, book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island
      FROM (SELECT *, lag(breaks) OVER (PARTITION BY language, collection, book ORDER BY seq) AS before FROM b))
"""


@register("continuity_islands", _ISLANDS + "SELECT id, breaks, island FROM i")
def continuity_islands(spark, sf):
    return continuity.islands(counted(spark, sf), F.col("has_gap") | (F.col("n_tokens") == 0)).select("id", "breaks", F.col("island").cast("long").alias("island"))


_PASSAGES = _ISLANDS.replace("WITH d AS", "WITH RECURSIVE d AS") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY language, collection, book, island ORDER BY seq) AS k FROM i),
fold AS (SELECT language, collection, book, island, id, seq, n_tokens, k, 0 AS block, n_tokens AS total FROM r WHERE k = 1
  UNION ALL SELECT r.language, r.collection, r.book, r.island, r.id, r.seq, r.n_tokens, r.k, CASE WHEN fold.total >= {PASSAGE} THEN fold.block + 1 ELSE fold.block END,
    CASE WHEN fold.total >= {PASSAGE} THEN r.n_tokens ELSE fold.total + r.n_tokens END
  FROM fold JOIN r ON r.language = fold.language AND r.collection = fold.collection AND r.book = fold.book AND r.island = fold.island AND r.k = fold.k + 1),
t AS (SELECT *, max(block) OVER z AS last FROM fold WINDOW z AS (PARTITION BY language, collection, book, island)),
s AS (SELECT *, sum(CASE WHEN block = last THEN n_tokens ELSE 0 END) OVER (PARTITION BY language, collection, book, island) AS tail FROM t),
j AS (SELECT *, CASE WHEN block = last AND last > 0 AND tail < {FLOOR} THEN block - 1 ELSE block END AS joined FROM s),
p AS (SELECT id, seq, language, collection, book, n_tokens, 'P-' || substr(sha256(string_agg(id, chr(0) ORDER BY seq) OVER z), 1, 16) AS passage_id,
      CAST(sum(n_tokens) OVER z AS BIGINT) AS passage_tokens, count(*) OVER z AS passage_units, CAST(1 AS BIGINT) AS passage_books, sum(n_tokens) OVER z >= {FLOOR} AS eligible
      FROM j WINDOW z AS (PARTITION BY language, collection, book, island, joined))
"""


def _packed(spark, sf):
    return passages.greedy(counted(spark, sf), PASSAGE, FLOOR)


@register("passages_greedy", _PASSAGES + "SELECT id, passage_id, passage_tokens, passage_units, passage_books, eligible FROM p")
def passages_greedy(spark, sf):
    return _packed(spark, sf).select("id", "passage_id", "passage_tokens", "passage_units", "passage_books", "eligible")


@register("passage_rollup", _PASSAGES + """SELECT language, count(DISTINCT passage_id) AS passages, count(DISTINCT CASE WHEN eligible THEN passage_id END) AS eligible_passages, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS units,
 round(sum(CASE WHEN eligible THEN n_tokens ELSE 0 END) * 1.0::DOUBLE / sum(n_tokens), 6) AS coverage FROM p GROUP BY language""")
def passage_rollup(spark, sf):
    """Flagship: greedy passages rolled up by language."""
    rows = _packed(spark, sf).groupBy("language", "passage_id").agg(F.first("eligible").alias("eligible"), F.sum("n_tokens").alias("n"), F.count("*").alias("units"))
    return rows.groupBy("language").agg(
        F.count("*").alias("passages"), F.count_if("eligible").alias("eligible_passages"), F.sum("n").alias("tokens"), F.sum("units").alias("units"),
        F.round(F.sum(F.when(F.col("eligible"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"),
    )


@register("passages_joined")
def passages_joined(spark, sf):
    u = counted(spark, sf)
    return passages.passage_rows(passages.greedy(u, PASSAGE, 100, ("src0", "src1", "src2"))).drop("text")


_TOKENS = SQL_UNITS + r""", tok AS (SELECT language, collection, book, doc_id, id, seq, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT *, regexp_extract_all(replace(lower(strip_accents(text)), 'ß', 'ss'), '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)?') AS words FROM units))
"""


@register("passages_exact", _TOKENS + """, n AS (SELECT *, (row_number() OVER (PARTITION BY language, collection, book ORDER BY seq, pos) - 1) // 100 AS win FROM tok),
f AS (SELECT *, count(*) OVER (PARTITION BY language, collection, book, win) AS size FROM n)
SELECT book, CAST(win AS BIGINT) AS "window", id, CAST(min(pos) AS BIGINT) AS token_start, CAST(max(pos) + 1 AS BIGINT) AS token_end FROM f WHERE size = 100 GROUP BY language, collection, book, win, id""")
def passages_exact(spark, sf):
    words = tokens.folded_words(F.col("text"))
    rows = units(spark, sf).select("language", "collection", "book", "id", "seq", F.size(words).alias("n"))
    return passages.exact_units(rows, 100, continuity.BOOK).select("book", "window", "id", "token_start", "token_end")


@register("passage_sample20", SQL_UNITS + """, s AS (SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY language) AS n FROM units),
pick AS (SELECT DISTINCT language, CASE WHEN n <= 20 THEN i ELSE CAST(floor(i * (n - 1) / 19.0) AS BIGINT) END AS place FROM (SELECT language, max(n) AS n FROM s GROUP BY language), range(20) t(i))
SELECT s.language, s.id FROM s JOIN pick USING (language, place)""")
def passage_sample20(spark, sf):
    return passages.evenly_ranged(units(spark, sf).select("language", "id", "seq"), 20, ("language",), "seq").select("language", "id")


@register("unit_chunks", SQL_UNITS + "SELECT id, CAST((row_number() OVER (PARTITION BY book ORDER BY seq) - 1) // 4 AS BIGINT) AS chunk FROM units")
def unit_chunks(spark, sf):
    return continuity.chunks(units(spark, sf), 4, ("book",)).select("id", "chunk")


@register("turn_runs", """WITH c AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations),
g AS (SELECT *, coalesce(step, 1) <> 1 AS has_gap FROM c),
h AS (SELECT *, CASE WHEN step = 1 AND NOT has_gap AND NOT lag(has_gap) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS starts FROM g),
r AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM h)
SELECT conv_id, CAST(run AS BIGINT) AS run, count(*) AS turns, CAST(min(turn) AS BIGINT) AS first_turn, CAST(max(turn) AS BIGINT) AS last_turn FROM r GROUP BY conv_id, run""")
def turn_runs(spark, sf):
    u = source.conversation_units(table(spark, sf, "conversations"))
    cut = continuity.runs(u, continuity.follows_by_number("turn", ("book",)), ("book",))
    return cut.groupBy("conv_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@register("role_segments", """WITH o AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM o),
r AS (SELECT conv_id, segment, first(role) AS role, count(*) AS units FROM s GROUP BY conv_id, segment),
m AS (SELECT conv_id, first(role ORDER BY n DESC, role) AS major FROM (SELECT conv_id, role, sum(units) AS n FROM r GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, role, units, role = major AS is_majority FROM r JOIN m USING (conv_id)""")
def role_segments(spark, sf):
    u = source.conversation_units(table(spark, sf, "conversations"))
    return continuity.segments(u, "collection", ("conv_id",)).select("conv_id", F.col("segment").cast("long").alias("segment"), F.col("collection").alias("role"), "units", "is_majority")


@register("rollup_levels", SQL_TAGGED + """, b AS (SELECT language, collection, book, chapter, style_id, count(*) AS n, count(*) FILTER (WHERE status = 'low_evidence') AS low FROM tagged GROUP BY ALL),
g AS (SELECT language, collection, book, chapter, style_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(low) AS BIGINT) AS low, grouping(collection) + grouping(book) + grouping(chapter) AS up
      FROM b GROUP BY GROUPING SETS ((language, style_id), (language, collection, style_id), (language, collection, book, style_id), (language, collection, book, chapter, style_id)))
SELECT ['chapter', 'book', 'collection', 'language'][up + 1] AS level, language, collection, book, chapter, CAST(sum(n) AS BIGINT) AS unit_count, CAST(sum(CASE WHEN style_id IS NULL THEN 0 ELSE n END) AS BIGINT) AS assigned_count,
 CAST(sum(CASE WHEN style_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS insufficient_count, CAST(sum(low) AS BIGINT) AS low_evidence_count, count(style_id) AS style_count,
 coalesce(string_agg(style_id || '=' || CAST(n AS VARCHAR), ',' ORDER BY style_id), '') AS style_counts, first(style_id ORDER BY (style_id IS NULL), n DESC, style_id) AS dominant_style
FROM g GROUP BY up, language, collection, book, chapter""")
def rollup_levels(spark, sf):
    return rollups.levels(tagged(spark, sf))


@register("style_map_breakdown", SQL_TAGGED + """SELECT language, collection, style_id, CAST(sum(token_count) AS BIGINT) AS amount, count(*) AS units, count(*) FILTER (WHERE status = 'low_evidence') AS low_evidence_units, CAST(0 AS BIGINT) AS missing_words,
 round(CASE WHEN sum(sum(token_count)) OVER z > 0 THEN sum(token_count) * 1.0::DOUBLE / sum(sum(token_count)) OVER z ELSE 0 END, 6) AS share FROM tagged GROUP BY language, collection, style_id WINDOW z AS (PARTITION BY language, collection)""")
def style_map_breakdown(spark, sf):
    return rollups.breakdown(tagged(spark, sf), "collection").withColumn("share", F.round("share", 6))


@register("contribution_share", SQL_TAGGED + """SELECT language, style_id, count(*) AS amount, count(*) AS units, count(*) FILTER (WHERE status = 'low_evidence') AS low_evidence_units, CAST(0 AS BIGINT) AS missing_words,
 round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY language), 6) AS share FROM tagged WHERE collection = 'src3' GROUP BY language, style_id""")
def contribution_share(spark, sf):
    rows = query.select(tagged(spark, sf), query.Selection(collection="src3"))
    return rollups.breakdown(rows, "language", "verses").withColumn("share", F.round("share", 6))


@register("style_summary", SQL_TAGGED + """, s AS (SELECT *, row_number() OVER (PARTITION BY language, style_id ORDER BY seq) AS k FROM tagged WHERE style_id IS NOT NULL)
SELECT language, style_id, count(*) AS unit_count, CAST(sum(token_count) AS BIGINT) AS token_count, count(DISTINCT (collection, book, chapter)) AS chapter_count, count(DISTINCT (collection, book)) AS book_count, count(DISTINCT collection) AS collection_count,
 string_agg(id, ',' ORDER BY seq) FILTER (WHERE k <= 5) AS examples FROM s GROUP BY language, style_id""")
def style_summary(spark, sf):
    return rollups.style_summary(tagged(spark, sf))


@register("style_works", SQL_TAGGED + """, t AS (SELECT * FROM tagged WHERE style_id IS NOT NULL)
SELECT language, style_id, collection, book, chapter, count(*) AS unit_count, CAST(sum(token_count) AS BIGINT) AS token_count,
 CASE WHEN grouping(chapter) = 1 THEN count(DISTINCT (collection, book, chapter)) END AS chapter_count, CASE WHEN grouping(book) = 1 THEN count(DISTINCT (collection, book)) END AS book_count, CASE WHEN grouping(collection) = 1 THEN count(DISTINCT collection) END AS collection_count
FROM t GROUP BY GROUPING SETS ((language, style_id), (language, style_id, collection), (language, style_id, collection, book), (language, style_id, collection, book, chapter))""")
def style_works(spark, sf):
    return rollups.style_works(tagged(spark, sf))


@register("corpus_filter", SQL_TAGGED + """SELECT id, language, collection, style_id, status FROM tagged WHERE language = 'en' AND status = 'assigned'
 AND (contains(lower(text), 'tiona') OR contains(lower(book_title), 'tiona') OR contains(lower(book), 'tiona') OR contains(lower(id), 'tiona') OR contains(lower(coalesce(style_id, '')), 'tiona'))""")
def corpus_filter(spark, sf):
    return query.select(tagged(spark, sf), query.Selection(language="en", status="assigned", query="  TIOna ")).select("id", "language", "collection", "style_id", "status")


@register("facets", SQL_TAGGED + """, f AS (SELECT 'language' AS facet, language AS value FROM tagged UNION SELECT 'collection', collection FROM tagged WHERE language = 'de' UNION SELECT 'book', book FROM tagged WHERE language = 'de' AND collection = 'src4'
 UNION SELECT 'chapter', chapter FROM tagged WHERE language = 'de' AND collection = 'src4' UNION SELECT 'style_id', style_id FROM tagged WHERE language = 'de' AND collection = 'src4' AND style_id IS NOT NULL)
SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY lower(regexp_replace(value, '[0-9]+$', '')), try_cast(regexp_extract(value, '[0-9]+$') AS BIGINT), value) AS place FROM f""")
def facets(spark, sf):
    return query.facets(tagged(spark, sf), query.Selection(language="de", collection="src4")).select("facet", "value", F.col("place").cast("long").alias("place"))


@register("page", SQL_TAGGED + "SELECT id, text, style_id FROM tagged WHERE language = 'fr' ORDER BY seq LIMIT 50 OFFSET 100")
def page(spark, sf):
    return query.page(tagged(spark, sf), query.Selection(language="fr"), 2).select("id", "text", "style_id")


@register("overview_series", SQL_TAGGED + """, k AS (SELECT language, style_id, row_number() OVER (PARTITION BY language ORDER BY sum(token_count) DESC, style_id) AS rank FROM tagged WHERE style_id IS NOT NULL GROUP BY language, style_id),
a AS (SELECT t.language, t.style_id, sum(token_count) AS amount, rank FROM tagged t LEFT JOIN k USING (language, style_id) WHERE chapter = '1' GROUP BY t.language, t.style_id, rank),
f AS (SELECT language, CASE WHEN style_id IS NULL THEN 2 WHEN rank <= 2 THEN 0 ELSE 1 END AS kind, CASE WHEN rank <= 2 THEN style_id END AS label, sum(amount) AS amount, count(*) AS n, min(rank) AS rank FROM a GROUP BY 1, 2, 3)
SELECT language, row_number() OVER (PARTITION BY language ORDER BY kind, rank) AS place, CASE kind WHEN 2 THEN 'Unassigned' WHEN 1 THEN CAST(n AS VARCHAR) || ' further styles' ELSE label END AS label, CAST(amount AS BIGINT) AS amount,
 round(amount * 1.0::DOUBLE / sum(amount) OVER (PARTITION BY language), 6) AS share FROM f""")
def overview_series(spark, sf):
    t = tagged(spark, sf)
    out = rollups.overview_series(t, t.where("chapter = '1'"), leading=2)
    return out.withColumn("share", F.round("share", 6)).withColumn("place", F.col("place").cast("long"))


@register("collection_measure", SQL_TAGGED + """, b AS (SELECT language, collection, book, count(DISTINCT style_id) AS styles, sum(token_count) AS words FROM tagged GROUP BY ALL),
n AS (SELECT language, collection, count(DISTINCT style_id) AS styles FROM tagged GROUP BY ALL)
SELECT b.language, b.collection, n.styles, count(*) AS books, CAST(quantile_disc(b.styles, 0.5) AS BIGINT) AS median_styles, count(*) FILTER (WHERE b.styles = 0) AS empty_books, first(book ORDER BY b.styles DESC, book) AS widest_book, CAST(sum(words) AS BIGINT) AS words
FROM b JOIN n ON b.language = n.language AND b.collection = n.collection GROUP BY b.language, b.collection, n.styles""")
def collection_measure(spark, sf):
    return rollups.collection_measure(tagged(spark, sf))


_CELLS = SQL_TAGGED + """, w AS (SELECT *, CASE WHEN reference_author IS NOT NULL THEN reference_author WHEN doc_id % 3 = 0 THEN 'G' || CAST(doc_id % 4 AS VARCHAR) ELSE 'Disputed (' || book || ')' END AS writer, reference_author IS NOT NULL OR doc_id % 3 = 0 AS known FROM tagged WHERE style_id IS NOT NULL),
cells AS (SELECT language, collection, writer, style_id, CAST(sum(token_count) AS BIGINT) AS words, arg_max(known, seq) AS known FROM w GROUP BY ALL),
sn AS (SELECT language, style_id, collection || ' · ' || writer AS name, sum(words) AS words FROM cells GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY language, style_id ORDER BY words DESC, name) AS place, count(*) OVER (PARTITION BY language, style_id) AS n, sum(words) OVER (PARTITION BY language, style_id) AS total FROM sn),
sv AS (SELECT language, style_id, CAST(total AS BIGINT) AS words, name AS top_writer, CASE WHEN total > 0 THEN words * 1.0::DOUBLE / total ELSE 0 END AS top_share, n FROM sr WHERE place = 1)
"""


def _cells(spark, sf):
    t = tagged(spark, sf)
    groups = t.select("book", "doc_id").distinct().where("doc_id % 3 = 0").select("book", F.concat(F.lit("G"), (F.col("doc_id") % 4).cast("string")).alias("group"))
    return expectation.cells(expectation.with_writer(t, groups))


@register("expected_vs_style", _CELLS + "SELECT language, collection, writer, style_id, words, known FROM cells")
def expected_vs_style(spark, sf):
    return _cells(spark, sf).drop("last")


@register("style_verdicts", _CELLS + "SELECT language, style_id, words, top_writer, round(top_share, 6) AS top_share, CASE WHEN n = 1 THEN 'one writer' WHEN top_share >= 0.8 THEN 'dominated' ELSE 'merged' END AS verdict FROM sv")
def style_verdicts(spark, sf):
    return expectation.style_verdicts(_cells(spark, sf)).withColumn("top_share", F.round("top_share", 6))


@register("writer_verdicts", _CELLS + """, m AS (SELECT *, sum(words) OVER p AS total, row_number() OVER (PARTITION BY language, collection, writer ORDER BY words DESC, style_id) AS place FROM cells WINDOW p AS (PARTITION BY language, collection, writer)),
v AS (SELECT m.*, CASE WHEN total > 0 THEN m.words * 1.0::DOUBLE / total ELSE 0 END AS share, top_writer, top_share FROM m JOIN sv USING (language, style_id) WHERE place = 1)
SELECT language, collection, writer, known, CAST(total AS BIGINT) AS words, style_id AS top_style, round(share, 6) AS top_style_share,
 CASE WHEN NOT known THEN 'unscored' WHEN share < 0.8 THEN 'split' WHEN top_writer = collection || ' · ' || writer AND top_share >= 0.8 THEN 'recovered' ELSE 'merged' END AS verdict FROM v""")
def writer_verdicts(spark, sf):
    return expectation.writer_verdicts(_cells(spark, sf)).withColumn("top_style_share", F.round("top_style_share", 6))


@register("collection_agreement", _CELLS + """, t AS (SELECT language, collection, style_id, max(words) AS best, sum(words) AS words FROM cells GROUP BY ALL)
SELECT language, collection, CAST(sum(words) AS BIGINT) AS words, count(*) AS style_count, round(sum(best) * 1.0::DOUBLE / sum(words), 6) AS agreement FROM t GROUP BY language, collection""")
def collection_agreement(spark, sf):
    return expectation.collection_agreement(_cells(spark, sf)).withColumn("agreement", F.round("agreement", 6))


@register("two_sided_agreement", SQL_TAGGED + """, c AS (SELECT language, style_id, CASE WHEN doc_id % 114 + 1 IN (2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110) THEN 'Medinan' ELSE 'Meccan' END AS side, sum(token_count) AS words FROM tagged WHERE style_id IS NOT NULL GROUP BY ALL),
b AS (SELECT language, sum(best) AS agreed, count(*) AS styles FROM (SELECT language, style_id, max(words) AS best FROM c GROUP BY ALL) GROUP BY language),
s AS (SELECT language, sum(w) AS total, max(w) AS largest FROM (SELECT language, side, sum(words) AS w FROM c GROUP BY ALL) GROUP BY language HAVING count(*) >= 2)
SELECT language, styles, CAST(total AS BIGINT) AS total, round(agreed * 1.0::DOUBLE / total, 6) AS agreement, round(largest * 1.0::DOUBLE / total, 6) AS baseline FROM b JOIN s USING (language)""")
def two_sided_agreement(spark, sf):
    t = tagged(spark, sf).withColumn("sura", F.concat(F.lit("Q"), (F.col("doc_id") % 114 + 1).cast("string")))
    out = expectation.two_sided_agreement(t, expectation.revelation_place("sura"))
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("baseline", F.round("baseline", 6))


@register("label_agreement", SQL_TAGGED + """, c AS (SELECT language, collection AS a, style_id AS b, CAST(count(*) AS DOUBLE) AS n FROM tagged WHERE style_id IS NOT NULL GROUP BY ALL),
x AS (SELECT language, sum(n) AS n, sum(n * (n - 1) / 2) AS pairs, sum(n * ln(n)) AS h FROM c GROUP BY language),
ca AS (SELECT language, sum(n * (n - 1) / 2) AS pa, sum(n * ln(n)) AS ha, count(*) AS ka FROM (SELECT language, a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY language),
cb AS (SELECT language, sum(n * (n - 1) / 2) AS pb, sum(n * ln(n)) AS hb, count(*) AS kb, sum(m) AS best FROM (SELECT language, b, sum(n) AS n, max(n) AS m FROM c GROUP BY ALL) GROUP BY language),
e AS (SELECT *, pa * pb / (n * (n - 1) / 2) AS expected, (pa + pb) / 2 AS most, ln(n) - ha / n AS ea, ln(n) - hb / n AS eb, ln(n) + (h - ha - hb) / n AS mutual FROM x JOIN ca USING (language) JOIN cb USING (language))
SELECT language, CAST(n AS BIGINT) AS n, round(CASE WHEN most = expected THEN 1 ELSE (pairs - expected) / (most - expected) END, 6) AS ari, round(CASE WHEN ea + eb <= 0 THEN 0 ELSE greatest(0, mutual) / ((ea + eb) / 2) END, 6) AS nmi, round(best / n, 6) AS purity, ka AS truth_count, kb AS found_count FROM e""")
def label_agreement(spark, sf):
    out = evaluate.agreement(tagged(spark, sf), "collection", "style_id", ["language"])
    return out.withColumns({c: F.round(c, 6) for c in ("ari", "nmi", "purity")}).withColumnsRenamed({})
