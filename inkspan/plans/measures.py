"""Registered queries on counts, richness, distances, windows and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import tokens
from inkspan.operators import distances, evaluate, frequency, rolling

from .registry import SQL_TAGGED, SQL_UNITS, register, table
from .structure import _TOKENS, tagged, units


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def words(spark, sf):
    """One row a folded word: (language, source, doc_id, text_id, pos, word)."""
    return units(spark, sf).select("language", F.col("collection").alias("source"), "doc_id", F.col("id").alias("text_id"), "seq", F.posexplode(tokens.folded_words(F.col("text"))).alias("pos", "word"))


def doc_texts(spark, sf):
    """(doc, language, source, words): a row a document, its words in an array."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("language"), "source", tokens.folded_words(F.col("text")).alias("words"))


def doc_words(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("lang").alias("language"), "source", F.col("doc_id").alias("doc"), F.posexplode(tokens.folded_words(F.col("text"))).alias("pos", "word"))


_FOLD = r"regexp_extract_all(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss'), '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)?')"
_DOC_WORDS = rf"""WITH f AS (SELECT doc_id AS doc, lang AS language, source, {_FOLD} AS words FROM documents),
w AS (SELECT doc, language, source, unnest(words) AS word, unnest(range(len(words))) AS pos FROM f)
"""


@register("mfw", _TOKENS + "SELECT * FROM (SELECT language, word, count(*) AS n, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, word) AS place FROM tok GROUP BY language, word) WHERE place <= 200")
def mfw(spark, sf):
    return frequency.top_words(frequency.word_counts(words(spark, sf), ["language"]), ["language"], 200).withColumn("place", F.col("place").cast("long"))


@register("word_bigrams", _DOC_WORDS + "SELECT language, a.word || ' ' || b.word AS word, count(*) AS n FROM w a JOIN (SELECT doc, pos - 1 AS pos, word FROM w) b USING (doc, pos) GROUP BY language, a.word || ' ' || b.word HAVING count(*) >= 5")
def word_bigrams(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("language"), tokens.folded_words(F.col("text")).alias("words"))
    rows = docs.select("language", F.explode(frequency.ngrams(F.col("words"), 2)).alias("word"))
    return frequency.word_counts(rows, ["language"]).where("n >= 5")


@register("char_4grams", SQL_UNITS + """, p AS (SELECT language, ' ' || text || ' ' AS t FROM units), g AS (SELECT language, unnest(list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 4))) AS word FROM p)
SELECT language, word, count(*) AS n FROM g GROUP BY language, word HAVING count(*) >= 3""")
def char_4grams(spark, sf):
    rows = units(spark, sf).select("language", F.explode(frequency.char_ngrams(F.col("text"), 4)).alias("word"))
    return frequency.word_counts(rows, ["language"]).where("n >= 3")


@register("repeated_phrases", _DOC_WORDS + """, g AS (SELECT language, a.word || ' ' || b.word || ' ' || c.word AS word, count(*) AS n FROM w a JOIN (SELECT doc, pos - 1 AS pos, word FROM w) b USING (doc, pos) JOIN (SELECT doc, pos - 2 AS pos, word FROM w) c USING (doc, pos) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS place FROM g) SELECT * FROM k WHERE place <= 40 AND n >= 3""")
def repeated_phrases(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("language"), tokens.folded_words(F.col("text")).alias("words"))
    rows = docs.select("language", F.explode(frequency.ngrams(F.col("words"), 3)).alias("word"))
    return frequency.top_words(frequency.word_counts(rows, ["language"]), ["language"], 40, 3).withColumn("place", F.col("place").cast("long"))


@register("collocations", _TOKENS + """, s AS (SELECT language, word, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT language, sum(n) AS total FROM s GROUP BY language),
p AS (SELECT a.language, a.word AS a, b.word AS b, count(*) AS n FROM tok a JOIN tok b ON a.id = b.id AND b.pos > a.pos AND b.pos - a.pos <= 3 GROUP BY ALL HAVING count(*) >= 3)
SELECT p.language, p.a, p.b, p.n, round(log2(p.n * t.total * 1.0::DOUBLE / (x.n * y.n)), 5) AS pmi FROM p JOIN s x ON x.language = p.language AND x.word = p.a JOIN s y ON y.language = p.language AND y.word = p.b JOIN t ON t.language = p.language""")
def collocations(spark, sf):
    texts = units(spark, sf).select("language", tokens.folded_words(F.col("text")).alias("words"))
    return frequency.collocations(texts, ["language"]).withColumn("pmi", F.round("pmi", 5))


@register("richness", _DOC_WORDS + """, c AS (SELECT doc, word, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, word) AS place FROM c),
b AS (SELECT doc, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, CAST(sum(n * n) AS DOUBLE) AS sq, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n = 2) AS two, sum(n) FILTER (WHERE place <= 10) AS top, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS rep FROM k GROUP BY doc)
SELECT doc, tokens, types, round(CASE WHEN tokens < 2 THEN 0 ELSE 1e4 * (sq - tokens) / (tokens * tokens) END, 5) AS yule_k, round(CASE WHEN tokens < 2 THEN 0 ELSE (sq - tokens) / (tokens * (tokens - 1)) END, 6) AS simpson_d, round(two * 1.0::DOUBLE / types, 6) AS sichel_s,
 round(100 * ln(tokens) / CASE WHEN once < types THEN 1 - once * 1.0::DOUBLE / types ELSE sqrt(1e-9) END, 3) AS honore_r, round(pow(tokens, pow(types, -0.165)), 6) AS brunet_w, round(once * 1.0::DOUBLE / types, 6) AS hapax_ratio, round(top * 1.0::DOUBLE / tokens, 6) AS top_share, round(rep * 1.0::DOUBLE / tokens, 6) AS repeat_rate FROM b""")
def richness(spark, sf):
    out = frequency.richness(frequency.word_counts(doc_words(spark, sf), ["doc"]), ["doc"])
    return r6(out, "simpson_d", "sichel_s", "brunet_w", "hapax_ratio", "top_share", "repeat_rate").withColumn("yule_k", F.round("yule_k", 5)).withColumn("honore_r", F.round("honore_r", 3))


@register("mattr", _DOC_WORDS + """, n AS (SELECT doc, len(words) AS n, words FROM f WHERE len(words) > 0), s AS (SELECT doc, words, least(n, 100) AS size, unnest(range(n - least(n, 100) + 1)) AS start FROM n)
SELECT doc, round(avg(len(list_distinct(words[start + 1:start + size])) * 1.0::DOUBLE / size), 7) AS mattr FROM s GROUP BY doc""")
def mattr(spark, sf):
    return frequency.mattr(doc_words(spark, sf), ["doc"]).withColumn("mattr", F.round("mattr", 7))


@register("surface_stats", r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*') AS w FROM documents),
s AS (SELECT *, greatest(len(w), 1)::DOUBLE AS n, greatest(length(text), 1)::DOUBLE AS size FROM t),
m AS (SELECT *, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n AS mean, coalesce(list_sum(list_transform(w, lambda x: length(x) * length(x))), 0) / n AS sq FROM s)
SELECT doc_id, round(mean, 6) AS mean_length, round(sqrt(greatest(0, sq - mean * mean)), 5) AS sd_length, round(len(list_filter(w, lambda x: length(x) <= 3)) / n, 6) AS short_share, round(len(list_filter(w, lambda x: length(x) >= 8)) / n, 6) AS long_share,
 round(len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) / n, 6) AS upper_share, round(len(list_filter(w, lambda x: substr(x, 1, 1) <> lower(substr(x, 1, 1)))) / n, 6) AS capital_share, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / n, 6) AS type_token,
 round(len(w) * 1.0::DOUBLE / greatest(1, len(regexp_extract_all(text, '[.!?]+'))), 6) AS words_a_sentence, round(len(regexp_extract_all(text, ',')) / n, 6) AS comma, round(len(regexp_extract_all(text, ';')) / n, 6) AS semicolon, round(len(regexp_extract_all(text, ':')) / n, 6) AS colon, round(len(regexp_extract_all(text, '!')) / n, 6) AS exclamation, round(len(regexp_extract_all(text, '\?')) / n, 6) AS question, round(len(regexp_extract_all(text, '—')) / n, 6) AS dash, round(len(regexp_extract_all(text, '\(')) / n, 6) AS bracket, round(len(regexp_extract_all(text, '"')) / n, 6) AS quote, round(len(regexp_extract_all(text, '[''’]')) / n, 6) AS apostrophe FROM m""")
def surface_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = docs.select("doc_id", frequency.surface(F.col("text")).alias("s")).select("doc_id", "s.*")
    return r6(out, *[c for c in out.columns if c not in ("doc_id", "sd_length")]).withColumn("sd_length", F.round("sd_length", 5))


@register("punctuation", r"SELECT lang AS language, mark, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), '[^\p{L}\p{N}\p{M}\s]')) AS mark FROM documents) GROUP BY ALL")
def punctuation(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.explode(frequency.punctuation(F.col("text"))).alias("mark"))
    return rows.groupBy("language", "mark").agg(F.count("*").alias("n"))


_PAIRS = [("the", "this"), ("on", "upon"), ("der", "die"), ("le", "la"), ("el", "los")]


@register("synonym_share", _DOC_WORDS + """, p(a, b) AS (VALUES ('the', 'this'), ('on', 'upon'), ('der', 'die'), ('le', 'la'), ('el', 'los')), c AS (SELECT doc, p.a || '/' || p.b AS pair, count(*) FILTER (WHERE word = p.a) AS a, count(*) FILTER (WHERE word = p.b) AS b FROM w, p GROUP BY doc, p.a, p.b)
SELECT doc, pair, round(CASE WHEN a + b > 0 THEN a * 1.0::DOUBLE / (a + b) ELSE 0.5 END, 6) AS share, CAST(least(10, a + b) AS BIGINT) AS attested FROM c""")
def synonym_share(spark, sf):
    return r6(frequency.synonym_shares(frequency.word_counts(doc_words(spark, sf), ["doc"]), ["doc"], _PAIRS), "share").withColumn("attested", F.col("attested").cast("long"))


_FUNCTION = ["the", "of", "and", "to", "in", "der", "die", "und", "le", "la", "de", "que"]


@register("word_rates", _DOC_WORDS + """, t AS (SELECT doc, count(*) AS n FROM w GROUP BY doc) SELECT w.doc, word, round(100.0::DOUBLE * count(*) / any_value(t.n), 6) AS rate FROM w JOIN t USING (doc) WHERE word IN ('the', 'of', 'and', 'to', 'in', 'der', 'die', 'und', 'le', 'la', 'de', 'que') GROUP BY w.doc, word""")
def word_rates(spark, sf):
    return r6(frequency.word_rates(frequency.word_counts(doc_words(spark, sf), ["doc"]), ["doc"], _FUNCTION), "rate")


@register("suffix_rates", _DOC_WORDS + """, t AS (SELECT doc, count(*) AS n FROM w GROUP BY doc), s(suffix) AS (VALUES ('ing'), ('ed'), ('ung'), ('keit'), ('ment'), ('cion'))
SELECT w.doc, suffix, round(100.0::DOUBLE * count(*) / any_value(t.n), 6) AS rate FROM w JOIN t USING (doc), s WHERE ends_with(word, suffix) AND length(word) > length(suffix) + 1 GROUP BY w.doc, suffix""")
def suffix_rates(spark, sf):
    return r6(frequency.suffix_rates_texts(doc_texts(spark, sf), ["doc"], ["ing", "ed", "ung", "keit", "ment", "cion"]), "rate")


@register("line_lengths", SQL_UNITS + """, n AS (SELECT book, seq, n_tokens, lead(n_tokens) OVER (PARTITION BY book ORDER BY seq) AS after FROM units), b AS (SELECT book, count(*) AS n, avg(n_tokens) AS mean, stddev_pop(n_tokens) AS sd, CASE WHEN count(after) > 1 AND stddev_pop(CASE WHEN after IS NOT NULL THEN n_tokens END) > 0 AND stddev_pop(after) > 0 THEN corr(n_tokens, after) ELSE 0 END AS lag_one FROM n GROUP BY book)
SELECT book, n, round(mean, 6) AS mean, round(sd, 5) AS sd, round(lag_one, 5) AS lag_one, round(CASE WHEN sd + mean > 0 THEN (sd - mean) / (sd + mean) ELSE 0 END, 5) AS burstiness FROM b""")
def line_lengths(spark, sf):
    u = units(spark, sf).select("book", F.col("seq").alias("pos"), tokens.count_words(tokens.folded_words(F.col("text"))).alias("length"))
    out = frequency.length_series(u, ["book"])
    return out.withColumns({c: F.round(c, 5) for c in ("sd", "lag_one", "burstiness")}).withColumn("mean", F.round("mean", 6))


# --- distances: one document for each (language, source), so the pairs are few

_BLOCKS = _DOC_WORDS + """, c AS (SELECT language || '|' || source AS doc, language AS block, word AS feature, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT doc, block, substr(doc, -1) AS grp FROM c),
k AS (SELECT block, feature FROM (SELECT block, feature, row_number() OVER (PARTITION BY block ORDER BY sum(n) DESC, feature) AS place FROM c GROUP BY block, feature) WHERE place <= 50),
q AS (SELECT doc, feature, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY doc) AS value FROM c),
v AS (SELECT g.block, g.doc, k.feature, coalesce(q.value, 0) AS value FROM g JOIN k ON g.block = k.block LEFT JOIN q ON q.doc = g.doc AND q.feature = k.feature),
z AS (SELECT *, CASE WHEN stddev_pop(value) OVER s < 1e-12 THEN 0 ELSE (value - avg(value) OVER s) / stddev_pop(value) OVER s END AS z FROM v WINDOW s AS (PARTITION BY block, feature))
"""


def blocks(spark, sf, most=50):
    w = doc_words(spark, sf).select(F.col("language").alias("block"), F.concat_ws("|", "language", "source").alias("doc"), F.col("word").alias("feature"))
    counts = w.groupBy("block", "doc", "feature").agg(F.count("*").alias("n"))
    docs = counts.select("block", "doc").distinct().withColumn("group", F.substring("doc", -1, 1))
    totals = counts.groupBy("block", "feature").agg(F.sum("n").alias("n")).withColumnRenamed("feature", "word")
    features = frequency.top_words(totals, ["block"], most).select("block", F.col("word").alias("feature"))
    values = distances.frequencies(counts, "doc")
    return docs, distances.zscores(distances.dense(values.drop("block"), docs, features))


@register("zscores", _BLOCKS + "SELECT block, doc, feature, round(value, 6) AS value, round(z, 5) AS z FROM z")
def zscores(spark, sf):
    _, z = blocks(spark, sf)
    return z.select("block", "doc", "feature", F.round("value", 6).alias("value"), F.round("z", 5).alias("z"))


@register("delta_classic", _BLOCKS + "SELECT a.block, a.doc AS a, b.doc AS b, round(avg(abs(a.z - b.z)), 5) AS distance FROM z a JOIN z b ON a.block = b.block AND a.feature = b.feature AND a.doc <> b.doc GROUP BY ALL")
def delta_classic(spark, sf):
    return distances.pairs(blocks(spark, sf)[1], "z", "classic").withColumn("distance", F.round("distance", 5))


@register("delta_cosine", _BLOCKS + "SELECT a.block, a.doc AS a, b.doc AS b, round(greatest(0, least(2, 1 - sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)))), 5) AS distance FROM z a JOIN z b ON a.block = b.block AND a.feature = b.feature AND a.doc <> b.doc GROUP BY ALL")
def delta_cosine(spark, sf):
    return distances.pairs(blocks(spark, sf)[1], "z", "cosine").withColumn("distance", F.round("distance", 5))


_JSD = _BLOCKS + """, s AS (SELECT block, doc, feature, value / sum(value) OVER (PARTITION BY doc) AS p FROM v), m AS (SELECT a.block, a.doc AS a, b.doc AS b, a.p AS x, b.p AS y, (a.p + b.p) / 2 AS m FROM s a JOIN s b ON a.block = b.block AND a.feature = b.feature AND a.doc <> b.doc)
SELECT block, a, b, round(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(x / m) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / m) ELSE 0 END) / 2), 5) AS distance FROM m GROUP BY ALL"""


@register("jensen_shannon", _JSD)
def jensen_shannon(spark, sf):
    from pyspark.sql import Window

    v = blocks(spark, sf)[1]
    p = v.withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("doc")))
    return distances.pairs(p, "p", "jsd").withColumn("distance", F.round("distance", 5))


@register("logo_nearest", _BLOCKS + """, d AS (SELECT a.doc AS a, b.doc AS b, round(avg(abs(a.z - b.z)), 5) AS distance FROM z a JOIN z b ON a.block = b.block AND a.feature = b.feature AND a.doc <> b.doc GROUP BY ALL),
o AS (SELECT d.* FROM d JOIN g x ON x.doc = d.a JOIN g y ON y.doc = d.b WHERE x.grp <> y.grp)
SELECT g.doc, first(o.b ORDER BY distance, o.b) AS nearest, min(distance) AS distance FROM g LEFT JOIN o ON o.a = g.doc GROUP BY g.doc""")
def logo_nearest(spark, sf):
    docs, z = blocks(spark, sf)
    return distances.nearest_outside(distances.pairs(z, "z", "classic").withColumn("distance", F.round("distance", 5)), docs)


@register("within_between", _BLOCKS + """, d AS (SELECT a.block, a.doc AS a, b.doc AS b, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS distance FROM z a JOIN z b ON a.block = b.block AND a.feature = b.feature AND a.doc <> b.doc GROUP BY ALL)
SELECT d.block, round(avg(distance) FILTER (WHERE x.grp = y.grp), 5) AS within, round(avg(distance) FILTER (WHERE x.grp <> y.grp), 5) AS "between" FROM d JOIN g x ON x.doc = d.a JOIN g y ON y.doc = d.b GROUP BY d.block""")
def within_between(spark, sf):
    docs, z = blocks(spark, sf)
    return distances.within_between(distances.pairs(z, "z", "euclidean"), docs).withColumns({c: F.round(c, 5) for c in ("within", "between")})


_MARKERS = ["the", "of", "and", "to", "in", "der", "die", "und"]
_EDGES = _DOC_WORDS + """, k AS (SELECT doc, pos, word FROM w WHERE word IN ('the', 'of', 'and', 'to', 'in', 'der', 'die', 'und')),
e AS (SELECT a.doc, a.word AS src, b.word AS dst, sum(1.0::DOUBLE / (b.pos - a.pos)) AS weight FROM k a JOIN k b ON a.doc = b.doc AND b.pos > a.pos AND b.pos <= a.pos + 5 GROUP BY ALL)
"""


@register("wan_edges", _EDGES + "SELECT doc, src, dst, round(weight, 6) AS weight FROM e")
def wan_edges(spark, sf):
    return r6(distances.adjacency(doc_texts(spark, sf), _MARKERS), "weight")


@register("wan_divergence", _DOC_WORDS + """, k AS (SELECT language || '|' || source AS doc, language, doc AS text, pos, word FROM w WHERE word IN ('the', 'of', 'and', 'to', 'in', 'der', 'die', 'und')),
e AS (SELECT a.doc, a.word AS src, b.word AS dst, sum(1.0::DOUBLE / (b.pos - a.pos)) AS weight FROM k a JOIN k b ON a.text = b.text AND b.pos > a.pos AND b.pos <= a.pos + 5 GROUP BY ALL),
m(x) AS (VALUES ('the'), ('of'), ('and'), ('to'), ('in'), ('der'), ('die'), ('und')), g AS (SELECT DISTINCT language || '|' || source AS doc, language AS block FROM w),
c AS (SELECT g.doc, g.block, m.x AS src, n.x AS dst, coalesce(weight, 0) AS weight FROM g, m, m n LEFT JOIN e ON e.doc = g.doc AND e.src = m.x AND e.dst = n.x),
p AS (SELECT *, (weight + 0.01::DOUBLE) / (sum(weight) OVER (PARTITION BY doc, src) + 0.08::DOUBLE) AS p FROM c)
SELECT a.block, a.doc AS a, b.doc AS b, round(sum(a.p * log2(a.p / b.p) + b.p * log2(b.p / a.p)) / 2 / 8, 5) AS divergence FROM p a JOIN p b ON a.block = b.block AND a.src = b.src AND a.dst = b.dst AND a.doc < b.doc GROUP BY ALL""")
def wan_divergence(spark, sf):
    texts = doc_texts(spark, sf).where(F.size("words") > 0).withColumn("doc", F.concat_ws("|", "language", "source"))
    docs = texts.select("doc", F.col("language").alias("block")).distinct()
    edges = distances.adjacency(texts, _MARKERS)
    return distances.divergence(distances.transitions(edges, docs, _MARKERS), docs).withColumn("divergence", F.round("divergence", 5))


@register("margin", """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label AS other, i, avg(x) AS m FROM p GROUP BY ALL),
d AS (SELECT vec_id, label, other, sqrt(sum((x - m) * (x - m))) AS d FROM p JOIN c USING (i) GROUP BY ALL), s AS (SELECT vec_id, label, max(d) FILTER (WHERE label = other) AS own, min(d) FILTER (WHERE label <> other) AS rest FROM d GROUP BY ALL)
SELECT vec_id, label, round((rest - own) / greatest(1e-9, own, rest), 5) AS margin FROM s""")
def margin(spark, sf):
    return distances.margins(table(spark, sf, "embeddings"), "label", "embedding", "vec_id").withColumn("margin", F.round("margin", 5))


# --- windows


@register("smooth", SQL_UNITS + "SELECT id, round(0.7::DOUBLE * avg(n_tokens) OVER (PARTITION BY book ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 0.3::DOUBLE * n_tokens, 6) AS smooth_n FROM units")
def smooth(spark, sf):
    u = units(spark, sf).withColumn("n", tokens.count_words(tokens.folded_words(F.col("text"))))
    return r6(rolling.smooth(u, ["book"], "seq", ["n"], 2, 0.7), "smooth_n").select("id", "smooth_n")


@register("rolling_windows", _DOC_WORDS + """, s AS (SELECT doc, words, unnest(CASE WHEN len(words) <= 200 THEN [0] ELSE range(0, len(words) - 200 + 1, 100) END) AS start FROM f)
SELECT doc, CAST(start AS BIGINT) AS start, CAST(len(words[start + 1:start + 200]) AS BIGINT) AS size, CAST(len(list_distinct(words[start + 1:start + 200])) AS BIGINT) AS types FROM s""")
def rolling_windows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), tokens.folded_words(F.col("text")).alias("words"))
    out = rolling.windows(docs, "words", 200, 100)
    return out.select("doc", F.col("start").cast("long").alias("start"), F.size("window").cast("long").alias("size"), F.size(F.array_distinct("window")).cast("long").alias("types"))


@register("change_points")
def change_points(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), tokens.folded_words(F.col("text")).alias("words"))
    wide = rolling.windows(docs, "words", 100, 50).select("doc", "start", "window")
    rows = wide.mapInArrow(rolling.text_features_arrow, "doc long, start int, mean_length double, short double, variety double")
    return rolling.change_points(rows, ["doc"], "start", ["mean_length", "short", "variety"], permutations=500)


# --- evaluation: labelled documents, scored by a plain function of the text

_SCORED = """WITH s AS (SELECT l.doc_id, lang AS author, source AS work, toxic = 1 AS positive, quality, (n_chars % 97) / 97.0::DOUBLE AS score, lang FROM labels l JOIN documents USING (doc_id))
"""


def scored(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select("doc_id", F.col("lang").alias("author"), F.col("source").alias("work"), (F.col("toxic") == 1).alias("positive"), "quality", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"), "lang")


@register("nested_mean", _SCORED + "SELECT author, round(avg(v), 6) AS value, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT author, work, avg(score) AS v, count(*) AS n FROM s GROUP BY ALL) GROUP BY author")
def nested_mean(spark, sf):
    return r6(evaluate.nested_mean(scored(spark, sf), F.col("score"), ["author", "work"]), "value")


@register("equal_weights", _SCORED + """, i AS (SELECT author, work, count(*) AS size FROM s GROUP BY ALL), o AS (SELECT author, count(*) AS inners FROM i GROUP BY author)
SELECT doc_id, round((SELECT count(*) FROM s) * 1.0::DOUBLE / ((SELECT count(*) FROM o) * inners * size), 6) AS weight FROM s JOIN i USING (author, work) JOIN o USING (author)""")
def equal_weights(spark, sf):
    return r6(evaluate.equal_weights(scored(spark, sf), "author", "work"), "weight").select("doc_id", "weight")


@register("macro_recall", _SCORED + ", r AS (SELECT author, quality, avg(CASE WHEN quality = CAST(score > 0.3 AS INT) THEN 1.0::DOUBLE ELSE 0 END) AS recall, count(*) AS n, count(*) FILTER (WHERE quality = CAST(score > 0.3 AS INT)) AS hits FROM s GROUP BY ALL) SELECT author, CAST(sum(n) AS BIGINT) AS n, round(sum(hits) * 1.0::DOUBLE / sum(n), 6) AS accuracy, round(avg(recall), 6) AS macro_recall FROM r GROUP BY author")
def macro_recall(spark, sf):
    s = scored(spark, sf).withColumn("found", (F.col("score") > 0.3).cast("int"))
    return r6(evaluate.macro_recall(s, "quality", "found", ["author"]), "accuracy", "macro_recall")


@register("book_vote", SQL_TAGGED + ", c AS (SELECT collection, style_id, count(*) AS n FROM tagged WHERE style_id IS NOT NULL GROUP BY ALL) SELECT collection, first(style_id ORDER BY n DESC, style_id) AS voted, max(n) AS votes, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY collection")
def book_vote(spark, sf):
    return evaluate.vote(tagged(spark, sf).where("style_id is not null"), ["collection"], "style_id")


@register("order_quantile", _SCORED + ", k AS (SELECT author, score, row_number() OVER (PARTITION BY author ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY author) AS n FROM s) SELECT author, round(score, 6) AS threshold FROM k WHERE k = ceil((n - 1) * 0.95::DOUBLE)")
def order_quantile(spark, sf):
    return r6(evaluate.order_quantile(scored(spark, sf), ["author"], "score", 0.95), "threshold")


@register("auc", _SCORED + ", p AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won, count(*) AS n FROM s a JOIN s b ON a.lang = b.lang AND a.positive AND NOT b.positive GROUP BY a.lang) SELECT lang, count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE NOT positive) AS negatives, round(any_value(won / n), 6) AS auc FROM s JOIN p USING (lang) GROUP BY lang")
def auc(spark, sf):
    return r6(evaluate.auc(scored(spark, sf), ["lang"], "score", "positive"), "auc")


@register("calibrate_rejection", _SCORED + """, t AS (SELECT DISTINCT score AS threshold FROM s), c AS (SELECT threshold, (SELECT count(*) FROM s WHERE positive AND score >= threshold) AS a, (SELECT count(*) FROM s WHERE NOT positive AND score >= threshold) AS f FROM t), n AS (SELECT count(*) FILTER (WHERE positive) AS g, count(*) FILTER (WHERE NOT positive) AS i FROM s)
SELECT round(threshold, 6) AS threshold, round(a * 1.0::DOUBLE / g, 6) AS accepted_share, round(f * 1.0::DOUBLE / i, 6) AS false_share FROM c, n WHERE f <= 0.05 * i ORDER BY threshold LIMIT 1""")
def calibrate_rejection(spark, sf):
    return r6(evaluate.calibrate_rejection(scored(spark, sf), "score", "positive", 0.05), "threshold", "accepted_share", "false_share")


@register("hash_buckets", "WITH h AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || lang || ':' || source), source) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM h) SELECT lang, source, CAST(k % 3 AS BIGINT) AS bucket FROM r WHERE n >= 3")
def hash_buckets(spark, sf):
    return evaluate.hash_buckets(table(spark, sf, "documents"), ["lang"], "source", 3, "s1", 3)


@register("pair_sample", "WITH d AS (SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('p1:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 8), p AS (SELECT x.lang, x.source AS work_a, y.source AS work_b, x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y ON x.lang = y.lang AND x.source < y.source), k AS (SELECT *, row_number() OVER (PARTITION BY lang, work_a, work_b ORDER BY sha256('p1:' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR)), a, b) AS place FROM p) SELECT * FROM k WHERE place <= 8")
def pair_sample(spark, sf):
    return evaluate.pair_sample(table(spark, sf, "documents"), "source", "doc_id", "lang", 8, "p1", 8).withColumn("place", F.col("place").cast("long"))


@register("cycle_roles", "WITH h AS (SELECT DISTINCT lang, source FROM documents), k AS (SELECT *, row_number() OVER w AS place, coalesce(lead(source) OVER w, first(source) OVER w) AS impostor FROM h WINDOW w AS (PARTITION BY lang ORDER BY sha256('r1:' || source), source)) SELECT * FROM k")
def cycle_roles(spark, sf):
    return evaluate.cycle_roles(table(spark, sf, "documents"), ["lang"], "source", "r1").withColumn("place", F.col("place").cast("long"))


@register("pareto_front", "WITH c AS (SELECT c_custkey, c_nationkey, count(*) AS cost, sum(o_totalprice) AS score FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT a.c_custkey, a.c_nationkey, a.cost, round(a.score, 2) AS score FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.c_nationkey = a.c_nationkey AND b.cost <= a.cost AND b.score >= a.score AND (b.cost < a.cost OR b.score > a.score))")
def pareto_front(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_nationkey").agg(F.count("*").alias("cost"), F.sum("o_totalprice").alias("score"))
    return evaluate.front(rows, ["c_nationkey"], "c_custkey", "cost", "score").withColumn("score", F.round("score", 2))


@register("eta_squared", """WITH g AS (SELECT label, count(*) AS n, avg(embedding[1]) AS m1, var_pop(embedding[1]) AS v1, avg(embedding[2]) AS m2, var_pop(embedding[2]) AS v2 FROM embeddings GROUP BY label),
t AS (SELECT sum(n) AS n, sum(n * m1) / sum(n) AS a1, sum(n * m1 * m1) / sum(n) AS s1, sum(n * v1) / sum(n) AS w1, sum(n * m2) / sum(n) AS a2, sum(n * m2 * m2) / sum(n) AS s2, sum(n * v2) / sum(n) AS w2 FROM g)
SELECT 'x' AS dimension, round((s1 - a1 * a1) / (s1 - a1 * a1 + w1), 5) AS eta_squared FROM t UNION ALL SELECT 'y', round((s2 - a2 * a2) / (s2 - a2 * a2 + w2), 5) FROM t""")
def eta_squared(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return evaluate.split_share(rows, ["label"], ["x", "y"]).withColumn("eta_squared", F.round("eta_squared", 5))
