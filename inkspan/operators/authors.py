"""Fixed recipes that compare passages with known authors, fitted on training passages
of whole works: cosine to standardised centroids of listed-word rates (function), the same
with endings and pairs of neighbouring listed words (morphology), and a weighted
multinomial model of character n-grams (characters).

Authors, their works and a work's passages weigh alike, together as much as there are
works.  Scores are cosines or decision values, not probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.operators import lexical

KINDS = ("function", "morphology", "characters")
MOST_PAIRS = 256


def training(passages: DataFrame) -> DataFrame:
    """The passages with weights, or ValueError: one language, a work has one author,
    two authors or more.  Texts may repeat."""
    lexical.guarded(passages, unique_texts=False)
    if passages.select("author").distinct().limit(2).count() < 2:
        raise ValueError("training needs passages of two authors")
    return lexical.passage_weights(passages)


def listed_pairs(passages: DataFrame, words: list[str]) -> DataFrame:
    """(id, pair, rate): neighbouring listed words per hundred pairs of neighbours."""
    listed = F.array(*map(F.lit, words))
    last = F.size("words") - 1
    pairs = F.when(last >= 1, F.filter(F.transform(F.sequence(F.lit(1), last), lambda i: F.when(F.array_contains(listed, F.col("words")[i - 1]) & F.array_contains(listed, F.col("words")[i]), F.concat_ws("|", F.col("words")[i - 1], F.col("words")[i]))), lambda p: p.isNotNull()))
    rows = passages.select("id", F.greatest(F.lit(1), last).alias("of"), F.explode(pairs).alias("pair"))
    return rows.groupBy("id", "pair", "of").agg(F.count("*").alias("n")).select("id", "pair", (F.col("n") * 100.0 / F.col("of")).alias("rate"))


@dataclass(frozen=True)
class Centroids:
    language: str
    kind: str
    words: list[str]
    suffixes: list[str]
    pairs: list[str]
    scale: tuple[list[float], list[float]]
    centroids: dict[str, list[float]]

    def vectors(self, passages: DataFrame) -> DataFrame:
        return _vectors(passages, self.kind, self.words, self.suffixes, self.pairs).select("id", lexical.scaled(F.col("v"), *self.scale).alias("v"))


@dataclass(frozen=True)
class Characters:
    language: str
    space: lexical.GramSpace
    authors: list[str]
    fitted: LogisticRegressionModel


def _vectors(passages: DataFrame, kind: str, words: list[str], suffixes: list[str], pairs: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    static = lexical.static_vectors(passages, words, suffixes, keep)
    if kind == "function":
        return static.select("id", *keep, F.slice("static", 1, len(words)).alias("v"))
    by = listed_pairs(passages, words).where(F.col("pair").isin(pairs)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pair", "rate"))).alias("rates"))
    rates = F.transform(F.array(*map(F.lit, pairs)), lambda p: F.coalesce(F.try_element_at("rates", p), F.lit(0.0))) if pairs else F.array().cast("array<double>")
    return static.join(by, "id", "left").select("id", *keep, F.concat("static", rates).alias("v"))


def fit_centroids(passages: DataFrame, kind: str, words: list[str], suffixes: list[str]) -> Centroids:
    rows = training(passages)
    language = rows.select("language").first()[0]
    pairs: list[str] = []
    if kind == "morphology":
        found = listed_pairs(rows, words).join(rows.select("id", "weight"), "id").groupBy("pair").agg(F.sum(F.col("weight") * F.col("rate")).alias("n"))
        pairs = [r.pair for r in found.orderBy(F.desc(F.round("n", 9)), "pair").limit(MOST_PAIRS).collect()]
    known = _vectors(rows, kind, words, suffixes, pairs, ("author", "weight")).persist()
    try:
        scale = lexical.scale_of(known, "v", "weight")
        entries = known.select("author", "weight", F.posexplode(lexical.scaled(F.col("v"), *scale)).alias("i", "x"))
        means = entries.groupBy("author", "i").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"))
        centroids = {r.author: list(r.c) for r in means.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c")).collect()}
    finally:
        known.unpersist()
    return Centroids(language, kind, words, suffixes, pairs, scale, dict(sorted(centroids.items())))


def fit_characters(passages: DataFrame, most_grams: int = 30_000, strength: float = 1.0, tol: float = 1e-6) -> Characters:
    """Weighted softmax regression; gradients of sparse rows are added up where the
    rows are, and what the driver holds is authors x n-grams of the vocabulary."""
    rows = training(passages)
    language = rows.select("language").first()[0]
    space = lexical.gram_space(rows, most_grams)
    names = [r.author for r in rows.select("author").distinct().orderBy("author").collect()]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("author")) - 1
    total = rows.agg(F.sum("weight")).first()[0]
    placed = rows.select("words", place.cast("double").alias("y"), F.col("weight").alias("w"))
    data = lexical.sparse_vectors(placed, space, ("y", "w"))  # the fit holds its own blocks of them
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=tol, family="multinomial").fit(data)
    return Characters(language, space, names, fitted)


def scores(model: Centroids | Characters, passages: DataFrame) -> DataFrame:
    """(id, candidate, score) of passages by each known author; nothing is learned."""
    lexical.guarded(passages, unique_texts=False)
    if passages.where(F.col("language") != model.language).limit(1).count():
        raise ValueError("passages of another language than the model's")
    if isinstance(model, Characters):
        rows = lexical.sparse_vectors(passages, model.space, ("id",))
        raw = model.fitted.transform(rows).select("id", vector_to_array("rawPrediction").alias("s"))
        named = F.arrays_zip(F.array(*map(F.lit, model.authors)).alias("candidate"), F.col("s").alias("score"))
        return raw.select("id", F.explode(named).alias("e")).select("id", "e.candidate", "e.score")
    known = F.array(*[F.struct(F.lit(name).alias("candidate"), F.array(*map(F.lit, c)).alias("c")) for name, c in model.centroids.items()])
    norm = lambda c: F.sqrt(lexical.dot(F.col("v"), F.col("v")) * lexical.dot(c, c))
    cosine = lambda k: F.struct(k["candidate"].alias("candidate"), F.when(norm(k["c"]) > 0, lexical.dot(F.col("v"), k["c"]) / norm(k["c"])).otherwise(0.0).alias("score"))
    return model.vectors(passages).select("id", F.explode(F.transform(known, cosine)).alias("e")).select("id", "e.candidate", "e.score")


def predicted(scored: DataFrame) -> DataFrame:
    """(id, predicted, score): the best candidate (ties: smallest name)."""
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("k", order).where("k = 1").select("id", F.col("candidate").alias("predicted"), "score")
