"""A verifier of pairs of passages: whether two works are by one author.

Trained on pairs of passages from different works only.  The fit is a weighted
logistic regression whose gradients are added up where the pairs are; metadata decides
weights and never enters the features.  Scores are decision values, not probabilities,
and a pair of one work or of one text isn't scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators import lexical
from inkspan.operators.evaluate import pair_sample

UNKNOWN = ("unknown", "unspecified")


def work_labels(passages: DataFrame) -> DataFrame:
    """(work, author, genre, topic): a genre or topic that isn't one known value is null."""
    one = lambda c: F.when((F.min(c) == F.max(c)) & ~F.min(c).isin(*UNKNOWN), F.min(c)).alias(c)
    return passages.groupBy("work").agg(F.min("author").alias("author"), one("genre"), one("topic"))


def training_pairs(passages: DataFrame, most: int = 8, seed: int = 42) -> DataFrame:
    """(work_a, work_b, a, b, author_a, author_b, same_author, same_genre, same_topic):
    for any two works the ``most`` pairs of lowest hash among all of theirs."""
    pairs = pair_sample(passages.select("language", "work", "id"), "work", "id", "language", most, str(seed))
    side = lambda s: work_labels(passages).select(*[F.col(c).alias(f"{c}_{s}") for c in ("work", "author", "genre", "topic")])
    rows = pairs.select("work_a", "work_b", "a", "b").join(side("a"), "work_a").join(side("b"), "work_b")
    alike = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)).alias(f"same_{c}")
    return rows.select("work_a", "work_b", "a", "b", "author_a", "author_b", alike("author"), alike("genre"), alike("topic"))


def pair_weights(pairs: DataFrame) -> DataFrame:
    """pairs with ``stratum`` and ``weight``.  Pairs of one author and of two weigh half
    the number of works each; those of two are shared alike by the strata that occur
    (same_genre, other); each by authors (or pairs of authors), pairs of works, pairs."""
    stratum = F.when(F.col("same_author"), "same_author").when(F.col("same_genre"), "same_genre").otherwise("other")
    group = F.concat_ws("\x1f", F.least("author_a", "author_b"), F.greatest("author_a", "author_b"))
    rows = pairs.withColumn("stratum", stratum).withColumn("group", group)
    by_works = rows.groupBy("stratum", "group", "work_a", "work_b").agg(F.count("*").alias("n"))
    by_group = by_works.groupBy("stratum", "group").agg(F.count("*").alias("work_pairs"))
    by_stratum = by_group.groupBy("stratum").agg(F.count("*").alias("groups"))  # three rows at most
    works = by_works.select(F.explode(F.array("work_a", "work_b")).alias("w")).agg(F.countDistinct("w").alias("works"))
    others = by_stratum.agg(F.count_if(F.col("stratum") != "same_author").alias("others"))
    share = F.col("works") / 2 / F.when(F.col("stratum") == "same_author", 1).otherwise(F.col("others"))
    strata = by_stratum.crossJoin(F.broadcast(works)).crossJoin(F.broadcast(others)).select("stratum", (share / F.col("groups")).alias("mass"))  # one row each
    table = by_works.join(by_group, ["stratum", "group"]).join(F.broadcast(strata), "stratum").select("work_a", "work_b", (F.col("mass") / F.col("work_pairs") / F.col("n")).alias("weight"))
    return rows.join(table, ["work_a", "work_b"]).drop("group")


@dataclass(frozen=True)
class PairModel:
    language: str
    words: list[str]
    suffixes: list[str]
    static_scale: tuple[list[float], list[float]]
    space: lexical.GramSpace
    pair_scale: tuple[list[float], list[float]]
    weights: list[float]
    bias: float

    def feature_names(self) -> list[str]:
        return [f"absdiff:{n}" for n in lexical.static_names(self.words, self.suffixes)] + ["static_cosine", "static_rms", "gram_cosine"]


def _described(passages: DataFrame, words: list[str], suffixes: list[str], scale, space: lexical.GramSpace) -> DataFrame:
    static = passages.where(F.size("words") > 0).select("id", "words", lexical.static_column(words, suffixes).alias("static"))
    return lexical.gram_vectors(static, space, ("static",)).select("id", lexical.scaled(F.col("static"), *scale).alias("static"), "at", "x")


def _paired(passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages that a pair names: no other ones are described."""
    return passages.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")


def pair_vectors(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with ``features``, which don't change when a and b are swapped."""
    side = lambda s: described.select(F.col("id").alias(s), F.col("static").alias(f"static_{s}"), F.col("at").alias(f"at_{s}"), F.col("x").alias(f"x_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.zip_with("static_a", "static_b", lambda x, y: F.abs(x - y))
    norm = F.sqrt(lexical.dot(F.col("static_a"), F.col("static_a")) * lexical.dot(F.col("static_b"), F.col("static_b")))
    cosine = F.when(norm > 0, lexical.dot(F.col("static_a"), F.col("static_b")) / norm).otherwise(0.0)
    rms = F.sqrt(lexical.dot(F.col("apart"), F.col("apart")) / F.size("apart"))
    known = rows.withColumn("apart", apart).withColumn("gram_cosine", lexical.sparse_dot("at_a", "x_a", "at_b", "x_b"))
    return known.select(*pairs.columns, F.concat("apart", F.array(cosine, rms, "gram_cosine")).alias("features"))


def fit_logistic(rows: DataFrame, features: str, label: str, weight: str, strength: float = 1.0, tol: float = 1e-6) -> tuple[list[float], float]:
    """Weights and bias that minimise the weighted logistic loss plus half the squared
    length of the weights over ``strength``; the bias isn't held back."""
    total = rows.agg(F.sum(weight)).first()[0]
    data = rows.select(array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).alias("w"))
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=tol, family="binomial").fit(data)
    return [float(v) for v in fit.coefficients], float(fit.intercept)


def fit(passages: DataFrame, words: list[str], suffixes: list[str], most_pairs: int = 8, most_grams: int = 10_000, seed: int = 42, tol: float = 1e-6) -> PairModel:
    """A verifier from training passages of one language.

    Refuses passages that aren't independent evidence, and needs pairs of one author
    and of two."""
    lexical.guarded(passages)
    language = passages.select("language").first()
    if language is None:
        raise ValueError("no passages")
    pairs = training_pairs(passages, most_pairs, seed).persist()
    weighted = pair_weights(pairs).persist()
    if {r.same_author for r in weighted.select("same_author").distinct().collect()} != {True, False}:
        raise ValueError("training needs works of two authors, and two works of one")
    static = lexical.static_vectors(lexical.passage_weights(passages), words, suffixes, ("weight",))
    static_scale = lexical.scale_of(static, "static", "weight")
    space = lexical.gram_space(passages, most_grams)
    rows = pair_vectors(weighted, _described(_paired(passages, pairs), words, suffixes, static_scale, space)).persist()
    try:
        pair_scale = lexical.scale_of(rows, "features", "weight")
        fitted = rows.select(lexical.scaled(F.col("features"), *pair_scale).alias("features"), "same_author", "weight")
        weights, bias = fit_logistic(fitted, "features", "same_author", "weight", tol=tol)
    finally:
        for held in (rows, weighted, pairs):
            held.unpersist()
    return PairModel(language[0], words, suffixes, static_scale, space, pair_scale, weights, bias)


def refused(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """(a, b, reason) of the pairs (a, b) that must not be scored."""
    side = lambda s: passages.select(F.col("id").alias(s), F.col("work").alias(f"work_{s}"), F.sha2(F.array_join("words", " "), 256).alias(f"text_{s}"))
    rows = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    reason = F.when(F.col("work_a").isNull() | F.col("work_b").isNull(), "unknown passage").when(F.col("work_a") == F.col("work_b"), "one work").when(F.col("text_a") == F.col("text_b"), "one text")
    return rows.withColumn("reason", reason).where("reason is not null").select("a", "b", "reason")


def decision(features: Column, model: PairModel) -> Column:
    return lexical.dot(lexical.scaled(features, *model.pair_scale), F.array(*map(F.lit, model.weights))) + F.lit(model.bias)


def score_pairs(model: PairModel, passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score) of pairs (a, b) of ids of passages; nothing is learned here."""
    lexical.guarded(passages, unique_texts=False)
    if passages.where(F.col("language") != model.language).limit(1).count():
        raise ValueError("passages of another language than the model's")
    bad = refused(pairs, passages).orderBy("a", "b").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.a} and {r.b}: {r.reason}" for r in bad))
    rows = pair_vectors(pairs.select("a", "b"), _described(_paired(passages, pairs), model.words, model.suffixes, model.static_scale, model.space))
    return rows.select("a", "b", decision(F.col("features"), model).alias("score"))
