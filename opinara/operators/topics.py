"""Topic modelling with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.numbers import half_even
from opinara.functions.text import ngrams
from opinara.operators.keywords import document_frequencies, review_counts, review_words
from opinara.session import materialise, stored


@dataclass(frozen=True)
class TopicModel:
    """A fitted model, its vocabulary (at most ``max_features`` terms) and the vectorised reviews."""

    model: LDAModel
    vocabulary: list[str]
    vectors: DataFrame

    def topic_words(self, n: int = 10) -> DataFrame:
        """(topic, rank, word, weight): the ``n`` heaviest words per topic."""
        spark = self.vectors.sparkSession
        terms = spark.createDataFrame(list(enumerate(self.vocabulary)), "term_index int, word string")
        described = self.model.describeTopics(n).select(
            F.concat(F.lit("topic_"), F.col("topic") + 1).alias("topic"),
            F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"),
        )
        rows = described.select(
            "topic", (F.col("pos") + 1).alias("rank"), F.col("t.termIndices").alias("term_index"),
            half_even(F.col("t.termWeights"), 6).alias("weight"),
        )
        return rows.join(terms, "term_index").select("topic", "rank", "word", "weight")

    def topic_distribution(self) -> DataFrame:
        """(review_id, distribution, dominant_topic)."""
        k = self.model.getK()
        shares = vector_to_array("topicDistribution")
        # A review without a vocabulary term gets zeros from Spark; it belongs to all topics alike.
        uniform = F.array_repeat(F.lit(1.0 / k), k)
        scored = self.model.transform(self.vectors).select("review_id", shares.alias("shares")).withColumn(
            "distribution", F.when(F.array_max("shares") > 0, F.col("shares")).otherwise(uniform)
        )
        best = F.array_position("distribution", F.array_max("distribution"))
        return scored.select("review_id", "distribution", F.concat(F.lit("topic_"), best).alias("dominant_topic"))

    def topic_counts(self) -> DataFrame:
        counts = self.topic_distribution().groupBy("dominant_topic").agg(F.count(F.lit(1)).alias("reviews"))
        return counts.orderBy(F.desc("reviews"), "dominant_topic")


def _vocabulary(table: DataFrame, max_features: int, min_df: int, max_df: float, stats: DataFrame | None = None) -> DataFrame:
    stats = document_frequencies(table, [1, 2]) if stats is None else stats
    reviews = review_counts(table).scalar()
    kept = stats.filter(F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= reviews * max_df) & (reviews >= 10))
    # The limit comes first, so the rank's one task holds at most max_features terms.
    best = kept.orderBy(F.desc("total"), "term").limit(max_features)
    rank = F.row_number().over(W.orderBy(F.desc("total"), "term"))
    return best.select("term", "df", "total", rank.alias("rank"))


def topic_vocabulary(df: DataFrame, stop_words: Sequence[str], *, max_features: int = 3000, min_df: int = 3,
                     max_df: float = 0.8) -> DataFrame:
    """(term, df, total, rank): the (1, 2)-grams a topic model is fitted on; none below ten reviews."""
    return _vocabulary(materialise(review_words(df, stop_words)), max_features, min_df, max_df)


def topic_tables(df: DataFrame, stop_words: Sequence[str], **settings) -> dict[str, DataFrame]:
    """``words``, ``distribution`` and ``counts`` of one fit; empty tables where there is nothing to fit."""
    model = fit_topics(df, stop_words, **settings)
    if model is not None:
        return {"words": model.topic_words(), "distribution": model.topic_distribution(), "counts": model.topic_counts()}
    review = df.schema["review_id"].dataType.simpleString()
    empty = df.sparkSession.createDataFrame
    return {
        "words": empty([], "topic string, rank int, word string, weight double"),
        "distribution": empty([], f"review_id {review}, distribution array<double>, dominant_topic string"),
        "counts": empty([], "dominant_topic string, reviews long"),
    }


def fit_topics(
    df: DataFrame, stop_words: Sequence[str], *, n_topics: int = 5, max_features: int = 3000,
    min_df: int = 3, max_df: float = 0.8, iterations: int = 10, seed: int = 42, word_table: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> TopicModel | None:
    """Fit an online LDA on (1, 2)-gram counts; None below ten reviews or without a usable term.

    The vocabulary is the only thing collected: at most ``max_features`` terms, ties in term order.  Word arrays and
    vectors are stored once below the shared folder; every iteration passes over all of them.  ``word_table`` is the stored
    ``review_words`` of ``df``, and ``stats`` are stored counts of at least the first ``max_features`` terms, if there are any.
    """
    table = materialise(review_words(df, stop_words)) if word_table is None else word_table
    ranked = _vocabulary(table, max_features, min_df, max_df, stats)
    vocabulary = [row.term for row in ranked.orderBy("rank").collect()]
    if not vocabulary:
        return None
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="features")
    terms = table.select("review_id", F.concat("words", ngrams(F.col("words"), 2)).alias("terms"))
    vectors = counter.transform(terms).select("review_id", "features")
    vectors = materialise(vectors) if stats is None else stored(vectors, "topic-vectors")
    lda = LDA(k=n_topics, seed=seed, optimizer="online", maxIter=iterations, subsamplingRate=1.0)
    return TopicModel(lda.fit(vectors), vocabulary, vectors)
