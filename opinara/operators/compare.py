"""Competitor comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.operators.aspects import Lexicon
from opinara.operators.ranking import global_rank


def comparison_ranking(sentiment: DataFrame) -> DataFrame:
    """1-based position of every place by health score (ties by name), from ``compare_sentiment``."""
    rows = sentiment.select(
        "place_name", "sentiment_health_score", "positive_pct", "negative_pct",
        F.col("avg_review_rating").alias("avg_rating"), "total_reviews",
    )
    falling = F.coalesce(-F.col("sentiment_health_score"), F.lit(float("inf")))
    return global_rank(rows, falling, [F.desc("sentiment_health_score"), F.col("place_name")], bounded=True)


def _best(net: str = "net_sentiment"):
    """Aggregate: highest net sentiment, the first name among equals."""
    return F.min(F.struct((-F.col(net)).alias("key"), "place_name", net, "mentions"))


def aspect_best_worst(aspects: DataFrame) -> DataFrame:
    """Best and worst place per aspect, from ``compare_aspects``."""
    worst = F.min(F.struct("net_sentiment", "place_name"))
    picked = aspects.groupBy("aspect").agg(_best().alias("b"), worst.alias("w"))
    return picked.select(
        "aspect",
        F.col("b.place_name").alias("best_place"), F.col("b.net_sentiment").alias("best_score"),
        F.col("w.place_name").alias("worst_place"), F.col("w.net_sentiment").alias("worst_score"),
    )


def competitive_advantages(
    aspects: DataFrame, lexicon: Lexicon = lexicons.ASPECTS, min_net: float = 10.0, min_mentions: int = 3
) -> DataFrame:
    """(place, aspect) where the place leads: tested after the best place is picked.

    An aspect without any spread over several places is skipped; a single place always counts.
    """
    picked = aspects.groupBy("aspect").agg(
        _best().alias("b"), F.count(F.lit(1)).alias("n"),
        F.min("net_sentiment").alias("low"), F.max("net_sentiment").alias("high"),
    )
    spread = (F.col("n") == 1) | (F.col("low") != F.col("high"))
    kept = picked.filter(spread & (F.col("b.net_sentiment") > min_net) & (F.col("b.mentions") >= min_mentions))
    order = F.array(*[F.lit(a) for a in lexicon])
    return kept.select(
        F.col("b.place_name").alias("place_name"), "aspect",
        F.array_position(order, F.col("aspect")).alias("aspect_order"),
    )


def advantages_by_place(advantages: DataFrame) -> DataFrame:
    """One row per leading place with its aspects in lexicon order (bounded by the lexicon)."""
    listed = F.array_sort(F.collect_list(F.struct("aspect_order", "aspect")))
    return advantages.groupBy("place_name").agg(listed.alias("_a")).select(
        "place_name", F.transform("_a", lambda a: a["aspect"]).alias("advantages")
    )
