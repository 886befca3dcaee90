"""Aspect tagging and every per-aspect aggregate.

The lexicon is a small mapping, so an aspect is a conditional aggregate, not a row: one pass and one
partially aggregated shuffle yield the dense place-by-aspect grid, including pairs without a mention,
with neither an explode of the reviews nor a cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.functions.labels import title_case
from opinara.functions.numbers import from_micro, half_even, micro_sum, percent
from opinara.functions.text import ngrams, with_computed
from opinara.operators.preprocess import fetch_texts
from opinara.operators.ranking import top_per_group

Lexicon = Mapping[str, Sequence[str]]


def tag_aspects(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS, *, match_phrases: bool = False) -> DataFrame:
    """Add ``aspects`` (lexicon order) and ``aspects_mentioned``.

    Tokens are first reduced to lexicon words, so the per-aspect tests see only a few.  With
    ``match_phrases`` two-word lexicon entries also match adjacent tokens.
    """
    source = F.col("tokens")
    if match_phrases:
        source = F.concat(source, ngrams(F.col("tokens"), 2))
    every_word = sorted({word for words in lexicon.values() for word in words})
    hits = df.withColumn("_hits", F.array_distinct(F.filter(source, lambda w: w.isin(every_word))))
    names = [
        F.when(F.arrays_overlap("_hits", F.array(*[F.lit(w) for w in words])), F.lit(aspect))
        for aspect, words in lexicon.items()
    ]
    tagged = with_computed(hits, aspects=F.array_compact(F.array(*names)))
    return tagged.withColumn("aspects_mentioned", F.size("aspects")).drop("_hits")


def aspect_flags(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Widen ``aspects`` to one boolean ``aspect_<name>`` column each (the storage form)."""
    return df.withColumns({f"aspect_{a}": F.array_contains("aspects", a) for a in lexicon})


def aspect_grid(df: DataFrame, lexicon: Lexicon, keys: Sequence[str] = (), polarity: str | None = None) -> DataFrame:
    """Dense (keys, aspect) measures; ``polarity`` restricts mentions to one sentiment.

    ``reviews`` and ``positive_reviews``/``negative_reviews`` repeat the totals of the keys.
    """
    positive, negative = F.col("sentiment") == "positive", F.col("sentiment") == "negative"
    wanted = F.lit(True) if polarity is None else F.col("sentiment") == polarity

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    measures: list[Column] = []
    for number, aspect in enumerate(lexicon):
        hit = F.array_contains("aspects", aspect) & wanted
        measures.append(F.struct(
            F.lit(aspect).alias("aspect"),
            F.lit(number).alias("aspect_order"),
            count(hit).alias("mentions"),
            count(hit & positive).alias("positive"),
            count(hit & negative).alias("negative"),
            count(hit & F.col("sentiment").isNotNull()).alias("labelled"),
            micro_sum(F.when(hit, F.col("sentiment_score"))).alias("score_sum"),
            count(hit & F.col("sentiment_score").isNotNull()).alias("scored"),
            micro_sum(F.when(hit, F.col("review_rating"))).alias("rating_sum"),
            count(hit & F.col("review_rating").isNotNull()).alias("rated"),
        ))
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reviews"),
        count(positive).alias("positive_reviews"),
        count(negative).alias("negative_reviews"),
        F.array(*measures).alias("_aspects"),
    )
    return totals.select(
        *keys, "reviews", "positive_reviews", "negative_reviews", F.inline("_aspects")
    )


def _mean(total: str, count: str) -> Column:
    return F.try_divide(from_micro(F.col(total)), F.col(count).cast("double"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def aspect_summary(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Per aspect: mentions, shares among labelled mentions, mean score and rating (zero rows kept)."""
    return summary_of(aspect_grid(df, lexicon))


def summary_of(grid: DataFrame) -> DataFrame:
    """``aspect_summary`` from a grid without keys."""
    def share(part: Column) -> Column:
        return _or_zero(half_even(percent(part, F.col("labelled")), 1))

    neutral = F.col("labelled") - F.col("positive") - F.col("negative")
    return grid.select(
        "aspect",
        F.col("mentions").alias("total_mentions"),
        _or_zero(half_even(percent(F.col("mentions"), F.col("reviews")), 1)).alias("mention_rate"),
        share(F.col("positive")).alias("positive_pct"),
        share(F.col("negative")).alias("negative_pct"),
        share(neutral).alias("neutral_pct"),
        _or_zero(half_even(_mean("score_sum", "scored"), 3)).alias("avg_sentiment_score"),
        half_even(_mean("rating_sum", "rated"), 2).alias("avg_rating"),
    )


def _with_place(df: DataFrame) -> DataFrame:
    return df.filter(F.col("place_name").isNotNull())


def place_aspects(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Per place and aspect: mentions, rate, shares among all mentions, mean score."""
    return place_aspects_of(aspect_grid(_with_place(df), lexicon, ["place_name"]))


def place_aspects_of(grid: DataFrame) -> DataFrame:
    """``place_aspects`` from a grid by place."""
    return grid.select(
        "place_name", "aspect", "mentions",
        half_even(percent(F.col("mentions"), F.col("reviews")), 1).alias("mention_rate"),
        _or_zero(half_even(percent(F.col("positive"), F.col("mentions")), 1)).alias("positive_pct"),
        _or_zero(half_even(percent(F.col("negative"), F.col("mentions")), 1)).alias("negative_pct"),
        _or_zero(half_even(_mean("score_sum", "scored"), 3)).alias("avg_sentiment"),
    )


def compare_aspects(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Per place and aspect: net sentiment from the unrounded shares."""
    return comparison_of(aspect_grid(_with_place(df), lexicon, ["place_name"]))


def comparison_of(grid: DataFrame) -> DataFrame:
    """``compare_aspects`` from a grid by place."""
    positive = _or_zero(percent(F.col("positive"), F.col("mentions")))
    negative = _or_zero(percent(F.col("negative"), F.col("mentions")))
    return grid.select(
        "place_name", "aspect", "mentions",
        half_even(percent(F.col("mentions"), F.col("reviews")), 1).alias("mention_rate_pct"),
        half_even(positive, 1).alias("positive_pct"),
        half_even(negative, 1).alias("negative_pct"),
        half_even(positive - negative, 1).alias("net_sentiment"),
    )


def aspect_coverage(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Per place and aspect: share of the place's reviews that mention it (radar data)."""
    return coverage_of(aspect_grid(_with_place(df), lexicon, ["place_name"]))


def coverage_of(grid: DataFrame) -> DataFrame:
    """``aspect_coverage`` from a grid by place."""
    return grid.select(
        "place_name", title_case(F.col("aspect")).alias("aspect"),
        half_even(percent(F.col("mentions"), F.col("reviews")), 4).alias("coverage_pct"),
    )


def aspect_matrix(df: DataFrame, places: Sequence[str], lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Aspect rows by the selected places (columns); the list of places bounds the width."""
    chosen = df.filter(F.col("place_name").isin(list(places)))
    pivoted = (
        compare_aspects(chosen, lexicon).groupBy("aspect").pivot("place_name", list(places))
        .agg(F.avg("net_sentiment"))
    )
    return pivoted.select(
        title_case(F.col("aspect")).alias("aspect"),
        *[_or_zero(half_even(F.col(f"`{p}`"), 1)).alias(p) for p in places],
    )


def aspect_samples(
    df: DataFrame, n: int = 3, sentiments: Sequence[str] = ("negative", "positive"), raw: DataFrame | None = None
) -> DataFrame:
    """The first ``n`` texts (by ``review_id``) per aspect and sentiment.

    Only ids are ranked; the texts of the few winners (aspects x sentiments x n rows) are fetched
    afterwards, so no review text is sorted or shuffled.
    """
    tagged = df.filter(F.col("sentiment").isin(list(sentiments)))
    ids = tagged.select(F.explode("aspects").alias("aspect"), "sentiment", "review_id")
    winners = top_per_group(ids, ["aspect", "sentiment"], [F.col("review_id")], n, rank="sample_rank")
    return fetch_texts(winners, df, raw).select(
        "aspect", "sentiment", "sample_rank", "review_id", F.col("clean_text").alias("sample_text")
    )
