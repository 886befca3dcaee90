"""A mergeable cube of exact sums: place x aspect x sentiment, from which the aggregate tables follow.

A row holds counts and whole-millionth sums, so cubes of batches add up to the cube of all their reviews, in any order, and a
new batch is added without another look at the earlier reviews.  The cube has at most places x (aspects + 1) x (sentiments + 1)
rows, however many reviews there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.functions.numbers import from_micro, half_even, micro_sum, percent
from opinara.operators.aspects import Lexicon

#: A NULL place or sentiment is a value like any other; a NULL aspect marks the row of all reviews of its place and sentiment.
DIMENSIONS = ["place_name", "aspect", "sentiment"]
_SHARED = ["reviews", "score_sum", "scored", "rating_sum", "rated"]
#: Sums that only rows without an aspect carry.
_WHOLE = ["texts", "word_sum", "worded", "label_sum", "numbered"]
MEASURES = [*_SHARED, *_WHOLE]


def build_cube(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS, keys: Sequence[str] = ()) -> DataFrame:
    """The cube of analysed reviews: one scan, one partially aggregated shuffle, no explode of the reviews.

    With ``keys``, such as a batch number, there is one cube for each of their values.
    Missing columns among ``review_text``, ``word_count`` and ``sentiment_label_num`` count as NULL.
    """
    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    def shared(kept: Column) -> list[Column]:
        score, rating = F.when(kept, F.col("sentiment_score")), F.when(kept, F.col("review_rating"))
        return [
            F.count(F.when(kept, 1)).alias("reviews"), micro_sum(score).alias("score_sum"), F.count(score).alias("scored"),
            micro_sum(rating).alias("rating_sum"), F.count(rating).alias("rated"),
        ]

    words, number = column("word_count", "int"), column("sentiment_label_num", "int")
    whole = [
        F.count(column("review_text", "string")), F.sum(words.cast("long")), F.count(words),
        F.sum(number.cast("long")), F.count(number),
    ]
    rows = [F.struct(F.lit(None).cast("string").alias("aspect"), *shared(F.lit(True)),
                     *[value.alias(name) for name, value in zip(_WHOLE, whole, strict=True)])]
    nothing = [F.lit(None).cast("long").alias(name) for name in _WHOLE]
    rows += [
        F.struct(F.lit(a).alias("aspect"), *shared(F.array_contains("aspects", a)), *nothing) for a in lexicon
    ]
    cells = df.groupBy(*keys, "place_name", "sentiment").agg(F.array(*rows).alias("_rows"))
    rows = cells.select(*keys, "place_name", "sentiment", F.inline("_rows")).filter("reviews > 0")
    return rows.select(*keys, *DIMENSIONS, *MEASURES)


def add_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all reviews of these cubes, which must not share any."""
    rows = cubes[0]
    for cube in cubes[1:]:
        rows = rows.unionByName(cube)
    return rows.groupBy(*DIMENSIONS).agg(*[F.sum(m).alias(m) for m in MEASURES])


def store_cubes(cubes: DataFrame, folder: str, batch: str = "batch") -> None:
    """Store cubes by batch, one folder each; a replayed batch replaces its own rows, so nothing is counted twice.

    A batch should hold a review, or its earlier rows stay.
    """
    # The cube of a batch is small, so one task writes it to one file.
    cubes.repartition(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(folder)


def read_cube(spark: SparkSession, folder: str) -> DataFrame:
    """The sum of all stored batches."""
    return add_cubes(spark.read.parquet(folder).select(*DIMENSIONS, *MEASURES))


def _sum(kept: Column, measure: str) -> Column:
    return F.sum(F.when(kept, F.col(measure)))


def _count(kept: Column, measure: str = "reviews") -> Column:
    return F.coalesce(_sum(kept, measure), F.lit(0).cast("long"))


def cube_grid(
    cube: DataFrame, lexicon: Lexicon = lexicons.ASPECTS, keys: Sequence[str] = (), polarity: str | None = None
) -> DataFrame:
    """What ``aspects.aspect_grid`` gives for the reviews of the cube."""
    whole = F.col("aspect").isNull()
    positive, negative = F.col("sentiment") == "positive", F.col("sentiment") == "negative"
    wanted = F.lit(True) if polarity is None else F.col("sentiment") == polarity
    measures = []
    for number, aspect in enumerate(lexicon):
        hit = (F.col("aspect") == aspect) & wanted
        measures.append(F.struct(
            F.lit(aspect).alias("aspect"), F.lit(number).alias("aspect_order"),
            _count(hit).alias("mentions"), _count(hit & positive).alias("positive"), _count(hit & negative).alias("negative"),
            _count(hit & F.col("sentiment").isNotNull()).alias("labelled"),
            _sum(hit, "score_sum").alias("score_sum"), _count(hit, "scored").alias("scored"),
            _sum(hit, "rating_sum").alias("rating_sum"), _count(hit, "rated").alias("rated"),
        ))
    totals = cube.groupBy(*keys).agg(
        _count(whole).alias("reviews"), _count(whole & positive).alias("positive_reviews"),
        _count(whole & negative).alias("negative_reviews"), F.array(*measures).alias("_aspects"),
    )
    return totals.select(*keys, "reviews", "positive_reviews", "negative_reviews", F.inline("_aspects"))


def _all(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("aspect").isNull())


def _each_place(cube: DataFrame):
    return _all(cube).filter(F.col("place_name").isNotNull()).groupBy("place_name")


def _mean(total: str, count: str, kept: Column | None = None) -> Column:
    kept = F.lit(True) if kept is None else kept
    return F.try_divide(from_micro(_sum(kept, total)), _sum(kept, count).cast("double"))


def _whole_mean(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double"))


def _is(sentiment: str) -> Column:
    return F.col("sentiment") == sentiment


def _share(sentiment: str) -> Column:
    return percent(_count(_is(sentiment)), F.sum("reviews"))


def review_stats(cube: DataFrame) -> DataFrame:
    """``summaries.review_stats`` from the cube."""
    return _all(cube).agg(
        _count(F.lit(True)).alias("total_reviews"), F.countDistinct("place_name").alias("total_places"),
        half_even(_mean("rating_sum", "rated"), 2).alias("avg_rating"),
        half_even(_whole_mean("word_sum", "worded"), 1).alias("avg_word_count"),
    )


def places_ranked(cube: DataFrame) -> DataFrame:
    """``summaries.places_ranked`` from the cube."""
    return _each_place(cube).agg(
        _count(F.lit(True), "texts").alias("reviews"), _mean("rating_sum", "rated").alias("avg_rating")
    ).orderBy(F.desc("reviews"), "place_name")


def _sentiment_measures() -> list[Column]:
    return [
        _count(F.col("sentiment").isNotNull()).alias("total_reviews"),
        *[half_even(_share(s), 2).alias(f"{s}_pct") for s in lexicons.SENTIMENTS],
        half_even(_mean("score_sum", "scored"), 2).alias("avg_sentiment_score"),
        half_even(_mean("rating_sum", "rated"), 2).alias("avg_review_rating"),
    ]


def sentiment_summary(cube: DataFrame) -> DataFrame:
    """``summaries.sentiment_summary`` from the cube."""
    return _each_place(cube).agg(*_sentiment_measures()).orderBy(F.desc("positive_pct"), "place_name")


def compare_sentiment(cube: DataFrame) -> DataFrame:
    """``summaries.compare_sentiment`` from the cube."""
    base = _each_place(cube).agg(
        *_sentiment_measures(), half_even(_whole_mean("label_sum", "numbered"), 2).alias("sentiment_label_avg"))
    health = F.col("positive_pct") * 0.6 + (100 - F.col("negative_pct")) * 0.4
    return base.withColumn("sentiment_health_score", half_even(health, 1)).orderBy(
        F.desc("sentiment_health_score"), "place_name")


def complaint_totals(cube: DataFrame, min_reviews: int = 3) -> DataFrame:
    """``insights.complaint_totals`` from the cube."""
    negative = _is("negative")
    return _all(cube).agg(
        _count(negative).alias("total_negative_reviews"),
        half_even(_share("negative"), 1).alias("negative_pct"),
        half_even(_mean("rating_sum", "rated", negative), 2).alias("avg_negative_rating"),
    ).filter(F.col("total_negative_reviews") >= min_reviews)


def insight_overview(cube: DataFrame) -> DataFrame:
    """``insights.insight_overview`` from the cube."""
    counted = _all(cube).agg(
        _count(F.lit(True)).alias("total_reviews"), half_even(_mean("rating_sum", "rated"), 2).alias("avg_rating"),
        *[_count(_is(s)).alias(f"{s}_reviews") for s in lexicons.SENTIMENTS],
    )
    shares = counted.withColumns({
        f"{s}_pct": half_even(percent(F.col(f"{s}_reviews"), F.col("total_reviews")), 1) for s in ("positive", "negative")})
    ratio = F.col("positive_pct") / F.greatest(F.col("negative_pct"), F.lit(0.1))
    return shares.withColumn("sentiment_ratio", half_even(ratio, 1))
