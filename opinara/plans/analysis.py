"""The whole analysis as one set of lazy result tables over one analysed review table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.operators import aspects, compare, insights, keywords, sentiment, summaries, topics
from opinara.operators import cube as cubes
from opinara.operators.frequent import Grams, Wanted, frequent_grams
from opinara.operators.preprocess import preprocess_reviews
from opinara.session import scratch_path, shuffles_freed, stored
from opinara.sources import writers


#: What the keyword results and topics want of the grams: their own limits of terms and reviews.
GRAMS = {
    "terms": Grams((1, 2), (Wanted(2000, 2, 0.85), Wanted(3000, 3, 0.8))),
    "place_terms": Grams((1, 2), (Wanted(2000, 2, 0.85),), ("place_name",), bits=22),
    "sided_terms": Grams((1, 2), (Wanted(2000),), ("sentiment",), keywords.POLARITIES),
    "phrases": Grams((3,), (Wanted(25, 2, 0.8),)),
}


@dataclass(frozen=True)
class AnalysisPlan:
    """Lexicons and choices of one analysis; ``stop_words=None`` takes the defaults."""

    stop_words: Sequence[str] | None = None
    aspects: Mapping[str, Sequence[str]] = field(default_factory=lambda: lexicons.ASPECTS)
    templates: Mapping[str, tuple[str, Sequence[str]]] = field(default_factory=lambda: lexicons.RECOMMENDATIONS)
    sentiment_method: str = "lexicon"
    sentiment_options: Mapping[str, object] = field(default_factory=dict)
    n_topics: int = 5

    def analyse(self, reviews: DataFrame) -> DataFrame:
        """Reviews with text, sentiment and aspect columns: row-wise, without a shuffle."""
        stop = self._stop_words(reviews)
        prepared = preprocess_reviews(reviews, stop)
        scored = sentiment.run_sentiment(prepared, self.sentiment_method, **self.sentiment_options)
        return aspects.tag_aspects(scored, self.aspects)

    def _stop_words(self, df: DataFrame) -> Sequence[str]:
        return lexicons.default_stop_words(df.sparkSession) if self.stop_words is None else self.stop_words

    def cube_results(self, cube: DataFrame, *, compare_places: bool = True) -> dict[str, DataFrame]:
        """Every result that follows from the cube of ``operators.cube``; no review is read."""
        grid = cubes.cube_grid(cube, self.aspects)
        placed = cubes.cube_grid(cube.filter(F.col("place_name").isNotNull()), self.aspects, ["place_name"])
        complaints = insights.complaints_of(cubes.cube_grid(cube, self.aspects, polarity="negative"))
        advice = insights.recommendations(complaints, self.templates)
        tables = {
            "stats": cubes.review_stats(cube),
            "places_ranked": cubes.places_ranked(cube),
            "sentiment_summary": cubes.sentiment_summary(cube),
            "aspect_summary": aspects.summary_of(grid),
            "aspect_comparison": aspects.place_aspects_of(placed),
            "complaint_totals": cubes.complaint_totals(cube),
            "complaint_aspects": complaints,
            "strengths": insights.strengths_of(cubes.cube_grid(cube, self.aspects, polarity="positive")),
            "insight_overview": cubes.insight_overview(cube),
            "recommendations": advice,
            "improvement_roadmap": insights.improvement_roadmap(advice),
        }
        if compare_places:
            by_place = aspects.comparison_of(placed)
            sentiments = cubes.compare_sentiment(cube)
            advantages = compare.competitive_advantages(by_place, self.aspects)
            tables.update({
                "sentiment_comparison": sentiments,
                "comparison_ranking": compare.comparison_ranking(sentiments),
                "aspect_net_sentiment": by_place,
                "aspect_best_worst": compare.aspect_best_worst(by_place),
                "competitive_advantages": compare.advantages_by_place(advantages),
            })
        return tables

    def results(
        self, analysed: DataFrame, *, with_topics: bool = True, compare_places: bool = True, cube: DataFrame | None = None
    ) -> dict[str, DataFrame]:
        """One DataFrame per result; storing the words, the counts of their grams and the place keywords, and topic fitting run here.

        ``cube`` is the stored cube of ``analysed``; without it each result of the cube derives it anew.
        """
        stop = self._stop_words(analysed)
        cube = cubes.build_cube(analysed, self.aspects) if cube is None else cube
        words = stored(keywords.review_words(analysed, stop, ["place_name", "sentiment"]), "words")
        grams = frequent_grams(words, GRAMS)
        by_place = stored(keywords.place_keywords(analysed, stop, word_table=words, stats=grams["place_terms"]), "place-keywords")
        tables = {
            **self.cube_results(cube, compare_places=compare_places),
            "rating_distribution": summaries.rating_distribution(analysed),
            "aspect_samples": aspects.aspect_samples(analysed),
            "global_keywords": keywords.global_keywords(analysed, stop, word_table=words, stats=grams["terms"]),
            "place_keywords": by_place,
            "phrase_frequencies": keywords.phrase_frequencies(analysed, stop, word_table=words, stats=grams["phrases"]),
            "word_frequencies": keywords.word_frequencies(analysed, 50),
            "keyword_sentiment": keywords.keyword_sentiment(analysed, stop, word_table=words, stats=grams["sided_terms"]),
            "complaint_keywords": insights.complaint_keywords(analysed, lexicon=self.aspects),
            "complaint_samples": aspects.aspect_samples(analysed, 5, ["negative"]),
        }
        if with_topics:
            fitted = topics.fit_topics(analysed, stop, n_topics=self.n_topics, word_table=words, stats=grams["terms"])
            if fitted is not None:
                tables["topic_words"] = fitted.topic_words()
                tables["topic_distribution"] = fitted.topic_distribution()
                tables["topic_counts"] = fitted.topic_counts()
        if compare_places:
            tables["keyword_comparison"] = keywords.comparison_of(by_place)
        return tables

    def run(self, reviews: DataFrame, output: str | None = None) -> dict[str, DataFrame]:
        """Analyse, store the analysed table once, and derive every result from the stored table.

        The store lies in ``output`` or in the shared checkpoint folder, so results survive the loss
        of executors and each of them scans only the columns it needs.  So does the cube, the only source of all results
        that count, average or rank.
        """
        spark = reviews.sparkSession
        store = f"{output}/analysed" if output else scratch_path(spark, "analysed")
        with shuffles_freed(spark):
            writers.write_parquet(self.analyse(reviews), store, compression="zstd")
        analysed = spark.read.parquet(store)
        cells = f"{output}/cube" if output else scratch_path(spark, "cube")
        writers.write_parquet(cubes.build_cube(analysed, self.aspects), cells)
        cube = spark.read.parquet(cells)
        several = len(cube.select("place_name").filter(F.col("place_name").isNotNull()).distinct().take(2)) > 1
        tables = self.results(analysed, compare_places=several, cube=cube)
        if output:
            writers.write_results(tables, f"{output}/results")
        return {"analysed": analysed, **tables}
