"""One query per operator over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opinara import lexicons, schemas
from opinara.catalog import adapters as a
from opinara.functions import labels, text
from opinara.functions.numbers import half_even
from opinara.operators import cube as cubes
from opinara.operators import (
    aspects, collection, compare, extract, growth, insights, keyphrases, keywords, merge, panels, preprocess,
    scorer, sentiment, summaries, topics, vectors,
)
from opinara.plans import export
from opinara.plans.analysis import AnalysisPlan
from opinara.session import materialise, scratch_path, stored
from opinara.sources import readers, writers
from opinara.streaming import attempts, history, ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
COMPARED_PLACES = [f"src{n}" for n in range(6)]


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _on(name: str, base: Query, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Register an operator that takes one review table."""
    REGISTRY[name] = lambda spark, sf_dir: operator(base(spark, sf_dir))


# ---- sources and sinks -------------------------------------------------------------------------

def _landed_places(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Place records as JSON lines of which some hold their reviews as JSON text, with elements that are no reviews."""
    places = a.raw_places(spark, sf_dir)
    as_text = F.to_json("user_reviews")
    mixed = F.concat(F.lit("[1, null, "), F.substring(as_text, 2, 1 << 30))
    stray = F.when(F.size("user_reviews") > 0, mixed).otherwise(as_text)
    textual = F.col("place_seq") % 2 == 1
    columns = [c for c in places.columns if c not in ("place_seq", "user_reviews")]
    places.filter(~textual).drop("place_seq").write.json(f"{folder}/kind=lines")
    places.filter(textual).select(*columns, stray.alias("user_reviews")).write.json(f"{folder}/kind=text")
    # The same records again as one array over many lines, in files of their own.
    arrays = places.filter(F.col("place_seq") % 3 == 0).drop("place_seq")
    rows = arrays.select(F.to_json(F.struct(*arrays.columns)).alias("value"), F.spark_partition_id().alias("p"),
                         F.monotonically_increasing_id().alias("i"))
    closed = W.partitionBy("p").orderBy("i")
    piece = F.concat(F.when(F.row_number().over(closed) == 1, "[\n ").otherwise(" ,"), "value",
                     F.when(F.lead("i").over(closed).isNull(), "\n]").otherwise(""))
    rows.select(piece.alias("value"), "p", "i").sortWithinPartitions("p", "i").select("value", "p").write.partitionBy(
        "p").text(f"{folder}/kind=array")
    return readers.read_places(spark, f"{folder}/{{kind=lines,kind=text,kind=array/*}}")


@query
def scan_raw_places(spark, sf_dir):
    places = _landed_places(spark, sf_dir, scratch_path(spark, "raw-places"))
    return extract.explode_reviews(places, ["place_seq"]).select(
        "place_name", "place_id", "pos", "review_text", "review_rating", "review_date", "reviewer_name")


@query
def flatten_struct(spark, sf_dir):
    events = a.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props")
    )
    return extract.flatten_struct(events)


@query
def scan_reviews(spark, sf_dir):
    path = scratch_path(spark, "reviews")
    writers.write_parquet(a.reviews(spark, sf_dir).select(*schemas.REVIEW_COLUMNS), path)
    return readers.read_reviews(spark, path).drop("review_id")


@query
def scan_batches(spark, sf_dir):
    folder = scratch_path(spark, "batches")
    stamped = a.reviews(spark, sf_dir).select(
        "review_id", "place_name", "review_rating",
        F.format_string("batch_%04d_reviews.parquet", "batch").alias("file"),
    )
    stamped.write.partitionBy("file").parquet(folder)
    return readers.read_batches(spark, f"{folder}/*batch_*_reviews.parquet")


@query
def scan_listed_batches(spark, sf_dir):
    """Batches of two schemas, found by their manifest; a file that no entry names is not read."""
    folder = scratch_path(spark, "listed")
    rows = a.reviews(spark, sf_dir).select("review_id", "place_name", "review_rating", "batch")
    for number, part in enumerate((F.col("batch") < 3, F.col("batch").between(3, 5), F.col("batch") > 5)):
        kept = rows.filter(part).drop("batch")
        writers.write_batch(kept.drop("review_rating") if number == 1 else kept, folder, number)
    rows.limit(5).drop("batch").write.mode("append").parquet(f"{folder}/batch_0002_reviews.parquet")
    return readers.read_listed_batches(spark, folder)


@query
def latest_run(spark, sf_dir):
    folder = scratch_path(spark, "runs")
    rows = a.reviews(spark, sf_dir).select("review_id", "place_name")
    writers.write_run(rows.withColumn("place_name", F.lit("old")), folder, "first")
    writers.write_run(rows, folder, "second")
    return readers.read_latest(spark, folder)


@query
def scan_queries(spark, sf_dir):
    path = scratch_path(spark, "query-list")
    key = F.col("page_id")
    line = F.when(key % 5 == 0, F.concat(F.lit("# "), "url")).when(key % 7 == 0, "\t ").otherwise(
        F.concat(F.lit("\t "), "url", F.lit(" \t"))
    )
    writers.write_queries(a.table(spark, sf_dir, "pages").select(line.alias("query")), path)
    return readers.read_queries(spark, path).select("query")


@query
def place_coordinates(spark, sf_dir):
    folder = scratch_path(spark, "places")
    places = a.places(spark, sf_dir)
    for part, kept in (("0", places.drop("review_count")), ("1", places)):
        half = kept.filter(F.col("place_seq") % 2 == int(part))
        writers.write_parquet(half.withColumn("order", F.col("place_seq")), f"{folder}/{part}")
    read = readers.read_coordinates(spark, f"{folder}/*")
    # Titles repeat, and a place's id is its number: the even half comes first.
    number = F.col("place_id").cast("long")
    return merge.dedupe_places(read, [number % 2, number])


@query
def merged_sink(spark, sf_dir):
    """The merged reviews as written and read back: rows and characters of the Parquet and the CSV copy."""
    folder = scratch_path(spark, "merged")
    columns = ["place_name", "place_id", "review_rating", "reviewer_name"]
    merged = merge.merge_reviews(a.copied_reviews(spark, sf_dir), ["batch", "review_id"]).select(*columns)
    writers.write_merged(merged, folder)
    stored = spark.read.parquet(f"{folder}/collected_all_reviews.parquet").withColumn("copy", F.lit("parquet"))
    text_copy = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/collected_all_reviews.csv")
    text_copy = text_copy.withColumn("review_rating", F.col("review_rating").cast("double")).withColumn("copy", F.lit("csv"))
    return stored.unionByName(text_copy).groupBy("copy", "place_name").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum(F.length("reviewer_name")).cast("long").alias("characters"),
        F.sum("review_rating").alias("ratings"))


_on("export_all_reviews", a.copied_reviews,
    lambda df: merge.merge_reviews(df, ["batch", "review_id"]).select(*schemas.REVIEW_COLUMNS))
_on("export_places_summary", a.reviews, summaries.places_summary)
_on("export_sentiment_by_place", a.scored, lambda df: export.sentiment_by_place(summaries.sentiment_summary(df)))


def _complaints(df: DataFrame) -> DataFrame:
    return insights.complaint_aspects(df, a.ASPECTS)


def _recommendations(df: DataFrame) -> DataFrame:
    return insights.recommendations(_complaints(df))


_on("export_recommendations", a.analysed, lambda df: export.recommendations(_recommendations(df)))
_on("export_aspect_summary", a.analysed, lambda df: export.aspect_summary(aspects.aspect_summary(df, a.ASPECTS)))
_on("export_ranking", a.scored,
    lambda df: export.comparison_ranking(compare.comparison_ranking(summaries.compare_sentiment(df))))
_on("roadmap_filtered", a.analysed,
    lambda df: insights.filter_severity(insights.improvement_roadmap(_recommendations(df)), ["critical", "high"]))
_on("exec_kpis", a.scored, panels.executive_kpis)
_on("exec_top_places", a.scored, lambda df: panels.executive_top_places(summaries.sentiment_summary(df)))
_on("exec_top_complaints", a.analysed, lambda df: panels.executive_complaints(_complaints(df)))
_on("exec_recommendations", a.analysed, lambda df: panels.executive_recommendations(_recommendations(df)))


# ---- projections and filters -------------------------------------------------------------------

@query
def extract_reviews(spark, sf_dir):
    return extract.extract_reviews(a.raw_places(spark, sf_dir), ["place_seq"])


@query
def coalesce_text(spark, sf_dir):
    third = F.col("doc_id") % 3
    chosen = extract.first_text(
        F.when(third == 0, F.col("text")).otherwise(""), F.when(third == 1, F.col("text")), F.col("source")
    )
    return a.table(spark, sf_dir, "documents").select("doc_id", chosen.alias("review_text"))


@query
def nonblank(spark, sf_dir):
    emptied = F.when(F.col("doc_id") % 4 == 0, " \t\n").otherwise(F.col("text"))
    rows = a.table(spark, sf_dir, "documents").select("doc_id", emptied.alias("text"))
    return rows.filter(text.not_blank(F.col("text")))


_on("global_filter", a.scored, lambda df: panels.apply_filters(
    df, rating_min=2, rating_max=4, sentiments=["positive", "negative"], places=["src1", "src2", "src3"],
    categories=["en", "de"],
).select("review_id", "place_name", "place_category", "review_rating", "sentiment"))
_on("select_places", a.reviews, lambda df: panels.select_places(df).select("review_id", "place_name"))
_on("filter_options", a.scored, panels.filter_options)


# ---- text --------------------------------------------------------------------------------------

_on("clean_text", a.cleaned, lambda df: df.select("review_id", "clean_text"))
_on("tokens", a.prepared, lambda df: df.select("review_id", F.array_join("tokens", " ").alias("tokens"), "token_count"))
_on("treebank_tokens", a.contracted, lambda df: preprocess.preprocess_reviews(df, a.STOP_WORDS, treebank=True).select(
    "review_id", F.array_join("tokens", " ").alias("tokens"), "token_count"))
_on("preprocess", a.prepared, lambda df: df.select(
    "review_id", "clean_text", F.array_join("tokens", "|").alias("tokens"), "token_count", "word_count",
    "review_length_bucket"))
_on("length_bucket", a.measured, lambda df: df.groupBy(
    "review_length_bucket", labels.length_bucket_order(F.col("review_length_bucket")).alias("bucket_order")
).agg(F.count(F.lit(1)).alias("reviews")))
_on("ngrams", a.cleaned, lambda df: keywords.review_words(
    df, a.STOP_WORDS
).select("review_id", F.array_join(text.ngrams(F.col("words"), 2), "|").alias("bigrams"),
         F.size(text.ngrams(F.col("words"), 3)).alias("n_trigrams")))
_on("sentiment_label", a.scored, lambda df: df.select(
    "review_id", "sentiment", "sentiment_score", "sentiment_label_num"))
_on("alert_level", a.scored, summaries.alert_level)
_on("health_label", a.scored, summaries.overall_health)
_on("aspect_tags", a.analysed, lambda df: df.select(
    "review_id", F.array_join("aspects", ",").alias("aspects"), "aspects_mentioned"))


@query
def lexicon_sentiment(spark, sf_dir):
    cleaned = a.cleaned(spark, sf_dir)
    rated = sentiment.lexicon_sentiment(
        cleaned, a.VALENCES | a.PHRASES, negators=a.NEGATORS, boosters=a.BOOSTERS | a.PHRASE_BOOSTERS)
    return rated.select("review_id", "sentiment", "sentiment_score", "sentiment_label_num")


@query
def model_sentiment(spark, sf_dir):
    cleaned = a.cleaned(spark, sf_dir)
    known = a.labelled(spark, sf_dir).select("review_id", F.col("sentiment").alias("label"))
    # A fifth of the labels is held out; tests measure the scorer on it.
    fitted = scorer.fit_scorer(cleaned.join(known.filter(F.col("review_id") % 5 != 0), "review_id"), "label")
    weights = spark.sparkContext.broadcast(fitted)  # 65,536 rows of three numbers
    rated = sentiment.model_sentiment(cleaned, lambda: weights.value)
    return rated.select("review_id", "sentiment", "sentiment_score", "sentiment_label_num")


# ---- aggregates --------------------------------------------------------------------------------

_on("review_stats", a.measured, summaries.review_stats)
_on("rating_distribution", a.measured, summaries.rating_distribution)
_on("places_ranked", a.measured, lambda df: summaries.places_ranked(df).withColumn(
    "avg_rating", half_even(F.col("avg_rating"), 6)))
_on("sentiment_summary", a.scored, summaries.sentiment_summary)
_on("labelled_summary", a.labelled, summaries.sentiment_summary)
_on("labelled_share", a.labelled, summaries.sentiment_share)
_on("compare_sentiment", a.scored, summaries.compare_sentiment)
_on("sentiment_share", a.scored, summaries.sentiment_share)
_on("rating_sentiment", a.scored, summaries.rating_sentiment)
_on("place_sentiment_top20", a.scored, summaries.place_sentiment_top)
_on("rating_by_place", a.measured, summaries.rating_by_place)
_on("net_health", a.scored, summaries.net_health)
_on("dataset_stats", a.reviews, summaries.dataset_stats)
_on("top_places", a.reviews, summaries.top_places)
_on("top_places_volume", a.measured, summaries.top_places_by_volume)
_on("batch_stats", a.reviews, summaries.batch_stats)
_on("query_progress", a.query_log, summaries.query_progress)
_on("aspect_summary", a.analysed, lambda df: aspects.aspect_summary(df, a.ASPECTS))
_on("place_aspect", a.analysed, lambda df: aspects.place_aspects(df, a.ASPECTS))
_on("compare_aspects", a.analysed, lambda df: aspects.compare_aspects(df, a.ASPECTS))
_on("aspect_coverage", a.analysed, lambda df: aspects.aspect_coverage(df, a.ASPECTS))
_on("aspect_matrix", a.analysed, lambda df: aspects.aspect_matrix(df, COMPARED_PLACES, a.ASPECTS))


@query
def aspect_samples(spark, sf_dir):
    return aspects.aspect_samples(a.analysed(spark, sf_dir), raw=a.reviews(spark, sf_dir))


@query
def map_places(spark, sf_dir):
    located = merge.dedupe_places(a.places(spark, sf_dir), ["place_seq"])
    joined = summaries.map_places(located, a.scored(spark, sf_dir))
    return joined.select(
        "place_name", half_even(F.col("latitude"), 4).alias("latitude"),
        half_even(F.col("longitude"), 4).alias("longitude"), "category", "address", "review_rating",
        "claimed_review_count", "collected_review_count", half_even(F.col("avg_rating"), 4).alias("avg_rating"),
        half_even(F.col("positive_pct"), 4).alias("positive_pct"),
    )


@query
def map_centre(spark, sf_dir):
    centre = summaries.map_centre(a.places(spark, sf_dir))
    return centre.select(*[half_even(F.col(c), 6).alias(c) for c in ("latitude", "longitude")])


# ---- insights and comparison -------------------------------------------------------------------

_on("complaint_totals", a.scored, insights.complaint_totals)
_on("complaint_aspects", a.analysed, _complaints)
_on("complaint_keywords", a.analysed, insights.complaint_keywords)
_on("strengths", a.analysed, lambda df: insights.strengths(df, a.ASPECTS))
_on("insight_overview", a.scored, insights.insight_overview)
_on("recommendations", a.analysed, lambda df: _recommendations(df).withColumn("actions", F.array_join("actions", "|")))
_on("improvement_roadmap", a.analysed, lambda df: insights.improvement_roadmap(_recommendations(df)))
_on("comparison_ranking", a.scored, lambda df: compare.comparison_ranking(summaries.compare_sentiment(df)))
_on("aspect_best_worst", a.analysed, lambda df: compare.aspect_best_worst(aspects.compare_aspects(df, a.ASPECTS)))
_on("competitive_advantages", a.analysed, lambda df: compare.advantages_by_place(
    compare.competitive_advantages(aspects.compare_aspects(df, a.ASPECTS), a.ASPECTS)
).withColumn("advantages", F.array_join("advantages", ",")))
_on("leaderboard", a.scored, lambda df: panels.leaderboard(summaries.sentiment_summary(df)))
_on("top_bottom", a.scored, lambda df: panels.top_bottom(summaries.sentiment_summary(df)))
_on("priority_insights", a.analysed, lambda df: panels.priority_insights(_complaints(df)))
_on("complaint_cards", a.analysed, lambda df: panels.complaint_cards(_complaints(df)))
_on("strength_cards", a.analysed, lambda df: panels.strength_cards(insights.strengths(df, a.ASPECTS)))


@query
def top_reviews(spark, sf_dir):
    return panels.top_reviews(a.scored(spark, sf_dir), raw=a.reviews(spark, sf_dir))


# ---- keywords and topics -----------------------------------------------------------------------

_on("word_freq", a.prepared, lambda df: keywords.word_frequencies(df, 50))
_on("phrase_freq", a.cleaned, lambda df: keywords.phrase_frequencies(df, a.STOP_WORDS))
_on("global_keywords", a.cleaned, lambda df: keywords.global_keywords(df, a.STOP_WORDS))
_on("place_keywords", a.cleaned, lambda df: keywords.place_keywords(df, a.STOP_WORDS))
_on("compare_keywords", a.cleaned, lambda df: keywords.compare_keywords(df, a.STOP_WORDS))
_on("keyword_sentiment", a.scored, lambda df: keywords.keyword_sentiment(df, a.STOP_WORDS))
_on("negative_keywords", a.scored,
    lambda df: panels.negative_keywords(keywords.keyword_sentiment(df, a.STOP_WORDS)))
_on("topic_words", a.cleaned, lambda df: topics.topic_tables(df, a.STOP_WORDS)["words"])
_on("topic_counts", a.cleaned, lambda df: topics.topic_tables(df, a.STOP_WORDS)["counts"])
_on("topic_vocabulary", a.cleaned, lambda df: topics.topic_vocabulary(df, a.STOP_WORDS))


@query
def topic_invariants(spark, sf_dir):
    """What holds for any fit, from one fit: every review has shares that add up to one, every topic its words."""
    tables = topics.topic_tables(a.cleaned(spark, sf_dir), a.STOP_WORDS)
    shares = F.aggregate("distribution", F.lit(0.0), lambda total, x: total + x)
    best = F.concat(F.lit("topic_"), F.array_position("distribution", F.array_max("distribution")))
    reviews = tables["distribution"].agg(
        F.count(F.lit(1)).alias("reviews"), F.countDistinct("review_id").alias("distinct_reviews"),
        F.count(F.when(F.abs(shares - 1) < 1e-6, 1)).alias("adding_up"),
        F.count(F.when(F.col("dominant_topic") == best, 1)).alias("dominant"))
    words = tables["words"]
    return reviews.withColumns({
        "topics": words.agg(F.countDistinct("topic")).scalar(), "topic_words": words.agg(F.count(F.lit(1))).scalar(),
        "counted": tables["counts"].agg(F.sum("reviews")).scalar()})


@query
def mmr_keyphrases(spark, sf_dir):
    return keyphrases.review_keyphrases(a.cleaned(spark, sf_dir), a.STOP_WORDS)


@query
def word_vectors(spark, sf_dir):
    table = materialise(keywords.review_words(a.cleaned(spark, sf_dir), a.STOP_WORDS))
    found = vectors.word_vectors(table)
    return found.select("word", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


# ---- merging and deduplication -----------------------------------------------------------------

@query
def union_batches(spark, sf_dir):
    rows = a.reviews(spark, sf_dir).select("review_id", "place_name", "review_rating", "reviewer_name", "batch")
    even = rows.filter(F.col("batch") % 2 == 0).drop("reviewer_name")
    return merge.union_batches([even, rows.filter(F.col("batch") % 2 == 1)])


_on("dedupe_prefix", a.copied_reviews,
    lambda df: extract.dedupe_by_prefix(df, ["batch", "review_id"]).select("review_id", "place_id"))
_on("merge_reviews", a.copied_reviews,
    lambda df: merge.merge_reviews(df, ["batch", "review_id"]).select("review_id", "place_id", "review_text"))


# ---- query lists -------------------------------------------------------------------------------

@query
def pending_queries(spark, sf_dir):
    return collection.pending_queries(a.listed_queries(spark, sf_dir), a.query_log(spark, sf_dir))


@query
def new_queries(spark, sf_dir):
    listed = a.listed_queries(spark, sf_dir)
    # The log knows every customer's clinic; none of the bakeries.
    bakeries = listed.select(F.regexp_replace("query", "^clinic", "bakery").alias("query"))
    return collection.new_queries(listed.union(bakeries), a.query_log(spark, sf_dir))


_on("distinct_queries", a.query_log, collection.distinct_queries)
_on("query_cross", a.areas, lambda df: collection.area_queries(df, lexicons.CLINIC_KEYWORDS))
_on("query_expansion", a.areas, lambda df: collection.expansion_queries(df, lexicons.NICHES))


@query
def query_max_coverage(spark, sf_dir):
    centres = a.boxes(spark, sf_dir).select(
        F.format_string("%.4f,%.4f", F.col("min_lat"), F.col("min_lon")).alias("centre")
    )
    return collection.max_coverage_queries(a.areas(spark, sf_dir), lexicons.CLINIC_KEYWORDS, centres, "clinic")


_on("grid_points", a.boxes, lambda df: collection.grid_points(df).select(
    "s_suppkey", half_even(F.col("lat"), 6).alias("lat"), half_even(F.col("lon"), 6).alias("lon"), "query"))


# ---- growth and coverage -----------------------------------------------------------------------

def _deduped_places(spark, sf_dir):
    return merge.dedupe_places(a.places(spark, sf_dir), ["place_seq"])


_on("batch_yield", a.copied_reviews, growth.batch_yield)
# February and July have no reviews, so the calendar has to fill them.
_on("sentiment_trend", a.scored, lambda df: growth.sentiment_trend(df.filter(F.month("review_ts") % 5 != 2)))
_on("area_rollup", a.reviews, growth.area_rollup)


@query
def capture_rate(spark, sf_dir):
    return growth.capture_rate(_deduped_places(spark, sf_dir), a.reviews(spark, sf_dir))


@query
def thin_places(spark, sf_dir):
    return growth.thin_places(_deduped_places(spark, sf_dir), a.reviews(spark, sf_dir))


# ---- streaming ---------------------------------------------------------------------------------

@query
def stream_extract(spark, sf_dir):
    folder = scratch_path(spark, "stream-extract")
    a.raw_places(spark, sf_dir).drop("place_seq").write.json(f"{folder}/landing")
    places = ingest.place_stream(spark, f"{folder}/landing")
    ingest.start_extract(places, f"{folder}/reviews", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/reviews").select(
        "place_id", "pos", "review_text", "review_rating", "review_date", "reviewer_name"
    )


def _in_deliveries(spark: SparkSession, sf_dir: str, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Reviews land in two deliveries of four batches; the stream runs after each, so that a delivery is one micro-batch."""
    columns = ["review_id", "place_name", "place_id", "review_text", "batch"]
    landed = a.copied_reviews(spark, sf_dir).select(*columns)
    for delivery in (F.col("batch") < 4, F.col("batch") >= 4):
        landed.filter(delivery).write.mode("append").parquet(f"{folder}/landing")
        start(spark.readStream.schema(landed.schema).parquet(f"{folder}/landing")).awaitTermination()


@query
def stream_merge(spark, sf_dir):
    """Which copy survives is part of the result."""
    folder = scratch_path(spark, "stream-merge")
    _in_deliveries(spark, sf_dir, folder, lambda stream: ingest.start_merge(
        stream, f"{folder}/history", f"{folder}/checkpoint", ["batch", "review_id"], target_rows=500, compact_every=1))
    return history.read_history(spark, f"{folder}/history").select("review_id", "place_id", "review_text")


@query
def stream_status(spark, sf_dir):
    folder = scratch_path(spark, "stream-status")
    _in_deliveries(spark, sf_dir, folder, lambda stream: ingest.start_status(
        stream, f"{folder}/status", f"{folder}/checkpoint"))
    recorded = spark.read.parquet(f"{folder}/status")
    # A batch lies in one delivery, hence in one epoch.
    return recorded.groupBy("batch", "status").agg(F.sum("places").alias("places"), F.sum("reviews").alias("reviews"))


@query
def attempt_state(spark, sf_dir):
    """Collection state folded from a log of attempts, one for each order."""
    return attempts.fold_attempts(a.attempt_log(spark, sf_dir)).withColumnRenamed("batch", "last_batch")


@query
def pending_attempts(spark, sf_dir):
    """What to run next, by the folded state."""
    state = attempts.fold_attempts(a.attempt_log(spark, sf_dir), every_failure=True)
    return collection.pending_queries(a.listed_queries(spark, sf_dir), state)


# ---- everything --------------------------------------------------------------------------------

def _from_cube(name: str, result: str) -> None:
    """Register a result of the whole analysis that comes from the stored cubes of eight batches."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_path(spark, "cube")
        cubes.store_cubes(cubes.build_cube(a.analysed(spark, sf_dir), a.ASPECTS, ["batch"]), folder)
        return AnalysisPlan(aspects=a.ASPECTS).cube_results(cubes.read_cube(spark, folder))[result]

    REGISTRY[name] = run


for _name, (_result, _same) in a.CUBED.items():
    _from_cube(_name, _result)


@query
def analysis_plan(spark, sf_dir):
    """Row counts of every result of the whole analysis."""
    plan = AnalysisPlan(
        stop_words=a.STOP_WORDS, aspects=a.ASPECTS, sentiment_method="tokens",
        sentiment_options={"valences": a.VALENCES},
    )
    tables = plan.run(a.reviews(spark, sf_dir).repartition("review_id"))
    # Counted one after the other, so that the shuffles of all results do not lie on disk together.
    counts = [
        stored(table.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("result"), "row_count"), "row-count")
        for name, table in tables.items()
    ]
    return merge.union_batches(counts)
