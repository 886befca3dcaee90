"""Review, place and query tables derived from the generic test tables.

The text of those tables is invented, so real lexicon words hardly occur in it; the fixture lexicons
below use frequent words of that text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import aspects, preprocess, sentiment

ASPECTS: dict[str, list[str]] = {
    "service": ["thor", "thea"], "price": ["thin", "thti"], "quality": ["thed", "thnt"],
    "ambiance": ["erst", "eren"], "location": ["thou", "eror"], "wait_time": ["erre", "eran"],
    "menu_variety": ["erin", "thly"], "portion": ["erhe", "erth"], "delivery": ["ered", "erat"],
}
VALENCES: dict[str, float] = {
    "thing": 1.9, "attion": 1.5, "thst": 2.1, "eres": 1.3, "thes": 1.0,
    "thwh": -1.8, "thsh": -2.2, "ernd": -1.5, "ernt": -1.2, "thble": -1.0,
}
STOP_WORDS: list[str] = [
    "that", "with", "this", "from", "the", "and", "of", "to", "is", "in", "it", "by", "for", "as", "on",
    "an", "at", "or", "was",
]
# Context words for the rule-based scorer, again frequent in the invented text.
NEGATORS: list[str] = ["with", "for"]
BOOSTERS: dict[str, float] = {"that": 0.293, "and": 0.293, "was": -0.293}
# Phrases for the same scorer: one begins like another, two begin and end with a scored word, one takes a degree word's place.
PHRASES: dict[str, float] = {"the eres": 2.6, "the eres the": -1.7, "attion to": -1.4, "thst the": 0.8, "and the": 0.9}
PHRASE_BOOSTERS: dict[str, float] = {"of the": 0.293}

#: What makes contractions of the invented text: pattern and replacement.
CONTRACTIONS: list[tuple[str, str]] = [
    (" with ", " don't (cannot) "), (" for ", " it's 3.50, "), (" by ", ' "they\'ll" '), (" was ", " well-known... we've -- "),
]

#: Query on the cube -> (result of the analysis, query on the reviews that gives the same rows).
CUBED = {
    "cube_stats": ("stats", "review_stats"),
    "cube_comparison": ("sentiment_comparison", "compare_sentiment"),
    "cube_aspects": ("aspect_summary", "aspect_summary"),
    "cube_net_sentiment": ("aspect_net_sentiment", "compare_aspects"),
    "cube_complaints": ("complaint_aspects", "complaint_aspects"),
    "cube_strengths": ("strengths", "strengths"),
}

# A place record holds a slice of a conversation, so that no record grows without bound.
TURNS_PER_RECORD = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document: its source is the place, its language the category and area."""
    key = F.col("doc_id")
    stamp = F.timestamp_add("DAY", (key % 365).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "documents").select(
        key.alias("review_id"),
        F.col("source").alias("place_name"), F.col("source").alias("place_id"),
        (1 + F.col("n_chars") % 5).cast("double").alias("place_rating"),
        F.col("lang").alias("place_category"), F.col("lang").alias("area"),
        F.concat(F.lit("addr "), "source").alias("place_address"),
        F.col("text").alias("review_text"),
        (1 + key % 5).cast("double").alias("review_rating"),
        stamp.alias("review_ts"),
        F.date_format(stamp, "yyyy-MM-dd").alias("review_date"),
        F.concat(F.lit("user "), (key % 97).cast("string")).alias("reviewer_name"),
        (key % 7).alias("reviewer_photos"), (key % 11).alias("review_likes"),
        (key % 8).cast("int").alias("batch"),
    )


def copied_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose place is the language, so that copies of a text meet in one place."""
    return reviews(spark, sf_dir).withColumn("place_id", F.col("area"))


def contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews in which frequent words of the invented text become contractions, quotes and numbers."""
    text = F.col("review_text")
    for pattern, replacement in CONTRACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return reviews(spark, sf_dir).repartition("review_id").withColumn("review_text", text)


# The test tables hold all documents in one row group, which one task would clean alone; the adapters deal them out, always.
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.clean_reviews(reviews(spark, sf_dir).repartition("review_id"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.measure_reviews(reviews(spark, sf_dir).repartition("review_id"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.preprocess_reviews(reviews(spark, sf_dir).repartition("review_id"), STOP_WORDS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.token_sentiment(prepared(spark, sf_dir), VALENCES)


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aspects.tag_aspects(scored(spark, sf_dir), ASPECTS)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a label from a table; reviews without one have a NULL sentiment."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), "quality", "toxic")
    joined = reviews(spark, sf_dir).drop("review_text").join(marks, "review_id", "left")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(
        F.col("toxic").isNotNull(), "neutral"
    )
    score = F.when(label == "neutral", 0.0).when(label.isNotNull(), 0.5)
    return sentiment.label_sentiment(joined, label, score)


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested place records from conversations; assistant and system turns use the second dialect."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "part", F.floor(F.col("turn") / TURNS_PER_RECORD)
    )
    user = F.col("role") == "user"
    rating = (1 + F.col("turn") % 5).cast("string")
    first = {"Description": F.col("text"), "Rating": rating, "Name": F.col("role")}
    second = {
        "text": F.col("text"), "stars": rating, "name": F.col("role"),
        "published_at": F.concat(F.lit("turn "), F.col("turn").cast("string")),
    }

    def as_map(fields: dict[str, Column]) -> Column:
        return F.create_map(*[part for name, value in fields.items() for part in (F.lit(name), value)])

    review = F.when(user, as_map(first)).otherwise(as_map(second))
    # At most TURNS_PER_RECORD turns per group; a map cannot be compared, so only the turn is.
    listed = F.collect_list(F.struct("turn", user.alias("is_user"), review.alias("review")))
    ordered = F.array_sort(listed, lambda x, y: F.signum(x["turn"] - y["turn"]).cast("int"))
    grouped = turns.groupBy("conv_id", "part").agg(ordered.alias("turns"))

    def of(is_user: bool):
        kept = F.filter("turns", lambda t: t["is_user"] == F.lit(is_user))
        return F.transform(kept, lambda t: t["review"])

    return grouped.select(
        (F.col("conv_id") * 1_000_000 + F.col("part")).cast("long").alias("place_seq"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("title"),
        F.col("conv_id").cast("string").alias("place_id"),
        F.lit(None).cast("string").alias("data_id"),
        F.lit("talk").alias("category"), F.lit("nowhere").alias("address"),
        F.lit(4.0).alias("review_rating"), F.lit(None).cast("long").alias("review_count"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        of(True).alias("user_reviews"), of(False).alias("user_reviews_extended"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place coordinates from suppliers; titles repeat and some match no review."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("place_seq"),
        F.concat(F.lit("src"), (key % 25).cast("string")).alias("title"),
        F.when(key % 10 != 0, 2.9 + 0.01 * F.col("s_nationkey")).alias("latitude"),
        (101.6 + 0.01 * F.col("s_nationkey")).alias("longitude"),
        key.cast("string").alias("place_id"),
        F.concat(F.lit("category "), (key % 4).cast("string")).alias("category"),
        F.concat(F.lit("street "), key.cast("string")).alias("address"),
        (1 + key % 5).cast("double").alias("review_rating"),
        (key % 60).alias("review_count"),
    )


def listed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("clinic in area "), F.col("c_custkey").cast("string")).alias("query")
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection outcomes from orders: finished, failed with attempts, or still pending."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(
        F.col("o_orderstatus") == "P", "failed"
    ).otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("clinic in area "), F.col("o_custkey").cast("string")).alias("query"),
        status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
        F.col("o_orderkey").alias("position"),
    )


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt for each order, in order of its key; every 997th is a reset of the first eighth of the keys."""
    key = F.col("o_orderkey")
    outcome = F.when(key % 997 == 0, "reset").when(F.col("o_orderstatus") == "F", "completed").when(
        key % 3 == 0, "empty").otherwise("error")
    orders = table(spark, sf_dir, "orders")
    early = orders.agg(F.max("o_orderkey")).scalar() / 8
    return orders.filter((outcome != "reset") | (key < early)).select(
        key.alias("seq"), F.concat(F.lit("clinic in area "), F.col("o_custkey").cast("string")).alias("query"),
        outcome.alias("outcome"), (key % 50).cast("int").alias("batch"), (key % 7).cast("long").alias("places"),
        (key % 1000).cast("long").alias("reviews"), F.when(outcome == "error", F.concat(F.lit("error "), key % 5)).alias("error"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Area "), F.col("c_custkey").cast("string")).alias("area")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = 2.9 + 0.01 * F.col("s_nationkey"), 101.6 + 0.01 * F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("clinic").alias("keyword"), lat.alias("min_lat"), lon.alias("min_lon"),
        (lat + 0.05).alias("max_lat"), (lon + 0.07).alias("max_lon"),
    )
