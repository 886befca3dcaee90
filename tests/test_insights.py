from pyspark.sql import functions as F

from opinara.operators import aspects, compare, cube, growth, insights, panels, summaries

LEXICON = {"service": ["staff", "rude"], "price": ["cheap"], "quality": ["fresh"]}
SCHEMA = ("review_id long, place_name string, clean_text string, tokens array<string>, sentiment string, "
          "sentiment_score double, sentiment_label_num int, review_rating double, review_text string, word_count int")


def frame(spark, rows):
    number = {"positive": 1, "negative": -1}
    full = [
        (n, place, " ".join(tokens), tokens, label, 0.5, number.get(label, 0), rating, "t", len(tokens))
        for n, (place, tokens, label, rating) in enumerate(rows)
    ]
    return aspects.tag_aspects(spark.createDataFrame(full, SCHEMA), LEXICON)


MIXED = [
    ("a", ["staff", "rude"], "negative", 1.0), ("a", ["staff"], "negative", 2.0), ("a", ["cheap"], "negative", 1.0),
    ("a", ["fresh"], "positive", 5.0), ("b", ["staff", "cheap"], "positive", 4.0), ("b", [], "neutral", 3.0),
    ("b", ["other"], None, None), (None, ["cheap"], "positive", 5.0),
]


def test_tags_and_phrases(spark):
    df = frame(spark, MIXED)
    assert [r.aspects for r in df.orderBy("review_id").collect()][:2] == [["service"], ["service"]]
    assert df.orderBy("review_id").collect()[4].aspects == ["service", "price"]
    phrase = aspects.tag_aspects(df.drop("aspects", "aspects_mentioned"), {"x": ["staff rude"]}, match_phrases=True)
    assert [r.review_id for r in phrase.filter("aspects_mentioned = 1").collect()] == [0]
    assert aspects.aspect_flags(df, LEXICON).filter("aspect_price").count() == 3


def test_grid_is_dense_and_drops_null_places(spark):
    rows = {(r.place_name, r.aspect): r for r in aspects.place_aspects(frame(spark, MIXED), LEXICON).collect()}
    assert len(rows) == 6
    assert rows["b", "quality"].mentions == 0 and rows["b", "quality"].positive_pct == 0.0
    assert rows["a", "service"].mentions == 2 and rows["a", "service"].negative_pct == 100.0
    assert rows["a", "service"].mention_rate == 50.0


def test_aspect_summary_with_an_unmentioned_aspect(spark):
    lexicon = {**LEXICON, "parking": ["parking"]}
    row = {r.aspect: r for r in aspects.aspect_summary(frame(spark, MIXED), lexicon).collect()}["parking"]
    assert (row.total_mentions, row.mention_rate, row.positive_pct, row.avg_rating) == (0, 0.0, 0.0, None)


def test_summary_keeps_unlabelled_rows_in_the_denominator(spark):
    rows = {r.place_name: r for r in summaries.sentiment_summary(frame(spark, MIXED)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["b"].total_reviews == 2 and rows["b"].positive_pct == 33.33 and rows["b"].avg_review_rating == 3.5
    assert rows["a"].negative_pct == 75.0


def test_minimum_of_negative_reviews(spark):
    for negatives, expected in ((0, 0), (2, 0), (3, 1)):
        df = frame(spark, [("a", ["staff"], "negative", 1.0)] * negatives + [("a", ["staff"], "positive", 5.0)])
        assert insights.complaint_totals(df).count() == expected
        assert insights.complaint_aspects(df, LEXICON).count() == expected
        assert insights.complaint_keywords(df).count() == expected


def test_recommendations_and_roadmap_order(spark):
    complaints = spark.createDataFrame(
        [("service", 2, 4.0, 1.0, 2.0), ("custom", 9, 15.0, 3.0, 2.0), ("price", 9, 25.0, 3.0, 2.0), ("quality", 8, 21.0, 3.0, 2.0)],
        "aspect string, complaint_count long, pct_of_negative_reviews double, pct_of_all_reviews double, avg_rating double",
    )
    recs = insights.recommendations(complaints)
    by_name = {r.category: r for r in recs.collect()}
    assert by_name["custom"].title == "Address issues related to: custom" and len(by_name["custom"].actions) == 3
    assert by_name["service"].severity == "low" and len(by_name["service"].actions) == 4
    roadmap = insights.improvement_roadmap(recs).collect()
    assert list(dict.fromkeys((r.priority, r.category) for r in roadmap)) == [
        (1, "price"), (2, "quality"), (3, "custom"), (4, "service")]
    assert len(roadmap) == 15 and roadmap[0].action_item.startswith("Benchmark prices")
    assert {r.severity for r in insights.filter_severity(insights.improvement_roadmap(recs)).collect()} == {"critical", "high"}


def nets(spark, rows):
    return spark.createDataFrame(rows, "place_name string, aspect string, mentions long, net_sentiment double")


def test_advantages(spark):
    table = nets(spark, [
        ("a", "service", 1, 100.0), ("b", "service", 9, 50.0),    # the best place has too few mentions
        ("a", "price", 5, 20.0), ("b", "price", 5, 20.0),         # no spread
        ("b", "quality", 5, 30.0), ("a", "quality", 5, 30.0), ("c", "quality", 5, 0.0),  # tie: first name
    ])
    assert [(r.place_name, r.aspect) for r in compare.competitive_advantages(table, LEXICON).collect()] == [("a", "quality")]
    single = nets(spark, [("a", "price", 5, 20.0), ("a", "service", 5, 20.0)])
    row = compare.advantages_by_place(compare.competitive_advantages(single, LEXICON)).first()
    assert row.advantages == ["service", "price"]
    best = {r.aspect: r for r in compare.aspect_best_worst(table).collect()}["quality"]
    assert (best.best_place, best.worst_place) == ("a", "c")


def test_ranking_breaks_ties_by_name(spark):
    df = frame(spark, [("b", [], "positive", 5.0), ("a", [], "positive", 5.0), ("c", [], "negative", 1.0)])
    ranks = compare.comparison_ranking(summaries.compare_sentiment(df)).collect()
    assert [(r.place_name, r["rank"]) for r in sorted(ranks, key=lambda r: r["rank"])] == [("a", 1), ("b", 2), ("c", 3)]
    board = panels.leaderboard(summaries.sentiment_summary(df)).orderBy("rank").collect()
    assert [r.medal for r in board] == ["gold", "silver", "bronze"]


def test_empty_input(spark):
    df = frame(spark, MIXED).limit(0)
    assert summaries.sentiment_summary(df).count() == 0
    assert summaries.review_stats(df).first().avg_rating is None
    assert aspects.aspect_summary(df, LEXICON).first().total_mentions == 0
    assert insights.insight_overview(df).first().positive_pct is None
    assert panels.top_bottom(summaries.sentiment_summary(df)).count() == 0


def test_filters(spark):
    df = frame(spark, MIXED).withColumn("place_category", F.lit("x"))
    assert panels.apply_filters(df).count() == 7
    assert panels.apply_filters(df, rating_min=4, sentiments=["positive"], places=["b"]).count() == 1
    assert panels.select_places(df, default=1).select("place_name").distinct().first().place_name == "a"
    assert panels.select_places(df, ["b"]).count() == 3
    assert panels.filter_options(df).count() == 3 + 1 + 2


def test_first_category_skips_nulls(spark):
    rows = [(1, "a", None, "x"), (2, "a", "cafe", None), (3, "a", "bar", "y")]
    df = spark.createDataFrame(rows, "review_id long, place_name string, place_category string, place_address string")
    df = df.withColumn("review_text", F.lit("t")).withColumn("review_rating", F.col("review_id").cast("double"))
    row = summaries.places_summary(df).first()
    assert (row.total_reviews, row.avg_rating, row.category, row.address) == (3, 2.0, "cafe", "x")


def test_capture_rate_without_claims(spark):
    places = spark.createDataFrame([("a", 4), ("b", 0), ("c", 10)], "title string, review_count long")
    reviews = spark.createDataFrame([("a",), ("a",), ("b",)], "place_name string")
    row = growth.capture_rate(places, reviews).first()
    assert (row.places, row.avg_capture_pct) == (2, 25.0)
    assert {r.place_name: r.coverage for r in growth.thin_places(places, reviews).collect()} == {"a": "few", "b": "few", "c": "none"}


def test_default_areas_and_centres(spark):
    from opinara import lexicons
    from opinara.operators import collection

    niches = sum(len(set(words)) for words in lexicons.NICHES.values())
    queries = collection.expansion_queries(collection.default_areas(spark))
    assert queries.count() <= niches * len(lexicons.AREAS) and queries.filter("query LIKE '% in Cyberjaya'").count() > 0
    covered = collection.max_coverage_queries(
        collection.default_areas(spark), lexicons.CLINIC_KEYWORDS, collection.default_centres(spark), "clinic")
    assert covered.filter("query LIKE 'clinic @%,14z'").count() == len(lexicons.GEO_CENTRES)


def test_trend_fills_empty_months(spark):
    from datetime import date, datetime

    rows = [("a", datetime(2024, 11, 3), "positive", 0.5), ("a", datetime(2025, 2, 1), "negative", -0.5), ("a", datetime(2025, 3, 31), "positive", 0.5),
            ("a", datetime(2025, 3, 1), "negative", 0.1), ("a", datetime(2025, 5, 1), None, None), ("b", datetime(2025, 1, 31), "positive", 1.0),
            ("b", None, "positive", 1.0), (None, datetime(2025, 1, 1), "positive", 1.0)]
    df = spark.createDataFrame(rows, "place_name string, review_ts timestamp, sentiment string, sentiment_score double")
    got = {(r.place_name, r.month): (r.reviews, r.positive_pct, r.positive_change) for r in growth.sentiment_trend(df).collect()}
    assert got == {
        ("a", date(2024, 11, 1)): (1, 100.0, None), ("a", date(2024, 12, 1)): (0, None, None), ("a", date(2025, 1, 1)): (0, None, None),
        # The month before has no reviews, so there is no change, however it was in November.
        ("a", date(2025, 2, 1)): (1, 0.0, None), ("a", date(2025, 3, 1)): (2, 50.0, 50.0), ("a", date(2025, 4, 1)): (0, None, None),
        ("a", date(2025, 5, 1)): (0, 0.0, None), ("b", date(2025, 1, 1)): (1, 100.0, None),
    }
    assert growth.sentiment_trend(df.limit(0)).count() == 0


def test_too_few_reviews_for_topics(spark):
    from opinara.operators import topics

    df = spark.createDataFrame([(i, "nice food here") for i in range(4)], "review_id long, clean_text string")
    tables = topics.topic_tables(df, [])
    assert {name: table.count() for name, table in tables.items()} == {"words": 0, "distribution": 0, "counts": 0}
    assert topics.topic_vocabulary(df, []).count() == 0
    many = spark.createDataFrame([(i, f"nice food number{i % 4}") for i in range(12)], "review_id long, clean_text string")
    assert [r.term for r in topics.topic_vocabulary(many, []).orderBy("rank").collect()][:2] == ["food number0", "food number1"]


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_cube_gives_the_tables_of_the_reviews(spark, tmp_path):
    df = frame(spark, [*MIXED, (None, ["staff"], None, None), ("c", ["cheap"], "negative", None), ("b", ["rude"], "negative", 2.0)])
    folder = str(tmp_path / "cube")
    numbered = df.withColumn("batch", F.col("review_id") % 3)
    for part in ("batch < 2", "batch = 2", "batch = 1"):
        cube.store_cubes(cube.build_cube(numbered.filter(part), LEXICON, ["batch"]), folder)
    stored = cube.read_cube(spark, folder)
    assert rows_of(stored) == rows_of(cube.build_cube(df, LEXICON))
    for keys, polarity in (((), None), (("place_name",), "negative")):
        expected = aspects.aspect_grid(df, LEXICON, keys, polarity)
        assert rows_of(cube.cube_grid(stored, LEXICON, keys, polarity)) == rows_of(expected)
    for name in ("review_stats", "places_ranked", "sentiment_summary", "compare_sentiment"):
        assert rows_of(getattr(cube, name)(stored)) == rows_of(getattr(summaries, name)(df)), name
    for name in ("complaint_totals", "insight_overview"):
        assert rows_of(getattr(cube, name)(stored)) == rows_of(getattr(insights, name)(df)), name


def test_cube_of_nothing_and_of_bare_reviews(spark):
    df = frame(spark, MIXED).filter("false")
    empty = cube.build_cube(df, LEXICON)
    assert empty.count() == 0
    assert rows_of(cube.cube_grid(empty, LEXICON)) == rows_of(aspects.aspect_grid(df, LEXICON))
    assert rows_of(cube.review_stats(empty)) == rows_of(summaries.review_stats(df))
    bare = cube.build_cube(frame(spark, MIXED).drop("review_text", "word_count", "sentiment_label_num"), LEXICON)
    assert cube.review_stats(bare).first().avg_word_count is None
