import random
import statistics

from pyspark.sql import functions as F

from opinara.operators import ranking


def hot_rows(n=3000):
    """A third of the rows in one group."""
    generator = random.Random(1)
    return [(i, "hot" if i % 3 == 0 else f"g{i % 7}", generator.randrange(50), f"t{generator.randrange(400)}") for i in range(n)]


def test_running_total_over_several_ranges(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, g string, v long, t string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranking.running_total(df, -F.col("v"), [F.desc("v"), F.col("id")], F.col("v"), "upto", total="all").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total, expected = 0, {}
    for i, _, v, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        total += v
        expected[i] = total
    assert {r.id: r.upto for r in out} == expected
    assert {r.all for r in out} == {total}


def test_global_rank_has_no_gaps(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("score"))
    ranks = ranking.global_rank(df, -F.col("score"), [F.desc("score"), F.col("id")]).collect()
    assert sorted(r.rank for r in ranks) == list(range(1, 1001))
    assert min(ranks, key=lambda r: r["rank"]).id == 2


def test_top_per_group_is_exact_for_large_n(spark):
    rows = hot_rows(6000)
    df = spark.createDataFrame(rows, "id long, g string, v long, t string")
    for n, spread in ((5, ()), (5, ("id",)), (1200, ()), (1200, ("id",))):
        got = ranking.top_per_group(df, ["g"], [F.desc("v"), F.col("id")], n, spread_by=spread).collect()
        expected = {}
        for g in {r[1] for r in rows}:
            best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:n]
            expected.update({r[0]: k for k, r in enumerate(best, 1)})
        assert {r.id: r["rank"] for r in got} == expected


def test_keep_first_drops_copies_before_the_shuffle(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", "x"), (4, "b", "x"), (5, "a", "x")], "id long, p string, t string")
    kept = ranking.keep_first(df, ["p", "t"], ["id"])
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_exact_median(spark):
    for values in ([1.0, 5.0, 2.0], [1.0, 5.0, 2.0, 2.0], [7.0], [1.0] * 5 + [9.0] * 5):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert ranking.exact_median(df, "x").first().x == statistics.median(values)


def test_ranks_start_no_job_when_built(spark):
    from opinara.operators import compare, growth, summaries

    scores = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2)], "place_name string, sentiment_health_score double, total_reviews long")
    scores = scores.withColumns({c: F.lit(1.0) for c in ("positive_pct", "negative_pct", "avg_review_rating")})
    reviews = spark.createDataFrame([("p", "x", 1), ("p", "x", 2)], "place_id string, review_text string, batch int")
    places = spark.createDataFrame([(1.0, 2.0)], "latitude double, longitude double")
    context = spark.sparkContext
    context.setJobGroup("build", "build")
    built = [compare.comparison_ranking(scores), growth.batch_yield(reviews), summaries.map_centre(places)]
    assert list(context.statusTracker().getJobIdsForGroup("build")) == []
    context.setJobGroup("run", "run")
    assert [b.count() for b in built] == [2, 2, 1]
    # Every task of the last window holds a cell, not the table.
    df = spark.range(50_000).select("id", F.lit(1).alias("n")).repartition(4)
    ranked = ranking.global_rank(df, F.col("id"), [F.col("id")])
    assert ranked.filter(F.col("rank") != F.col("id") + 1).count() == 0
    assert "SinglePartition" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_rank_of_few_and_null_keys(spark):
    df = spark.createDataFrame([(None, "c"), (2.0, "a"), (2.0, "b"), (None, "a")], "score double, name string")
    falling = F.coalesce(-F.col("score"), F.lit(float("inf")))
    ranks = ranking.global_rank(df, falling, [F.desc("score"), F.col("name")]).collect()
    assert {(r.score, r.name): r["rank"] for r in ranks} == {(2.0, "a"): 1, (2.0, "b"): 2, (None, "a"): 3, (None, "c"): 4}
    same = ranking.global_rank(df, falling, [F.desc("score"), F.col("name")], bounded=True).collect()
    assert sorted(map(str, same)) == sorted(map(str, ranks))
    far = spark.range(-2000, 2000).select((F.col("id") * 0.5).alias("x"))
    beyond = ranking.global_rank(far, F.col("x"), [F.col("x")], bounded=True)
    assert beyond.filter(F.col("rank") != F.col("x") * 2 + 2001).count() == 0
    assert ranking.global_rank(df.limit(0), falling, [F.desc("score")]).count() == 0
