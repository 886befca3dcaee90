from opinara.catalog import adapters
from opinara.plans import export
from opinara.plans.analysis import AnalysisPlan

SF_DIR = "/root/testdata/sf0.001"


def test_whole_analysis_and_csv_export(spark, tmp_path):
    plan = AnalysisPlan(
        stop_words=adapters.STOP_WORDS, aspects=adapters.ASPECTS, sentiment_method="tokens",
        sentiment_options={"valences": adapters.VALENCES}, n_topics=2,
    )
    reviews = adapters.reviews(spark, SF_DIR)
    tables = plan.run(reviews, str(tmp_path / "out"))
    total = tables["stats"].first().total_reviews
    assert total == tables["analysed"].count()
    assert sum(r.reviews for r in tables["topic_counts"].collect()) == total
    for row in tables["sentiment_summary"].collect():
        assert abs(row.positive_pct + row.neutral_pct + row.negative_pct - 100) < 0.02
    assert {p.name for p in (tmp_path / "out" / "results").iterdir()} == set(tables) - {"analysed"}
    export.export_csv(reviews, tables, str(tmp_path / "csv"))
    assert {p.name for p in (tmp_path / "csv").iterdir()} == {
        "all_reviews.csv", "places_summary.csv", "sentiment_by_place.csv", "recommendations.csv",
        "aspect_summary.csv", "comparison_ranking.csv"}


def test_one_place_skips_the_comparison(spark):
    reviews = adapters.reviews(spark, SF_DIR).filter("place_name = 'src1'")
    tables = AnalysisPlan().run(reviews)
    assert "comparison_ranking" not in tables and "strengths" in tables
