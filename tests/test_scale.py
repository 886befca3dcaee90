from collections import Counter

from opinara.operators import keywords, vectors
from opinara.plans import analysis
from opinara.plans.analysis import AnalysisPlan
from opinara.streaming import history


def test_grams_are_counted_before_spark_sees_them(spark):
    texts = [("p", ["aa", "bb"] * 500), ("q", ["aa", None, "bb", "aa"]), (None, ["bb", "aa"]), ("p", []), ("q", None), ("p", ["aa", "bb"])]
    table = spark.createDataFrame(texts, "place_name string, words array<string>").coalesce(1)
    assert keywords.gram_counts(table, [1, 2]).count() == 4  # aa, bb and their two pairs, not 2,000 occurrences
    df, total = Counter(), Counter()
    for place, words in texts:
        words = words or []
        grams = Counter((place, w) for w in words if w) + Counter(
            (place, " ".join(p)) for p in zip(words, words[1:], words[2:]) if None not in p)
        total.update(grams)
        df.update(grams.keys())
    found = keywords.document_frequencies(table, [1, 3], ["place_name"]).collect()
    assert {(r.place_name, r.term): (r.df, r.total) for r in found if r.term} == {t: (df[t], total[t]) for t in total}
    assert {r.place_name: r.df for r in found if r.term is None} == {"p": 3, "q": 2, None: 1}


def test_neighbours_are_summed_before_spark_sees_them(spark):
    table = spark.createDataFrame([(["aa", "bb", "cc"] * 400,), (["aa"],), ([],)], "words array<string>").coalesce(1)
    sums = {r.word: r.sums for r in vectors.neighbour_sums(table, 8, 1).collect()}
    assert {word: values[-1] for word, values in sums.items()} == {"aa": 799, "bb": 800, "cc": 799}


def test_a_large_place_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FILE_ROWS", 100)
    reviews = spark.range(1000).selectExpr("id review_id", "'p' place_id", "concat('text ', id) review_text").repartition(3)
    sink = str(tmp_path / "history")
    history.merge_batch(reviews, sink, ["review_id"])
    assert len(list((tmp_path / "history").rglob("part-*.parquet"))) >= 5
    assert history.compact(spark, sink, force=True)
    newest = history.current(spark, sink).path.removeprefix("file:")
    from pathlib import Path

    assert len(list(Path(newest).rglob("part-*.parquet"))) >= 5
    assert sorted(r.review_id for r in history.read_history(spark, sink).collect()) == list(range(1000))


def test_terms_do_not_meet_by_sentiment(spark):
    rows = [(n, "aa bb cc", "positive" if n % 2 else "negative") for n in range(6)]
    df = spark.createDataFrame(rows, "review_id long, clean_text string, sentiment string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keywords.keyword_sentiment(df, [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_the_analysis_takes_words_once(spark, monkeypatch):
    taken = []
    original = keywords.review_words
    for module in (keywords, analysis.topics):
        monkeypatch.setattr(module, "review_words", lambda *a, **b: taken.append(1) or original(*a, **b))
    rows = [(n, f"p{n % 2}", "fresh staff and cheap food", float(1 + n % 5)) for n in range(12)]
    reviews = spark.createDataFrame(rows, "review_id long, place_name string, review_text string, review_rating double")
    tables = AnalysisPlan(stop_words=[], n_topics=2).run(reviews)
    assert len(taken) == 1 and "keyword_comparison" in tables
