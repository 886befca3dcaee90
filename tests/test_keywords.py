import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from opinara.catalog import adapters
from opinara.operators import keyphrases, keywords, topics

SF_DIR = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "review_id long, place_name string, clean_text string")


def brute_tfidf(texts, top_n, max_features=2000, min_df=2, max_df=0.85):
    """The vectoriser's definition on plain lists of words."""
    grams = [t + [" ".join(p) for p in zip(t, t[1:])] for t in texts]
    counts = [Counter(g) for g in grams]
    df, total = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        total.update(c)
    kept = [t for t in df if min_df <= df[t] <= max_df * len(texts)]
    vocabulary = set(sorted(kept, key=lambda t: (-total[t], t))[:max_features])
    scores = defaultdict(float)
    for c in counts:
        weights = {t: c[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in c if t in vocabulary}
        length = math.sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            scores[t] += w / length
    rounded = {t: round(s, 6) for t, s in scores.items()}
    return sorted(rounded.items(), key=lambda x: (-x[1], x[0]))[:top_n]


def test_tfidf_against_brute_force_with_a_hot_place(spark):
    words = adapters.cleaned(spark, SF_DIR).withColumn(
        "place_name", F.when(F.col("review_id") % 3 == 0, "hot").otherwise(F.col("place_name"))
    ).persist()
    rows = keywords.review_words(words, adapters.STOP_WORDS, ["place_name"]).collect()
    per_place = defaultdict(list)
    for r in rows:
        per_place[r.place_name].append(r.words)
    got = defaultdict(list)
    for r in keywords.place_keywords(words, adapters.STOP_WORDS).orderBy("place_name", "rank").collect():
        got[r.place_name].append((r.keyword, r.score))
    for place, texts in per_place.items():
        expected = brute_tfidf(texts, 15) if len(texts) >= 3 else []
        assert [k for k, _ in got[place]] == [k for k, _ in expected]
        assert np.allclose([s for _, s in got[place]], [s for _, s in expected], atol=2e-6)
    cut = keywords.tfidf_keywords(words, adapters.STOP_WORDS, top_n=10, max_features=50).orderBy("rank").collect()
    assert [r.keyword for r in cut] == [k for k, _ in brute_tfidf([r.words for r in rows], 10, max_features=50)]
    words.unpersist()


def test_tfidf_by_hand(spark):
    df = frame(spark, [(1, "p", "aa bb"), (2, "p", "aa bb"), (3, "p", "cc dd")])
    got = {r.keyword: r.score for r in keywords.tfidf_keywords(df, []).collect()}
    third = round(2 / math.sqrt(3), 6)
    assert got == {"aa": third, "bb": third, "aa bb": third}
    # With two reviews no term can be in at least two and at most 85 % of them.
    assert keywords.tfidf_keywords(frame(spark, [(1, "p", "aa"), (2, "p", "aa")]), []).count() == 0


def test_places_with_few_reviews_have_no_keywords(spark):
    rows = [(1, "two", "aa bb"), (2, "two", "aa bb")] + [(n, "three", t) for n, t in ((3, "aa"), (4, "aa"), (5, "bb"))]
    assert {r.place_name for r in keywords.place_keywords(frame(spark, rows), []).collect()} == {"three"}


def test_document_frequencies(spark):
    table = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, [])], "review_id long, words array<string>")
    rows = {r.term: (r.df, r.total) for r in keywords.document_frequencies(table, [1]).collect()}
    assert rows == {None: (3, 3), "a": (2, 3), "b": (1, 1)}  # the reviews are counted under NULL


def test_phrases_bridge_stop_words(spark):
    df = frame(spark, [(1, "p", "good and fast food"), (2, "p", "good fast food"), (3, "p", "other")])
    assert [(r.phrase, r.occurrences) for r in keywords.phrase_frequencies(df, ["and"]).collect()] == [("good fast food", 2)]


def test_keyword_sentiment_by_hand(spark):
    df = frame(spark, [(1, "p", "aa aa bb"), (2, "p", "bb")]).withColumn(
        "sentiment", F.when(F.col("review_id") == 1, "positive").otherwise("negative")
    )
    rows = {r.keyword: (r.positive_score, r.negative_score, r.sentiment_bias) for r in keywords.keyword_sentiment(df, []).collect()}
    length = math.sqrt(4 + 1 + 1 + 1)
    assert rows["aa"] == (round(2 / length, 3), 0.0, round(2 / length, 3))
    assert rows["bb"] == (round(1 / length, 3), 1.0, round(1 / length - 1, 3))


def test_topics_have_the_right_shape(spark):
    model = topics.fit_topics(adapters.cleaned(spark, SF_DIR), adapters.STOP_WORDS, n_topics=3, iterations=5)
    words = model.topic_words().collect()
    assert {r.topic for r in words} == {"topic_1", "topic_2", "topic_3"} and len(words) == 30
    rows = model.topic_distribution().collect()
    assert len(rows) == model.vectors.count()
    assert all(abs(sum(r.distribution) - 1) < 1e-6 for r in rows)
    assert sum(r.reviews for r in model.topic_counts().collect()) == len(rows)
    assert topics.fit_topics(frame(spark, [(n, "p", "aa") for n in range(9)]), []) is None


def test_mmr_against_brute_force(spark):
    generator = np.random.default_rng(3)
    vectors = {f"p{n:02d}": generator.normal(size=4) for n in range(12)}
    about = generator.normal(size=4)
    unit = {p: v / np.linalg.norm(v) for p, v in vectors.items()}
    relevance = {p: float(v @ about / np.linalg.norm(about)) for p, v in unit.items()}
    chosen = [max(relevance, key=relevance.get)]
    while len(chosen) < 4:
        chosen.append(max(
            (p for p in unit if p not in chosen),
            key=lambda p: 0.7 * relevance[p] - 0.3 * max(unit[p] @ unit[c] for c in chosen),
        ))
    candidates = spark.createDataFrame([(1, p) for p in vectors] + [(2, "p00")], "review_id long, phrase string")
    phrase_vectors = spark.createDataFrame([(p, v.tolist()) for p, v in vectors.items()], "phrase string, vector array<double>")
    reviews = spark.createDataFrame([(1, about.tolist()), (2, about.tolist())], "review_id long, vector array<double>")
    rows = keyphrases.mmr_keyphrases(candidates, phrase_vectors, reviews, top_n=4).collect()
    first = [r.phrase for r in sorted((r for r in rows if r.review_id == 1), key=lambda r: r["rank"])]
    assert first == sorted(chosen, key=lambda p: -relevance[p])
    assert [r.phrase for r in rows if r.review_id == 2] == ["p00"]
    totals = keyphrases.summed_keyphrases(spark.createDataFrame(rows), [], 2).collect()
    assert len(totals) == 2
