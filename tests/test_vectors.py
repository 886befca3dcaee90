import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from opinara.operators import keyphrases, scorer, sentiment, vectors


def _expected(texts, dims, window):
    def marks(word):
        digest = hashlib.md5(word.encode()).hexdigest()
        for k in range(4):
            number = int(digest[8 * k:8 * k + 8], 16)
            yield (number // 2) % dims, 1 - 2 * (number % 2)

    near = Counter()
    for words in texts:
        for i, word in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if j != i:
                    near[word, words[j]] += 1
    sums, own, total = {}, Counter(), [0] * dims
    for (word, other), n in near.items():
        cells = sums.setdefault(word, [0] * dims)
        own[word] += n
        for dim, sign in marks(other):
            cells[dim] += n * sign
            total[dim] += n * sign
    out = {}
    for word, cells in sums.items():
        beyond = [cells[d] - own[word] * total[d] / sum(own.values()) for d in range(dims)]
        top = max(map(abs, beyond))
        out[word] = [math.floor(x * 127 / top + 0.5) if top > 0 else 0 for x in beyond]
    return out


def test_word_vectors_against_brute_force(spark):
    chance = random.Random(5)
    texts = [[chance.choice(["aa", "bb", "cc", "dd", "été", "語語"]) for _ in range(chance.randrange(9))] for _ in range(40)]
    table = spark.createDataFrame(list(enumerate([*texts, [], ["zz"]])), "review_id long, words array<string>")
    for dims, window in ((8, 1), (16, 3)):
        found = {r.word: list(r.vector) for r in vectors.word_vectors(table, dims=dims, window=window).collect()}
        assert found == _expected(texts, dims, window)
    # Nothing to learn from: no vector, no error.
    assert vectors.word_vectors(table.filter("size(words) < 2 and review_id >= 40")).collect() == []


def test_keyphrases_from_their_own_text(spark):
    rows = [(1, "red apple pie and red apple juice"), (2, "apple"), (3, ""), (4, "lonely"), (5, "red apple pie and red apple juice"),
            (6, "green pear juice and green pear pie")]
    df = spark.createDataFrame(rows, "review_id long, clean_text string")
    found = keyphrases.review_keyphrases(df, ["and"], top_n=3).collect()
    by_review = {n: [(r["rank"], r["phrase"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["review_id"] == n]
                 for n in range(1, 7)}
    assert [len(by_review[n]) for n in range(1, 7)] == [3, 1, 0, 1, 3, 3]
    assert by_review[1] == by_review[5]  # equal texts
    assert by_review[2] == [(1, "apple", 1.0)]
    assert by_review[4] == [(1, "lonely", 0.0)]  # never beside another word, so without a vector
    scores = [s for _, _, s in by_review[1]]
    assert scores == sorted(scores, reverse=True) and all(-1 <= s <= 1 for s in scores)
    assert keyphrases.review_keyphrases(df.filter("review_id > 9"), []).collect() == []


def test_words_used_alike_have_like_vectors(spark):
    chance = random.Random(1)
    texts = []
    for _ in range(400):
        fruit, tool = chance.choice(["apple", "pear"]), chance.choice(["hammer", "drill"])
        texts.append(["sweet", fruit, "juicy"])
        texts.append(["steel", tool, "sharp"])
    found = {r.word: np.array(list(r.vector), float) for r in vectors.word_vectors(
        spark.createDataFrame(list(enumerate(texts)), "review_id long, words array<string>")).collect()}

    def cosine(a, b):
        return found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])

    assert cosine("apple", "pear") > 0.9 and cosine("hammer", "drill") > 0.9 and cosine("apple", "drill") < 0


def test_fitted_scorer(spark):
    rows = [(n, text, label) for n, (text, label) in enumerate(
        [("Lovely food", "positive"), ("lovely place", "positive"), ("awful food", "negative"), ("awful wait", "negative"),
         ("a table", "neutral"), ("unlabelled awful", None), ("other", "mixed"), (None, "neutral")])]
    df = spark.createDataFrame(rows, "review_id long, clean_text string, label string")
    fitted = scorer.fit_scorer(df, "label")
    judged = dict(zip(["LOVELY", "awful awful", "", None], fitted(["LOVELY", "awful awful", "", None])))
    assert judged["LOVELY"][0] == "positive" and judged["awful awful"][0] == "negative"
    # No word: the prior alone, and the first of equal labels.
    assert judged[""] == judged[None] == ("negative", round(1 / 3, 4))
    assert fitted([]) == []
    empty = scorer.fit_scorer(df.filter("false"), "label")
    assert empty(["anything"]) == [("negative", round(1 / 3, 4))]
    rated = sentiment.model_sentiment(df.fillna(""), lambda: fitted).select("review_id", "sentiment", "sentiment_label_num").collect()
    assert {r.review_id: r.sentiment_label_num for r in rated}[0] == 1 and len(rated) == len(rows)


def test_fitted_scorer_on_held_out_labels(spark):
    from opinara.catalog import adapters, queries

    sf_dir = "/root/testdata/sf0.01"
    truth = adapters.labelled(spark, sf_dir).select("review_id", F.col("sentiment").alias("truth")).filter(
        "truth IS NOT NULL AND review_id % 5 = 0")
    rows = queries.REGISTRY["model_sentiment"](spark, sf_dir).join(truth, "review_id").collect()
    right = sum(r.sentiment == r.truth for r in rows) / len(rows)
    commonest = max(Counter(r.truth for r in rows).values()) / len(rows)
    assert right > commonest
