import random

from pyspark.sql import functions as F

from opinara.functions.lookup import dictionary
from opinara.operators import sentiment

VALENCES = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "bad": -2.5}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id long, clean_text string")


def test_published_examples(spark):
    # Scores the published tool gives for these sentences with the same valences.
    cases = {
        "VADER is smart, handsome, and funny.": 0.8316,
        "VADER is smart, handsome, and funny!": 0.8439,
        "VADER is very smart, handsome, and funny.": 0.8545,
        "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
        "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
        "The book was good.": 0.4404,
        "At least it isn't a bad book.": 0.431,
        "The book was not good.": -0.3412,
        "It was good but the service was bad.": -0.5859,
        "Nothing to say": 0.0,
        "": 0.0,
    }
    rows = sentiment.lexicon_sentiment(frame(spark, list(cases)), VALENCES).orderBy("review_id").collect()
    signed = [-r.sentiment_score if r.sentiment == "negative" else r.sentiment_score for r in rows]
    assert signed == list(cases.values())
    assert {r.sentiment: r.sentiment_label_num for r in rows} == {"positive": 1, "negative": -1, "neutral": 0}


def test_dictionary_of_many_words(spark):
    words = {f"word{n}": float(n) for n in range(3000)}
    df = spark.range(3100).select(F.concat(F.lit("word"), F.col("id")).alias("w"), "id")
    rows = df.select("id", dictionary(words)(F.col("w")).alias("v")).collect()
    assert all(r.v == (float(r.id) if r.id < 3000 else None) for r in rows)


def test_model_hook_sees_whole_texts(spark):
    def load():
        return lambda texts: [("positive" if t.endswith("end") else "other", float(len(texts))) for t in texts]

    df = frame(spark, ["x" * 30000 + "end"] + ["short"] * 20).coalesce(1)
    rows = sentiment.model_sentiment(df, load, batch_size=16).orderBy("review_id").collect()
    assert rows[0].sentiment == "positive" and rows[1].sentiment_label_num == 0
    assert {r.sentiment_score for r in rows} == {16.0, 5.0}


def test_dispatch(spark):
    import pytest

    with pytest.raises(ValueError):
        sentiment.run_sentiment(frame(spark, ["a"]), "unknown")
    assert sentiment.run_sentiment(frame(spark, ["good"]), "lexicon", valences=VALENCES).first().sentiment == "positive"


PHRASES = ["cut the mustard", "cut the", "the mustard", "kiss of death", "of death to", "a+b (c)", ":) :)", "not bad"]


def longest_matches(words, phrases):
    """Leftmost phrases, the longest of those that begin at one word."""
    split = {tuple(p.split()) for p in phrases}
    out, i = [], 0
    while i < len(words):
        n = max((len(p) for p in split if tuple(w.lower() for w in words[i:i + len(p)]) == p), default=1)
        out.append(" ".join(words[i:i + n]))
        i += n
    return out


def test_phrases_by_brute_force(spark):
    rng = random.Random(2)
    stock = "cut the mustard Cut THE kiss of death to a+b (c) :) not bad good x".split()
    rows = [(i, [rng.choice(stock) for _ in range(rng.randint(0, 25))]) for i in range(400)]
    rows += [(400, ["x"] * 20_000 + ["kiss", "of", "death"] * 3)]
    df = spark.createDataFrame(rows, "review_id long, words array<string>")
    got = {r.review_id: r.words for r in sentiment.with_phrases(df, "words", PHRASES).collect()}
    assert got == {i: longest_matches(w, PHRASES) for i, w in rows}
    assert sentiment.with_phrases(df, "words", ["single"]) is df


def test_a_phrase_scores_like_one_word(spark):
    valences = VALENCES | {"die": -2.9, "to die for": 3.0, "kiss  of death": -1.5, "one": 3.0, "other": -1.5, ":)": 2.0}
    boosters, negators = {"very": 0.293, "kind of": -0.293, "kindof": -0.293}, ["not", "no longer", "nolonger"]
    rng = random.Random(4)
    stock = ["to die for", "kiss of death", "kind of", "no longer", "very", "not", "good", "but", "food", "NEVER", "so", "To Die For", ":)", "die"]
    alias = {"to die for": "one", "To Die For": "One", "kiss of death": "other", "kind of": "kindof", "no longer": "nolonger"}
    parts = [[rng.choice(stock) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    both = [" ".join(p) for p in parts] + [" ".join(alias.get(w, w) for w in p) for p in parts]
    rows = sentiment.lexicon_sentiment(frame(spark, both), valences, boosters=boosters, negators=negators).orderBy("review_id").collect()
    scores = [(r.sentiment, r.sentiment_score) for r in rows]
    assert scores[:300] == scores[300:] and len(set(scores)) > 50
    signed = sentiment.lexicon_sentiment(frame(spark, ["The cake is to die for", "to die for", "die"]), valences).orderBy("review_id").collect()
    assert [r.sentiment for r in signed] == ["positive", "positive", "negative"]


def test_a_full_size_lexicon(spark):
    valences = {f"word{n}": (n % 9 - 4) / 2 for n in range(7500)} | {f"word{n} word{n + 1}": 3.0 for n in range(0, 500, 5)}
    rows = sentiment.lexicon_sentiment(frame(spark, ["word8 word9", "word5 word6", "x word7498"]), valences).orderBy("review_id").collect()
    # 2.0 and -2.0 are no phrase; the second is one.
    assert [r.sentiment for r in rows] == ["neutral", "positive", "negative"]


def test_a_word_is_looked_up_once_however_often_it_occurs(spark):
    import pyarrow as pa

    from opinara.functions.valence import Valences

    class Counted(Valences):
        looked_up = 0

        def code(self, word):
            self.looked_up += 1
            return super().code(word)

    rules = Counted(VALENCES, {"very": 0.293}, ["not"])
    texts = pa.array(["not very good", None, "", "GOOD but bad! x"] * 5_000)
    (totals,) = rules.of_texts(iter([texts]))
    assert rules.looked_up == 8 and totals.null_count == 5_000 and totals[2].as_py() == 0.0
    # Rows go through it: no array of structs for each word of a text is made any more.
    rated = sentiment.lexicon_sentiment(frame(spark, ["not very good", None, "bad?? good!!"]), VALENCES)
    plan = rated._jdf.queryExecution().optimizedPlan().toString()
    assert "zip" not in plan and [r.sentiment_score is None for r in rated.orderBy("review_id").collect()] == [False, True, False]
