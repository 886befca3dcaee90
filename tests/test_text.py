import random
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.functions import labels, text
from opinara.operators.preprocess import clean_reviews, preprocess_reviews


def reference_clean(value):
    """The rules restated in plain Python."""
    if value is None or not value.strip():
        return ""
    value = unicodedata.normalize("NFKD", value)
    value = re.sub(r"http\S+|www\S+", "", value)
    value = re.sub(r"\S+@\S+", "", value)
    kept = r"؀-ۿ฀-๿一-鿿぀-ゟ゠-ヿ가-힯"
    value = re.sub(rf"[^\w\s.,!?;:'\"\-()&%$#@{kept}]", "", value)
    return re.sub(r"\s+", " ", value).strip()


def cleaned(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "n long, t string")
    rows = text.with_clean_text(df, "t", "c").collect()
    return [r.c for r in sorted(rows, key=lambda r: r.n)]


def test_every_stable_code_point(spark):
    # Characters assigned in Unicode 3.2 have the same class in Java and Python.
    old = unicodedata.ucd_3_2_0
    chars = [
        chr(c) for c in range(0x20, 0x11000)
        if not 0xD800 <= c <= 0xDFFF and old.category(chr(c)) not in ("Cn", "Co")
        and old.category(chr(c))[0] == unicodedata.category(chr(c))[0]
    ]
    values = [f"ab {c} x{c}y {c}@k.c http{c} q" for c in chars]
    wrong = [(hex(ord(c)), w, g) for c, w, g in zip(chars, map(reference_clean, values), cleaned(spark, values)) if w != g]
    assert wrong == []


def test_literal_cases(spark):
    values = [
        None, "", "  \t\n", "abcd", "café ﬁ ２ 한국", "see http://x.y/z now", "a@b.c hi", "@user hi@",
        "@@b a@@ a@ @", "xwww.a b", "emoji \U0001f600 ok", "nb sp line", "สวัสดี",
        "مرحباً شَّ", "ガ が", "x" * 5000 + "@", "a*b_c|d",
    ]
    assert cleaned(spark, values) == [reference_clean(v) for v in values]


_alphabet = st.sampled_from("ab @.\t\n  é́wpht:/!*½＠한\x1c\x85")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(_alphabet, max_size=14), min_size=200, max_size=200))
def test_random_text(spark, values):
    assert cleaned(spark, values) == [reference_clean(v) for v in values]


def test_minimum_length(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcde"), (3, None), (4, " \n ")], "review_id long, review_text string")
    assert [r.review_id for r in clean_reviews(df).collect()] == [2]


def test_tokens(spark):
    df = spark.createDataFrame(
        [(1, "The 24 cafes, a b2b x 1a don't_stop ٥٦ THE"), (2, "of the and"), (3, "12345")],
        "review_id long, review_text string",
    )
    rows = {r.review_id: r for r in preprocess_reviews(df, ["the", "of", "and"]).collect()}
    assert rows[1].tokens == ["cafes", "b2b", "1a", "don", "t_stop"]
    assert rows[2].tokens == [] and rows[2].token_count == 0 and rows[2].word_count == 3
    assert rows[3].tokens == []


def test_ngrams_of_short_arrays(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "w array<string>")
    rows = df.select(*[text.ngrams(F.col("w"), n).alias(f"g{n}") for n in (1, 2, 3)]).collect()
    assert [r.g2 for r in rows] == [[], [], ["a b"], ["a b", "b c"]]
    assert [r.g3 for r in rows] == [[], [], [], ["a b c"]]
    assert [len(r.g1) for r in rows] == [0, 1, 2, 3]


def test_length_bucket_edges(spark):
    counts = [0, 1, 10, 11, 30, 31, 50, 51, 100, 101, 500, 501, 10000, 10001]
    df = spark.createDataFrame([(c,) for c in counts], "n int").select(
        labels.length_bucket(F.col("n")).alias("b"), labels.length_bucket_order(labels.length_bucket(F.col("n"))).alias("o")
    )
    rows = df.collect()
    assert [r.b for r in rows] == [
        None, "very_short", "very_short", "short", "short", "medium", "medium", "long", "long", "very_long",
        "very_long", "extremely_long", "extremely_long", None,
    ]
    assert [r.o for r in rows] == [None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, None]


def test_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in (-0.05, -0.049, 0.049, 0.05)], "c double")
    rows = df.select(labels.sentiment_of(F.col("c")).alias("s"), labels.score_of(F.col("c")).alias("v")).collect()
    assert [r.s for r in rows] == ["negative", "neutral", "neutral", "positive"]
    assert [r.v for r in rows] == [0.05, -0.049, 0.049, 0.05]
    pct = spark.createDataFrame([(v,) for v in (5.0, 5.1, 10.0, 10.1, 20.0, 20.1, None)], "p double")
    rows = pct.select(labels.severity(F.col("p")).alias("s"), labels.priority_severity(F.col("p")).alias("q")).collect()
    assert [r.s for r in rows] == ["low", "medium", "medium", "high", "high", "critical", None]
    assert [r.q for r in rows] == ["medium", "medium", "medium", "high", "high", "critical", None]


def treebank(sentence):
    """The same conventions, one rule after the other, on a string."""
    out = sentence.lower()
    for pattern, replacement in text.TREEBANK_RULES:
        out = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", replacement), out)
    return [half for word in out.split(" ") if word for half in text.TREEBANK_SPLITS.get(word, (word,))]


def test_treebank_examples_and_random_strings(spark):
    # What the published conventions give for these sentences.
    examples = {
        "they'll save and invest more.": "they 'll save and invest more .",
        "hi, my name can't hello,": "hi , my name ca n't hello ,",
        "good muffins cost $3.88 in new york. please buy me two of them. thanks.":
            "good muffins cost $ 3.88 in new york . please buy me two of them . thanks .",
        "\"we beat some pretty good teams to get here,\" he said.": "`` we beat some pretty good teams to get here , '' he said .",
        "i cannot cannot work; gonna (lemme) try -- it's john's!": "i can not can not work ; gon na ( lem me ) try -- it 's john 's !",
        "wait... what? no!!": "wait ... what ? no ! !", "well-known 10,000 at 5:30, e.g. here": "well-known 10,000 at 5:30 , e.g. here",
        "": "", "a": "a", "don't": "do n't", "'tis": "'t is",
    }
    rng = random.Random(6)
    stock = ["don't", "can't", "cannot", "it's", "x", "ab", "3.5", "1,000", "e.g.", "end.", "...", "--", '"', "''", "'", "(", ")", ",", ":", ";",
             "'s", "we've", "they'll", "gonna", "wanna", "café", "naïve.", "한국", "a:b", "o'", "$5", "50%", "?!", "n't", "»", "”", "é'd"]
    made = ["".join(rng.choice(stock) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 14))).strip() for _ in range(600)]
    made = [" ".join(m.split()) for m in made]
    df = spark.createDataFrame(list(enumerate([*examples, *made])), "id long, t string")
    got = [r.w for r in df.select("id", text.treebank_words(F.col("t")).alias("w")).orderBy("id").collect()]
    assert [" ".join(w) for w in got[:len(examples)]] == list(examples.values())
    assert got == [treebank(t) for t in [*examples, *made]]
    kept = spark.createDataFrame([("I don't like the 100 tiny, well-known rooms.",)], "t string").select(
        text.tokens(F.col("t"), ["the"], treebank=True).alias("w")).first().w
    assert kept == ["do", "n't", "like", "tiny", "well-known", "rooms"]


def test_cleaning_searches_no_whole_text_for_single_characters(spark):
    """The long character classes see only what is left of a text without its ASCII characters."""
    df = spark.createDataFrame([("café ẛ̣ \x1cend ",), ("a\x1db\x1fc",), ("\x1e",)], "review_text string")
    cleaned = text.with_clean_text(df, "review_text")
    assert [r.clean_text for r in cleaned.collect()] == ["cafe s end", "a b c", ""]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    searched = plan.split("RLIKE(")[1:]
    assert searched and all(s.startswith("regexp_replace(") for s in searched)
