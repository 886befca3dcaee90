import random
import time
from collections import Counter

from opinara.operators import insights, keywords
from opinara.operators.frequent import Grams, Wanted, frequent_grams
from opinara.plans.analysis import AnalysisPlan
from opinara.session import stored

COLUMNS = "review_id long, place_name string, sentiment string, words array<string>"


def _reviews(n, seed=5):
    """Reviews of few frequent and many rare words, some without place, sentiment, words or one of the words."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{min(int(pick.paretovariate(0.6)), 4000)}" if pick.random() > 0.02 else None for _ in range(pick.randrange(60))]
        rows.append((i, pick.choice(["p", "p", "q", None]), pick.choice(["positive", "negative", "neutral", None]),
                     words if i % 50 else None))
    return rows


def _counted(rows, sizes, key):
    df, total = Counter(), Counter()
    for row in rows:
        words, group = row[3] or [], row[key] if key else ()
        grams = [" ".join(words[i:i + n]) for n in sizes for i in range(len(words) - n + 1) if None not in words[i:i + n]]
        total.update((group, g) for g in grams)
        df.update({(group, g) for g in grams})
    return df, total


def test_wanted_grams_are_counted_exactly_and_few_others(spark):
    rows = _reviews(600)
    table = stored(spark.createDataFrame(rows, COLUMNS).repartition(5), "words")
    spaces = {
        "all": (Grams((1, 2), (Wanted(20, 2, 0.5), Wanted(30, 3, 0.8)), bits=12), 0, {()}),
        "place": (Grams((1, 2), (Wanted(10, 2, 0.85),), ("place_name",), bits=12), 1, {"p", "q"}),
        "sided": (Grams((1, 2), (Wanted(15),), ("sentiment",), keywords.POLARITIES, bits=12), 2, set(keywords.POLARITIES)),
        "threes": (Grams((3,), (Wanted(5, 2, 0.8),), bits=6), 0, {()}),  # hardly any cells: nothing is ruled out, nothing is lost
        "rare": (Grams((2,), (Wanted(1 << 20, 2, 1.0),), bits=12), 0, {()}),
    }
    found = frequent_grams(table, {name: grams for name, (grams, _, _) in spaces.items()})
    for name, (grams, key, groups) in spaces.items():
        df, total = _counted(rows, grams.sizes, key)
        got = {(r[0] if grams.keys else (), r.term): (r.df, r.total) for r in found[name].collect()}
        assert all(got[t] == (df[t], total[t]) for t in got) and {g for g, _ in got} <= groups
        for group in groups:
            reviews = sum(1 for row in rows if not key or row[key] == group)
            for w in grams.wanted:
                def first(terms):
                    fit = [t for t in terms if t[0] == group and w.min_df <= df[t] <= reviews * (w.max_df or 1)]
                    return sorted(fit, key=lambda t: (-total[t], t[1]))[:w.n]

                assert first(got) == first(total), (name, group)
        if name in ("all", "place", "sided"):
            assert len(got) < len([t for t in total if t[0] in groups]) / 10


def test_the_analysis_shuffles_no_table_of_all_grams(spark, monkeypatch):
    counted = []
    original = keywords.gram_counts
    monkeypatch.setattr(keywords, "gram_counts", lambda *a, **b: counted.append(1) or original(*a, **b))
    rows = [(n, f"p{n % 2}", "fresh staff and cheap food", float(1 + n % 5)) for n in range(12)]
    reviews = spark.createDataFrame(rows, "review_id long, place_name string, review_text string, review_rating double")
    tables = AnalysisPlan(stop_words=[], n_topics=2).run(reviews)
    # All twelve reviews have every gram, which is more than the largest share.
    assert not counted and tables["place_keywords"].count() == 0 and tables["phrase_frequencies"].count() == 0


def test_place_keywords_from_counts_equal_those_without(spark):
    table = stored(spark.createDataFrame(_reviews(300), COLUMNS), "words")
    stats = frequent_grams(table, {"x": Grams((1, 2), (Wanted(2000, 2, 0.85),), ("place_name",), bits=12)})["x"]

    def rows(df):
        return sorted(map(tuple, df.collect()))

    plain = rows(keywords.place_keywords(table, [], word_table=table))
    assert len(plain) == 30 and rows(keywords.place_keywords(table, [], word_table=table, stats=stats)) == plain


def test_complaint_words_of_known_aspects(spark):
    rows = [("negative", ["a", "b"], ["x", "y", "x"]), ("negative", ["b"], ["x", None]), ("negative", [], ["x"]), ("negative", ["a"], []),
            ("negative", ["c", "a"], ["z"]), ("positive", ["a"], ["x"]), (None, ["a"], ["x"])]
    df = spark.createDataFrame(rows, "sentiment string, aspects array<string>, tokens array<string>")
    plain = insights.complaint_keywords(df).collect()
    known = insights.complaint_keywords(df, lexicon={"a": [], "b": [], "c": [], "d": []}).collect()
    assert len(plain) == 7 and sorted(map(repr, plain)) == sorted(map(repr, known))


def test_a_stored_table_leaves_no_shuffle(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_") and b.endswith(".data")}

    before = files()
    kept = stored(spark.range(1000).selectExpr("id % 7 k").repartition(5, "k").groupBy("k").count(), "kept")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 7
