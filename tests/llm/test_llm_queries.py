"""Registered queries of the subpackage: against their SQL, and the pipeline against a brute-force version."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import brute
import compare
import corpus_pipeline
from opinara.llm import secrets
from opinara.llm.queries import ORACLE, REGISTRY

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in REGISTRY if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))
    assert set(driver.queries()) >= {*REGISTRY, "pipeline"} and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare.differences(REGISTRY[name](spark, SF_DIR), compare.connect(SF_DIR), ORACLE[name]) == []


def test_native_queries_run_no_python(spark):
    for name in ("op6_secret_scan", "op7_licence_scan"):
        plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_models_beat_frequencies(spark):
    held = REGISTRY["op3_lm_scoring"](spark, SF_DIR).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_quality_and_language_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = REGISTRY["op5_quality_rules"](spark, SF_DIR).drop("quality").join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    kept = REGISTRY["op1_language_id"](spark, SF_DIR).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert kept > 0.99 and sum(good) > 0.97 * len(good) > 0


def test_pages_language(spark):
    pages = REGISTRY["page_language_id"](spark, SF_DIR)
    assert pages.filter("declared = language AND accepted").count() > 0.95 * pages.count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    rows = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    component = brute.components([r["doc_id"] for r in rows], [brute.shingles(r["text"], 5) for r in rows], 80, 100)
    kept = [r for r, c in zip(rows, component) if r["doc_id"] == c]
    copies = collections.Counter(r["doc_id"] for r in got)
    assert set(copies) <= {r["doc_id"] for r in kept} and max(copies.values()) <= 2
    # Every source gets its target, up to one whole document.
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in kept}
    by_source = collections.Counter()
    for r in kept:
        by_source[r["source"]] += size[r["doc_id"]]
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += size[r["doc_id"]]
    longest = max(size.values())
    assert 1.5 * sum(size.values()) - longest <= sum(taken.values()) <= 1.5 * sum(size.values()) + longest * len(by_source)
    assert all(taken[s] <= 2 * n for s, n in by_source.items())
    # No secret survives: ids decode to texts without findings.
    masked = corpus_pipeline.secret_scan(spark, docs, SF_DIR)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    left = secrets.scan_paths(masked, secrets.ledger_scratch(masked))
    assert left.filter(F.size("findings") > 0).count() == 0


def test_near_duplicates_of_five_words_and_any_id(spark):
    def text(seed):
        return [f"w{seed}x{i}" for i in range(60)]

    def changed(words, *at):
        return [f"other{i}" if i in at else w for i, w in enumerate(words)]

    a, b, c, d, e = (text(s) for s in range(5))
    between = changed(a, 2, 58)
    for width, linked in ((4, False), (5, True)):
        one, other = (brute.shingles(" ".join(t), width) for t in (a, between))
        assert (len(one & other) / len(one | other) >= (0.8 if width == 5 else 0.85)) == linked
    rows = [(1, a), (2, between), (None, b), (None, changed(b, 59)), (3, c), (None, changed(c, 59)), (4, d), (4, changed(d, 59)),
            (5, e), (6, changed(e, 20, 40)), (None, None), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t and " ".join(t), "en", "a", None) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()]
    plain = {(i, t and " ".join(t)) for i, t in rows}
    assert len(got) == len(set(got)) and set(got) <= plain
    by_id = collections.Counter(i for i, _ in got)
    assert by_id == {1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}


def test_stages_keep_columns_and_take_awkward_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, "the cat sat on the mat", "en", "a", 22, "x"), (1, "the cat sat on the mat", "en", "a", 22, "x"),
            (2, "the cat sat on the mat", "en", None, 22, "y"), (3, None, None, None, None, None),
            (None, "und der Hund", "de", "b", 12, "z"), (4, "word " * 20_000, "en", "a", 100_000, None),
            (5, "token = abcdef123456", "en", "a", 20, None)]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    ids = {r["doc_id"] for r in tokens.collect()}
    assert 3 not in ids and 2 not in ids and ids <= {1, 4, 5, None}
    empty = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0
