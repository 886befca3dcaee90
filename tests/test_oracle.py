"""Every registered query against its independent SQL."""

import re

import pytest

import __spark_entry__ as driver
import compare

SF_DIR = "/root/testdata/sf0.001"
# Queries of the optional subpackage are tested in its own folder.
QUERIES = {name: query for name, query in driver.queries().items() if name not in driver.LLM_REGISTRY}
ORACLE = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connection, name):
    assert compare.differences(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) == []


def test_registry_is_complete():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"topic_words", "topic_counts", "analysis_plan"}


def test_entry(spark):
    assert driver.entry(spark).count() == 20


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(ORACLE) if not n.startswith("stream_")])
def test_no_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    pushed = re.search(r"PushedFilters: (.*)", _plan(QUERIES["global_filter"](spark, SF_DIR))).group(1)
    assert "In(source" in pushed
    assert "ReadSchema: struct<source:string>" in _plan(QUERIES["top_places"](spark, SF_DIR))


def test_row_work_has_no_shuffle(spark):
    from opinara.catalog import adapters
    from opinara.operators import aspects, preprocess, sentiment

    reviews = adapters.reviews(spark, SF_DIR)
    rows = preprocess.preprocess_reviews(reviews, adapters.STOP_WORDS)
    rows = aspects.tag_aspects(sentiment.lexicon_sentiment(rows, adapters.VALENCES), adapters.ASPECTS)
    assert "Exchange" not in _plan(rows) and _plan(rows).count("ArrowEvalPython") == 1
