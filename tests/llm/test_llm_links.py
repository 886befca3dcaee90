from collections import Counter
from itertools import combinations

import pytest

import brute
from opinara.llm import jaccard, links
from test_llm_operators import _clashing, _families, awkward, empty  # noqa: F401


def _linked(a, b, num, den):
    common = len(a & b)
    return bool(a) and bool(b) and den * common >= num * (len(a) + len(b) - common)


def _counts(texts, width=4, num=85, den=100):
    sets = [brute.shingles(t, width) for t in texts]
    return [(len(s), sum(_linked(s, t, num, den) for j, t in enumerate(sets) if j != i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed, block, width, num", [(1, 250_000, 4, 85), (5, 300, 5, 80)])
def test_all_links(spark, monkeypatch, seed, block, width, num):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)  # 300: components are cut into chunks that meet in pairs
    texts = _families(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    threshold = jaccard.Threshold(num, 100)
    got = sorted(map(tuple, links.link_counts(df, width=width, threshold=threshold).collect()))
    want = _counts(texts, width, num)
    assert got == [(i, *c) for i, c in enumerate(want)]
    assert max(n for _, n in want) > 2


def test_each_pair_once(spark):
    texts = _families(6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = links.links(df)
    pairs = [(r.a, r.b) for r in found.pairs.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)  # each pair once
    kinds = {s for s in (brute.shingles(t) for t in texts) if s}
    assert len(pairs) == sum(_linked(a, b, 85, 100) for a, b in combinations(kinds, 2))


def test_links_awkward(awkward, empty):  # noqa: F811
    got = links.link_counts(_clashing(awkward, "node", "n", "content", "n_links", "block")).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = [(i, *c) for (i, _), c in zip(rows, _counts([t for _, t in rows]))]
    assert Counter(map(tuple, got)) == Counter(want)
    assert links.link_counts(empty).count() == 0
    assert links.links(empty).pairs.count() == 0


def test_sets_are_built_once_for_each_text(spark, monkeypatch):
    built = Counter()
    for name in ("prefixes", "hot_grams", "sets_of"):
        def counted(docs, *rest, of=getattr(jaccard, name), name=name):
            built[name] += 1
            return of(docs, *rest)

        monkeypatch.setattr(jaccard, name, counted)
    texts = _families(3) * 2 + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, links.link_counts(df).collect()))
    assert got == [(i, *c) for i, c in enumerate(_counts(texts))]
    assert built == {"prefixes": 1, "hot_grams": 1, "sets_of": 1}
