"""Packing, hard negatives and periodic runs against brute force, and their awkward cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import compare
from opinara.llm import negatives, oracle, packing, periods, textkit
from opinara.llm.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORD_BPE)
ODD_TEXTS = ["", None, "  \t\n ", "Don't we'll CAN'T i'd it's", "naïve façade Straße ÀÉ ÿ Þß", "a b c\x1cd é İ Σς ﬁ ２",
             "한국어 テキスト ไทย ابت 😀😀 x😀y", "12345 3.14 ... ?! ,., '' a.b c...", "the the the", "x" * 5000, "ö." * 300,
             "<|endoftext|> a<|startoftext|>b", "don't.stop,now tom's; (a) [b] \"c\"", "ǅ ŉ ĳ Ǉ"]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_are_those_of_the_library(spark):
    known = packing.WordIds(open(WORD_BPE, encoding="utf-8").read())
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + ODD_TEXTS
    for text in texts:
        got = np.frombuffer(known.encode((text or "").encode()), known.kind).tolist()
        assert got == ids_of(text)[:-1], text


def packed(pieces, texts, window=2048):
    """Checks what holds for any packing; returns the tokens of each sequence in order."""
    whole = collections.defaultdict(dict)
    streams = collections.defaultdict(dict)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        whole[p["doc_id"]][p["start"]] = ids
        assert p["offset"] not in streams[p["sequence_id"]]
        streams[p["sequence_id"]][p["offset"]] = (p["source"], ids)
    expected = {i: ids_of(t) for i, t in texts.items()}
    assert {i: [t for s in sorted(d) for t in d[s]] for i, d in whole.items()} == expected
    assert all(p["doc_tokens"] == len(expected[p["doc_id"]]) for p in pieces)
    assert sorted(streams) == list(range(len(streams)))
    lengths = []
    for number in sorted(streams):
        at = 0
        for offset in sorted(streams[number]):
            assert offset == at
            at += len(streams[number][offset][1])
        lengths.append(at)
    total = sum(map(len, expected.values()))
    full = total // window
    assert lengths[:full] == [window] * full
    assert all(n & (n - 1) == 0 and n < window for n in lengths[full:]) and sum(lengths) == total
    return [streams[n] for n in sorted(streams)]


def test_packing_holds_every_id_once_and_the_mixture_everywhere(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pieces = packing.pack(docs, WORD_BPE).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    streams = packed(pieces, texts)
    tokens = collections.Counter()
    for r in docs.collect():
        tokens[r["source"]] += len(ids_of(r["text"]))
    total, sent = sum(tokens.values()), collections.Counter()
    for k, stream in enumerate(streams):
        for source, ids in stream.values():
            sent[source] += len(ids)
        so_far = sum(sent.values())
        # A window may end inside a round, and every source may be a packet behind.
        assert all(abs(sent[s] - so_far * n / total) <= 2 * packing.PACKET + packing.WINDOW * n / total + len(tokens)
                   for s, n in tokens.items()), k
    joined = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs, WORD_BPE)).collect()}
    assert all(np.frombuffer(joined[k]["ids"], "<u4").tolist() == [i for o in sorted(s) for i in s[o][1]] for k, s in enumerate(streams))


def test_packing_by_deficit_round_robin(spark):
    """Packets leave in the order of a plain deficit round-robin over the queues, for weights of one's own too."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice("abbbb")) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None, None), (61, "", "a")], "doc_id long, text string, source string")
    weights = {"a": 3.0, "b": 1.0, None: 1.0}
    weight = F.when(F.col("source") == "a", 3.0).otherwise(1.0)
    pieces = packing.pack(docs, WORD_BPE, weight=weight, window=64, packet=16).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed(pieces, texts, 64)
    pieces.sort(key=lambda p: (p["sequence_id"], p["offset"]))
    # The queues as they were sent, then the same queues served plainly.
    queues = {s: [] for s in ("a", "b", None)}
    for p in pieces:
        queue = queues[p["source"]]
        cut = p["start"] % 16
        if cut:
            queue[-1][2] += p["length"]
        else:
            queue.append([p["doc_id"], p["start"], p["length"]])
    shares = {s: round(w * packing.PARTS / 5) for s, w in weights.items()}
    expected, deficit, at = [], dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    while any(at[s] < len(q) for s, q in queues.items()):
        for s in ("a", "b", None):
            deficit[s] += 64 * shares[s]
            while at[s] < len(queues[s]) and queues[s][at[s]][2] * packing.PARTS <= deficit[s]:
                deficit[s] -= queues[s][at[s]][2] * packing.PARTS
                expected.append(tuple(queues[s][at[s]]))
                at[s] += 1
    got = [(p["doc_id"], p["start"]) for p in pieces if p["start"] % 16 == 0]
    assert got == [e[:2] for e in expected]


def test_packing_awkward_rows(spark):
    rows = [(i, t, None if i % 3 else "s", "x") for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids string")
    packed(packing.pack(docs, WORD_BPE).collect(), {i: t for i, t, _, _ in rows})
    same = spark.createDataFrame([(None, "the cat", "a")] * 5 + [(1, "the cat", "a")] * 3, "doc_id long, text string, source string")
    pieces = packing.pack(same, WORD_BPE, window=8, packet=8).collect()
    assert sum(p["length"] for p in pieces) == 8 * 3 and len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    empty = packing.pack(docs.limit(0), WORD_BPE)
    assert empty.count() == 0 and empty.columns == packing.NAMES


def test_packing_query(spark):
    docs = {r["doc_id"]: ids_of(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in REGISTRY["op11_packing"](spark, SF_DIR).collect():
        ids = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def mined(rows, is_anchor, n_positive=5, n_negative=3, low=50, high=95):
    rows = list(dict.fromkeys((i, y, tuple(v)) for i, y, v in rows if None not in (i, y, v)))
    out = collections.Counter()
    for i, y, v in (r for r in rows if is_anchor(r[0])):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows if j != i]
        for s, j, _ in sorted(r for r in scored if r[2] == y)[:n_positive]:
            fit = sorted(r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s)[:n_negative]
            for rank, (t, k, _) in enumerate(fit, 1):
                out[(i, j, rank, k, -s, -t)] += 1
    return out


@pytest.mark.parametrize("spread", ["near", "lengths", "copies", "large"])
def test_hard_negatives_by_brute_force(spark, spread):
    rng = np.random.default_rng(len(spread))
    n, d = 400, 8
    v = rng.normal(size=(n, d)) * 100
    if spread == "near":  # few directions, so that the coordinate lists rule out most of a block
        v = np.eye(d)[rng.integers(0, d, n)] * 200 + rng.normal(size=(n, d)) * 20
    elif spread == "lengths":
        v *= np.exp(rng.normal(size=(n, 1)) * 2)
    elif spread == "copies":
        v[100:250] = v[7]
    elif spread == "large":
        v *= 2e5
    v = np.clip(np.floor(v), 1 - negatives.LARGEST, negatives.LARGEST - 1).astype(int)
    rows = [(int(i), str(rng.integers(0, 3)), [int(x) for x in w]) for i, w in enumerate(v)]
    rows[5] = rows[6] = (6, "1", [0] * d)
    df = spark.createDataFrame(rows, "vec_id long, label string, vector array<long>")
    got = negatives.mine(df, F.col("vec_id") % 9 == 0, block_rows=50).collect()
    assert collections.Counter(map(tuple, got)) == mined(rows, lambda i: i % 9 == 0)


def test_coordinate_lists_keep_all_that_reach_the_score():
    rng = np.random.default_rng(3)
    v = np.floor(np.eye(16)[rng.integers(0, 16, 500)] * 200 + rng.normal(size=(500, 16)) * 25).astype(np.int64)
    norms = np.linalg.norm(v, axis=1)
    unit = v / norms[:, None]
    block = negatives.Block(np.arange(500), np.zeros(500, np.int64), v, unit, np.argsort(unit, axis=0).T, float(norms.max()))
    pruned = 0
    for anchor in v[:40].astype(float):
        for share in (0.2, 0.5, 0.8, 0.99, 1.2):
            score = share * np.linalg.norm(anchor) * norms.max()
            some = negatives.candidates(anchor, block, score)
            if some is not None:
                pruned += 500 - len(some)
                assert set(np.flatnonzero(v @ anchor >= score)) <= set(some)
    assert pruned > 10_000


def test_hard_negatives_awkward_rows(spark):
    kind = "vec_id long, label int, vector array<long>, score string, block string"
    rows = [(0, 1, [5, 1]), (1, 1, [5, 0]), (2, 2, [3, 0]), (3, None, [3, 0]), (4, 2, None), (5, 2, [None, 1]), (None, 2, [3, 0]),
            (6, 2, [1 << 25, 0]), (7, 2, [1, 2, 3]), (2, 2, [3, 0]), (8, 2, [3, 1]), (9, 1, [0, 0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], kind)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") == 0).collect()))
    usable = [(i, y, v) for i, y, v in rows if i in (0, 1, 2, 8, 9)]
    # The positive of score 0 takes only negatives of score 0.
    assert got == sorted(mined(usable, lambda i: i == 0)) == [(0, 1, 1, 8, 25, 16), (0, 1, 2, 2, 25, 15)]
    for nothing in (df.limit(0), df.filter("label = 2"), df.filter("vec_id = 0")):
        assert negatives.mine(nothing, F.col("vec_id") == 0).count() == 0


def test_hard_negative_query_takes_odd_vectors(spark, tmp_path):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)], i % 3) for i in range(120)]
    rows += [(150, [float("nan")] * 4, 1), (200, [float("inf"), 0.0, 0.0, 0.0], 1), (250, None, 1), (300, [None, 0.0, 0.0, 0.0], 1), (350, [0.5] * 4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("*.parquet"))
    part.rename(tmp_path / "embeddings.parquet")
    got = REGISTRY["op12_hard_negatives"](spark, str(tmp_path))
    assert got.count() > 0 and compare.differences(got, compare.connect(str(tmp_path)), oracle.hard_negatives()) == []


def runs_of(words):
    """All runs by comparing every pair of places a period apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_by_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        texts = []
        for _ in range(20):
            n, k = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 20])
            words = [str(rng.randrange(k)) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                a, b = sorted(rng.choices(range(n + 1), k=2))
                p = rng.randint(1, max(1, (b - a) // 2))
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
            texts.append(" ".join(words).encode())
        words = textkit._words(texts, False)
        got = [[] for _ in texts]
        for start, length, period in zip(*(x.tolist() for x in periods.find(words.hashes, words.rows))):
            row = words.rows[start]
            got[row].append((start - int(words.first[row]), length, period))
        assert got == [runs_of(t.split()) for t in texts]


def test_each_nonterminal_is_cut_once_and_expands_to_its_place():
    symbols = np.array([0, 1, 2] * 40 + [3] * 50 + [0, 1, 2, 4] * 10)
    grammar = periods.Grammar(symbols, np.repeat([0, 1], [130, 80]))
    n_rules = len(grammar.length) - grammar.words
    assert n_rules < 60

    def expand(node):
        return [node] if node < grammar.words else expand(grammar.left[node]) + expand(grammar.right[node])

    for node in range(grammar.words, len(grammar.length)):
        at = grammar.at[node]
        assert expand(node) == symbols[at : at + grammar.length[node]].tolist()
    for node, place in zip(*grammar.positions()):
        assert expand(node) == symbols[place : place + grammar.length[node]].tolist()
    assert sum(grammar.length[grammar.roots]) == len(symbols)


def test_runs_of_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 12), (5, "a " * 11), (6, "x a b a b a b a b a b a b y"), (4, "a " * 12),
            (7, "word " * 200_000), (8, " a b " * 20), (9, " ".join(f"w{i % 5000}" for i in range(15_000)))]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, runs string")
    found = periods.detect(df)
    assert found.columns[:4] == ["doc_id", "text", "runs", "n_words"] and len(set(found.columns)) == 6
    runs, collapsed = found.columns[4:]
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r[runs]], r[collapsed]) for r in found.collect()}
    assert got[1] == got[2] == got[3] == (0, [], "") and found.count() == len(rows)
    assert got[4] == (12, [(0, 12, 1)], "a") and got[5] == (11, [], " ".join("a" * 11))
    assert got[6] == (14, [(1, 12, 2)], "x a b y")
    assert got[7] == (200_000, [(0, 200_000, 1)], "word") and got[8] == (20, [(0, 20, 1)], " a b")
    assert got[9][1] == [(0, 15_000, 5000)]
    assert periods.detect(df.limit(0)).count() == 0


def test_periodic_runs_query(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    planted = 0
    for r in REGISTRY["op13_periodic_runs"](spark, SF_DIR).collect():
        words = brute.words(rows[r["doc_id"]])
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if n > 6000:
            continue  # the plain version is quadratic
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = runs_of(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 10


def test_frequent_words_stay_remembered(monkeypatch):
    """A worker whose memory is full forgets words that no longer occur, not those that do."""
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    with open(WORD_BPE, encoding="utf-8") as file:
        known = packing.WordIds(file.read())
    model, asked = known.model, []

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return model.tokenize(word)

    known.model = Model()
    letters = "abcdefghijklmnopqrst"
    text = " ".join(f"the x{a}{b}z The," for a in letters for b in letters)
    assert np.frombuffer(known.encode(text.encode()), known.kind).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert asked.count("the") == 1 and len(asked) == 402
