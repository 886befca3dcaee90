"""Embedding-based keyphrases with maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.numbers import half_even
from opinara.functions.text import ngrams
from opinara.operators.keywords import review_words
from opinara.operators.ranking import top_per_group
from opinara.operators.vectors import word_vectors
from opinara.session import materialise

#: Reviews that share one lookup of word vectors, and phrases compared at a time.
BLOCK_REVIEWS = 128
CHUNK = 1 << 16


def candidate_phrases(df: DataFrame, stop_words: Sequence[str], sizes: Sequence[int] = (1, 2)) -> DataFrame:
    """(review_id, phrase): the distinct n-grams of every review."""
    grams = F.concat(*[ngrams(F.col("words"), n) for n in sizes])
    return review_words(df, stop_words).select("review_id", F.explode(F.array_distinct(grams)).alias("phrase"))


def _greedy(
    relevance: np.ndarray, similarity: Callable[[int], np.ndarray], top_n: int, diversity: float,
) -> list[int]:
    """Places of the chosen phrases, most relevant first; of equal ones the first is taken."""
    chosen = [int(np.argmax(relevance))]
    overlap = similarity(chosen[0])
    while len(chosen) < min(top_n, len(relevance)):
        gain = (1 - diversity) * relevance - diversity * overlap
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
        overlap = np.maximum(overlap, similarity(chosen[-1]))
    return sorted(chosen, key=lambda i: (-relevance[i], i))


def mmr_keyphrases(
    candidates: DataFrame, phrase_vectors: DataFrame, review_vectors: DataFrame, *,
    top_n: int = 10, diversity: float = 0.3,
) -> DataFrame:
    """(review_id, rank, phrase, score): relevant but diverse phrases of each review.

    ``phrase_vectors(phrase, vector)`` and ``review_vectors(review_id, vector)`` come from whatever
    embedding model is in use.  Only the greedy choice runs in Python, on the phrases of one review.
    """
    vectors = candidates.join(phrase_vectors, "phrase")
    about = review_vectors.select("review_id", F.col("vector").alias("about"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("phrase", kind="stable")
        matrix = np.stack(group["vector"].to_numpy()).astype(float)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        target = np.asarray(group["about"].iloc[0], dtype=float)
        relevance = matrix @ (target / max(np.linalg.norm(target), 1e-12))
        chosen = _greedy(relevance, lambda i: matrix @ matrix[i], top_n, diversity)
        return pd.DataFrame({
            "review_id": group["review_id"].iloc[0],
            "rank": np.arange(1, len(chosen) + 1),
            "phrase": group["phrase"].to_numpy()[chosen],
            "score": relevance[chosen].round(4),
        })

    joined = vectors.join(about, "review_id")
    return joined.groupBy("review_id").applyInPandas(
        choose, "review_id long, rank int, phrase string, score double"
    )


def _review_phrases(
    words: list[str], vectors: dict[str, np.ndarray], zero: np.ndarray, sizes: Sequence[int], top_n: int, diversity: float,
) -> tuple[list[str], np.ndarray]:
    """The chosen phrases of one review and their relevance.

    Phrase and review vectors are sums of word vectors, hence whole numbers: products are exact in any order.
    """
    phrases = sorted({phrase for n in sizes for phrase in zip(*(words[i:] for i in range(n)))}, key=" ".join)
    if not phrases:
        return [], np.zeros(0)
    index = {word: i for i, word in enumerate(dict.fromkeys(words))}
    table = np.stack([vectors.get(word, zero) for word in index])
    about = np.bincount([index[word] for word in words]) @ table.astype(float)
    matrix = np.zeros((len(phrases), len(zero)), np.int16)
    for n in dict.fromkeys(sizes):
        at = [i for i, phrase in enumerate(phrases) if len(phrase) == n]
        for k in range(n):
            matrix[at] += table[[index[phrases[i][k]] for i in at]]
    parts = [matrix[start:start + CHUNK] for start in range(0, len(phrases), CHUNK)]
    lengths = np.concatenate([np.sqrt((part.astype(float) ** 2).sum(1)) for part in parts])

    def cosine(vector: np.ndarray) -> np.ndarray:
        scale, out = lengths * np.sqrt(vector @ vector), np.zeros(len(phrases))
        products = np.concatenate([part.astype(float) @ vector for part in parts])
        return np.divide(products, scale, out=out, where=scale > 0)

    relevance = cosine(about)
    chosen = _greedy(relevance, lambda i: cosine(matrix[i].astype(float)), top_n, diversity)
    return [" ".join(phrases[i]) for i in chosen], relevance[chosen]


def review_keyphrases(
    df: DataFrame, stop_words: Sequence[str], *, sizes: Sequence[int] = (1, 2), top_n: int = 10, diversity: float = 0.3,
    dims: int = 64, window: int = 2,
) -> DataFrame:
    """(review_id, rank, phrase, score): relevant but diverse phrases of each review, with vectors learned from ``df``.

    Words get ``vectors.word_vectors``; a phrase or review is the sum of its words, and the score is the cosine of the two.
    A word's vector is looked up once for each block of ``BLOCK_REVIEWS`` reviews, not for each occurrence.  A word without
    a vector adds nothing, and a phrase of such words has score 0.  A review without words has no phrases.
    """
    if max(sizes, default=0) * 127 > np.iinfo(np.int16).max or min(sizes, default=0) < 1:
        raise ValueError("sizes must lie between 1 and 258 words")
    table = materialise(review_words(df, stop_words))
    vectors = word_vectors(table, dims=dims, window=window)
    blocks = max(1, -(-table.count() // BLOCK_REVIEWS))
    table = table.withColumn("block", F.pmod(F.xxhash64("review_id"), F.lit(blocks)))
    needed = table.select(F.col("block").alias("part"), F.explode("words").alias("word")).distinct().join(vectors, "word")

    def choose(reviews: pd.DataFrame, lookup: pd.DataFrame) -> pd.DataFrame:
        known = {w: np.asarray(v, np.int16) for w, v in zip(lookup["word"], lookup["vector"])}
        zero = np.zeros(dims, np.int16)
        parts = []
        for review, words in zip(reviews["review_id"], reviews["words"]):
            phrases, scores = _review_phrases(list(words), known, zero, sizes, top_n, diversity)
            parts.append(pd.DataFrame({
                "review_id": review, "rank": np.arange(1, len(phrases) + 1, dtype=np.int32), "phrase": phrases,
                "score": scores.round(4) + 0.0}))
        return pd.concat(parts) if parts else pd.DataFrame({"review_id": [], "rank": [], "phrase": [], "score": []})

    return table.groupBy("block").cogroup(needed.groupBy("part")).applyInPandas(
        choose, "review_id long, rank int, phrase string, score double")


def summed_keyphrases(phrases: DataFrame, keys: Sequence[str], top_n: int) -> DataFrame:
    """Total phrase scores per group (or over everything) and the best ``top_n``."""
    totals = phrases.groupBy(*keys, "phrase").agg(half_even(F.sum("score"), 4).alias("score"))
    return top_per_group(totals, list(keys), [F.desc("score"), F.col("phrase")], top_n)
