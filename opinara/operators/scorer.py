"""A sentiment scorer fitted to labelled reviews: naive Bayes over hashed words, for ``sentiment.model_sentiment``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a word's digest, and so 16 ** 4 buckets: the bound of the fitted table.
DIGITS = 4
#: Logarithms are kept as whole millionths, so sums over words are exact in any order.
UNIT = 1_000_000
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


@lru_cache(maxsize=1 << 16)
def _bucket(word: str) -> int:
    return int(md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:DIGITS], 16)


def _bucket_of(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, DIGITS), 16, 10).cast("int")


@dataclass(frozen=True)
class BayesScorer:
    """``weights[bucket, label]`` and ``priors[label]`` in millionths of a natural logarithm.

    A text's words share the evidence of at most ``longest`` words, as words of one text are not independent; without that,
    every long text would be certain.  Equally likely labels are told apart by their order.
    """

    labels: tuple[str, ...]
    priors: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    longest: int = 50

    def __call__(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            words = [w for w in (text or "").translate(_LOWER).split(" ") if w]
            sums = self.weights[[_bucket(w) for w in words]].sum(0) if words else np.zeros(len(self.labels), np.int64)
            evidence = (self.priors + sums * (min(len(words), self.longest) / max(len(words), 1))) / UNIT
            best = int(np.argmax(evidence))
            out.append((self.labels[best], round(float(1 / np.exp(evidence - evidence[best]).sum()), 4)))
        return out


def fit_scorer(
    df: DataFrame, label: str, labels: Sequence[str] = ("negative", "neutral", "positive"), *, text_col: str = "clean_text",
    longest: int = 50,
) -> BayesScorer:
    """Learn from all rows of ``df`` whose ``label`` is one of ``labels``.

    One partially aggregated count of (label, bucket) reaches the driver: at most 65,536 rows a label, whatever the size
    of ``df``.  Rows count once a word and once as a text; a label without rows keeps a pseudo-count of one, and so
    does every bucket.
    """
    rows = df.filter(F.col(label).isin(*labels)).select(
        F.col(label).alias("label"),
        F.filter(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase), " "),
                 lambda w: w != "").alias("words"))
    # The entry -1 counts the text itself.
    buckets = F.concat(F.array(F.lit(-1)), F.transform("words", _bucket_of))
    counted = rows.select("label", F.explode(buckets).alias("bucket")).groupBy("label", "bucket").count().collect()
    names, size = tuple(labels), 16 ** DIGITS
    texts, words = np.ones(len(names)), np.ones((size, len(names)))
    for row in counted:
        if row.bucket < 0:
            texts[names.index(row.label)] += row["count"]
        else:
            words[row.bucket, names.index(row.label)] += row["count"]

    def logarithms(shares: np.ndarray) -> np.ndarray:
        return np.rint(np.log(shares) * UNIT).astype(np.int64)

    return BayesScorer(names, logarithms(texts / texts.sum()), logarithms(words / words.sum(0)), longest)
