"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each.

``measure`` computes facts of each text, ``RULES`` turn facts into votes (1 good, -1 bad, 0 abstains), and
``QualityModel`` holds, for each rule and latent class, the probability of each vote.  Class 0 is good text;
since texts are bad in unrelated ways, there is one bad class for each rule.  The model is fitted by
expectation-maximisation on the counts of vote patterns.  There are at most
``3 ** len(RULES)`` patterns whatever the number of documents, and they come from one partially aggregated
``groupBy``, so every document counts and the driver sees a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit
from opinara.llm.frames import fresh, named

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
         "n_digits", "n_upper")
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains (also on nulls)."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.good} THEN 1 WHEN {self.bad} THEN -1 ELSE 0 END").cast("int")


#: Rules over the facts; each has a band between good and bad in which it abstains.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words >= 40", "n_words < 20"),
    Rule("word_length", "word_chars BETWEEN 3.5 * n_words AND 9.5 * n_words",
         "word_chars < 2.5 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "100 * n_symbols <= 3 * n_words", "100 * n_symbols > 10 * n_words"),
    Rule("line_copies", "n_dup_lines < 3 OR 10 * n_dup_lines <= n_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("variety", "n_words >= 20 AND n_distinct_words * n_distinct_words >= 8 * n_words",
         "n_words >= 20 AND n_distinct_words * n_distinct_words < 3 * n_words"),
    Rule("digits", "100 * n_digits <= 5 * word_chars", "100 * n_digits > 20 * word_chars"),
    Rule("capitals", "100 * n_upper <= 15 * word_chars", "100 * n_upper > 40 * word_chars"),
)


def _count_by_row(flags: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[row_starts])


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS_SYMBOL, _IS_DIGIT = _table(SYMBOLS), _table(b"0123456789")
_IS_UPPER, _IS_CONTINUED = _table(bytes(range(65, 91))), _table(bytes(range(128, 192)))


def _repeated_words(words: textkit.Words, n_rows: int) -> np.ndarray:
    """Words that lie in a window of ``WINDOW`` words found twice or more in their text."""
    n = len(words.hashes)
    if n < WINDOW:
        return np.zeros(n_rows, np.int64)
    rows, windows = textkit.shingles(words, WINDOW)
    # Short rows give one shingle of fewer words; with one window they cannot repeat.
    at = np.flatnonzero(words.rows[: n - WINDOW + 1] == words.rows[WINDOW - 1 :])
    rows, windows = rows[: len(at)], windows[: len(at)]
    order = np.lexsort((windows, rows))
    same = (windows[order][1:] == windows[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    opened = np.zeros(n + 1, np.int64)
    np.add.at(opened, at[twice], 1)
    np.add.at(opened, at[twice] + WINDOW, -1)
    return np.bincount(words.rows[np.cumsum(opened[:-1]) > 0], minlength=n_rows)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        parts: list[list[np.ndarray]] = [[] for _ in FACTS]
        for start, stop, words in textkit.slices(texts, lower=False):
            n_rows = stop - start
            n_words = np.diff(words.first)
            word_byte = ~textkit.IS_SPACE[words.data]
            lines, copies = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
            for i in range(n_rows):
                text = texts[start + i].as_py() or ""
                kept = [line for line in text.split("\n") if line.strip(_BLANK)]
                lines[i], copies[i] = len(kept), len(kept) - len(set(kept))
            _, first = textkit.sets_by_row(words.rows, words.hashes, n_rows)
            for part, value in zip(parts, (
                n_words, _count_by_row(word_byte & ~_IS_CONTINUED[words.data], words.row_starts),
                _count_by_row(_IS_SYMBOL[words.data], words.row_starts), copies,
                _repeated_words(words, n_rows), lines, np.diff(first),
                _count_by_row(_IS_DIGIT[words.data], words.row_starts),
                _count_by_row(_IS_UPPER[words.data], words.row_starts),
            )):
                part.append(value)
        columns = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
        arrays = [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])


def _measured(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``k0``, ``k1``, ... for those of ``keep``, and the facts of each whole text."""
    kept = [named(df, c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, named(df, text).cast("string").alias("t"))
    kinds = [f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    return rows.mapInArrow(_facts, ", ".join([*kinds, *(f"{f} long" for f in FACTS)]))


def measure(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the facts of each whole text (null: no words)."""
    facts = _measured(df, text, keep)
    return facts.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *FACTS)


@dataclass(frozen=True)
class QualityModel:
    """``prior[c]`` and ``votes[c][r][v + 1]``: shares of the classes, and how likely rule r votes v in class c."""

    rules: tuple[Rule, ...]
    prior: tuple[float, ...]
    votes: tuple[tuple[tuple[float, float, float], ...], ...]

    def posteriors(self) -> list[float]:
        """Probability of good for each of the ``3 ** len(rules)`` vote patterns, by pattern number."""
        votes = np.array(list(product((0, 1, 2), repeat=len(self.rules))))
        p = np.log(np.array(self.votes))
        scores = np.log(np.array(self.prior)) + sum(p[:, r, votes[:, r]].T for r in range(len(self.rules)))
        weights = np.exp(scores - scores.max(1, keepdims=True))
        return (weights[:, 0] / weights.sum(1)).tolist()

    def probability(self) -> Column:
        """Posterior probability that a text is good, from its facts; a lookup by pattern number, no join."""
        number = F.lit(0)
        for rule in self.rules:
            number = number * 3 + rule.vote() + 1
        return F.element_at(F.lit(self.posteriors()), number + 1)


#: Votes (bad, none, good) of a rule on texts that are bad in its way; most of its bad votes on good texts.
OWN_VOTES = (0.94, 0.05, 0.01)
MOST_FALSE = 0.02


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """``(prior, p)``: shares of the classes and ``p[c, r, v + 1]``, the probability of vote v of rule r in class c.

    Class 0 is good, class r + 1 is bad in the way of rule r.  Two bounds keep those meanings, so classes cannot change
    places: rule r votes as ``OWN_VOTES`` in its own class, and bad on at most ``MOST_FALSE`` of good texts.  The rest
    is estimated, with pseudo-counts of a hundredth of the texts.
    """
    n_rules = votes.shape[1]
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2)  # pattern, rule, vote
    total = max(counts.sum(), 1)
    share = (seen * counts[:, None, None]).sum(0) / total + 0.02
    share /= share.sum(1, keepdims=True)
    start = np.repeat(share[None], n_rules + 1, axis=0)
    start[0] *= [0.1, 1.0, 1.0]
    for r in range(n_rules):
        start[r + 1, r] = OWN_VOTES
    p = start / start.sum(2, keepdims=True)
    prior = np.array([0.8, *[0.2 / n_rules] * n_rules])
    anchor, anchor_prior = 0.01 * total * p, 0.01 * total * prior
    for _ in range(rounds):
        scores = np.einsum("prv,crv->pc", seen, np.log(p)) + np.log(prior)
        weights = np.exp(scores - scores.max(1, keepdims=True))
        weights *= counts[:, None] / weights.sum(1, keepdims=True)
        mass = np.einsum("pc,prv->crv", weights, seen) + anchor
        p = mass / mass.sum(2, keepdims=True)
        p[np.arange(1, n_rules + 1), np.arange(n_rules)] = OWN_VOTES
        p[0, :, 0] = np.minimum(p[0, :, 0], MOST_FALSE)
        p[0] /= p[0].sum(1, keepdims=True)
        prior = weights.sum(0) + anchor_prior
        prior /= prior.sum()
    return prior, p


def fit(facts: DataFrame, rules: Sequence[Rule] = RULES) -> QualityModel:
    """Estimate the rules' accuracies over all rows of ``facts`` (one job, bounded result)."""
    patterns = facts.select(*(r.vote().alias(f"v{i}") for i, r in enumerate(rules))).groupBy(
        *(f"v{i}" for i in range(len(rules)))
    ).count().collect()
    rows = sorted(tuple(r) for r in patterns)
    votes = np.array([r[:-1] for r in rows], int).reshape(-1, len(rules))
    counts = np.array([r[-1] for r in rows], float)
    prior, p = expectation_maximisation(votes, counts)
    return QualityModel(tuple(rules), tuple(prior.tolist()), tuple(tuple(map(tuple, c)) for c in p.tolist()))


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` plus ``quality`` (posterior probability of good) and ``quality_kept``.

    Null and empty texts have no words: they get the posterior of those votes, as every other text.  An empty table
    gives an empty one.  Equal rows get equal results.  Existing columns of these names are kept: the new ones then
    get a suffix.
    """
    model = fit(measure(df, text))
    facts = _measured(df, text, df.columns).withColumn("q", model.probability())
    return facts.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)), F.col("q").alias(fresh(df, "quality")),
        (F.col("q") >= threshold).alias(fresh(df, "quality_kept")))
