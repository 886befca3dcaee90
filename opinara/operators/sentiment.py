"""Review sentiment: valence lexicon, pluggable model, or a supplied label table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.functions import labels
from opinara.functions.lookup import dictionary
from opinara.functions.numbers import half_even
from opinara.functions.text import with_computed
from opinara.functions.valence import Valences

# A scorer takes whole texts and returns one (label, score) per text.
Scorer = Callable[[list[str]], Sequence[tuple[str, float]]]


def _compound(total: Column) -> Column:
    return half_even(total / F.sqrt(total * total + lexicons.NORMALISATION), 4)


def _labelled(df: DataFrame, total: Column) -> DataFrame:
    """Evaluate the valence total once, then derive the three sentiment columns from it."""
    scored = with_computed(df, _valence=total).withColumn("compound", _compound(F.col("_valence")))
    label = labels.sentiment_of(F.col("compound"))
    return (
        scored.withColumn("sentiment", label)
        .withColumn("sentiment_score", labels.score_of(F.col("compound")))
        .withColumn("sentiment_label_num", labels.sentiment_number(label))
        .drop("compound", "_valence")
    )


def token_sentiment(df: DataFrame, valences: Mapping[str, float] = lexicons.VALENCES) -> DataFrame:
    """Sum the valences of ``tokens``, without context rules."""
    value = dictionary(valences)
    hits = F.filter("tokens", lambda word: word.isin(list(valences)))
    total = F.aggregate(hits, F.lit(0.0), lambda acc, word: acc + F.coalesce(value(word), F.lit(0.0)))
    return _labelled(df, total)


def _phrase_pattern(phrases: Iterable[str]) -> str | None:
    """An alternation that finds, from left to right, the longest of the given phrases of several words.

    It is meant for words set in single blanks each (`` one  two ``), so that a match takes whole words and their own blanks only.
    """
    split = {tuple(p.lower().split()) for p in phrases}
    several = sorted((p for p in split if len(p) > 1), key=lambda p: (-len(p), p))
    quoted = (" " + "  ".join(re.sub(r"([^\w\s])", r"\\\1", word) for word in p) + " " for p in several)
    return f"(?iu){'|'.join(quoted)}" if several else None


def with_phrases(df: DataFrame, column: str, phrases: Iterable[str]) -> DataFrame:
    """Join the words of an array column that make up a phrase, as one element with single blanks.

    The leftmost phrase wins and, of those that begin there, the longest; phrases do not overlap; case does not matter and is
    kept.  Rows without a phrase keep their array as it is.  One pass of one automaton over the row's words.
    """
    pattern = _phrase_pattern(phrases)
    if pattern is None:
        return df

    def separate(piece: Column) -> Column:
        return F.filter(F.split(piece, " +"), lambda w: w != "")

    def joined(phrase: Column) -> Column:
        return F.when(phrase.isNull(), F.array().cast("array<string>")).otherwise(
            F.array(F.regexp_replace(F.trim(phrase), " +", " ")))

    staged = df.withColumn("_text", F.concat(F.lit(" "), F.array_join(column, "  "), F.lit(" ")))
    between = F.split("_text", pattern)
    found = F.regexp_extract_all("_text", F.lit(pattern), 0)
    merged = F.flatten(F.zip_with(between, found, lambda piece, phrase: F.concat(separate(piece), joined(phrase))))
    return staged.withColumn(column, F.when(F.col("_text").rlike(pattern), merged).otherwise(F.col(column))).drop("_text")


def lexicon_sentiment(
    df: DataFrame, valences: Mapping[str, float] = lexicons.VALENCES, *,
    negators: Sequence[str] = lexicons.NEGATORS, boosters: Mapping[str, float] = lexicons.BOOSTERS,
) -> DataFrame:
    """Rule-based valence scoring of ``clean_text`` with the published constants.

    Keys of several words, in any of the lists, are phrases: where one occurs (see ``with_phrases``) its words count as one word
    with the phrase's own value, to which degree words, negation and the other rules apply, and its parts mean
    nothing.  Emoticons are words like others.

    The rules are array operations on the word numbers of a chunk of texts (``functions.valence``), so a word is looked up once for
    each task that meets it: no explode and no shuffle, whatever the length of the review.
    """
    valences, boosters = ({" ".join(k.split()): float(v) for k, v in m.items()} for m in (valences, boosters))
    rules = Valences(valences, boosters, [" ".join(n.split()) for n in negators])

    @F.arrow_udf("double")
    def total(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return rules.of_texts(texts)

    def number_of(mark: str) -> Column:
        return F.octet_length("clean_text") - F.octet_length(F.replace("clean_text", F.lit(mark), F.lit("")))

    staged = with_computed(df, _total=total("clean_text"))
    exclamations, questions = number_of("!"), number_of("?")
    emphasis = F.least(exclamations, F.lit(4)) * 0.292 + F.when(questions <= 1, 0.0).when(
        questions <= 3, questions * 0.18).otherwise(0.96)
    return _labelled(staged, F.col("_total") + F.signum("_total") * emphasis).drop("_total")


def model_sentiment(
    df: DataFrame, load_scorer: Callable[[], Scorer], *, batch_size: int = 16, text_col: str = "clean_text"
) -> DataFrame:
    """Score with a model that ``load_scorer`` builds once per Python worker task.

    Whole texts are handed over; shortening them to a model's window is the scorer's business.
    """

    @F.pandas_udf("struct<label:string,score:double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for texts in batches:
            values = texts.tolist()
            rows: list[tuple[str, float]] = []
            for start in range(0, len(values), batch_size):
                rows.extend(scorer(values[start:start + batch_size]))
            yield pd.DataFrame(rows, columns=["label", "score"])

    scored = with_computed(df, _scored=score(F.col(text_col)))
    return _from_label(scored, F.col("_scored.label"), F.col("_scored.score")).drop("_scored")


def label_sentiment(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """Use a label that is already in the table (for instance one scored elsewhere)."""
    return _from_label(df, label, score)


def _from_label(df: DataFrame, label: Column, score: Column) -> DataFrame:
    return (
        df.withColumn("sentiment", label)
        .withColumn("sentiment_score", score)
        .withColumn("sentiment_label_num", labels.sentiment_number(label))
    )


def run_sentiment(df: DataFrame, method: str = "lexicon", **options) -> DataFrame:
    """Dispatch on the method name."""
    methods = {"lexicon": lexicon_sentiment, "tokens": token_sentiment, "model": model_sentiment}
    if method not in methods:
        raise ValueError(f"unknown sentiment method {method!r}; use one of {sorted(methods)}")
    return methods[method](df, **options)
