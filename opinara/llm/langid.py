"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from hashed character trigrams, counted over all labelled rows.  To their logarithm are added how
likely the declared language and the address suffix are in each language, and the logarithm of the host's prior.  Host
priors are smoothed towards the suffix, suffix priors towards the corpus; all come from grouped aggregates of
what the text alone says.  Evidence that a row lacks (null) adds nothing.

A text may be in none of the languages: beside them stands a model in which all trigrams are alike, with a small prior
of its own.  Foreign scripts and random letters are likelier under it, and no other evidence speaks for or against it.

Trigrams of one text depend on each other, so their likelihood is tempered: a text of n trigrams counts as
``n / (1 + n / TEMPER)`` independent ones, each with the text's mean likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.frames import fresh, named, written

#: Hash buckets of trigrams; with the number of languages this bounds the model.
BUCKETS = 32_768
TEMPER = 40.0
#: Pseudo-counts of host and suffix priors, and of the tables of declared languages and suffixes.
HOST_WEIGHT, SUFFIX_WEIGHT, TABLE_WEIGHT = 20.0, 50.0, 5.0
#: Rows below this posterior probability are rejected, and texts with fewer letters.
LEAST_PROBABILITY, LEAST_LETTERS = 0.5, 1
#: Prior share of texts in no known language.
UNKNOWN = 0.01
#: Languages learned, those with the most letters; texts labelled otherwise teach nothing and are judged like all others.
MOST_LANGUAGES = 256
#: Tables of counts that a task holds before it hands them on.
_HELD = 64
_SLICE_CHARS, _SLICE_ROWS = 1 << 18, 256


@dataclass(frozen=True)
class TextModel:
    """``log_p[language, bucket]`` of the languages in order."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_LETTERS = _letters()


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(from_row, rows, buckets, letters per row)``: letter trigrams with word edges, over whole texts.

    A part of the batch at a time is held as Python strings.
    """
    for start in range(0, len(texts), _SLICE_ROWS):
        for at, *rest in _trigrams(texts.slice(start, _SLICE_ROWS).to_pylist()):
            yield start + at, *rest


def _trigrams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= _SLICE_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        some = [t or "" for t in texts[at:stop]]
        codes = np.frombuffer(("  ".join(some) + "  ").encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 2 for t in some])
        letters = _LETTERS[codes]
        rows = np.searchsorted(ends, np.arange(len(codes)), side="right")
        is_letter = letters != 32
        middle = np.flatnonzero(is_letter)
        before = np.where(middle > 0, letters[middle - 1], 32)
        value = (before.astype(np.uint64) << np.uint64(42)) | (letters[middle].astype(np.uint64) << np.uint64(21)) | letters[
            middle + 1].astype(np.uint64)
        value = value * np.uint64(0x9E3779B97F4A7C15)
        buckets = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS)
        yield at, rows[middle], buckets.astype(np.int64), np.bincount(rows[middle], minlength=len(some))
        at = stop


def fit(df: DataFrame, text: str, label: str, most: int = MOST_LANGUAGES) -> TextModel:
    """Trigram counts of all rows with a label, for the ``most`` languages with the most letters (ties by name).

    A task hands on its counts whenever it holds many labels, so a column of stray labels costs rows, not memory.
    """
    labelled = df.select(named(df, label).cast("string").alias("label"), named(df, text).cast("string").alias("text"))
    labelled = labelled.filter("label IS NOT NULL AND text IS NOT NULL")

    def handed(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for language, table in sorted(counts.items()):
            seen = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(seen)), pa.array(seen, pa.int32()), pa.array(table[seen])],
                names=["language", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for start, rows, buckets, _ in trigrams(batch.column(1)):
                of = labels[start + rows]
                for language in set(of.tolist()):
                    table = counts.setdefault(language, np.zeros(BUCKETS, np.int64))
                    table += np.bincount(buckets[of == language], minlength=BUCKETS)
                if len(counts) >= _HELD:
                    yield from handed(counts)
                    counts = {}
        yield from handed(counts)

    counted = labelled.mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(
        F.sum("n").alias("n"))
    # Languages times buckets bound what reaches the driver, and the number of languages is bounded here.
    counted = written(counted, "trigrams")
    largest = counted.groupBy("language").agg(F.sum("n").alias("letters")).orderBy(F.desc("letters"), "language").limit(most)
    languages = tuple(sorted(r["language"] for r in largest.collect()))
    counted = counted.filter(F.col("language").isin(list(languages)))
    table = np.full((len(languages), BUCKETS), 0.5)
    packed = counted.groupBy("language").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    for row in packed.toLocalIterator():
        counts = np.array(row["counts"], np.int64)
        table[languages.index(row["language"]), counts[:, 0]] += counts[:, 1]
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def _with_text_evidence(df: DataFrame, model: TextModel, text: str, evidence: str, letters: str) -> DataFrame:
    table, n_languages = np.ascontiguousarray(model.log_p.T), len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = np.zeros((batch.num_rows, n_languages)), np.zeros(batch.num_rows, np.int64)
            for start, rows, buckets, n in trigrams(batch.column(batch.num_columns - 1)):
                counts[start : start + len(n)] = n
                if len(rows):
                    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    scores[start + rows[first]] = np.add.reduceat(table[buckets], first, axis=0, dtype=np.float64)
            scores *= (1 / (1 + counts / TEMPER))[:, None]
            flat = pa.array(np.round(scores, 6).reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1) * n_languages, pa.int32())
            arrays = [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, flat), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    kept = df.select(*(named(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)),
                     named(df, text).cast("string").alias("t"))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields[:-1])]
    out = kept.mapInArrow(run, ", ".join([*kinds, "e array<double>, l long"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)),
                      F.col("e").alias(evidence), F.col("l").alias(letters))


def _unknown(letters: Column) -> Column:
    """Tempered log likelihood of so many letters under the model of no known language, with its prior."""
    return float(np.log(UNKNOWN / (1 - UNKNOWN))) - float(np.log(BUCKETS)) * letters / (1 + letters / TEMPER)


def _first_of_largest(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def identify(df: DataFrame, text: str = "text", host: str | None = None, declared: str | None = None,
             suffix: str | None = None, label: str | None = None, model: TextModel | None = None) -> DataFrame:
    """All rows and columns of ``df`` plus ``language``, ``probability`` and ``accepted``.

    ``host``, ``declared`` and ``suffix`` name columns of evidence; ``label`` names the column to learn text
    likelihoods from unless ``model`` is given.  ``probability`` is that of ``language``, with no known language as
    one more alternative.  A text without letters (null and empty ones too) is rejected and
    has no language.  Ties go to the language first in order.  Without any language to choose from, nothing is
    accepted.  Labels beyond the ``MOST_LANGUAGES`` with the most letters are no languages to choose from.  Equal rows get
    equal results, an empty table gives an empty one, and clashing names get a suffix.
    """
    model = model or fit(df, text, label)
    languages = list(model.languages)
    language, probability, accepted = (fresh(df, c) for c in ("language", "probability", "accepted"))
    if not languages:
        return df.withColumns({language: F.lit(None).cast("string"), probability: F.lit(None).cast("double"),
                               accepted: F.lit(False)})
    n = len(languages)
    evidence, letters = fresh(df, "_evidence"), fresh(df, "_letters")
    # What the text alone says, per row of evidence columns only: the priors need no texts.
    clues = {"host": host, "declared": declared, "suffix": suffix}
    narrow = df.select(*(F.lit(None).cast("string").alias(k) if c is None else named(df, c).cast("string").alias(k)
                         for k, c in clues.items()), named(df, text).cast("string").alias("text"))
    said = _with_text_evidence(narrow, model, "text", "e", "l").filter(
        (F.col("l") >= LEAST_LETTERS) & (F.array_max("e") >= _unknown(F.col("l"))))
    votes = said.groupBy("host", "suffix", "declared", (_first_of_largest(F.col("e")) - 1).alias("k")).agg(
        F.count("*").alias("n"))
    votes = written(votes, "language-votes")

    def table(*by: str) -> DataFrame:
        counts = F.array(*(F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)))
        return votes.groupBy(*by).agg(counts.alias("c"))

    whole = table().first()
    corpus = np.array(whole["c"] if whole and whole["c"][0] is not None else [0.0] * n) + 1.0
    per_language = corpus.tolist()
    corpus = (corpus / corpus.sum()).tolist()

    def smoothed(counts: Column, parent: Column, weight: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + weight * p) / (total + weight))

    suffixes = table("suffix").filter("suffix IS NOT NULL")
    suffix_prior = suffixes.select(F.col("suffix").alias("s"), smoothed(
        F.col("c"), F.lit(corpus), SUFFIX_WEIGHT).alias("suffix_prior"))
    hosts = table("host", "suffix").filter("host IS NOT NULL").join(
        suffix_prior, F.col("suffix") == F.col("s"), "left")
    # A host seen with several suffixes: its counts add up, its parent is the mean of theirs, by rows.
    rows = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    parent = F.coalesce("suffix_prior", F.lit(corpus))
    host_prior = hosts.groupBy("host").agg(
        F.array(*(F.sum(F.col("c")[i]) for i in range(n))).alias("c"),
        F.array(*(F.sum(parent[i] * rows) / F.sum(rows) for i in range(n))).alias("parent"),
    ).select(F.col("host").alias("h"), F.transform(smoothed(F.col("c"), F.col("parent"), HOST_WEIGHT), lambda p: F.log(p)).alias("prior"))

    def likelihood(column: str) -> DataFrame:
        """Log of how often each language shows this value, relative to the whole corpus."""
        seen = table(column).filter(F.col(column).isNotNull())
        total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        overall = float(sum(per_language))
        ratio = F.zip_with("c", F.lit(per_language), lambda c, m: F.log(
            (c + TABLE_WEIGHT * total / overall) / ((m + TABLE_WEIGHT) * total / overall)))
        return seen.select(F.col(column).alias("value"), ratio.alias("ratio"))

    scored = _with_text_evidence(df, model, text, evidence, letters)
    total = F.col(evidence)
    joins = []
    if host is not None:
        # With a host, its suffix is in the prior already.
        joins.append((host, host_prior.select(F.col("h").alias("value"), F.col("prior").alias("ratio"))))
    elif suffix is not None:
        joins.append((suffix, likelihood("suffix")))
    if declared is not None:
        joins.append((declared, likelihood("declared")))
    for i, (column, values) in enumerate(joins):
        # Written first, so that Spark knows the table's size when it chooses the join.
        values = written(values.select(F.col("value").alias(f"_v{i}"), F.col("ratio").alias(f"_r{i}")), "priors")
        scored = scored.join(values, named(scored, column).cast("string") == F.col(f"_v{i}"), "left")
        nothing = F.lit([float(np.log(p)) for p in corpus]) if column == host and i == 0 else F.lit([0.0] * n)
        total = F.zip_with(total, F.coalesce(F.col(f"_r{i}"), nothing), lambda a, b: a + b)
    if host is None:
        total = F.zip_with(total, F.lit([float(np.log(p)) for p in corpus]), lambda a, b: a + b)
    posterior = fresh(df, "_posterior")
    scored = scored.withColumn(posterior, total)
    top = F.array_max(posterior)
    mass = F.aggregate(posterior, F.lit(0.0), lambda a, x: a + F.exp(x - top)) + F.exp(
        _unknown(F.col(letters)) - top)
    lettered = F.col(letters) >= LEAST_LETTERS
    named_language = F.element_at(F.lit(languages), _first_of_largest(F.col(posterior)))
    done = scored.withColumns({
        language: F.when(lettered, named_language), probability: F.when(lettered, F.round(1.0 / mass, 6))})
    done = done.withColumn(accepted, lettered & (F.col(probability) >= LEAST_PROBABILITY))
    return done.select(*(named(done, c) for c in df.columns), language, probability, accepted)


def declared_language(html: Column) -> Column:
    """Primary tag of the ``lang`` attribute of the root element, in lower case; null without one."""
    tag = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffix_of(url: Column) -> Column:
    """Last label of the host, null for none."""
    label = F.regexp_extract(host_of(url), r"\.([^.]+)$", 1)
    return F.when(label != "", label)


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles, comments and tags, for the likelihood only."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")
