"""Corpus pipeline: each stage takes the documents its predecessor kept, as a written Parquet table.

All stages but the last return the columns of ``documents``.  No stage needs a column other than these, and rows with
nulls pass through them as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import bpe, jaccard, langid, mixing, secrets
from opinara.llm.frames import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the others go."""
    identified = langid.identify(docs.select(*COLUMNS), host="source", declared="lang", label="lang")
    return identified.filter("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones, one without an id only if none has one.

    Links are those of five words and 0.8.  Rows are told apart by a hash of all columns, so rows without an id and
    rows that share one are compared like any others; equal rows become one.
    """
    nulls = F.concat(*(F.isnull(c).cast("string") for c in COLUMNS))
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS, nulls))
    groups = jaccard.components(docs, identity="_row", width=5, threshold=jaccard.Threshold(80, 100)).select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = docs.select("_row", "doc_id")
    first = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "_row")
    kept = groups.join(ids, "_row").groupBy("_group").agg(F.min(first)["_row"].alias("_row")).select("_row")
    # Rows of one hash lie together after the join, so equal rows are found without moving texts again.
    return docs.join(kept.hint("shuffle_hash"), "_row", "left_semi").distinct().select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    found = secrets.scan_paths(docs, secrets.ledger_scratch(docs))
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col("findings")))
    length = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.materialise(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("tokenise", tokenise),
]

#: The language model, tokens and components are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
