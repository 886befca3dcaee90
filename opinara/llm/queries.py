"""One thin query per operator over the test tables, and the SQL each is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import (
    bpe, jaccard, langid, licences, links, lm, mixing, negatives, neighbours, oracle, packing, periods, quality, secrets, sharding,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark, sf_dir):
    # A document's source stands for its host and its declared language for the page's markup; addresses it has none.
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return langid.identify(docs, host="source", declared="lang", label="lang").select(
        "doc_id", "language", "probability", F.col("accepted").alias("kept"))


@query
def page_language_id(spark, sf_dir):
    """The same operator on pages: markup language, address suffix and host; text likelihoods from documents."""
    pages = _table(spark, sf_dir, "pages")
    clues = pages.select(
        "page_id", langid.visible_text(F.col("html")).alias("text"), langid.declared_language(F.col("html")).alias("declared"),
        langid.host_of(F.col("url")).alias("host"), langid.suffix_of(F.col("url")).alias("suffix"))
    model = langid.fit(_table(spark, sf_dir, "documents"), "text", "lang")
    return langid.identify(clues, host="host", declared="declared", suffix="suffix", model=model).select(
        "page_id", "declared", "language", "probability", "accepted")


@query
def op2_jaccard_join(spark, sf_dir):
    return jaccard.components(_table(spark, sf_dir, "documents"))


@query
def jaccard_links(spark, sf_dir):
    """The same operator with all its links: to how many other documents each one links."""
    return links.link_counts(_table(spark, sf_dir, "documents"))


@query
def op3_lm_scoring(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score(_table(spark, sf_dir, "documents"), held_out)


@query
def op4_sharding(spark, sf_dir):
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


@query
def op5_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    facts = quality.measure(docs, "text", ["doc_id"])
    model = quality.fit(quality.measure(docs, "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return facts.withColumn("quality", model.probability()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"))


@query
def op8_bpe(spark, sf_dir):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


@query
def op9_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op9_mixing"] = r"""
WITH rows AS (
    SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS lim,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
               WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
    FROM rows GROUP BY source),
-- The level: for each number of filled sources, what would be left for the others by weight.
filled AS (
    SELECT a.source, a.lim / a.w AS ratio,
           ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE
             - coalesce((SELECT sum(b.lim) FROM sources b WHERE (b.lim / b.w, b.source) < (a.lim / a.w, a.source)), 0))
           / ((SELECT sum(w) FROM sources)
             - coalesce((SELECT sum(b.w) FROM sources b WHERE (b.lim / b.w, b.source) < (a.lim / a.w, a.source)), 0))
           AS level, a.lim, a.w
    FROM sources a),
final AS (SELECT arg_min(level, (ratio, source)) FILTER (WHERE level * w <= lim) AS level FROM filled),
targets AS (
    SELECT s.source, source_size,
           CASE WHEN f.level IS NULL OR f.level * w > lim THEN lim ELSE f.level * w END AS target
    FROM sources s, final f),
placed AS (
    SELECT r.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
           (sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (budget // greatest(source_size, 1))
        + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed"""


@query
def op6_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_paths(docs, secrets.ledger_scratch(docs))
    base = [r.kind for r in secrets.BASE_RULES]
    findings = F.col("findings")

    def count(kind: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(secrets.digest(findings, base), 256).alias("base_sha256"),
                        secrets.digest(findings).alias("spans"))


ORACLE["jaccard_links"] = oracle.jaccard_links()
ORACLE["op6_secret_scan"] = oracle.secret_scan()


@query
def op7_licence_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licences")
    best = F.array_max(F.transform(found, lambda x: x["dice"]))
    first = F.array_min(F.transform(F.filter(found, lambda x: x["dice"] == best), lambda x: x["licence"]))
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["licence"])))
    return licences.scan(docs).select(
        "doc_id", F.size("licences").cast("long").alias("n_matches"), first.alias("licence"), best.alias("dice"),
        F.array_join(names, ",").alias("licences"))


ORACLE["op7_licence_scan"] = oracle.licence_scan()


@query
def op10_nearest_neighbours(spark, sf_dir):
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_hard_negatives(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    rows = rows.select("vec_id", label.alias("label"), F.when(finite, whole).alias("vector"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


ORACLE["op12_hard_negatives"] = oracle.hard_negatives()


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth document by a hash of its id gets a periodic end, as the contract of op13 lays down."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumns({"_g": F.floor(h / 10), "_words": F.when(h % 10 == 0, words)})
    n = F.size("_words")
    docs = docs.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    place = F.sequence(F.lit(0), n - 1)
    moved = F.transform(place, lambda i: F.get("_words", F.when(i < F.col("_a"), i).otherwise(
        F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return docs.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periods.detect(_planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs")
    longest = F.sort_array(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    first = F.get(longest, F.lit(0))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("first", first).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("first.s").alias("start"), (-F.col("first.l")).alias("length"),
        F.col("first.p").alias("period"),
        F.expr("(1000 * -first.l) div first.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
