"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256.  The ledger holds one row for each (blob, rule, rule version)
that was scanned, with the spans found, also where there are none.  A scan looks at unseen pairs only,
appends them to the ledger, and joins findings back to all paths that hold the blob.  All work is built-in
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.frames import fresh, named
from opinara.session import scratch_path

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those that do not match ``keep`` as a whole are dropped."""

    kind: str
    version: int
    pattern: str
    keep: str = ""


_ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
           r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?")
# Every match holds ':' or '='; a run of value characters that reaches the end of the match has 6 or more.
BASE_RULES: tuple[Rule, ...] = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]+", "^" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}$"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Formats of credentials that their issuers document (fixed values).
MORE_RULES: tuple[Rule, ...] = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def find(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches, in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths give all positions.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    # Running sums over as many steps as there are matches; a state holds the spans so far.
    empty = F.lit([]).cast(SPANS)
    last = lambda spans: F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))

    def grow(spans: Column, step: Column) -> Column:
        start = last(spans) + F.length(step["b"])
        span = F.struct(start.alias("start"), (start + F.length(step["m"])).alias("end"))
        return F.concat(spans, F.array(span))

    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches,
                       lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    spans = F.aggregate(steps, empty, grow)
    if rule.keep:
        # keep is about the match itself, so kept spans follow from the pairs.
        pairs = F.zip_with(spans, matches, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        spans = F.transform(F.filter(pairs, lambda p: p["m"].rlike(rule.keep)), lambda p: p["s"])
    return F.when(F.regexp_like(text, pattern), spans).otherwise(empty)


def scan(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule, version) pairs in ``versions`` (blob, text) that ``ledger`` does not have."""
    known = ledger.select("blob", "rule", "version").distinct()
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    seen = known.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    # One text for each blob; copies are alike, so any will do.
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    due = blobs.join(seen, "blob", "left").withColumn(
        "due", F.array_except(wanted, F.coalesce("seen", F.lit([]).cast("array<struct<rule:string,version:int>>"))))
    found = due.filter(F.size("due") > 0).select("blob", F.array(*(
        F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
            F.when(F.array_contains("due", F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"))),
                   find(F.col("text"), r)).alias("spans"))
        for r in rules)).alias("results"))
    rows = found.select("blob", F.explode("results").alias("r")).select("blob", "r.rule", "r.version", "r.spans")
    return rows.filter(F.col("spans").isNotNull())


def scan_paths(df: DataFrame, ledger_path: str, text: str = "text", rules: Sequence[Rule] = RULES,
               ledger_exists: bool = False) -> DataFrame:
    """All rows and columns of ``df`` plus ``findings``: array of (kind, start, end) by start, then order of rules.

    Null texts count as empty and have no findings; copies share their blob's scan; an empty table leaves the ledger
    as it is.  The column gets a suffix if ``df`` has one of that name.  Re-running after a failure scans
    what is not in the ledger; a pair that was written twice counts once.
    """
    spark = df.sparkSession
    if ledger_exists:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    else:
        # Empty without Python data, which would start a second pool of Python workers.
        ledger = spark.range(0).select(F.from_json(F.lit(None).cast("string"), LEDGER).alias("row")).select("row.*")
    blob, findings, hit = fresh(df, "_blob"), fresh(df, "findings"), fresh(df, "_hit")
    content = F.coalesce(named(df, text).cast("string"), F.lit(""))
    addressed = df.withColumn(blob, F.sha2(content, 256))
    scan(addressed.select(F.col(blob).alias("blob"), content.alias("text")), ledger, rules).write.mode("append").parquet(
        ledger_path)
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    current = reduce(lambda a, b: a | b, ((F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules))
    hits = spark.read.schema(LEDGER).parquet(ledger_path).filter(current & (F.size("spans") > 0))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("place"),
                                                    F.col("rule").alias("kind"), s["end"].alias("end")))
    by_blob = hits.select("blob", spans.alias("s")).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s")).select(
        F.col("blob").alias(hit),
        F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                            s["end"].alias("end"))).alias(findings))
    joined = addressed.join(by_blob, F.col(blob) == F.col(hit), "left").drop(hit, blob)
    none = F.lit([]).cast("array<struct<kind:string,start:int,end:int>>")
    return joined.withColumn(findings, F.coalesce(F.col(findings), none))


def digest(findings: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the findings (of ``kinds`` only, if given), joined by commas."""
    some = findings if kinds is None else F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(text: Column, findings: Column, mask: str = "<secret>") -> Column:
    """The text with every finding masked; overlapping and touching findings get one mask."""
    covered = "array<struct<start:int,end:int>>"

    def merge(done: Column, f: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        widened = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))))
        added = F.concat(done, F.array(F.struct(f["start"].alias("start"), f["end"].alias("end"))))
        return F.when(f["start"] <= last["end"], widened).otherwise(added)

    merged = F.aggregate(findings, F.lit([]).cast(covered), merge)
    # Text before each mask runs from the end of the one before.
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    ends = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(F.size(findings) == 0, text).otherwise(F.array_join(pieces, mask))


def ledger_scratch(df: DataFrame) -> str:
    """A fresh ledger below the shared folder."""
    return scratch_path(df.sparkSession, "ledger")


