"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the digest of its content. The ledger says which rules, in
which version, have seen a blob and what they found; only pairs of blob and rule version that it lacks
are scanned. Findings come back to all paths by the blob's digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table
from variantloom.session import materialize

SPAN = "array<struct<start: int, kind: int, end: int>>"
LEDGER = "blob_id string, rules array<string>, spans array<struct<start: int, rule: string, end: int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the base kinds in their order, then what this scan adds
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run of 16 or more; shorter runs would be dropped anyway
]
ADDED = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("platform_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,})"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
# end of fixed values
RULES = BASE + ADDED


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule in code points. The text between matches and the matches give the places."""
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def step(state: Column, at: Column) -> Column:
        start = state["pos"] + F.length(at["piece"])
        end = start + F.coalesce(F.length(at["hit"]), F.lit(0))
        value = F.regexp_extract(at["hit"], rule.pattern, rule.group) if rule.group else at["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        found = F.when(at["hit"].isNotNull() & (F.length(value) >= rule.least), F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("found"))
    walked = F.aggregate(F.arrays_zip(pieces.alias("piece"), matches.alias("hit")), start, step)["found"]
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPAN))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows to append: one for each blob of ``versions`` that some rule version has not seen.

    Equal texts are one blob, merged within each task before they are moved. A null text is the empty
    blob. An empty table or a complete ledger gives no rows; repeated ledger rows do no harm.
    """
    all_ids = F.array(*[F.lit(r.id) for r in rules])
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("body")).groupBy(blob_id(F.col("body")).alias("blob_id")).agg(F.first("body").alias("body"))
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    due = F.array_except(all_ids, F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.join(seen, "blob_id", "left").select("blob_id", "body", due.alias("rules")).where(F.size("rules") > 0)
    none = F.array().cast(SPAN)
    found = [F.when(F.array_contains("rules", r.id), rule_spans(F.col("body"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["start"], all_ids[s["kind"]].alias("rule"), s["end"]))
    return todo.select("blob_id", "rules", spans.alias("spans"))


def findings(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``blob_id, found``: the spans that the given rules have left in the ledger, by start, then rule order."""
    ids, kinds = F.array(*[F.lit(r.id) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    current = ledger.where(F.arrays_overlap("rules", ids) & (F.size("spans") > 0))
    known = F.filter(F.array_distinct(F.flatten(F.collect_set("spans"))), lambda s: F.array_contains(ids, s["rule"]))

    def named(s: Column) -> Column:
        number = F.array_position(ids, s["rule"]).cast("int")
        return F.struct(s["start"], number.alias("kind_no"), s["end"], kinds[number - 1].alias("kind"))

    return current.groupBy("blob_id").agg(F.array_sort(F.transform(known, named)).alias("found"))


def join_paths(versions: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns of ``versions`` with ``found``, an empty list where nothing was found.

    A column of that name is replaced. Blobs that many paths share are a skewed key of a plain join,
    which adaptive execution splits.
    """
    hits = findings(ledger, rules).withColumnsRenamed({"blob_id": "_hit_blob_id", "found": "_hit_found"})
    own = versions.drop("found")
    joined = own.join(hits, blob_id(F.col(text)) == F.col("_hit_blob_id"), "left")
    empty = F.array().cast("array<struct<start: int, kind_no: int, end: int, kind: string>>")
    return joined.select(*[F.col(f"`{c}`") for c in own.columns], F.coalesce("_hit_found", empty).alias("found"))


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mask``; null stays null."""

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["pos"]
        kept = F.concat(state["out"], F.substring(text, state["pos"] + 1, s["start"] - state["pos"]), F.lit(mask))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), F.when(new, kept).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(found, start, step, lambda state: F.concat(state["out"], F.substring(text, state["pos"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``found``, and the ledger with this scan's rows, which are stored."""
    known = ledger if ledger is not None else empty_ledger(docs.sparkSession)
    new = materialize(scan_unseen(docs, known, rules), "blob-ledger")
    full = new if ledger is None else known.unionByName(new)
    return join_paths(docs, full, rules), full


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = scan_documents(docs)
    base = F.filter("found", lambda s: s["kind_no"] <= len(BASE))

    def count(number: int, rule: Rule) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == number)).cast("long").alias(f"n_{rule.kind}")

    counts = [count(i, r) for i, r in enumerate(BASE, 1)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
