"""The corpus pipeline: documents to token digests in stages, each written before the next one reads it.

Every stage takes and gives null and repeated ids, null, empty and very long texts and repeated rows as its operator does, and an
empty table gives an empty one; columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm import bpe, partenum, quality, secrets, winnow
from variantloom.session import delete_tables, materialize, noted, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.filter_kept(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.75."""
    return partenum.keep_first(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 5 percent or more of their words in passages of the benchmark."""
    return winnow.clean_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows the text."""
    found, _ = secrets.scan_documents(docs.select(*COLUMNS))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("found")))
    n_chars = F.when(F.size("found") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars.cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.digests(docs, *bpe.public_vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[tuple[str, str], list[str]] = {}  # by application and stage: tables that its result reads


def _in_turn(stages: list[tuple[str, Stage]]) -> list[tuple[str, Stage]]:
    """The stages, each of which first deletes what the stage before it left: that one's rows are stored by now."""

    def turn(before: str, name: str, stage: Stage) -> Stage:
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            delete_tables(spark, _LEFT.pop((app, before), []))
            with noted(spark) as made:
                result = stage(spark, docs, sf_dir)
            _LEFT.setdefault((app, name), []).extend(made)
            return result

        run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
        return run_stage

    names = ["", *[name for name, _ in stages]]
    return [(name, turn(before, name, stage)) for before, (name, stage) in zip(names[:-1], stages, strict=True)]


STAGES: list[tuple[str, Stage]] = _in_turn([
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("tokens", tokens),
])
ORACLE_SQL = None  # the quality model and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored and read again by the next, then deleted."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            stored = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            result = made.pop()
        delete_tables(spark, held)
        docs, held = stored, [result]
    return STAGES[-1][1](spark, docs, sf_dir)
