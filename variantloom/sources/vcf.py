"""VCF text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.functions.genomic import allele_kind, normalize_chrom
from variantloom.sources.blockgzip import RANGE_BYTES, text_lines


def parse_vcf_lines(lines: DataFrame, column: str = "value", carry: Sequence[str] = (), dialect: str = "canonical") -> DataFrame:
    """One row per ALT allele of every data line; headers, blank and short lines are skipped."""
    fields = F.split(F.make_valid_utf8(F.col(column)), "\t")
    data = lines.where((F.col(column) != "") & ~F.col(column).startswith("#")).withColumn("_f", fields)
    data = data.where(F.size("_f") >= 5)
    alleles = data.select(
        *carry,
        normalize_chrom(F.col("_f")[0], dialect).alias("chrom"),
        F.col("_f")[1].alias("pos"),
        F.upper(F.col("_f")[3]).alias("ref"),
        F.posexplode(F.split(F.col("_f")[4], ",")).alias("alt_index", "_alt"),
    )
    cleaned = alleles.withColumn("alt", F.upper(F.trim("_alt"))).drop("_alt").where(F.col("alt") != "")
    return cleaned.withColumn("allele_kind", allele_kind(F.col("alt")))


def scan_vcf(spark: SparkSession, paths: str | Sequence[str], dialect: str = "canonical", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """VCF files, plain or gzipped. ``file``, ``block`` and ``line_id`` keep the order of lines. Block gzip is read by many tasks."""
    lines = text_lines(spark, paths, range_bytes).withColumnsRenamed({"split": "block", "line": "line_id"})
    return parse_vcf_lines(lines, carry=["file", "block", "line_id"], dialect=dialect)


def vcf_limit(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` allele rows in file order (1 or more)."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return records.orderBy("file", "block", "line_id", "alt_index").limit(limit)
