"""Writers: parquet, idempotent stages, JSON summaries and quoted CSV reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantloom.functions.scoring import percent_text, triage_label
from variantloom.functions.values import finite
from variantloom.session import fingerprint, path_exists


def scan_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write and read back, so later steps start from the files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def skip_if_materialized(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: Sequence[str] | None = None, *options: object
) -> DataFrame:
    """Compute a stage only when its finished output is not there yet, or was made from other inputs.

    A folder without the success marker is a broken attempt and is written again. With ``inputs`` the
    names, sizes and times of those files, and the options, are stored beside the stage after it.
    """
    mark = None if inputs is None else fingerprint(spark, inputs, *options)
    if not path_exists(spark, f"{path}/_SUCCESS") or (mark is not None and stored_mark(spark, path) != mark):
        build().write.mode("overwrite").parquet(path)
        if mark is not None:
            store_mark(spark, path, mark)
    return spark.read.parquet(path)


def stored_mark(spark: SparkSession, path: str) -> str | None:
    """The input fingerprint that a stage was finished with."""
    if not path_exists(spark, f"{path}.inputs/_SUCCESS"):
        return None
    row = spark.read.text(f"{path}.inputs").first()
    return row["value"] if row else None


def store_mark(spark: SparkSession, path: str, mark: str) -> None:
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.inputs")


def without_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL at every depth."""

    def clean(c, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(c).cast(kind)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda item: clean(item, kind.elementType))
        if isinstance(kind, T.StructType):
            inner = F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind])
            return F.when(c.isNotNull(), inner)
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def sink_json_summary(summary: DataFrame, path: str) -> DataFrame:
    """A summary (one row by construction) as a single JSON file with keys in name order."""
    ready = without_nonfinite(summary).select(*sorted(summary.columns))
    ready.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return summary.sparkSession.read.schema(ready.schema).json(path)


def batch_report(results: DataFrame, counters: DataFrame) -> DataFrame:
    """Scored batch rows as report cells; the counters of the batch stand on every row.

    ``counters`` is one aggregate row, attached as a scalar subquery.
    """
    names = ["processed", "predicted", "not_found", "failed"]
    total = counters.select(F.struct(*names)).scalar()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    triage = triage_label(F.col("label"), F.col("probability"), F.col("confidence_score"))
    return results.withColumn("_counters", total).select(
        "chrom", "pos", "ref", "alt", "status",
        text("prediction").alias("prediction"),
        text("label").alias("label"),
        F.coalesce(triage, F.lit("")).alias("triage"),
        percent_text(F.col("probability")).alias("probability_percent"),
        percent_text(F.col("confidence_score")).alias("confidence_percent"),
        text("message").alias("message"),
        *[F.col(f"_counters.{n}").alias(n) for n in names],
    )


def review_report(queue: DataFrame) -> DataFrame:
    """Review history as report cells."""
    triage = triage_label(F.col("label"), F.col("probability"), F.col("confidence"))
    return queue.select(
        F.col("ts").cast("string").alias("timestamp"), "variant", "source",
        F.coalesce(F.nullif("review_status", F.lit("")), F.lit("Needs review")).alias("review_status"),
        F.col("label").alias("prediction"),
        triage.alias("triage"),
        percent_text(F.col("probability")).alias("probability_percent"),
        percent_text(F.col("confidence")).alias("confidence_percent"),
    )


def sink_csv_report(report: DataFrame, path: str) -> DataFrame:
    """All cells quoted, quotes doubled; the files read back as text cells."""
    options = {"header": True, "quote": '"', "escape": '"'}
    report.write.mode("overwrite").options(**options).option("quoteAll", True).csv(path)
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in report.schema])
    return report.sparkSession.read.schema(schema).options(**options).csv(path)


def csv_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Write a table as CSV with a header and read it back with its own types."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
