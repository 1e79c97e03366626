"""The append-only log of prediction events (JSON lines)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.contract import EVENT_NUMERIC, EVENT_TEXT, EVENT_TEXT_SCHEMA
from variantloom.functions.values import to_number
from variantloom.sources.sinks import without_nonfinite


def append_event_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per day.

    An event without its own ``timestamp`` gets the current UTC time; keys are in name order.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    given = F.col("timestamp").cast("string") if "timestamp" in events.columns else F.lit(None).cast("string")
    stamped = without_nonfinite(events).withColumn("timestamp", F.coalesce(given, now))
    stamped = stamped.withColumn("day", F.substring("timestamp", 1, 10))
    columns = sorted(c for c in stamped.columns if c != "day")
    # few, evenly sized files per day; a very busy day is split over several tasks
    by_day = stamped.select(*columns, "day").hint("rebalance", F.col("day"))
    writer = by_day.write.mode("append").partitionBy("day")
    writer.option("ignoreNullFields", False).json(path)


def scan_event_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Events with typed numbers; blank and malformed lines are skipped, non-finite numbers NULL.

    Lines are parsed as text fields first: a number written as text, or text in a number field,
    never costs the rest of its event. ``day`` is the folder a log is partitioned by, so a filter on
    it reads only those folders; a log without day folders takes it from the timestamp.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    partitioned = "day" in lines.columns
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", EVENT_TEXT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"),
        *([F.col("day").cast("string").alias("folder")] if partitioned else []),
    )
    day = F.col("folder") if partitioned else F.substring("e.timestamp", 1, 10)
    good = parsed.where(F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())
    return good.select(
        *[F.col(f"e.{n}").alias(n) for n in EVENT_TEXT],
        *[to_number(F.col(f"e.{n}")).alias(n) for n in EVENT_NUMERIC],
        F.col("e.prediction").try_cast("double").try_cast("int").alias("prediction"),
        day.alias("day"),
    )


def recent_events(events: DataFrame, limit: int = 100, order: Sequence[str] = ("timestamp",), ties: Sequence[str] = ()) -> DataFrame:
    """The newest ``limit`` events."""
    keys = [F.desc_nulls_last(c) for c in order] + [F.asc_nulls_last(c) for c in ties]
    return events.orderBy(*keys).limit(limit)
