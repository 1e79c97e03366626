"""Continuous monitoring and scoring: the batch operators behind a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from variantloom.contract import MONITORED_FEATURES
from variantloom.functions.values import to_number
from variantloom.operators import monitor
from variantloom.operators.ingest import rename_monitoring_columns
from variantloom.operators.lookup import lookup
from variantloom.operators.scoring import Scorer, batch_events, formula_scorer, vcf_batch_score
from variantloom.streaming.feeds import append_stream, event_time, merge_closed, read_state, read_windows, write_updates, write_windows

MIN_INTERVAL_SECONDS = 30


def stream_event_counts(events: DataFrame) -> DataFrame:
    return monitor.event_counts(event_time(events))


def stream_error_increase(events: DataFrame) -> DataFrame:
    return monitor.error_increase(event_time(events))


def stream_latency_buckets(events: DataFrame) -> DataFrame:
    """Windowed bucket sums; ``monitor.bucket_quantile`` turns each output row into its p95."""
    return monitor.latency_buckets(event_time(events))


def stream_pathogenic_rate(events: DataFrame) -> DataFrame:
    return monitor.pathogenic_share(event_time(events))


def stream_lookup_outcomes(lookups: DataFrame) -> DataFrame:
    return monitor.lookup_outcomes(event_time(lookups))


def stream_dedupe_events(events: DataFrame, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Each event once; its key is remembered only as long as the watermark lasts."""
    return event_time(events).dropDuplicatesWithinWatermark(list(key))


def stream_lookups(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests of a stream with ``lookup_status`` from a join with the static store: found, not_found or error."""
    position = F.trim(F.col("pos").cast("string")).try_cast("bigint")
    status = F.when(position.isNull(), "error").when(F.col("found"), "found").otherwise("not_found")
    return lookup(requests, store).withColumn("lookup_status", status)


def run_to_table(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Process what is available now and return the current row of every window; ``keys`` has ``window_start``."""
    write_windows(stream, out, checkpoint, keys).awaitTermination()
    merge_closed(spark, out)
    return read_windows(spark, out).drop("_batch")


# --- drift ------------------------------------------------------------------------------


def batch_moments(events: DataFrame, batch_id: int = 0) -> DataFrame:
    """Rows, NULLs, and (count, mean, sum of squared deviations) of each monitored feature of a micro-batch."""
    current = rename_monitoring_columns(events)
    stats: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    entries = []
    for f in MONITORED_FEATURES:
        x = to_number(F.col(f))
        stats += [F.count(x).alias(f"n_{f}"), F.count_if(F.col(f).isNull()).alias(f"z_{f}"), F.avg(x).alias(f"m_{f}"), F.var_pop(x).alias(f"v_{f}")]
        n = F.col(f"n_{f}").cast("double")
        moments = F.struct(n.alias("n"), F.coalesce(f"m_{f}", F.lit(0.0)).alias("mean"), (n * F.coalesce(f"v_{f}", F.lit(0.0))).alias("m2"))
        entries.append(F.struct(F.lit(f).alias("feature"), F.col("_rows").alias("rows"), F.col(f"z_{f}").alias("nulls"), moments.alias("moments")))
    return current.agg(*stats).select(F.inline(F.array(*entries)))


def fold_moments(parts: DataFrame) -> DataFrame:
    """One row per feature: moments are merged by their means, so large values lose no digits."""

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + delta * share).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = F.aggregate(F.array_sort(F.collect_list("moments")), none, merge)  # the last state and one batch
    return parts.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), merged.alias("moments"))


def merged_moments(state: DataFrame) -> DataFrame:
    """Means, deviations and missing rates of everything seen so far."""
    n, m = F.col("moments.n"), F.col("moments")
    return state.select(
        "feature", F.when(n > 0, m["mean"]).alias("mean"), F.sqrt(F.try_divide(m["m2"], n)).alias("std"),
        F.try_divide(F.col("nulls").cast("double"), F.col("rows")).alias("missing_rate"), "rows",
    )


def stream_drift(events: DataFrame, out: str, checkpoint: str, interval_seconds: int | None = None) -> StreamingQuery:
    """Keep the moments of the monitored features; a check never reads the log again.

    ``interval_seconds`` sets a running check, at least 30 seconds apart; without it the
    available events are processed once.
    """
    trigger = None
    if interval_seconds is not None:
        trigger = {"processingTime": f"{max(MIN_INTERVAL_SECONDS, int(interval_seconds))} seconds"}
    return write_updates(events, out, checkpoint, fold_moments, batch_moments, trigger=trigger)


def current_drift(spark: SparkSession, out: str, reference_moments: DataFrame) -> DataFrame:
    """Drift of everything seen so far against stored reference moments (four rows each)."""
    return monitor.compare_moments(reference_moments, merged_moments(read_state(spark, out)))


# --- scoring ----------------------------------------------------------------------------


def stream_score_variants(
    requests: DataFrame, store: DataFrame, out: str, checkpoint: str, scorer: Scorer = formula_scorer, trigger: dict | None = None
) -> StreamingQuery:
    """Score a stream of requests against the static store and append the prediction events."""
    events = batch_events(vcf_batch_score(requests, store, scorer), endpoint="/api/predict", source="stream")
    return append_stream(events.withColumn("timestamp", F.current_timestamp()), out, checkpoint, trigger=trigger)
