"""One monitoring round over the event log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.operators import monitor
from variantloom.session import materialize
from variantloom.sources.events import scan_event_log
from variantloom.sources.sinks import sink_json_summary


@dataclass
class MonitoringRound:
    summary: DataFrame
    counters: DataFrame
    drift: DataFrame
    alerts: DataFrame


def run_once(spark: SparkSession, event_log: str, reference: DataFrame, summary_path: str, hold_minutes: int = 1) -> MonitoringRound:
    """Summary, counters, drift (also written as JSON) and alert states.

    The log is parsed once into a stored table. ``reference`` is the training table, or its stored
    ``feature_moments``, which later rounds then need not compute again. Alert windows read only the
    last days of the events.
    """
    events = materialize(scan_event_log(spark, event_log).withColumn("ts", F.col("timestamp").try_cast("timestamp")), "events")
    moments = reference if set(monitor.MOMENTS) <= set(reference.columns) else materialize(monitor.feature_moments(reference), "reference-moments")
    drift = sink_json_summary(monitor.drift_summary(moments, events), summary_path)
    newest = events.agg(F.date_trunc("minute", F.max("ts")).alias("t"), F.max("day").alias("day")).first()
    held = events.where(F.col("ts") < F.lit(newest["t"]) - F.make_interval(mins=F.lit(hold_minutes)))
    before = monitor.drift_score(monitor.compare_moments(moments, monitor.current_moments(held)))
    recent = events.where(F.col("day") >= F.date_format(F.date_sub(F.lit(newest["day"]).cast("date"), 1), "yyyy-MM-dd"))
    alerts = monitor.alert_rules(recent, drift, hold_minutes=hold_minutes, drift_before=before)
    return MonitoringRound(monitor.prediction_summary(events, "timestamp"), monitor.counter_metrics(events), drift, alerts)
