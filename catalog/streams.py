"""Structured Streaming queries; each is checked against its batch definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query, real, rounded
from catalog.ingest import encoded
from catalog.lookup import resolved_store
from catalog.monitor import WINDOW_SQL, WINDOW_TEXT, _DRIFT_SHOWN, window_text
from variantloom.operators import monitor
from variantloom.session import fresh_path
from variantloom.streaming import alerts, feeds, jobs


def event_feed(t: Tables) -> DataFrame:
    events = t.prediction_events
    return feeds.file_stream(t.spark, t.stored_path("prediction_events"), events.schema)


def settle(t: Tables, stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    return jobs.run_to_table(t.spark, stream, fresh_path(t.spark, label), fresh_path(t.spark, f"{label}-checkpoint"), keys)


@query("stream_event_counts", WINDOW_SQL["event_counts"])
def stream_event_counts(t: Tables):
    return window_text(settle(t, jobs.stream_event_counts(event_feed(t)), "event-counts", ["window_start", "endpoint", "status"]))


@query("stream_error_increase", WINDOW_SQL["error_increase"])
def stream_error_increase(t: Tables):
    return window_text(settle(t, jobs.stream_error_increase(event_feed(t)), "errors", ["window_start"]))


@query("stream_latency_p95", WINDOW_SQL["latency_p95"])
def stream_latency_p95(t: Tables):
    buckets = settle(t, jobs.stream_latency_buckets(event_feed(t)), "latency", ["window_start"])
    return window_text(monitor.bucket_quantile(buckets))


@query("stream_pathogenic_rate", WINDOW_SQL["pathogenic_rate"])
def stream_pathogenic_rate(t: Tables):
    return window_text(settle(t, jobs.stream_pathogenic_rate(event_feed(t)), "rate", ["window_start"]))


@query(
    "stream_lookup_outcomes",
    f"""SELECT {WINDOW_TEXT}, lookup_status, CAST(count(*) AS BIGINT) AS lookups FROM (
      SELECT w.window_start, w.window_end, CASE WHEN r.k_pos IS NULL THEN 'error' WHEN s.chrom IS NULL THEN 'not_found' ELSE 'found' END AS lookup_status
      FROM o_requests r JOIN o_windowed w ON w.event_id = r.request_id % (SELECT max(event_id) + 1 FROM prediction_events)
      LEFT JOIN o_store s ON r.k_chrom = s.chrom AND r.k_pos = s.pos AND r.k_ref = s.ref AND r.k_alt = s.alt) x GROUP BY 1, 2, 3""",
)
def stream_lookup_outcomes(t: Tables):
    """Requests, each at the time of one event, looked up in the store as they arrive."""
    events = t.prediction_events.select(F.col("event_id").alias("_event"), "ts")
    last = events.agg(F.max("_event") + 1).scalar()
    timed = t.variant_requests.withColumn("_event", F.col("request_id") % last).join(events, "_event").drop("_event")
    path = fresh_path(t.spark, "timed-requests")
    timed.write.parquet(path)
    feed = feeds.file_stream(t.spark, path, t.spark.read.parquet(path).schema)
    lookups = jobs.stream_lookups(feed, resolved_store(t))
    return window_text(settle(t, jobs.stream_lookup_outcomes(lookups), "lookups", ["window_start", "lookup_status"]))


@query("stream_drift", f"SELECT {_DRIFT_SHOWN} FROM o_drift")
def stream_drift(t: Tables):
    out = fresh_path(t.spark, "moments")
    jobs.stream_drift(event_feed(t), out, fresh_path(t.spark, "moments-checkpoint")).awaitTermination()
    return rounded(jobs.current_drift(t.spark, out, monitor.feature_moments(encoded(t))))


@query("stream_dedupe_events", "SELECT event_id, endpoint, status, latency_ms FROM prediction_events")
def stream_dedupe_events(t: Tables):
    """Every event is delivered twice."""
    doubled = fresh_path(t.spark, "doubled")
    for _ in range(2):
        t.prediction_events.write.mode("append").parquet(doubled)
    stream = jobs.stream_dedupe_events(feeds.file_stream(t.spark, doubled, t.prediction_events.schema))
    out = fresh_path(t.spark, "deduped")
    feeds.append_stream(stream, out, fresh_path(t.spark, "deduped-checkpoint")).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "endpoint", "status", "latency_ms")


@query(
    "stream_score_variants",
    """SELECT CASE WHEN status = 'predicted' THEN 'success' ELSE 'error' END AS status, chrom, pos, ref, alt, CAST(prediction AS DOUBLE) AS prediction,
      round(probability, 6) AS probability, round(confidence_score, 6) AS confidence_score, CASE WHEN status <> 'predicted' THEN message END AS error
    FROM o_batch WHERE status <> 'not_found'""",
)
def stream_score_variants(t: Tables):
    requests = t.variant_requests
    feed = feeds.file_stream(t.spark, t.stored_path("variant_requests"), requests.schema, files_per_trigger=4)
    out = fresh_path(t.spark, "scored-events")
    jobs.stream_score_variants(feed, resolved_store(t), out, fresh_path(t.spark, "scored-checkpoint")).awaitTermination()
    events = t.spark.read.parquet(out).select("status", "chrom", "pos", "ref", "alt", "prediction", "probability", "confidence_score", "error")
    return real(rounded(events), "prediction")


_MINUTES = """counts AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS minute, count(*) AS events, count(*) FILTER (WHERE status = 'success') AS successes,
    count(*) FILTER (WHERE status = 'error') AS errors FROM prediction_events GROUP BY 1),
  spine AS (SELECT unnest(generate_series(min(minute), max(minute), INTERVAL 1 MINUTE)) AS minute FROM counts),
  dense AS (SELECT s.minute, coalesce(events, 0) AS events, coalesce(successes, 0) AS successes, coalesce(errors, 0) AS errors FROM spine s LEFT JOIN counts c ON s.minute = c.minute),
  long AS (SELECT 'no events in window' AS rule, 'critical' AS severity, minute, events AS n, 'low' AS kind FROM dense
    UNION ALL SELECT 'no successful predictions in window', 'critical', minute, successes, 'low' FROM dense
    UNION ALL SELECT 'prediction errors detected', 'warning', minute, errors, 'high' FROM dense),
  summed AS (SELECT *, sum(n) OVER (PARTITION BY rule ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM long),
  judged AS (SELECT *, CASE WHEN kind = 'low' THEN v < 1 ELSE v > 0 END AS bad FROM summed),
  states AS (SELECT *, CASE WHEN NOT bad THEN 'normal' WHEN lag(bad) OVER w THEN 'firing' ELSE 'pending' END AS plain FROM judged WINDOW w AS (PARTITION BY rule ORDER BY minute)),
  named AS (SELECT *, CASE WHEN plain = 'normal' AND lag(plain) OVER w = 'firing' THEN 'resolved' ELSE plain END AS state FROM states WINDOW w AS (PARTITION BY rule ORDER BY minute)),
  changes AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule ORDER BY minute), 'normal') AS was FROM named)"""
_CHANGES = "SELECT rule, severity, strftime(minute, '%Y-%m-%d %H:%M:%S') AS at, CAST(v AS DOUBLE) AS value, was, state FROM changes WHERE state <> was AND NOT (was = 'resolved' AND state = 'normal')"


def changes_text(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("alert_timeline", f"WITH {_MINUTES} {_CHANGES}")
def alert_timeline(t: Tables):
    return changes_text(alerts.alert_timeline(t.prediction_events))


@query("stream_alerts", f"WITH {_MINUTES} {_CHANGES} AND minute <= (SELECT date_trunc('minute', max(ts) - INTERVAL 10 MINUTE) FROM prediction_events)")
def stream_alerts(t: Tables):
    """The same changes from the stream, as far as its watermark has come."""
    out = fresh_path(t.spark, "alert-changes")
    alerts.run_alerts(event_feed(t), out, fresh_path(t.spark, "alert-checkpoint")).awaitTermination()
    return changes_text(t.spark.read.parquet(out))
