"""Monitoring and drift queries over the prediction events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query, rounded
from catalog.ingest import encoded
from catalog.lookup import batch
from catalog.oracle import ORACLE_VIEWS
from variantloom.contract import LATENCY_BUCKETS_SECONDS
from variantloom.operators import monitor
from variantloom.session import fresh_path
from variantloom.sources import sinks


@query(
    "prediction_summary",
    """SELECT CAST(count(*) AS BIGINT) AS total_predictions, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS successful_predictions,
      CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS failed_predictions,
      CAST(count(*) FILTER (WHERE status = 'success' AND prediction = 1) AS BIGINT) AS pathogenic_predictions,
      CAST(count(*) FILTER (WHERE status = 'success' AND prediction = 0) AS BIGINT) AS benign_predictions,
      round(count(*) FILTER (WHERE status = 'success' AND prediction = 1) * 1.0 / count(*) FILTER (WHERE status = 'success'), 6) AS pathogenic_rate,
      round(avg(probability) FILTER (WHERE status = 'success'), 6) AS average_probability,
      round(avg(confidence_score) FILTER (WHERE status = 'success'), 6) AS average_confidence, round(avg(latency_ms), 6) AS average_latency_ms,
      CAST(count(*) FILTER (WHERE status = 'success' AND confidence_score < 0.6) AS BIGINT) AS low_confidence_predictions,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_prediction_at FROM prediction_events""",
)
def prediction_summary(t: Tables):
    summary = rounded(monitor.prediction_summary(t.prediction_events))
    return summary.withColumn("latest_prediction_at", F.date_format("latest_prediction_at", "yyyy-MM-dd HH:mm:ss"))


@query("predictions_by_source", "SELECT coalesce(source, 'unknown') AS source, CAST(count(*) AS BIGINT) AS count FROM prediction_events GROUP BY coalesce(source, 'unknown')")
def predictions_by_source(t: Tables):
    return monitor.predictions_by_source(t.prediction_events)


@query("predictions_by_chromosome", "SELECT coalesce(chrom, 'unknown') AS chrom, CAST(count(*) AS BIGINT) AS count FROM prediction_events GROUP BY coalesce(chrom, 'unknown')")
def predictions_by_chromosome(t: Tables):
    return monitor.predictions_by_chromosome(t.prediction_events)


ORACLE_VIEWS["o_counters"] = """
SELECT 'predictions_total' AS metric, concat('endpoint=', endpoint, ',status=', status, ',source=', coalesce(source, 'unknown')) AS labels, CAST(count(*) AS BIGINT) AS value FROM prediction_events GROUP BY 2
UNION ALL SELECT 'prediction_errors_total', concat('endpoint=', endpoint), CAST(count(*) AS BIGINT) FROM prediction_events WHERE status = 'error' GROUP BY 2
UNION ALL SELECT 'prediction_label_total', concat('label=', CASE WHEN prediction = 1 THEN 'pathogenic' ELSE 'benign' END), CAST(count(*) AS BIGINT) FROM prediction_events WHERE prediction IS NOT NULL GROUP BY 2
UNION ALL SELECT 'low_confidence_predictions_total', concat('endpoint=', endpoint), CAST(count(*) AS BIGINT) FROM prediction_events WHERE confidence_score < 0.6 GROUP BY 2
"""


@query(
    "counter_metrics",
    """SELECT * FROM o_counters
    UNION ALL SELECT 'feature_store_lookup_total', concat('status=', CASE WHEN found_in_store THEN 'found' ELSE 'not_found' END), CAST(count(*) AS BIGINT) FROM o_batch GROUP BY 2
    UNION ALL SELECT 'vcf_batch_records_total', concat('status=', status), CAST(count(*) AS BIGINT) FROM o_batch GROUP BY 2""",
)
def counter_metrics(t: Tables):
    return monitor.counter_metrics(t.prediction_events, batch(t))


_EDGES = ", ".join(f"(CAST({le} AS DOUBLE))" for le in LATENCY_BUCKETS_SECONDS)
ORACLE_VIEWS["o_edges"] = f"SELECT le FROM (VALUES {_EDGES}, (CAST('inf' AS DOUBLE))) v(le)"
ORACLE_VIEWS["o_latency"] = """
SELECT endpoint, le, CAST(count(*) FILTER (WHERE greatest(0, latency_ms / 1000) <= le) AS BIGINT) AS bucket_count,
  sum(greatest(0, latency_ms / 1000)) AS latency_sum, CAST(count(*) AS BIGINT) AS latency_count
FROM prediction_events, o_edges GROUP BY endpoint, le
"""


@query("latency_histogram", "SELECT endpoint, CAST(le AS VARCHAR) AS le, bucket_count, round(latency_sum, 6) AS latency_sum, latency_count FROM o_latency")
def latency_histogram(t: Tables):
    edge = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return rounded(monitor.latency_histogram(t.prediction_events).withColumn("le", edge))


@query(
    "latency_p95",
    """SELECT round(CASE WHEN le = CAST('inf' AS DOUBLE) THEN low ELSE low + (le - low) * (0.95 * total - below) / (cum - below) END, 6) AS p95_seconds FROM (
      SELECT le, cum, coalesce(lag(le) OVER (ORDER BY le), 0) AS low, coalesce(lag(cum) OVER (ORDER BY le), 0) AS below, max(cum) OVER () AS total
      FROM (SELECT le, CAST(sum(bucket_count) AS DOUBLE) AS cum FROM o_latency GROUP BY le) m) s WHERE cum >= 0.95 * total AND below < 0.95 * total""",
)
def latency_p95(t: Tables):
    return rounded(monitor.latency_p95(t.prediction_events))


@query("pathogenic_rate_live", "SELECT round(count(*) FILTER (WHERE prediction = 1) * 1.0 / greatest(count(prediction), 1), 6) AS pathogenic_rate FROM prediction_events")
def pathogenic_rate_live(t: Tables):
    return rounded(monitor.pathogenic_rate_live(t.prediction_events))


def _moments(table: str, column: str, feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, avg(CAST({column} AS DOUBLE)) AS mean, stddev_pop(CAST({column} AS DOUBLE)) AS std,
      avg(CASE WHEN {column} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, CAST(count(*) AS BIGINT) AS rows FROM {table}"""


_FEATURES = ["CADD", "SIFT", "PolyPhen", "ALT_FREQ"]


def _drift(events: str) -> str:
    return f"""
SELECT r.feature, r.mean AS reference_mean, r.std AS reference_std, r.missing_rate AS reference_missing_rate, r.rows AS reference_rows,
  c.mean AS current_mean, c.missing_rate AS current_missing_rate, c.rows AS current_rows, abs(c.mean - r.mean) AS mean_delta,
  greatest(r.std, CAST(0.05 AS DOUBLE)) AS threshold, abs(c.mean - r.mean) > greatest(r.std, CAST(0.05 AS DOUBLE)) AS drifted
FROM ({' UNION ALL '.join(_moments('o_encoded', f, f) for f in _FEATURES)}) r
JOIN ({' UNION ALL '.join(_moments(events, f.lower(), f) for f in _FEATURES)}) c ON r.feature = c.feature
"""


ORACLE_VIEWS["o_drift"] = _drift("prediction_events")
ORACLE_VIEWS["o_events_before"] = """SELECT * FROM prediction_events
WHERE ts < (SELECT date_trunc('minute', max(ts)) - INTERVAL 1 MINUTE FROM prediction_events)"""
ORACLE_VIEWS["o_drift_before"] = _drift("o_events_before")
_DRIFT_NUMBERS = ["reference_mean", "reference_std", "reference_missing_rate", "current_mean", "current_missing_rate", "mean_delta", "threshold"]
_DRIFT_SHOWN = "feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in _DRIFT_NUMBERS) + ", reference_rows, current_rows, drifted"


@query("drift_feature_stats", f"SELECT {_DRIFT_SHOWN} FROM o_drift")
def drift_feature_stats(t: Tables):
    stats = monitor.drift_feature_stats(encoded(t), t.prediction_events)
    return rounded(stats.select("feature", *_DRIFT_NUMBERS, "reference_rows", "current_rows", "drifted"))


ORACLE_VIEWS["o_drift_score"] = """
SELECT max(current_rows) AS current_rows, max(reference_rows) AS reference_rows, CAST(count(*) FILTER (WHERE drifted) AS BIGINT) AS drifted_features,
  CAST(count(*) AS BIGINT) AS monitored_features, count(*) FILTER (WHERE drifted) * 1.0 / count(*) AS drift_score, 'ok' AS status FROM o_drift
"""


@query("drift_score", "SELECT * REPLACE (CAST(round(drift_score, 6) AS DOUBLE) AS drift_score) FROM o_drift_score")
def drift_score(t: Tables):
    return rounded(monitor.drift_score(monitor.drift_feature_stats(encoded(t), t.prediction_events)))


@query(
    "drift_profile_report",
    """SELECT feature, round(reference_mean, 6) AS reference_mean, round(current_mean, 6) AS current_mean,
    round(reference_missing_rate, 6) AS reference_missing_rate, round(current_missing_rate, 6) AS current_missing_rate FROM o_drift""",
)
def drift_profile_report(t: Tables):
    return rounded(monitor.drift_profile_report(encoded(t), t.prediction_events))


@query(
    "sink_json_summary",
    """SELECT s.status, s.current_rows, s.reference_rows, s.drifted_features, s.monitored_features, CAST(round(s.drift_score, 6) AS DOUBLE) AS drift_score,
      feature, round(mean_delta, 6) AS mean_delta, drifted FROM o_drift_score s, o_drift""",
)
def sink_json_summary(t: Tables):
    summary = monitor.drift_summary(encoded(t), t.prediction_events)
    back = sinks.sink_json_summary(summary, fresh_path(t.spark, "drift-summary"))
    flat = back.select(
        "status", "current_rows", "reference_rows", "drifted_features", "monitored_features", "drift_score", F.explode("features").alias("f")
    )
    return rounded(flat.select("*", "f.feature", "f.mean_delta", "f.drifted").drop("f"))


@query(
    "dashboard_totals",
    """SELECT 'total_predictions' AS panel, CAST(sum(value) AS DOUBLE) AS value FROM o_counters WHERE metric = 'predictions_total'
    UNION ALL SELECT 'rows_in_drift_window', CAST(max(current_rows) AS DOUBLE) FROM o_drift
    UNION ALL SELECT 'drifted:' || feature, CAST(CAST(drifted AS INT) AS DOUBLE) FROM o_drift""",
)
def dashboard_totals(t: Tables):
    drift = monitor.drift_feature_stats(encoded(t), t.prediction_events)
    return monitor.dashboard_totals(monitor.counter_metrics(t.prediction_events), drift)


_RANGES = {"CADD": 60, "SIFT": 1, "PolyPhen": 1, "ALT_FREQ": 1}


def _bins(table: str, side: str, columns: dict[str, str], chrom: str) -> str:
    parts = [
        f"""SELECT '{f}' AS feature, CASE WHEN x IS NULL OR x < 0 THEN 'missing' ELSE CAST(CAST(least(9, floor(x / {high} * 10)) AS BIGINT) AS VARCHAR) END AS bin, '{side}' AS side
        FROM (SELECT CAST({columns[f]} AS DOUBLE) AS x FROM {table}) s"""
        for f, high in _RANGES.items()
    ]
    return " UNION ALL ".join([*parts, f"SELECT 'CHROM', coalesce({chrom}, 'missing'), '{side}' FROM {table}"])


def _values(table: str, side: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({columns[f]} AS DOUBLE) AS value, '{side}' AS side FROM {table} WHERE {columns[f]} IS NOT NULL" for f in _RANGES)


_REF = {f: f for f in _RANGES}
_CUR = {f: f.lower() for f in _RANGES}


@query(
    "distribution_drift",
    f"""WITH b AS (SELECT feature, bin, CAST(count(*) FILTER (WHERE side = 'r') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE side = 'c') AS DOUBLE) AS c FROM (
        {_bins('o_encoded', 'r', _REF, 'CHROM')} UNION ALL {_bins('prediction_events', 'c', _CUR, 'chrom')}) u GROUP BY feature, bin),
      s AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), CAST(0.0001 AS DOUBLE)) AS p, greatest(c / sum(c) OVER (PARTITION BY feature), CAST(0.0001 AS DOUBLE)) AS q FROM b),
      d AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi, sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)) AS js_distance FROM s GROUP BY feature),
      v AS (SELECT feature, value, CAST(count(*) FILTER (WHERE side = 'r') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE side = 'c') AS DOUBLE) AS c FROM (
        {_values('o_encoded', 'r', _REF)} UNION ALL {_values('prediction_events', 'c', _CUR)}) u GROUP BY feature, value),
      k AS (SELECT feature, max(abs(cr / tr - cc / tc)) AS ks FROM (
        SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS tr, sum(c) OVER (PARTITION BY feature) AS tc
        FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)) x GROUP BY feature)
    SELECT d.feature, round(psi, 6) AS psi, round(js_distance, 6) AS js_distance, round(ks, 6) AS ks FROM d LEFT JOIN k ON d.feature = k.feature""",
)
def distribution_drift(t: Tables):
    return rounded(monitor.distribution_drift(encoded(t), t.prediction_events))


# sliding windows: an event belongs to the five one-minute starts that cover it
ORACLE_VIEWS["o_windowed"] = """
SELECT e.*, date_trunc('minute', ts) - to_minutes(o.k) AS window_start, date_trunc('minute', ts) - to_minutes(o.k) + INTERVAL 5 MINUTE AS window_end
FROM prediction_events e, (SELECT CAST(unnest(range(5)) AS INT) AS k) o
"""
WINDOW_TEXT = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end"
WINDOW_SQL = {
    "event_counts": f"SELECT {WINDOW_TEXT}, endpoint, status, CAST(count(*) AS BIGINT) AS events FROM o_windowed GROUP BY 1, 2, endpoint, status",
    "error_increase": f"SELECT {WINDOW_TEXT}, CAST(count(*) AS BIGINT) AS errors FROM o_windowed WHERE status = 'error' GROUP BY 1, 2",
    "pathogenic_rate": f"""SELECT {WINDOW_TEXT}, CAST(count(*) FILTER (WHERE prediction = 1) AS BIGINT) AS pathogenic, CAST(count(*) AS BIGINT) AS labelled,
      round(count(*) FILTER (WHERE prediction = 1) * 1.0 / greatest(count(*), 1), 6) AS pathogenic_rate FROM o_windowed WHERE prediction IS NOT NULL GROUP BY 1, 2""",
    "latency_p95": f"""SELECT window_start, window_end, CAST(total AS BIGINT) AS latency_count,
      round(CASE WHEN le = CAST('inf' AS DOUBLE) THEN low ELSE low + (le - low) * (0.95 * total - below) / (cum - below) END, 6) AS p95_seconds FROM (
        SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cum) OVER w, 0) AS below, max(cum) OVER (PARTITION BY window_start) AS total FROM (
          SELECT {WINDOW_TEXT}, le, CAST(count(*) FILTER (WHERE latency_ms / 1000 <= le) AS DOUBLE) AS cum FROM o_windowed, o_edges GROUP BY 1, 2, le) m
        WINDOW w AS (PARTITION BY window_start ORDER BY le)) s WHERE cum >= 0.95 * total AND below < 0.95 * total""",
}


def window_text(df):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return rounded(df.withColumns(shown))


@query("event_counts_windowed", WINDOW_SQL["event_counts"])
def event_counts_windowed(t: Tables):
    return window_text(monitor.event_counts(t.prediction_events))


@query("error_increase_windowed", WINDOW_SQL["error_increase"])
def error_increase_windowed(t: Tables):
    return window_text(monitor.error_increase(t.prediction_events))


@query("pathogenic_rate_windowed", WINDOW_SQL["pathogenic_rate"])
def pathogenic_rate_windowed(t: Tables):
    return window_text(monitor.pathogenic_share(t.prediction_events))


@query("latency_p95_windowed", WINDOW_SQL["latency_p95"])
def latency_p95_windowed(t: Tables):
    return window_text(monitor.bucket_quantile(monitor.latency_buckets(t.prediction_events)))


@query(
    "alert_rules",
    """WITH n AS (SELECT date_trunc('minute', max(ts)) AS t FROM prediction_events),
      w AS (SELECT count(*) FILTER (WHERE a) AS e0, count(*) FILTER (WHERE b) AS e1, count(*) FILTER (WHERE a AND status = 'success') AS s0,
        count(*) FILTER (WHERE b AND status = 'success') AS s1, count(*) FILTER (WHERE a AND status = 'error') AS r0, count(*) FILTER (WHERE b AND status = 'error') AS r1
        FROM (SELECT status, ts >= t - INTERVAL 5 MINUTE AND ts < t AS a, ts >= t - INTERVAL 6 MINUTE AND ts < t - INTERVAL 1 MINUTE AS b FROM prediction_events, n) x)
    SELECT rule, severity, CAST(v AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold,
      CASE WHEN f0 AND f1 THEN 'firing' WHEN f0 THEN 'pending' ELSE 'normal' END AS state FROM (
      SELECT 'no events in window' AS rule, 'critical' AS severity, e0 AS v, 1 AS threshold, e0 < 1 AS f0, e1 < 1 AS f1 FROM w
      UNION ALL SELECT 'no successful predictions in window', 'critical', s0, 1, s0 < 1, s1 < 1 FROM w
      UNION ALL SELECT 'prediction errors detected', 'warning', r0, 0, r0 > 0, r1 > 0 FROM w
      UNION ALL SELECT 'data drift detected', 'warning', drift_score, 0, drift_score > 0,
        (SELECT bool_or(drifted) FROM o_drift_before) FROM o_drift_score) y""",
)
def alert_rules(t: Tables):
    reference, log = encoded(t), t.prediction_events
    held = log.where(F.col("ts") < log.agg(F.date_trunc("minute", F.max("ts")) - F.expr("INTERVAL 1 MINUTE")).scalar())
    now, before = (monitor.drift_score(monitor.drift_feature_stats(reference, events)) for events in (log, held))
    return monitor.alert_rules(log, now, drift_before=before)


@query(
    "drift_levels",
    """SELECT CAST(round(drift_score, 6) AS DOUBLE) AS drift_score,
      CASE WHEN drift_score >= 0.5 THEN 'high' WHEN drift_score >= 0.25 THEN 'elevated' ELSE 'normal' END AS level FROM o_drift_score""",
)
def drift_levels(t: Tables):
    scores = monitor.drift_score(monitor.drift_feature_stats(encoded(t), t.prediction_events))
    return rounded(monitor.drift_levels(scores).select("drift_score", "level"))
