"""Monitoring of the prediction-event log: summaries, counters, latency, drift and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.contract import LATENCY_BUCKETS_SECONDS, LOW_CONFIDENCE, MONITORED_FEATURES
from variantloom.functions.values import at_least_one, count_if, finite, ratio, to_number
from variantloom.operators.ingest import rename_monitoring_columns
from variantloom.operators.ranks import prefix_sums, unpivoted
from variantloom.session import materialize



def prediction_summary(events: DataFrame, timestamp: str = "ts") -> DataFrame:
    """One row of totals, rates and averages over the log; an empty log gives zeros and NULLs."""
    success = F.col("status") == "success"
    n, good = F.count(F.lit(1)), count_if(success)
    pathogenic = count_if(success & (F.col("prediction") == 1))
    return events.agg(
        n.alias("total_predictions"),
        good.alias("successful_predictions"),
        count_if(F.col("status") == "error").alias("failed_predictions"),
        pathogenic.alias("pathogenic_predictions"),
        count_if(success & (F.col("prediction") == 0)).alias("benign_predictions"),
        ratio(pathogenic, good, 0.0).alias("pathogenic_rate"),
        F.avg(F.when(success, finite(F.col("probability")))).alias("average_probability"),
        F.avg(F.when(success, finite(F.col("confidence_score")))).alias("average_confidence"),
        F.avg(finite(F.col("latency_ms"))).alias("average_latency_ms"),
        count_if(success & (F.col("confidence_score") < LOW_CONFIDENCE)).alias("low_confidence_predictions"),
        F.max(timestamp).alias("latest_prediction_at"),
    )


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """Events per value, NULL shown as ``unknown``, most frequent first."""
    shown = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    counts = events.groupBy(shown.alias(column)).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def predictions_by_source(events: DataFrame) -> DataFrame:
    return counts_by(events, "source")


def predictions_by_chromosome(events: DataFrame) -> DataFrame:
    return counts_by(events, "chrom")


# --- counters and latency ---------------------------------------------------------------


def _sample(metric: str, labels: Sequence[tuple[str, Column]], when: Column | None = None) -> Column:
    text = F.concat_ws(",", *[F.concat(F.lit(f"{name}="), value) for name, value in labels])
    sample = F.struct(F.lit(metric).alias("metric"), text.alias("labels"))
    return sample if when is None else F.when(when, sample)


def counter_metrics(events: DataFrame, batch_results: DataFrame | None = None) -> DataFrame:
    """Monotonic counters as (metric, labels, value).

    Each event is turned into the counters it increments and all are summed in one grouped
    pass; increments are combined before the shuffle.
    """
    endpoint = ("endpoint", F.coalesce("endpoint", F.lit("unknown")))
    status = ("status", F.coalesce("status", F.lit("unknown")))
    source = ("source", F.coalesce("source", F.lit("unknown")))
    label = F.when(F.col("prediction") == 1, "pathogenic").otherwise("benign")
    samples = [
        _sample("predictions_total", [endpoint, status, source]),
        _sample("prediction_errors_total", [endpoint], F.col("status") == "error"),
        _sample("prediction_label_total", [("label", label)], F.col("prediction").isNotNull()),
        _sample("low_confidence_predictions_total", [endpoint], F.col("confidence_score") < LOW_CONFIDENCE),
    ]
    increments = events.select(F.inline(F.array_compact(F.array(*samples))))
    if batch_results is not None:
        found = F.when(F.col("found_in_store"), "found").otherwise("not_found")
        batch = [
            _sample("feature_store_lookup_total", [("status", found)]),
            _sample("vcf_batch_records_total", [("status", F.col("status"))]),
        ]
        increments = increments.unionByName(batch_results.select(F.inline(F.array(*batch))))
    return increments.groupBy("metric", "labels").agg(F.count(F.lit(1)).alias("value"))


def latency_histogram(events: DataFrame, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Cumulative latency buckets per group: (by..., le, bucket_count, latency_sum, latency_count)."""
    seconds = F.greatest(F.lit(0.0), F.col("latency_ms") / 1000.0)
    stats = events.where(F.col("latency_ms").isNotNull()).groupBy(*by).agg(
        *[count_if(seconds <= le).alias(f"_le{i}") for i, le in enumerate(LATENCY_BUCKETS_SECONDS)],
        F.count(F.lit(1)).alias("latency_count"),
        F.sum(seconds).alias("latency_sum"),
    )
    return stats.select(*by, F.inline(_bucket_rows()), "latency_sum", "latency_count")


def _bucket_rows() -> Column:
    rows = [
        F.struct(F.lit(float(le)).alias("le"), F.col(f"_le{i}").alias("bucket_count"))
        for i, le in enumerate(LATENCY_BUCKETS_SECONDS)
    ]
    return F.array(*rows, F.struct(F.lit(float("inf")).alias("le"), F.col("latency_count").alias("bucket_count")))


def histogram_quantile(histogram: DataFrame, q: float = 0.95, by: Sequence[str] = (), name: str = "p95_seconds") -> DataFrame:
    """Quantile interpolated inside its bucket; beyond the last finite edge, that edge."""
    merged = histogram.groupBy(*by, "le").agg(F.sum("bucket_count").alias("_cum"))
    ordered = Window.partitionBy(*by).orderBy("le")  # eleven edges per group
    spans = merged.withColumns(
        {
            "_low": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)),
            "_below": F.coalesce(F.lag("_cum").over(ordered), F.lit(0)),
            "_total": F.max("_cum").over(Window.partitionBy(*by)),
        }
    )
    rank = F.lit(float(q)) * F.col("_total")
    hit = spans.where((F.col("_cum") >= rank) & (F.col("_below") < rank))
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * ratio(rank - F.col("_below"), F.col("_cum") - F.col("_below"))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(inside)
    return hit.select(*by, value.alias(name))


def latency_p95(events: DataFrame) -> DataFrame:
    return histogram_quantile(latency_histogram(events))


def pathogenic_rate_live(events: DataFrame) -> DataFrame:
    labelled = F.count("prediction")
    return events.agg(ratio(count_if(F.col("prediction") == 1), at_least_one(labelled)).alias("pathogenic_rate"))


def dashboard_totals(counters: DataFrame, drift: DataFrame) -> DataFrame:
    """Headline numbers as (panel, value)."""
    total = counters.where("metric = 'predictions_total'").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("value"))
    window = drift.agg(F.coalesce(F.max("current_rows"), F.lit(0)).cast("double").alias("value"))
    parts = [total.select(F.lit("total_predictions").alias("panel"), "value"), window.select(F.lit("rows_in_drift_window").alias("panel"), "value")]
    flags = drift.select(F.concat(F.lit("drifted:"), F.col("feature")).alias("panel"), F.col("drifted").cast("int").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [*parts, flags])


# --- drift ------------------------------------------------------------------------------


MOMENTS = ("feature", "mean", "std", "missing_rate", "rows")


def feature_moments(df: DataFrame, exclude_sentinels: bool = False, features: Sequence[str] = MONITORED_FEATURES) -> DataFrame:
    """Mean, deviation, missing rate and row count per monitored feature, in one pass.

    ``exclude_sentinels`` treats the encoded missing value -1 as missing.
    """
    stats, entries = [F.count(F.lit(1)).alias("_rows")], []
    for f in features:
        if f not in df.columns:
            continue
        x = to_number(F.col(f))
        if exclude_sentinels and f != "ALT_FREQ":
            x = F.when(x != -1.0, x)
        missing = x.isNull() if exclude_sentinels else F.col(f).isNull()
        stats += [F.avg(x).alias(f"m_{f}"), F.stddev_pop(x).alias(f"s_{f}"), F.avg(missing.cast("double")).alias(f"z_{f}")]
        entries.append(
            F.struct(
                F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"),
                F.col(f"z_{f}").alias("missing_rate"), F.col("_rows").alias("rows"),
            )
        )
    return df.agg(*stats).select(F.inline(F.array(*entries)))


def current_moments(events: DataFrame) -> DataFrame:
    return feature_moments(rename_monitoring_columns(events))


def compare_moments(reference: DataFrame, current: DataFrame, floor: float = 0.05) -> DataFrame:
    """Drift of the current mean against the reference spread, per feature with values on both sides."""
    ref = reference.select("feature", *[F.col(c).alias(f"reference_{c}") for c in ("mean", "std", "missing_rate", "rows")])
    cur = current.select("feature", *[F.col(c).alias(f"current_{c}") for c in ("mean", "missing_rate", "rows")])
    joined = ref.join(F.broadcast(cur), "feature")  # four rows: the monitored features
    joined = joined.where(F.col("reference_mean").isNotNull() & F.col("current_mean").isNotNull())
    delta = F.abs(F.col("current_mean") - F.col("reference_mean"))
    joined = joined.withColumns({"mean_delta": delta, "threshold": F.greatest("reference_std", F.lit(floor))})
    return joined.withColumn("drifted", F.col("mean_delta") > F.col("threshold"))


def drift_feature_stats(reference: DataFrame, events: DataFrame, exclude_sentinels: bool = False) -> DataFrame:
    current = rename_monitoring_columns(events)
    return compare_moments(feature_moments(reference, exclude_sentinels), feature_moments(current))


def drift_score(stats: DataFrame) -> DataFrame:
    """One row: share of drifted features, and whether there was anything to compare."""
    drifted, monitored = count_if(F.col("drifted")), F.count(F.lit(1))
    return stats.agg(
        F.coalesce(F.max("current_rows"), F.lit(0)).alias("current_rows"),
        F.coalesce(F.max("reference_rows"), F.lit(0)).alias("reference_rows"),
        drifted.alias("drifted_features"),
        monitored.alias("monitored_features"),
        ratio(drifted, monitored, 0.0).alias("drift_score"),
    ).withColumn("status", F.when(F.col("current_rows") > 0, "ok").otherwise("waiting_for_predictions"))


def drift_summary(reference: DataFrame, events: DataFrame) -> DataFrame:
    """The nested summary: the score with its per-feature rows (at most the monitored four).

    ``reference`` is a table or its ``feature_moments``. Row counts come from the tables themselves, so
    they hold even when no feature is comparable.
    """
    ref = reference if set(MOMENTS) <= set(reference.columns) else feature_moments(reference)
    cur = current_moments(events)
    stats = compare_moments(ref, cur)
    detail = F.struct(
        "feature", "reference_mean", "current_mean", "reference_std", "mean_delta", "threshold", "drifted",
        "reference_missing_rate", "current_missing_rate",
    )
    drifted, monitored = count_if(F.col("drifted")), F.count(F.lit(1))
    rows = stats.agg(
        drifted.alias("drifted_features"), monitored.alias("monitored_features"),
        ratio(drifted, monitored, 0.0).alias("drift_score"), F.array_sort(F.collect_list(detail)).alias("features"),
    )
    largest = lambda side: F.coalesce(side.agg(F.max("rows")).scalar(), F.lit(0))
    rows = rows.withColumns({"current_rows": largest(cur), "reference_rows": largest(ref)})
    return rows.withColumn("status", F.when(F.col("current_rows") > 0, "ok").otherwise("waiting_for_predictions"))


def drift_profile_report(reference: DataFrame, events: DataFrame) -> DataFrame:
    stats = drift_feature_stats(reference, events)
    return stats.select("feature", "reference_mean", "current_mean", "reference_missing_rate", "current_missing_rate")


# legal ranges cut into ten equal bins for the distribution distances
DISTRIBUTION_RANGES = {"CADD": (0.0, 60.0), "SIFT": (0.0, 1.0), "PolyPhen": (0.0, 1.0), "ALT_FREQ": (0.0, 1.0)}
DRIFT_CATEGORICAL = ("CHROM", "mutation_type", "prediction")
EPSILON = 1e-4


def _binned(df: DataFrame, side: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    cells = []
    for f in numeric:
        low, high = DISTRIBUTION_RANGES[f]
        x = to_number(F.col(f))
        number = F.least(F.lit(9), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * 10)))
        missing = x.isNull() | (x < low)
        cells.append(F.struct(F.lit(f).alias("feature"), F.when(missing, "missing").otherwise(number.cast("string")).alias("bin")))
    cells += [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("bin")) for c in categorical]
    return df.select(F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias(side))


def distribution_drift(reference: DataFrame, events: DataFrame, categorical: Sequence[str] = DRIFT_CATEGORICAL) -> DataFrame:
    """Population stability index, Jensen-Shannon distance and two-sample KS per common column.

    Columns that one side lacks are left out. Both sides are reduced to bin counts (for KS, value
    counts) before they meet; they meet in a grouped union, not in a join. KS is NULL for categorical
    columns.
    """
    current = rename_monitoring_columns(events)
    common = set(reference.columns) & set(current.columns)
    numeric = [c for c in DISTRIBUTION_RANGES if c in common]
    text = [c for c in categorical if c in common]
    if not numeric and not text:
        return reference.sparkSession.createDataFrame([], "feature string, psi double, js_distance double, ks double")
    ref, cur = _binned(reference, "r", numeric, text), _binned(current, "c", numeric, text)
    union = ref.unionByName(cur, allowMissingColumns=True)
    bins = union.groupBy("feature", "bin").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    whole = Window.partitionBy("feature")
    p = F.greatest(ratio(F.col("r"), F.sum("r").over(whole)), F.lit(EPSILON))
    q = F.greatest(ratio(F.col("c"), F.sum("c").over(whole)), F.lit(EPSILON))
    shares = bins.select("feature", p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    p, q, m = F.col("p"), F.col("q"), F.col("m")
    distances = shares.groupBy("feature").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(p * F.log(p / m) + q * F.log(q / m)) / 2)).alias("js_distance"),
    )
    if not numeric:
        return distances.withColumn("ks", F.lit(None).cast("double"))
    # one row for each numeric column of the schema
    return distances.join(F.broadcast(ks_statistic(reference, current, numeric)), "feature", "left")


def ks_statistic(reference: DataFrame, current: DataFrame, features: Sequence[str] = MONITORED_FEATURES) -> DataFrame:
    """Largest gap between the two cumulative distributions, per feature."""

    def values(df: DataFrame, side: str) -> DataFrame:
        numbers = df.select(*[to_number(F.col(f)).alias(f) for f in features])
        long = unpivoted(numbers, features).where(F.col("value").isNotNull())
        return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias(side))

    union = values(reference, "r").unionByName(values(current, "c"), allowMissingColumns=True)
    both = union.groupBy("feature", "value").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    running = prefix_sums(materialize(both, "ks-values"), ["feature"], "value", ["r", "c"])
    gap = F.abs(ratio(F.col("cum_r"), F.col("tot_r")) - ratio(F.col("cum_c"), F.col("tot_c")))
    return running.groupBy("feature").agg(F.max(gap).alias("ks"))


# --- windows and alerts -----------------------------------------------------------------

WINDOW, SLIDE = "5 minutes", "1 minute"

# name, metric, comparison, threshold, severity, state without data
ALERT_RULES = [
    ("no events in window", "events_in_window", "<", 1.0, "critical", "alerting"),
    ("no successful predictions in window", "successes_in_window", "<", 1.0, "critical", "alerting"),
    ("prediction errors detected", "errors_in_window", ">", 0.0, "warning", "ok"),
    ("data drift detected", "drift_score", ">", 0.0, "warning", "ok"),
]


def windowed(events: DataFrame, by: Sequence[str], aggregates: Sequence[Column], ts: str = "ts") -> DataFrame:
    """Sliding five-minute windows, every minute. Works on a batch and, behind a watermark, on a stream."""
    span = F.window(F.col(ts), WINDOW, SLIDE)
    grouped = events.groupBy(span.alias("_w"), *by).agg(*aggregates)
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in grouped.columns if c != "_w"])


def event_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    return windowed(events, ["endpoint", "status"], [F.count(F.lit(1)).alias("events")], ts)


def error_increase(events: DataFrame, ts: str = "ts") -> DataFrame:
    return windowed(events.where("status = 'error'"), [], [F.count(F.lit(1)).alias("errors")], ts)


def pathogenic_share(events: DataFrame, ts: str = "ts") -> DataFrame:
    counted = windowed(
        events.where(F.col("prediction").isNotNull()), [],
        [count_if(F.col("prediction") == 1).alias("pathogenic"), F.count(F.lit(1)).alias("labelled")], ts,
    )
    return counted.withColumn("pathogenic_rate", ratio(F.col("pathogenic"), at_least_one(F.col("labelled"))))


def latency_buckets(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Windowed cumulative bucket counts: plain sums, so the state of a stream stays mergeable."""
    seconds = F.greatest(F.lit(0.0), F.col("latency_ms") / 1000.0)
    buckets = [count_if(seconds <= le).alias(f"_le{i}") for i, le in enumerate(LATENCY_BUCKETS_SECONDS)]
    return windowed(events.where(F.col("latency_ms").isNotNull()), [], [*buckets, F.count(F.lit(1)).alias("latency_count")], ts)


def bucket_quantile(buckets: DataFrame, q: float = 0.95, name: str = "p95_seconds") -> DataFrame:
    """The interpolated quantile of each row of bucket counts, without any further grouping."""
    rank = F.lit(float(q)) * F.col("latency_count")
    value = F.lit(float(LATENCY_BUCKETS_SECONDS[-1]))
    for i in reversed(range(len(LATENCY_BUCKETS_SECONDS))):
        low = float(LATENCY_BUCKETS_SECONDS[i - 1]) if i else 0.0
        high = float(LATENCY_BUCKETS_SECONDS[i])
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        here = F.col(f"_le{i}")
        inside = F.lit(low) + F.lit(high - low) * ratio(rank - below, here - below)
        value = F.when(here >= rank, inside).otherwise(value)
    return buckets.select("window_start", "window_end", "latency_count", value.alias(name))


def lookup_outcomes(batch_events: DataFrame, ts: str = "ts") -> DataFrame:
    return windowed(batch_events, ["lookup_status"], [F.count(F.lit(1)).alias("lookups")], ts)


def alert_rules(events: DataFrame, drift: DataFrame, ts: str = "ts", hold_minutes: int = 1, drift_before: DataFrame | None = None) -> DataFrame:
    """State of every rule at the newest event: (rule, severity, value, threshold, state).

    The windows that end at the last full minute and ``hold_minutes`` before are compared; a rule
    fires when both breach, is pending when only the newest does. ``drift`` is a ``drift_score`` row, and
    ``drift_before`` the one of the events before the hold; without it drift has not been held yet.
    """
    newest = events.agg(F.date_trunc("minute", F.max(ts)).alias("_t")).scalar()
    stamp = F.col(ts).cast("timestamp")
    # windows are half-open: an event at the evaluation minute belongs to the next window
    span, hold = F.expr("INTERVAL 5 MINUTES"), F.make_interval(mins=F.lit(hold_minutes))
    now = F.col("_now").cast("timestamp")
    recent = events.withColumn("_now", newest)
    in_now = (stamp >= now - span) & (stamp < now)
    in_before = (stamp >= now - hold - span) & (stamp < now - hold)
    recent = recent.where(in_now | in_before)
    counts = []
    for tag, inside in (("now", in_now), ("before", in_before)):
        counts += [
            count_if(inside).alias(f"events_in_window_{tag}"),
            count_if(inside & (F.col("status") == "success")).alias(f"successes_in_window_{tag}"),
            count_if(inside & (F.col("status") == "error")).alias(f"errors_in_window_{tag}"),
        ]
    values = recent.agg(*counts).withColumn("drift_score_now", drift.agg(F.max("drift_score")).scalar())
    before_score = F.lit(None).cast("double") if drift_before is None else drift_before.agg(F.max("drift_score")).scalar()
    values = values.withColumn("drift_score_before", before_score)
    rows = []
    for name, metric, comparison, threshold, severity, no_data in ALERT_RULES:
        now_value, before = F.col(f"{metric}_now").cast("double"), F.col(f"{metric}_before").cast("double")
        breach = (lambda v: v < threshold) if comparison == "<" else (lambda v: v > threshold)
        state = (
            F.when(now_value.isNull(), no_data)
            .when(breach(now_value) & F.coalesce(breach(before), F.lit(False)), "firing")
            .when(breach(now_value), "pending")
            .otherwise("normal")
        )
        rows.append(
            F.struct(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"), now_value.alias("value"),
                F.lit(threshold).alias("threshold"), state.alias("state"),
            )
        )
    return values.select(F.inline(F.array(*rows)))


def drift_levels(scores: DataFrame) -> DataFrame:
    """``drift_score`` rows with their panel level."""
    return scores.withColumn("level", drift_level(F.col("drift_score")))


def drift_level(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.25, "elevated").otherwise("normal")
