import datetime as dt

import pytest
from pyspark.sql import functions as F

from variantloom.functions.scoring import evidence_drivers
from variantloom.operators import monitor, scoring
from variantloom.session import fresh_path
from variantloom.streaming import feeds, jobs

EVENT = (
    "event_id long, ts timestamp_ntz, endpoint string, source string, status string, chrom string, prediction int, probability double, "
    "confidence_score double, latency_ms double, cadd double, sift double, polyphen double, alt_freq double"
)
START = dt.datetime(2024, 1, 1)


def make_events(spark, n, first=0, step=20):
    rows = []
    for i in range(first, first + n):
        bad = i % 5 == 0
        rows.append((
            i, START + dt.timedelta(seconds=step * i), "/api/predict", "api" if i % 2 else None, "error" if bad else "success", "11",
            None if bad else i % 2, None if bad else 0.3, None if bad else 0.7, 5.0 * i, float(i % 40), 0.1, 0.2, 0.001,
        ))
    return spark.createDataFrame(rows, EVENT)


def test_summary_of_one_event_and_of_none(spark):
    one = spark.createDataFrame([(1, START, "/api/predict", "api", "success", "11", 1, 0.91, 0.91, 12.5, None, None, None, None)], EVENT)
    row = monitor.prediction_summary(one).first()
    assert (row.total_predictions, row.pathogenic_predictions, row.pathogenic_rate, row.average_latency_ms) == (1, 1, 1.0, 12.5)
    assert [(r.chrom, r["count"]) for r in monitor.predictions_by_chromosome(one).collect()] == [("11", 1)]
    empty = monitor.prediction_summary(one.limit(0)).first()
    assert (empty.total_predictions, empty.pathogenic_rate, empty.average_probability) == (0, 0.0, None)


REFERENCE = [(10.0, 0.1, 0.2, 0.01), (11.0, 0.2, 0.3, 0.02), (12.0, 0.3, 0.4, 0.03)]


def test_drift_flags_and_waiting_state(spark):
    reference = spark.createDataFrame(REFERENCE, "CADD double, SIFT double, PolyPhen double, ALT_FREQ double")
    current = spark.createDataFrame([(30.0, 0.9, 0.95, 0.4)], "cadd double, sift double, polyphen double, alt_freq double")
    summary = monitor.drift_summary(reference, current).first()
    assert (summary.status, summary.current_rows, summary.monitored_features, summary.drifted_features, summary.drift_score) == ("ok", 1, 4, 4, 1.0)
    waiting = monitor.drift_summary(reference, current.limit(0)).first()
    assert (waiting.status, waiting.drift_score, waiting.current_rows, list(waiting.features)) == ("waiting_for_predictions", 0.0, 0, [])


def test_latency_quantile_interpolates_and_caps_at_the_last_edge(spark):
    events = spark.createDataFrame([("e", 20.0)] * 10, "endpoint string, latency_ms double")
    assert monitor.latency_p95(events).first()[0] == pytest.approx(0.01 + 0.04 * 0.95)
    slow = spark.createDataFrame([("e", 99_000.0)], "endpoint string, latency_ms double")
    assert monitor.latency_p95(slow).first()[0] == 30.0


def test_alert_fires_only_when_the_breach_holds(spark):
    drift = spark.createDataFrame([(0.25,)], "drift_score double")
    rows = [(START + dt.timedelta(minutes=m), s) for m, s in ((0, "success"), (7, "success"), (9, "error"), (10, "success"))]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, status string")
    got = {r.rule: r.state for r in monitor.alert_rules(events, drift).collect()}
    # the error at minute 9 is inside [5, 10) but not inside [4, 9)
    assert got["prediction errors detected"] == "pending" and got["data drift detected"] == "pending"
    held = {r.rule: r.state for r in monitor.alert_rules(events, drift, drift_before=drift).collect()}
    assert held["data drift detected"] == "firing"
    assert got["no events in window"] == "normal"


def test_counters_cover_every_event_once(spark):
    events = make_events(spark, 100)
    values = {(r.metric, r.labels): r.value for r in monitor.counter_metrics(events).collect()}
    assert sum(v for (m, _), v in values.items() if m == "predictions_total") == 100
    assert values[("prediction_errors_total", "endpoint=/api/predict")] == 20


def test_triage_and_drivers(spark):
    rows = [("PATHOGENIC", 0.8, 0.8), ("PATHOGENIC", 0.65, 0.65), ("BENIGN", 0.1, 0.9), ("BENIGN", 0.5, None), (None, None, None)]
    df = spark.createDataFrame(rows, "label string, probability double, confidence_score double")
    assert [r.triage for r in scoring.triage(df).collect()] == ["High priority", "Review priority", "Low priority", "Insufficient evidence", None]
    scores = spark.createDataFrame([(0.0, 1.0, 35.0, 0.0)], "s double, p double, c double, a double")
    drivers = scores.select(evidence_drivers(F.col("s"), F.col("p"), F.col("c"), F.col("a"))).first()[0]
    assert [d.name for d in drivers] == ["CADD", "ALT frequency", "SIFT", "PolyPhen"]


def test_stream_over_many_batches_equals_batch(spark):
    """Files arrive one by one in time order; the settled table equals the batch result."""
    path, out, checkpoint = (fresh_path(spark, n) for n in ("feed", "windows", "checkpoint"))
    schema = make_events(spark, 1).schema
    everything = None
    for part in range(3):
        events = make_events(spark, 120, first=120 * part).coalesce(1)
        events.write.mode("append").parquet(path)
        everything = events if everything is None else everything.unionByName(events)
        stream = jobs.stream_event_counts(feeds.file_stream(spark, path, schema))
        table = jobs.run_to_table(spark, stream, out, checkpoint, ["window_start", "endpoint", "status"])
    expected = monitor.event_counts(everything.withColumn("ts", F.col("ts").cast("timestamp")))
    same = ["window_start", "endpoint", "status", "events"]
    assert table.select(*same).exceptAll(expected.select(*same)).count() == 0
    assert table.count() == expected.count()


def test_stream_drift_adds_up_over_restarts(spark):
    path, out, checkpoint = (fresh_path(spark, n) for n in ("feed", "moments", "checkpoint"))
    reference = monitor.feature_moments(spark.createDataFrame(REFERENCE, "CADD double, SIFT double, PolyPhen double, ALT_FREQ double"))
    schema = make_events(spark, 1).schema
    for part in range(2):
        make_events(spark, 50, first=50 * part).write.mode("append").parquet(path)
        jobs.stream_drift(feeds.file_stream(spark, path, schema), out, checkpoint).awaitTermination()
    got = {r.feature: r for r in jobs.current_drift(spark, out, reference).collect()}
    whole = {r.feature: r for r in monitor.feature_moments(make_events(spark, 100).withColumnsRenamed({"cadd": "CADD", "sift": "SIFT", "polyphen": "PolyPhen", "alt_freq": "ALT_FREQ"})).collect()}
    assert all(got[f].current_mean == pytest.approx(whole[f]["mean"]) and got[f].current_rows == 100 for f in got) and len(got) == 4


def test_stream_state_does_not_grow(spark):
    path, out, checkpoint = (fresh_path(spark, n) for n in ("feed", "windows", "checkpoint"))
    schema = make_events(spark, 1).schema
    sizes = []
    for part in range(5):
        make_events(spark, 60, first=60 * part).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.stream_event_counts(feeds.file_stream(spark, path, schema))
        jobs.run_to_table(spark, stream, out, checkpoint, ["window_start", "endpoint", "status"])
        sizes.append(len(feeds.finished_states(spark, out)))
    assert max(sizes) <= 2


def test_replayed_batch_counts_once(spark):
    """A batch saved twice, as after a failure, starts from the state before it both times."""
    out = fresh_path(spark, "replayed")
    events = make_events(spark, 40)
    for batch_id in (0, 1, 1):
        done = [n for n in feeds.finished_states(spark, out) if n < batch_id]
        rows = jobs.batch_moments(events)
        if done:
            rows = spark.read.parquet(f"{out}/state={done[-1]}").unionByName(rows)
        jobs.fold_moments(rows).write.mode("overwrite").parquet(f"{out}/state={batch_id}")
    assert {r.rows for r in feeds.read_state(spark, out).collect()} == {80}


def test_moments_of_large_values_keep_their_digits(spark):
    values = [1e9 + x for x in (0.0, 1.0, 2.0, 3.0)]
    frames = [spark.createDataFrame([(v, 0.0, 0.0, 0.0)], "CADD double, SIFT double, PolyPhen double, ALT_FREQ double") for v in values]
    state = jobs.batch_moments(frames[0])
    for frame in frames[1:]:
        state = jobs.fold_moments(state.unionByName(jobs.batch_moments(frame)))
    got = {r.feature: r for r in jobs.merged_moments(state).collect()}
    assert got["CADD"].std == pytest.approx(1.25**0.5) and got["CADD"].rows == 4


def test_drift_skips_columns_one_side_lacks(spark):
    left = spark.createDataFrame([(1.0, 0.5, "x", 1), (2.0, 0.4, "y", 0)], "CADD double, SIFT double, mutation_type string, prediction int")
    right = spark.createDataFrame([(1.0, "x", 1)], "CADD double, mutation_type string, prediction int")
    got = {r.feature: r for r in monitor.distribution_drift(left, right).collect()}
    assert set(got) == {"CADD", "mutation_type", "prediction"} and got["CADD"].ks is not None and got["prediction"].ks is None


def test_stream_lookups_ask_the_store(spark):
    store = spark.createDataFrame([("1", 5, "A", "G", 0.1, 0.2, 30.0, 0.0, "local")], "k_chrom string, k_pos bigint, k_ref string, k_alt string, sift double, polyphen double, cadd double, alt_freq double, feature_source string")
    requests = spark.createDataFrame([("chr1", "5", "a", "g"), ("1", "6", "A", "G"), ("1", "x", "A", "G")], "chrom string, pos string, ref string, alt string")
    assert [r.lookup_status for r in jobs.stream_lookups(requests, store).orderBy("pos").collect()] == ["found", "not_found", "error"]
