"""Alerts over time: batch by hand, and the stream against the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from variantloom.session import fresh_path
from variantloom.streaming import alerts, feeds

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, status string"


def events(spark, rows):
    return spark.createDataFrame([(START + dt.timedelta(seconds=s), status) for s, status in rows], SCHEMA)


def changes(df):
    return sorted((r["rule"], r["at"], r["value"], r["was"], r["state"]) for r in df.select("rule", F.date_format("at", "HH:mm").alias("at"), "value", "was", "state").collect())


def test_a_breach_is_pending_then_fires_then_resolves(spark):
    rows = [(60 * m, "success") for m in range(20)] + [(305, "error"), (1199, "success")]
    got = [c for c in changes(alerts.alert_timeline(events(spark, rows))) if c[0] == "prediction errors detected"]
    # the error of minute 5 is in the windows that end at minutes 6 to 10
    assert got == [
        ("prediction errors detected", "00:06", 1.0, "normal", "pending"),
        ("prediction errors detected", "00:07", 1.0, "pending", "firing"),
        ("prediction errors detected", "00:11", 0.0, "firing", "resolved"),
    ]
    longer = [c[1] for c in changes(alerts.alert_timeline(events(spark, rows), hold_minutes=3)) if c[4] == "firing" and c[0] == "prediction errors detected"]
    assert longer == ["00:09"]
    assert alerts.alert_timeline(events(spark, [])).count() == 0


def test_stream_equals_batch_over_restarts_and_silence(spark):
    rng = random.Random(3)
    rows, now = [], 0
    for _ in range(120):
        now += rng.choice([5, 30, 90, 60 * 9])  # some gaps are longer than the window
        rows.append((now, rng.choices(["success", "error", "other"], [6, 1, 1])[0]))
    path, out, checkpoint = (fresh_path(spark, n) for n in ("feed", "alerts", "checkpoint"))
    for at in range(0, 120, 30):
        events(spark, rows[at : at + 30]).coalesce(1).write.mode("append").parquet(path)
        alerts.run_alerts(feeds.file_stream(spark, path, events(spark, []).schema), out, checkpoint).awaitTermination()
    last = (START + dt.timedelta(seconds=now - 600)).replace(second=0)
    want = changes(alerts.alert_timeline(events(spark, rows)).where(F.col("at") <= F.lit(last)))
    got = changes(spark.read.parquet(out))
    assert got == want and {c[4] for c in got} == {"pending", "firing", "resolved"}
