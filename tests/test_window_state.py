"""Closed windows are written once and only open ones carried on."""

import datetime as dt

from pyspark.sql import functions as F

from variantloom.session import fresh_path, hadoop_path
from variantloom.streaming import feeds

START = dt.datetime(2024, 1, 1)
KEYS = ["window_start", "endpoint"]


def updated_windows(spark, batch, events=3):
    """What an update-mode aggregate of five-minute windows gives for the events of minute ``batch``."""
    rows = [
        (START + dt.timedelta(minutes=batch - back), START + dt.timedelta(minutes=batch - back + 5), endpoint, events * (back + 1))
        for back in range(5)
        for endpoint in ("a", "b")
    ]
    return spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, endpoint string, events bigint")


def size(spark, path):
    fs, target = hadoop_path(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def test_a_batch_writes_no_more_after_many_batches(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = fresh_path(spark, "windows")
        save = feeds.window_writer(spark, out, KEYS)
        written = []
        for batch in range(60):
            save(updated_windows(spark, batch), batch)
            written.append(size(spark, f"{out}/state={batch}") + size(spark, f"{out}/closed/from={batch - 1}"))
            if batch in (20, 21, 40):
                save(updated_windows(spark, batch), batch)  # replayed
        assert max(written[40:]) <= 1.1 * max(written[15:25])
        assert len(feeds.finished_states(spark, out)) <= 2
        # every window once, each with the value of the last batch that held it
        got = {(r["window_start"], r["endpoint"]): r["events"] for r in feeds.read_windows(spark, out).collect()}
        want = {}
        for batch in range(60):
            for back in range(5):
                for endpoint in ("a", "b"):
                    want[(START + dt.timedelta(minutes=batch - back), endpoint)] = 3 * (back + 1)
        assert got == want and feeds.read_windows(spark, out).count() == len(want)
        feeds.merge_closed(spark, out, least=16)
        ranges, parts = feeds.closed_parts(spark, out)
        assert len(ranges) == 3 and len(parts) < 16
        assert feeds.read_windows(spark, out).count() == len(want)
        save(updated_windows(spark, 60), 60)
        assert feeds.read_windows(spark, out).count() == len(want) + 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_batch_that_failed_half_way_is_not_seen(spark):
    out = fresh_path(spark, "windows")
    save = feeds.window_writer(spark, out, KEYS)
    for batch in range(0, 40, 20):
        save(updated_windows(spark, batch), batch)
    before = sorted(map(str, feeds.read_windows(spark, out).drop("_batch").collect()))
    newest = feeds.finished_states(spark, out)[-1]
    # the closed part of the newest state is there, its successor is not
    feeds.read_windows(spark, out).where(F.lit(True)).limit(5).write.parquet(f"{out}/closed/from={newest}")
    feeds.merge_closed(spark, out, least=1)
    assert sorted(map(str, feeds.read_windows(spark, out).drop("_batch").collect())) == before
    save(updated_windows(spark, 60), 60)
    assert feeds.read_windows(spark, out).count() == 30


def test_empty_batches_and_no_windows(spark):
    out = fresh_path(spark, "windows")
    save = feeds.window_writer(spark, out, KEYS)
    save(updated_windows(spark, 0).limit(0), 0)
    assert feeds.read_windows(spark, out).count() == 0
    save(updated_windows(spark, 0), 1)
    save(updated_windows(spark, 0).limit(0), 2)
    assert feeds.read_windows(spark, out).count() == 10
