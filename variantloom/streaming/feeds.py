"""Streaming inputs and restartable outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from variantloom.session import delete_tables, hadoop_path, list_names, path_exists

WATERMARK = "10 minutes"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, file_format: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(file_format).load(path)


def event_time(events: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time as TIMESTAMP (a watermark needs the zoned type) behind a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def write_updates(
    stream: DataFrame, out: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame], transform: Callable[[DataFrame, int], DataFrame],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Fold each micro-batch into one current table, ``out/state=<batch id>``.

    ``transform`` gives the state's columns from a batch and its number; ``fold`` brings the rows of the last state and of the batch down to the new state. A state is
    written beside the one it follows and then takes its place; older ones are deleted, so the number
    of files does not grow with the stream. A batch that is replayed after a failure starts again
    from the state before it.
    """
    spark = stream.sparkSession

    def save(rows: DataFrame, batch_id: int) -> None:
        changed = transform(rows, batch_id)
        done = finished_states(spark, out)
        before = [n for n in done if n < batch_id]
        if before:
            changed = spark.read.parquet(f"{out}/state={before[-1]}").unionByName(changed)
        fold(changed).write.mode("overwrite").parquet(f"{out}/state={batch_id}")
        for old in [n for n in done if n != batch_id and n not in before[-1:]]:
            fs, target = hadoop_path(spark, f"{out}/state={old}")
            fs.delete(target, True)

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finished_states(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the complete states, at most the last three batches'."""
    if not path_exists(spark, out):
        return []
    numbers = [int(n.removeprefix("state=")) for n in list_names(spark, out) if n.startswith("state=")]
    return sorted(n for n in numbers if path_exists(spark, f"{out}/state={n}/_SUCCESS"))


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest complete state."""
    return spark.read.parquet(f"{out}/state={finished_states(spark, out)[-1]}")


def numbered(rows: DataFrame, batch_id: int) -> DataFrame:
    return rows.withColumn("_batch", F.lit(batch_id))


def newest_row(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold that keeps the row with the largest ``_batch`` of each key."""

    def fold(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return picked.select(*keys, "_row.*")

    return fold


# --- windows: closed ones are written once, only open ones are carried on -------------------

DELAY_SECONDS = 600  # WATERMARK
MERGE_PARTS = 64


def window_writer(spark: SparkSession, out: str, keys: Sequence[str], delay_seconds: int = DELAY_SECONDS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps ``out/state=<batch>`` and appends ``out/closed/from=<batch>``.

    A state holds the newest row of each window that was open before its batch or that the batch changed. The next batch parts it:
    windows that ended before the watermark can never change again, so they are appended as closed, once, and
    the others go on with the new rows. What a batch writes is bounded by the windows within the watermark,
    however long the stream has run. A replayed batch writes the same folders again.
    """
    fold = newest_row(keys)

    def save(rows: DataFrame, batch_id: int) -> None:
        done = finished_states(spark, out)
        before = [n for n in done if n < batch_id]
        changed = numbered(rows, batch_id)
        if before:
            last = spark.read.parquet(f"{out}/state={before[-1]}")
            # no later than the watermark of this batch: window starts are not after the newest event
            horizon = last.agg(F.max("window_start")).scalar()
            if horizon is not None:
                ended = F.col("window_end") <= F.lit(horizon) - F.make_dt_interval(secs=F.lit(delay_seconds))
                last.where(ended).coalesce(1).write.mode("overwrite").parquet(f"{out}/closed/from={before[-1]}")
                last = last.where(~ended)
            changed = last.unionByName(changed)
        fold(changed).write.mode("overwrite").parquet(f"{out}/state={batch_id}")
        delete_tables(spark, [f"{out}/state={n}" for n in done if n != batch_id and n not in before[-1:]])

    return save


def closed_parts(spark: SparkSession, out: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Merged ranges and single parts of the closed windows, without what a range has already."""
    path = f"{out}/closed"
    names = list_names(spark, path) if path_exists(spark, path) else []
    whole = [n for n in names if path_exists(spark, f"{path}/{n}/_SUCCESS")]
    ranges = sorted(tuple(map(int, n.removeprefix("range=").split("-"))) for n in whole if n.startswith("range="))
    parts = sorted(int(n.removeprefix("from=")) for n in whole if n.startswith("from="))
    return ranges, [p for p in parts if not any(a <= p <= b for a, b in ranges)]


def merge_closed(spark: SparkSession, out: str, least: int = MERGE_PARTS) -> None:
    """Single parts become one range when there are ``least`` of them; a range is never written again.

    For a job beside the stream or between its runs. Readers see a range only when it is whole, and the parts no more from then on.
    """
    newest = finished_states(spark, out)[-1]
    parts = [p for p in closed_parts(spark, out)[1] if p < newest]
    while len(parts) >= least:
        own, parts = parts[:least], parts[least:]
        rows = spark.read.parquet(*[f"{out}/closed/from={p}" for p in own])
        rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/closed/range={own[0]}-{own[-1]}")
        delete_tables(spark, [f"{out}/closed/from={p}" for p in own])


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """Every window once: the closed ones and the newest state."""
    newest = finished_states(spark, out)[-1]
    ranges, parts = closed_parts(spark, out)
    paths = [f"{out}/closed/range={a}-{b}" for a, b in ranges] + [f"{out}/closed/from={p}" for p in parts if p < newest]
    return spark.read.parquet(f"{out}/state={newest}", *paths)


def write_windows(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None) -> StreamingQuery:
    """The windows of ``stream`` (behind ``event_time``, in update mode), read back by ``read_windows``."""
    writer = stream.writeStream.outputMode("update").foreachBatch(window_writer(stream.sparkSession, out, keys))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_stream(stream: DataFrame, out: str, checkpoint: str, file_format: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Append-only file sink; its own log makes each row appear once."""
    writer = stream.writeStream.outputMode("append").format(file_format).option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
