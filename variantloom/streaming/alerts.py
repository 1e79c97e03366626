"""Alert rules over time: held breaches fire, and resolve, minute by minute, in batch and on a stream.

At each full minute a rule looks at the five minutes before it. A breach makes it pending; one that has held for
``hold_minutes`` makes it firing; the first minute without a breach resolves a firing rule. Minutes
without any event count too: no events is itself a breach of two rules.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from variantloom.functions.values import count_if
from variantloom.operators.monitor import ALERT_RULES
from variantloom.streaming.feeds import append_stream, event_time

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

SPAN_MINUTES = 5
MINUTE_MS = 60_000
COUNTS = {"events_in_window": "events", "successes_in_window": "successes", "errors_in_window": "errors"}
RULES = [(name, COUNTS[metric], comparison, threshold, severity) for name, metric, comparison, threshold, severity, _ in ALERT_RULES if metric in COUNTS]
TRANSITIONS = "rule string, severity string, at timestamp, value double, was string, state string"


def minute_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``minute`` (its end) with its events, successes and errors."""
    # a cast would hide the watermark of the column
    stamp = F.col(ts) if events.schema[ts].dataType == T.TimestampType() else F.col(ts).cast("timestamp")
    window = F.window(stamp, "1 minute").alias("w")
    counts = [F.count(F.lit(1)).alias("events"), count_if(F.col("status") == "success").alias("successes"), count_if(F.col("status") == "error").alias("errors")]
    return events.groupBy(window).agg(*counts).select(F.col("w.end").alias("minute"), F.window_time("w").alias("seen"), "events", "successes", "errors")


def next_state(breach: bool, held: int, was: str, hold_minutes: int) -> tuple[str, int]:
    """State of a rule and for how many minutes its breach has held."""
    if not breach:
        return ("resolved" if was == "firing" else "normal"), 0
    return ("firing" if held >= hold_minutes else "pending"), held + 1


def alert_timeline(events: DataFrame, ts: str = "ts", hold_minutes: int = 1) -> DataFrame:
    """``rule, severity, at, value, was, state`` of each change of state, from the first event's minute to the last one's.

    Every minute of that time is a row, so the windows over minutes grow with the time and not with the events.
    """
    counts = minute_counts(events, ts)
    ends = counts.agg(F.min("minute").alias("low"), F.max("minute").alias("high")).where("low IS NOT NULL")
    minutes = ends.select(F.explode(F.sequence("low", "high", F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    dense = minutes.join(counts.drop("seen"), "minute", "left").na.fill(0)
    cells = [F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(count).alias("n"), F.lit(c).alias("comparison"), F.lit(float(t)).alias("threshold")) for name, count, c, t, severity in RULES]
    long = dense.select("minute", F.inline(F.array(*cells)))
    order = "OVER (PARTITION BY rule ORDER BY minute"
    value = F.expr(f"CAST(sum(n) {order} ROWS BETWEEN {SPAN_MINUTES - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)")
    breach = F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    judged = long.withColumn("value", value).withColumn("breach", breach)
    held = F.expr(f"min(CAST(breach AS INT)) {order} ROWS BETWEEN {hold_minutes} PRECEDING AND CURRENT ROW) = 1 AND count(*) {order} ROWS BETWEEN {hold_minutes} PRECEDING AND CURRENT ROW) = {hold_minutes + 1}")
    state = F.when(F.col("breach") & F.col("held"), "firing").when(F.col("breach"), "pending").otherwise("normal")
    states = judged.withColumn("held", held).withColumn("plain", state)
    before = F.expr(f"coalesce(lag(plain) {order}), 'normal')")
    named = states.withColumn("before", before).withColumn("state", F.when((F.col("plain") == "normal") & (F.col("before") == "firing"), "resolved").otherwise(F.col("plain")))
    changes = named.withColumn("was", F.expr(f"coalesce(lag(state) {order}), 'normal')")).where("state <> was AND NOT (was = 'resolved' AND state = 'normal')")
    return changes.select("rule", "severity", F.col("minute").alias("at"), "value", "was", "state")


class AlertProcessor(StatefulProcessor):
    """One rule's counts of the last minutes, and its state. A timer at the next minute also wakes it when no event comes."""

    def __init__(self, hold_minutes: int):
        self.hold_minutes = hold_minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "last bigint, recent string, state string, held int")

    def _advance(self, rule: str, new: dict[int, int], upto: int) -> list[tuple]:
        """Judge every minute (as a number) up to ``upto``; returns the changes."""
        _, _, comparison, threshold, severity = next(r for r in RULES if r[0] == rule)
        if self.memory.exists():
            last, recent, state, held = self.memory.get()
            counts = {int(k): v for k, v in json.loads(recent).items()}
        elif new:
            last, counts, state, held = min(new) - 1, {}, "normal", 0
        else:
            return []
        counts.update(new)
        changes = []
        for minute in range(last + 1, upto + 1):
            value = sum(counts.get(minute - back, 0) for back in range(SPAN_MINUTES))
            now, held = next_state(value < threshold if comparison == "<" else value > threshold, held, state, self.hold_minutes)
            if now != state and not (state == "resolved" and now == "normal"):
                changes.append((rule, severity, pd.Timestamp(minute * MINUTE_MS, unit="ms", tz="UTC"), float(value), state, now))
            state, last = now, minute
        kept = {k: v for k, v in counts.items() if k > last - SPAN_MINUTES}
        self.memory.update((last, json.dumps(kept), state, held))
        self.handle.registerTimer((last + 1) * MINUTE_MS)
        return changes

    @staticmethod
    def _frame(changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=["rule", "severity", "at", "value", "was", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for frame in rows:
            new.update({int(m): int(n) for m, n in zip(frame["minute_no"], frame["n"], strict=True)})
        # all minutes that ended before the watermark have come by now; those without a row had no event
        yield self._frame(self._advance(key[0], new, max(max(new), timerValues.getCurrentWatermarkInMs() // MINUTE_MS)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._advance(key[0], {}, timerValues.getCurrentWatermarkInMs() // MINUTE_MS))

    def close(self) -> None:
        pass


def stream_alert_changes(events: DataFrame, ts: str = "ts", hold_minutes: int = 1) -> DataFrame:
    """The changes of ``alert_timeline`` as they become certain: once the watermark has passed a minute.

    Events are counted by minute first, so a rule's state sees one row a minute, whatever the traffic.
    """
    counts = minute_counts(event_time(events, ts), ts)
    number: Column = (F.unix_millis("minute") / MINUTE_MS).cast("bigint").alias("minute_no")
    cells = [F.struct(F.lit(name).alias("rule"), F.col(count).alias("n")) for name, count, *_ in RULES]
    long = counts.select(number, "seen", F.inline(F.array(*cells)))
    return long.groupBy("rule").transformWithStateInPandas(AlertProcessor(hold_minutes), TRANSITIONS, "append", "EventTime")


def run_alerts(events: DataFrame, out: str, checkpoint: str, ts: str = "ts", hold_minutes: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Append the changes to ``out``. Timers need the RocksDB store, which this query is started with."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return append_stream(stream_alert_changes(events, ts, hold_minutes), out, checkpoint, trigger=trigger)
    finally:
        conf.set(name, before)
