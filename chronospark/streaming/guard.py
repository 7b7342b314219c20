"""Stale values in a stream: a channel that stays silent sends its last value again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stale import INTERVAL_NS


class Guard:
    """The state of all channels on one machine, with the same rules as the stream's.

    ``poll`` sends the last value of each channel again that has been silent for the
    interval, stamped with the time of the poll, once; nothing is filled in between.
    """

    def __init__(self, interval_ns: int = INTERVAL_NS):
        self.interval_ns = interval_ns
        self.last: dict[Any, tuple[int, Any]] = {}

    def write(self, channel: Any, ts_ns: int, value: Any) -> None:
        self.last[channel] = (ts_ns, value)

    def poll(self, now_ns: int) -> list[tuple[Any, int, Any]]:
        out = []
        for channel, (at, value) in self.last.items():
            if now_ns - at >= self.interval_ns:
                out.append((channel, now_ns, value))
                self.last[channel] = (now_ns, value)
        return out

    def is_tracked(self, channel: Any) -> bool:
        return channel in self.last

    def forget(self, channel: Any) -> None:
        self.last.pop(channel, None)

    def clear(self) -> None:
        self.last.clear()


def with_lateness(samples: DataFrame, delay: str | None = None) -> DataFrame:
    """Samples with event time ``ts`` and, if a delay is given, a watermark.

    Without one nothing is ever late and no state is dropped.
    """
    out = samples.withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
    return out.withWatermark("ts", delay) if delay else out


POSITION = ("latitude", "longitude", "altitude")


def guard_stream(samples: DataFrame, interval_ns: int = INTERVAL_NS, delay: str = "0 seconds") -> DataFrame:
    """The samples as they come and, as the watermark moves on, values sent again: one
    for each time it has passed the interval since the channel's last activity.

    Samples pass whether they are late or not; the watermark only moves the timers, and a
    sample that is older than it starts none.  With a column ``v_gps`` also positions are
    guarded.  Text and bytes have neither value and pass unguarded, as nulls.  State is
    one time and value per channel.
    """
    interval_ms = max(1, interval_ns // 1_000_000)
    gps = "v_gps" in samples.columns
    values = ["v", *(POSITION if gps else ())]
    schema = "channel string, ts_ns long, " + ", ".join(f"{c} double" for c in values)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, *value = state.get
            now = max(at + interval_ns, state.getCurrentWatermarkMs() * 1_000_000)
            state.update((now, *value))
            state.setTimeoutTimestamp(now // 1_000_000 + interval_ms)
            yield pd.DataFrame({"channel": [key[0]], "ts_ns": [now]} | {c: [x] for c, x in zip(values, value)})
            return
        at, *value = state.get if state.exists else (None, *[None] * len(values))
        for batch in batches:
            last = batch.sort_values("ts_ns", kind="stable").iloc[-1]
            if at is None or last["ts_ns"] >= at:
                at, value = int(last["ts_ns"]), [None if pd.isna(last[c]) else float(last[c]) for c in values]
        if at is not None:
            state.update((at, *value))
            state.setTimeoutTimestamp(max(at // 1_000_000 + interval_ms, state.getCurrentWatermarkMs() + 1))

    position = [F.col(f"v_gps.{c}").cast("double").alias(c) for c in POSITION] if gps else []
    rows = samples.select("channel", "ts_ns", F.col("v").cast("double").alias("v"), *position)
    guarded = rows.where(" or ".join(f"{c} is not null" for c in values))
    state = "ts_ns long, " + ", ".join(f"{c} double" for c in values)
    again = with_lateness(guarded, delay).groupBy("channel").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    both = rows.withColumn("reemitted", F.lit(False)).unionByName(again.withColumn("reemitted", F.lit(True)))
    if not gps:
        return both
    found = F.when(F.col("latitude").isNotNull() | F.col("longitude").isNotNull() | F.col("altitude").isNotNull(), F.struct(*POSITION))
    return both.select("channel", "ts_ns", "v", found.alias("v_gps"), "reemitted")
