"""Stale values: the last value of a silent channel is sent again (the batch twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import bucket_size, time_bucket, with_next

#: The default interval: 100 s.
INTERVAL_NS = 100_000_000_000


def reemit_stale(samples: DataFrame, interval_ns: int = INTERVAL_NS, end_ns: int | None = None) -> DataFrame:
    """Values sent again at last + k * interval until the next sample: channel, ts_ns, v.

    With ``end_ns`` the last value of each channel is sent again up to that time.
    """
    rows = with_next(samples, ["channel"], ["ts_ns", "ord"], time_bucket(F.col("ts_ns"), bucket_size(samples, ["channel"])), {"__next": "ts_ns"})
    if end_ns is not None:
        rows = rows.withColumn("__next", F.coalesce("__next", F.lit(end_ns + 1)))
    count = F.call_function("div", F.col("__next") - F.col("ts_ns") - 1, F.lit(interval_ns))
    gaps = rows.where(F.col("__next") - F.col("ts_ns") > interval_ns)
    out = gaps.select("channel", "ts_ns", "v", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("__k"))
    return out.select("channel", (F.col("ts_ns") + F.col("__k") * interval_ns).alias("ts_ns"), "v")
