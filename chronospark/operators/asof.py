"""As-of lookups of one series at the times of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import lerp
from .ordered import bucket_size, time_bucket, with_nearest

METHODS = ("linear", "nearest", "zoh")


def asof(probe: DataFrame, source: DataFrame, method: str = "linear", by: Sequence[str] = (), bucket_ns: int | None = None, order: str = "ord", value: str = "v") -> DataFrame:
    """The probe's rows with the source's value at their times as ``found``.

    linear interpolates and is constant outside; nearest takes the closer sample, the
    earlier of two as close; zoh holds the last value.  Of source rows with equal times
    the last in order counts.  The two sides are merged by time in buckets, so no join
    on inequalities and no single sorted task is needed; buckets follow the counts.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    if bucket_ns is None:  # such that neither side has too many rows in one
        bucket_ns = bucket_size(source, by, size=bucket_size(probe, by))
    points = source.where(F.col("ts_ns").isNotNull() & F.col(value).isNotNull()).groupBy(*by, "ts_ns").agg(F.max_by(value, order).alias("__sv"))
    columns = probe.columns
    left = probe.select(*[F.col(c) for c in columns], F.lit(None).cast("struct<t:bigint,v:double>").alias("__p"), F.lit(1).alias("__side"))
    right = points.select(*by, "ts_ns", F.struct(F.col("ts_ns").alias("t"), F.col("__sv").cast("double").alias("v")).alias("__p"), F.lit(0).alias("__side"))
    rows = left.unionByName(right, allowMissingColumns=True)
    found = with_nearest(rows, list(by), ["ts_ns", "__side"], time_bucket(F.col("ts_ns"), bucket_ns), F.col("__p"), "__lo2", "__hi2")
    found = found.where("__side = 1")
    # A point at the probe's own time stands before it in order; it is both neighbours.
    lo, hi, t = F.col("__lo2"), F.col("__hi2"), F.col("ts_ns")
    hi_t = F.when(lo["t"] == t, lo["t"]).otherwise(hi["t"])
    hi_v = F.when(lo["t"] == t, lo["v"]).otherwise(hi["v"])
    if method == "zoh":
        out = lo["v"]
    elif method == "linear":
        out = lerp(t, lo["t"], lo["v"], hi_t, hi_v)
    else:
        out = F.when(lo["t"].isNull(), hi_v).when(hi_t.isNull(), lo["v"]).when(t - lo["t"] <= hi_t - t, lo["v"]).otherwise(hi_v)
    return found.select(*columns, out.alias("found"))
