"""Fewer samples: extremes per pixel, every n-th, fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import id_bucket, numbered


def pixel(ts_ns: Column, t0: int, t1: int, width: int) -> Column:
    """The column px whose range [t0 + px * span // width, ...) holds the time; exact."""
    span = t1 - t0
    wide = "decimal(38,0)"
    place = ((ts_ns - F.lit(t0) + 1).cast(wide) * F.lit(width).cast(wide) - 1).cast(wide)
    return F.call_function("div", place, F.lit(span).cast(wide)).cast("long")


def decimate(samples: DataFrame, t0: int, t1: int, width: int, closed: str = "left", value: str = "v", all_pixels: bool = False) -> DataFrame:
    """channel, px, lo, hi; with ``all_pixels`` also empty columns, and has_data."""
    if t1 <= t0 or width <= 0:
        raise ValueError("the range and the width must not be empty")
    inside = (F.col("ts_ns") >= t0) & (F.col("ts_ns") <= t1 if closed == "both" else F.col("ts_ns") < t1)
    px = F.least(pixel(F.col("ts_ns"), t0, t1, width), F.lit(width - 1).cast("long"))
    out = samples.where(inside).groupBy("channel", px.alias("px")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    if not all_pixels:
        return out
    every = samples.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("px"))
    return every.join(out, ["channel", "px"], "left").withColumn("has_data", F.col("lo").isNotNull())


def every_nth(samples: DataFrame, max_points: int, order: str = "ord") -> DataFrame:
    """Each (n div max_points)-th sample of channels with more samples than that."""
    counts = samples.groupBy("channel").agg(F.count("*").alias("__n"))
    rows = numbered(samples, ["channel"], [order], id_bucket(F.col(order)), "__i").join(counts, "channel")
    step = F.when(F.col("__n") > max_points, F.call_function("div", F.col("__n"), F.lit(max_points))).otherwise(F.lit(1))
    return rows.where(F.col("__i") % step == 0).drop("__i", "__n")


def sliding_windows(samples: DataFrame, size: int, stride: int, order: str = "ord", value: str = "v") -> DataFrame:
    """Whole windows of ``size`` samples, one every ``stride``: channel, win, values in order."""
    counts = samples.groupBy("channel").agg(F.count("*").alias("__n"))
    rows = numbered(samples, ["channel"], [order], id_bucket(F.col(order)), "__i").join(counts, "channel")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    low = F.greatest(F.lit(0).cast("long"), div(F.col("__i") - size + stride, stride))
    high = F.least(div(F.col("__i"), stride), div(F.col("__n") - size, stride))
    fits = (F.col("__n") >= size) & (low <= high)
    out = rows.where(fits).select("channel", F.explode(F.sequence(low, high)).alias("win"), "__i", value)
    pairs = F.array_sort(F.collect_list(F.struct("__i", value)))
    return out.groupBy("channel", "win").agg(F.transform(pairs, lambda p: p[value]).alias("values"))
