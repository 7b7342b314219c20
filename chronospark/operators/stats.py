"""Statistics of channels, extents, crossings, bands and telemetry of reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import band_index
from .asof import asof
from .filters import by_names, interval
from .ordered import bucket_size, time_bucket, with_next

#: Inner bounds of the default bands, e.g. of a speed in km/h.
BOUNDS = (30, 50, 80, 110)


def channel_stats(samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None, channels: Sequence[str] | None = None, value: str = "v") -> DataFrame:
    """n, vmin, vmax, mean and sample deviation (0 for a single sample).

    NaN is left out of the extremes and makes mean and deviation NaN.
    """
    rows = interval(by_names(samples, channels), start_ns, end_ns)
    v = F.col(value)
    real = F.when(~F.isnan(v), v)
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.min(real).alias("vmin"), F.max(real).alias("vmax"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))


def with_empty(stats: DataFrame, channels: DataFrame) -> DataFrame:
    """Also channels without samples, with n = 0."""
    out = channels.select("channel").distinct().join(stats, "channel", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


#: Precision of the quantiles between which an exact median is looked for.
MEDIAN_ACCURACY = 10_000


def median(samples: DataFrame, keys: Sequence[str] = ("channel",), value: str = "v") -> DataFrame:
    """The exact median of each key as ``med``, without all values of a key in one place.

    A quantile sketch of bounded size gives two values that the median lies between; the
    rows below are counted, and only the few in between are put in order, by their
    distinct values.  NaN is the largest value, nulls do not count.
    """
    v, slack = F.col(value).cast("double"), 2.0 / MEDIAN_ACCURACY
    rows = samples.where(F.col(value).isNotNull()).select(*keys, v.alias("__v"))
    near = rows.groupBy(*keys).agg(F.percentile_approx("__v", [max(0.0, 0.5 - slack), 0.5 + slack], MEDIAN_ACCURACY).alias("__q"), F.count("*").alias("__n"))
    joined = rows.join(near, list(keys)) if keys else rows.crossJoin(F.broadcast(near))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    below = joined.groupBy(*keys).agg(F.count_if(F.col("__v") < lo).alias("__below"))
    inside = joined.where((F.col("__v") >= lo) & (F.col("__v") <= hi)).groupBy(*keys, "__v").agg(F.count("*").alias("__m"), F.first("__n").alias("__n"))
    over = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (inside.join(below, list(keys)) if keys else inside.crossJoin(F.broadcast(below))).withColumn("__end", F.col("__below") + F.sum("__m").over(over))
    first, second = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)  # 0-based places of the middle
    at = lambda k: F.max(F.when((F.col("__end") > k) & (F.col("__end") - F.col("__m") <= k), F.col("__v")))
    return placed.groupBy(*keys).agg(at(first).alias("__a"), at(second).alias("__b")).select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * 0.5).alias("med"))


def describe_numeric(samples: DataFrame, value: str = "v") -> DataFrame:
    """Extremes, mean and exact median of each channel."""
    made = samples.groupBy("channel").agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.avg(value).alias("mean"))
    return made.join(median(samples, ("channel",), value), "channel", "left").select("channel", "vmin", "vmax", "mean", "med")


def extent(samples: DataFrame) -> DataFrame:
    """First and last time over all channels; 0 and 0 without samples."""
    return samples.agg(F.coalesce(F.min("ts_ns"), F.lit(0)).alias("first_ts"), F.coalesce(F.max("ts_ns"), F.lit(0)).alias("last_ts"))


def y_range(samples: DataFrame, value: str = "v") -> DataFrame:
    return samples.groupBy("channel").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def forward_diff(samples: DataFrame, bucket_ns: int | None = None) -> DataFrame:
    """dur_ns: time to the next sample of the channel; null for the last."""
    bucket = time_bucket(F.col("ts_ns"), bucket_ns or bucket_size(samples, ["channel"]))
    out = with_next(samples, ["channel"], ["ts_ns", "ord"], bucket, {"next_ts": "ts_ns"})
    return out.withColumn("dur_ns", F.col("next_ts") - F.col("ts_ns")).drop("next_ts")


def band_occupancy(samples: DataFrame, bounds: Sequence[float] = BOUNDS, value: str = "v", all_bands: bool = False) -> DataFrame:
    """Time in each band of values: channel, band, dur_ns; a value holds until the next."""
    rows = forward_diff(samples).where("dur_ns is not null")
    out = rows.groupBy("channel", band_index(F.col(value), bounds).alias("band")).agg(F.sum("dur_ns").alias("dur_ns"))
    if not all_bands:
        return out
    every = samples.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("band"))
    return every.join(out, ["channel", "band"], "left").withColumn("dur_ns", F.coalesce("dur_ns", F.lit(0)))


def band_shares(occupancy: DataFrame) -> DataFrame:
    """Seconds and share in percent of each band."""
    total = occupancy.groupBy("channel").agg(F.sum("dur_ns").alias("__all"))
    out = occupancy.join(total, "channel")
    return out.select("channel", "band", (F.col("dur_ns") / 1e9).alias("seconds"), F.when(F.col("__all") > 0, F.col("dur_ns") * 100.0 / F.col("__all")).otherwise(0.0).alias("share"))


def band_stats(a: DataFrame, b: DataFrame, bounds: Sequence[float] = BOUNDS, method: str = "linear") -> DataFrame:
    """Mean, maximum and count of a, by the band of b at a's times."""
    rows = asof(a, b, method).withColumn("band", band_index(F.col("found"), bounds))
    return rows.where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("vmax"))


def first_crossing(samples: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Time from a channel's first sample to the first at or above the threshold."""
    hit = F.min(F.when(F.col(value) >= threshold, F.col("ts_ns")))
    return samples.groupBy("channel").agg((hit - F.min("ts_ns")).alias("elapsed_ns"))


def window_summary(samples: DataFrame, window_ns: int, value: str = "v", trend: bool = False) -> DataFrame:
    """lo, hi, mean and sd of each channel and window; ``trend`` adds direction and anomaly."""
    w = F.col("ts_ns") - F.pmod("ts_ns", F.lit(window_ns))
    made = [F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    if trend:
        made.append(F.regr_slope(F.col(value), F.col("ts_ns") / 1e9).alias("slope"))
    out = samples.groupBy("channel", w.alias("w")).agg(*made)
    if trend:
        out = out.withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat"))
        out = out.withColumn("anomaly", F.coalesce((F.col("hi") - F.col("mean") > 3 * F.col("sd")) | (F.col("mean") - F.col("lo") > 3 * F.col("sd")), F.lit(False))).drop("slope")
    return out


def top_channels(samples: DataFrame, k: int = 10) -> DataFrame:
    """The channels with most samples, by name among equals."""
    return samples.groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(k)


def list_channels(channels: DataFrame, sort: str = "INDEX") -> DataFrame:
    return channels.orderBy("channel_index" if sort.upper() == "INDEX" else "channel")


SKIP_REASONS = ("UnsupportedDataType", "ReservedBlockType", "DeprecatedBlockType", "StatusEvent", "ZeroLengthBlock", "CrcMismatch", "SignatureBlock")


def channel_telemetry(blocks: DataFrame) -> DataFrame:
    """What reading saw of each channel."""
    read, skipped = F.col("skip_reason").isNull(), F.col("skip_reason").isNotNull()
    return blocks.groupBy("file", "channel_index").agg(
        F.count_if(read).alias("blocks_read"), F.count_if(skipped).alias("blocks_skipped"), F.coalesce(F.sum(F.when(read, F.col("n"))), F.lit(0)).alias("samples_total"),
        F.coalesce(F.sum(F.when(read, F.col("length"))), F.lit(0)).alias("bytes_payload"), F.count_if(read & (F.col("kind") == "start")).alias("segments"),
        F.min(F.when(read, F.col("first_ts"))).alias("first_ts"), F.max(F.when(read, F.col("last_ts"))).alias("last_ts"),
    )


def file_telemetry(blocks: DataFrame) -> DataFrame:
    """Blocks of each file in all, read, and skipped for each reason; they add up."""
    read = F.col("skip_reason").isNull()
    made = [F.count_if(F.coalesce(F.col("skip_reason") == r, F.lit(False))).alias("skipped_" + r) for r in SKIP_REASONS]
    return blocks.groupBy("file").agg(F.count("*").alias("blocks_total"), F.count_if(read).alias("blocks_read"), *made, F.countDistinct(F.when(read & (F.col("n") > 0), F.col("channel_index"))).alias("channels_with_data"), F.sum("length").alias("bytes_payload"))


def verification_status(integrity: Column, crc_failures: Column) -> Column:
    return F.when(integrity == "none", "none").when(crc_failures > 0, "invalid").when(integrity == "signed", "signature_unverifiable").otherwise("crc_valid")
