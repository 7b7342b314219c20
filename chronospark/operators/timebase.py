"""Time of samples from blocks: equidistant segments, relative stamps, block families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import id_bucket, running_sum, with_nearest

_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


def _saturated(sum_: Column, up: Column) -> Column:
    return F.coalesce(sum_, F.when(up, F.lit(_MAX)).otherwise(F.lit(_MIN)))


def equidistant_ts(start_ns: Column, rate_hz: Column, i: Column, model: str = "exact") -> Column:
    """Time of sample i: start + trunc(i * 1e9 / rate), at the ends of the range at most.

    A rate of 0 or below keeps the start.  The model "rounded" uses a whole increment; in
    the model "increment" the second column is that increment in nanoseconds, and i counts
    from the channel's first sample whatever the segments are.
    """
    if model == "increment":  # the sample's place times the channel's increment in ns, whatever the rate
        return F.try_add(start_ns, i * rate_hz.cast("long"))
    if model == "rounded":
        step = i * F.rint(F.lit(1e9) / rate_hz).try_cast("long")
    else:
        step = F.coalesce((i * F.lit(1e9) / rate_hz).try_cast("long"), F.lit(_MAX))
    total = _saturated(F.try_add(start_ns, step), step > 0)
    return F.when((rate_hz > 0) & (i != 0), total).otherwise(start_ns)


def _blocks_in_order(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("block_ord")


def segments(blocks: DataFrame, keys: tuple[str, ...] = ("file", "channel_index")) -> DataFrame:
    """Blocks with seg_id (a start block opens one), seg_off, and the segment's start and rate.

    Blocks are few beside samples: these windows see one row for each block.
    """
    over = _blocks_in_order(keys)
    out = blocks.withColumn("seg_id", F.sum((F.col("kind") == "start").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "seg_id").orderBy("block_ord")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("seg_off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = inside.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("seg_start", F.first("start_ns", True).over(whole)).withColumn("seg_rate", F.first("rate_hz", True).over(whole))


def expand_equidistant(blocks: DataFrame, values: str = "values", keys: tuple[str, ...] = ("file", "channel_index"), model: str = "exact") -> DataFrame:
    """One row per sample of start and continued blocks: keys, seg_id, i, ts_ns and v.

    Gaps between segments stay gaps.  Samples before any start block have no time.
    """
    rows = segments(blocks, keys)
    rows = rows.select(*keys, "block_ord", "seg_id", "seg_off", "seg_start", "seg_rate", F.posexplode(values).alias("__at", "v"))
    rows = rows.withColumn("i", F.col("seg_off") + F.col("__at"))
    ts = F.when(F.col("seg_id") > 0, equidistant_ts(F.col("seg_start"), F.col("seg_rate"), F.col("i"), model))
    return rows.select(*keys, "block_ord", F.col("seg_id").cast("long").alias("seg"), "i", ts.alias("ts_ns"), "v")


def accumulate_relative(df: DataFrame, keys: tuple[str, ...] = ("channel",), order: str = "ord", absolute: str = "abs_ns", delta: str = "delta_ns", bucket: Column | None = None) -> DataFrame:
    """Times of samples of which some are absolute and the others relative to the one before.

    Without an absolute time before it a sample has none (``anchored`` is false).
    ``bucket`` never falls as the order goes on; by default the order is a dense number.
    A sample's time is the running sum of all steps and, of the last absolute one before
    it, how far that lies ahead of its own sum; both pass from bucket to bucket.
    """
    bucket = id_bucket(F.col(order)) if bucket is None else bucket
    step = F.when(F.col(absolute).isNull(), F.col(delta)).otherwise(0)
    out = running_sum(df, keys, [order], bucket, step, "__run")
    lead = F.col(absolute) - F.col("__run")
    out = with_nearest(out, list(keys), [order], bucket, lead, "__lead", None)
    return out.withColumn("ts_ns", F.col("__lead") + F.col("__run")).withColumn("anchored", F.col("__lead").isNotNull()).drop("__run", "__lead")


def check_families(blocks: DataFrame, keys: tuple[str, ...] = ("file", "channel_index")) -> DataFrame:
    """Channels whose blocks do not belong together: keys, code and detail."""
    family = F.when(F.col("kind").isin("start", "continued"), "equidistant").when(F.col("kind").isin("absolute", "relative"), "timestamped").when(F.col("kind") == "message", "timestamped")
    rows = blocks.withColumn("__family", family).where("__family is not null")
    per = rows.groupBy(*keys).agg(F.collect_set("__family").alias("__all"), F.min_by("kind", "block_ord").alias("__first"))
    mixed = per.where(F.size("__all") > 1).select(*keys, F.lit("ChannelMixedBlockTypes").alias("code"), F.array_join(F.array_sort("__all"), ",").alias("detail"))
    headless = per.where("__first = 'continued'").select(*keys, F.lit("ContinuedDataWithoutStart").alias("code"), F.lit("continued").alias("detail"))
    lost = per.where("__first = 'relative'").select(*keys, F.lit("RelativeStampWithoutAnchor").alias("code"), F.lit("relative").alias("detail"))
    return mixed.unionByName(headless).unionByName(lost)


def time_range(samples: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))
