"""The driver's tables as samples: channel, ts_ns, v and the stream's order ord."""

from __future__ import annotations

import tempfile
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import from_timestamp

CHANNELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Times are UTC: without a zone they are read, and rendered, in the session's.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only in local mode, where there is but one machine, an unset one is made up.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _instant(ts_ns: int) -> Column:
    return F.to_timestamp_ntz(F.lit(str(datetime.fromtimestamp(ts_ns // 1_000_000_000, timezone.utc).replace(tzinfo=None))))


def samples(spark: SparkSession, sf_dir: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """With bounds also a filter in whole seconds on the stored column, which reaches the scan."""
    events = table(spark, sf_dir, "events")
    if start_ns is not None:
        events = events.where(F.col("ts") >= _instant(start_ns))
    if end_ns is not None:
        events = events.where(F.col("ts") < _instant(end_ns + 1_000_000_000))
    return events.select(F.col("event_id").alias("ord"), F.col("event_type").alias("channel"), from_timestamp(F.col("ts")).alias("ts_ns"), F.col("value").alias("v"))


def hourly(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_ns", F.col("ts_ns") - F.pmod("ts_ns", F.lit(3_600_000_000_000)))


def two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings that overlap, with times cut to hours."""
    rows = hourly(samples(spark, sf_dir))
    a = rows.where("ord % 3 <> 0").select(F.lit(0).alias("file_rank"), "ord", "channel", "ts_ns", "v")
    b = rows.where("ord % 2 = 0").select(F.lit(1).alias("file_rank"), "ord", "channel", "ts_ns", (F.col("v") + 1000).alias("v"))
    return a.unionByName(b)


def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as start and continued blocks: segments of 40 samples in blocks of 10 at 3 Hz."""
    from ..operators.ordered import id_bucket, numbered

    rows = numbered(samples(spark, sf_dir), ["channel"], ["ord"], id_bucket(F.col("ord")), "rn")
    rows = rows.withColumn("seg", F.floor(F.col("rn") / 40)).withColumn("part", F.floor(F.col("rn") / 10))
    blocks = rows.groupBy("channel", "part").agg(
        F.min("seg").alias("seg"), F.min("ts_ns").alias("low"), F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda p: p["v"]).alias("values"),
    )
    start = F.col("part") % 4 == 0
    return blocks.select(
        "channel", F.col("part").alias("block_ord"), F.when(start, "start").otherwise("continued").alias("kind"), "n",
        F.when(start, F.col("low")).alias("start_ns"), F.when(start, F.lit(3.0)).alias("rate_hz"), "values",
    )


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per 100 events of a channel's hundred, with reasons to skip some."""
    rows = samples(spark, sf_dir).withColumn("block_ord", F.floor(F.col("ord") / 100))
    blocks = rows.groupBy("channel", "block_ord").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))
    index = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel")).cast("int") - 1
    k = F.col("block_ord")
    reason = F.when(k % 7 == 3, "ZeroLengthBlock").when(k % 11 == 5, "CrcMismatch").when(k % 13 == 6, "StatusEvent")
    return blocks.select(
        F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"), "block_ord", index.alias("channel_index"), (F.col("n") * 16 + 5).alias("length"),
        F.when(k % 4 == 0, "start").otherwise("continued").alias("kind"), "n", F.col("first_ts").alias("start_ns"), "first_ts", "last_ts", reason.alias("skip_reason"),
    )
