"""Queries that go through the wire format: packed, decoded, cut, merged and streamed."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.recordings import decoded, encode_samples
from ..sources.views import Options
from .queries import S, _merged, query
from .tables import samples, shared_dir, table, two_files


def _typed(df: DataFrame) -> DataFrame:
    return df.select("file", F.lit("double").alias("datatype"), "channel", F.lit(0).alias("channel_index"), F.col("ord").cast("int").alias("sample_ord"), "ts_ns", F.col("v").alias("v_double"))


def _packed(df: DataFrame, **how: str) -> DataFrame:
    """One recording (column ``content``) for each value of ``file``."""

    def pack(t: pa.Table) -> pa.Table:
        name = t.column("file")[0].as_py()
        return pa.table({"file": [name], "content": pa.array([encode_samples(t.drop_columns(["file"]), **how)], pa.binary())})

    return _typed(df).groupBy("file").applyInArrow(pack, "file string, content binary")


@query(f"{S} select channel, ts_ns, v from s")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event through a checked recording for its channel and day, and back."""
    days = samples(spark, sf_dir).withColumn("file", F.concat_ws("-", "channel", F.floor(F.col("ts_ns") / 86_400_000_000_000).cast("string")))
    return decoded(_packed(days, integrity="crc32c"), Options()).select("channel", "ts_ns", F.col("v_double").alias("v"))


@query(f"{S} select channel, ts_ns, v from s")
def frame_roundtrip_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the older version, compressed."""
    days = samples(spark, sf_dir).withColumn("file", F.concat_ws("-", "channel", F.floor(F.col("ts_ns") / 86_400_000_000_000).cast("string")))
    return decoded(_packed(days, version=4, compression="gzip"), Options()).select("channel", "ts_ns", F.col("v_double").alias("v"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"


@query(_merged("asc"))
def merge_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings written, listed, pruned by their ranges, read and merged."""
    from ..sources import merging
    from ..sources.recordings import write

    folder = _folder(spark)
    both = two_files(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("file_rank").cast("string")))
    named = _typed(both).withColumn("channel_index", F.abs(F.hash("channel")) % 60_000)
    write(named, folder)
    merged, _ = merging.merge(spark, folder, 0, (1 << 62))
    return merged.select(F.lower("channel").alias("channel"), "ts_ns", F.col("v_double").alias("v"))


@query(f"""{S}, w as (select max(ts_ns) // 1000000 as ms from s), a as (select channel, max(ts_ns) as t, arg_max(v, ts_ns) as v from s group by 1)
select channel, ts_ns, v, false as reemitted from s
union all select channel, greatest(t + 60000000000, ms * 1000000) as ts_ns, v, true from a, w where t // 1000000 + 60000 < ms""")
def stale_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; silent channels send their last value again."""
    from ..functions.times import from_timestamp
    from ..streaming.guard import guard_stream

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows_ = stream.select(F.col("event_type").alias("channel"), from_timestamp(F.col("ts")).alias("ts_ns"), F.col("value").alias("v"))
    name, folder = f"stale_{uuid.uuid4().hex}", _folder(spark)
    q = guard_stream(rows_, 60_000_000_000).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")
