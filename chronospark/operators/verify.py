"""Checks of order and of what reading skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_previous


def backward_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, bucket: Column) -> DataFrame:
    """How often the time goes back from one row of a key to the next: keys and n_back."""
    rows = with_previous(df, keys, order, bucket, {"__before": time})
    return rows.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("__before") > F.col(time), F.lit(False))).alias("n_back"))


def verify(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Findings: file, level (error, warning or info), code, channel_index, detail."""
    levels = {"CrcMismatch": "error", "ZeroLengthBlock": "warning", "StatusEvent": "info", "UnknownChannel": "error"}
    level = F.lit(None).cast("string")
    for k, v in levels.items():
        level = F.when(F.col("skip_reason") == k, F.lit(v)).otherwise(level)
    skipped = blocks.withColumn("level", level).where("level is not null").groupBy("file", "level", F.col("skip_reason").alias("code"), "channel_index").agg(F.count("*").alias("__n"))
    skipped = skipped.select("file", "level", "code", "channel_index", F.concat(F.col("__n").cast("string"), F.lit(" blocks")).alias("detail"))
    starts = blocks.where("kind = 'start' and skip_reason is null")
    back = backward_steps(starts, ["file", "channel_index"], ["block_ord"], "start_ns", F.floor(F.col("block_ord") / 65536)).where("n_back > 0")
    back = back.select("file", F.lit("error").alias("level"), F.lit("start_backward").alias("code"), "channel_index", F.concat(F.col("n_back").cast("string"), F.lit(" steps")).alias("detail"))
    cut = files.where("truncated").select("file", F.lit("warning").alias("level"), F.lit("truncated").alias("code"), F.lit(None).cast("int").alias("channel_index"), F.lit("the last block is not whole").alias("detail"))
    bad = files.where("error is not null").select("file", F.lit("error").alias("level"), F.lit("unreadable").alias("code"), F.lit(None).cast("int").alias("channel_index"), F.col("error").alias("detail"))
    return skipped.unionByName(back).unionByName(cut).unionByName(bad)


def exit_code(findings: DataFrame, strict: bool = False) -> int:
    """4 for errors, with ``strict`` also for warnings, else 0."""
    levels = ["error", "warning"] if strict else ["error"]
    return 0 if findings.where(F.col("level").isin(levels)).isEmpty() else 4
