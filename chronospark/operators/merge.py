"""Merging recordings: one value per channel and time, first or last wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import by_names, interval, overlaps


def merge(samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None, channels: Sequence[str] | None = None, overlap: str = "skip", order: Sequence[str] = ("file_rank", "ord"), values: Sequence[str] = ("v",)) -> DataFrame:
    """channel (lower case), ts_ns and values; repeated times in one file count as overlap.

    An aggregate, not a window: each task reduces its own rows first, so a hot channel
    or time costs no single task.
    """
    if start_ns is not None and end_ns is not None and end_ns <= start_ns:
        raise ValueError("the interval is empty: end must lie after start")
    if overlap not in ("skip", "overwrite"):
        raise ValueError(f"overlap is skip or overwrite, not {overlap!r}")
    rows = interval(by_names(samples, channels), start_ns, end_ns)
    pick = F.min_by if overlap == "skip" else F.max_by
    chosen = pick(F.struct(*values), F.struct(*order)).alias("__v")
    out = rows.groupBy(F.lower("channel").alias("channel"), "ts_ns").agg(chosen)
    return out.select("channel", "ts_ns", *[F.col(f"__v.{c}").alias(c) for c in values])


def file_rank(catalog: DataFrame) -> DataFrame:
    """Files by first time, then path; a row per file, so few rows."""
    return catalog.withColumn("file_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("first_ts"), "file")) - 1)


def merged_schema(definitions: DataFrame, order: Sequence[str] = ("file_rank", "channel_pos")) -> DataFrame:
    """The definition of each channel: the first sighting's, with a new index in that order."""
    fields = [c for c in definitions.columns if c not in ("channel_index",)]
    first = definitions.groupBy(F.lower("channel").alias("key")).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("__d"))
    out = first.select("key", *[F.col(f"__d.{c}").alias(c) for c in fields])
    return out.withColumn("channel_index", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def split_mismatches(samples: DataFrame, definitions: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples whose file agrees on the channel's type, and a warning for each that does not."""
    want = schema.select("key", F.col("datatype").alias("__want"))
    judged = definitions.withColumn("key", F.lower("channel")).join(want, "key")
    bad = judged.where(F.col("datatype") != F.col("__want"))
    warnings = bad.select("file", "key", F.col("datatype").alias("found"), F.col("__want").alias("expected"))
    drop = bad.select("file", F.col("key").alias("__key"))
    good = samples.join(drop, (samples["file"] == drop["file"]) & (F.lower(samples["channel"]) == F.col("__key")), "left_anti")
    return good, warnings


def report(catalog: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Files found, kept and in error, and samples of the kept ones: one row."""
    keep = overlaps(start_ns, end_ns) & F.col("error").isNull()
    return catalog.agg(F.count("*").alias("found"), F.count_if(keep).alias("kept"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("samples"))
