"""Merging recordings of a folder: prune by the catalog, read, merge, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as ops
from . import catalog as catalogs
from .recordings import read, write

VALUES = ("v_double", "v_long", "v_ulong", "v_bool", "v_string", "v_binary", "v_gps")


def merge(spark: SparkSession, path: str, start_ns: int, end_ns: int, channels: Sequence[str] | None = None, overlap: str = "skip", catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged samples with new channel indices, and warnings of channels that do not fit.

    Nothing that overlaps the interval is an error, as is an empty interval.
    """
    if end_ns <= start_ns:
        raise ValueError("the interval is empty: end must lie after start")
    table = catalogs.build(spark, path) if catalog is None else catalog
    kept = ops.file_rank(catalogs.prune(table, start_ns, end_ns)).select("file", "file_rank")
    # The names of kept files go to the driver to be the scan's paths: a row per file.
    names = [r["file"] for r in kept.select("file").toLocalIterator()]
    if not names:
        raise ValueError("no recording overlaps the interval")
    options = {"channels": list(channels) if channels else None, "start_ns": start_ns, "end_ns": end_ns}
    definitions = read(spark, path, "channels", paths=names, channels=options["channels"]).where("supported").join(kept, "file").withColumn("channel_pos", F.col("channel_index"))
    schema = ops.merged_schema(definitions)
    rows = read(spark, path, paths=names, **options).join(kept, "file")
    good, warnings = ops.split_mismatches(rows, definitions, schema)
    good = good.withColumn("ord", F.struct("block_ord", "sample_ord"))
    merged = ops.merge(good, start_ns, end_ns, overlap=overlap, values=VALUES)
    named = schema.select(F.col("key").alias("__key"), F.col("channel").alias("name"), "channel_index", "datatype", "physical_unit", "physical_dimension", "display_name", "comment", "reference", "mime_type", "channel_type")
    out = merged.join(named, F.col("channel") == F.col("__key")).drop("channel", "__key").withColumnRenamed("name", "channel")
    return out, warnings


def merge_to_file(spark: SparkSession, path: str, target: str, name: str, start_ns: int, end_ns: int, channels: Sequence[str] | None = None, overlap: str = "skip", version: int = 5, catalog: DataFrame | None = None) -> DataFrame:
    """The merged recording as one file; gives the warnings."""
    out, warnings = merge(spark, path, start_ns, end_ns, channels, overlap, catalog)
    write(out.withColumn("file", F.lit(name)), target, version=version, tasks=1)
    return warnings
