"""The catalog: a table of files and the time ranges of their channels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import fmt_ts
from ..operators.filters import overlaps
from .recordings import GLOB, _store, read
from .wire import EXTENSIONS


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files below a path: file, size and time of change; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


#: Version of the catalog's layout; one of another version is built anew.
VERSION = 1
#: Times of change that differ by less are the same, as file systems round them.
TOLERANCE_S = 1.5
#: What is put behind a recording's name for the JSON file beside it.
SIDECAR = ".json"


def build(spark: SparkSession, path: str, files: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """One row per file and channel: count and true range; nulls where a channel is empty.

    Files that cannot be read keep one row with their error.
    """
    files = listing(spark, path) if files is None else files
    meta = read(spark, path, "files", paths=paths).select("file", "version", "truncated", "error")
    channels = read(spark, path, "channels", paths=paths).select("file", "channel_index", "channel", "datatype", "physical_unit")
    # Ranges come from the blocks: no value is decoded into a row for them.
    ranges = read(spark, path, "blocks", paths=paths).where("skip_reason is null and n > 0").groupBy("file", "channel_index")
    # A count and the range of the first and last samples in time.
    ranges = ranges.agg(F.sum("n").alias("n"), F.min(F.least("first_ts", "last_ts")).alias("first_ts"), F.max(F.greatest("first_ts", "last_ts")).alias("last_ts"))
    rows = channels.join(ranges, ["file", "channel_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return files.join(meta, "file").join(rows, "file", "left").withColumn("catalog_version", F.lit(VERSION))


def _generations(spark: SparkSession, at: str) -> list[tuple[int, str]]:
    """Whole generations of the catalog kept at ``at``, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return []
    found = []
    for f in store.listStatus(hadoop):
        name = f.getPath().getName()
        if name.startswith("generation-") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found.append((int(name.rsplit("-", 1)[1]), f.getPath().toString()))
    return sorted(found)


def load(spark: SparkSession, at: str) -> DataFrame | None:
    """The newest whole generation; none if there is none of this version."""
    kept = _generations(spark, at)
    if not kept:
        return None
    table = spark.read.parquet(kept[-1][1])
    if "catalog_version" not in table.columns or table.where(F.col("catalog_version") != VERSION).limit(1).count():
        return None
    return table


def _same(old: DataFrame, now: DataFrame) -> DataFrame:
    """Files of the listing that the catalog knows as they are now."""
    known = old.select("file", F.col("size").alias("__s"), F.col("mtime").alias("__m")).distinct()
    near = F.abs(F.unix_micros("mtime") - F.unix_micros("__m")) <= int(TOLERANCE_S * 1_000_000)
    return now.join(known, "file", "left").withColumn("status", F.when(F.col("__s").isNull(), "missing").when((F.col("__s") == F.col("size")) & near, "valid").otherwise("stale")).drop("__s", "__m")


def refresh(spark: SparkSession, path: str, at: str, force: bool = False) -> DataFrame:
    """The catalog kept at ``at``: only files that are new or changed in size or time are read.

    A new generation is written beside the last one, which stays readable; older ones go.
    """
    old = None if force else load(spark, at)
    now = listing(spark, path)
    if old is None:
        out = build(spark, path)
    else:
        state = _same(old, now)
        kept = old.join(state.where("status = 'valid'").select("file"), "file", "left_semi")
        changed = [r["file"] for r in state.where("status <> 'valid'").select("file").toLocalIterator()]  # a row per file
        out = kept.unionByName(build(spark, path, now.where(F.col("file").isin(changed)), changed)) if changed else kept
    before = _generations(spark, at)
    made = f"{at.rstrip('/')}/generation-{before[-1][0] + 1 if before else 0}"
    out.write.mode("overwrite").parquet(made)
    for _, path_ in before[:-1]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path_)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return spark.read.parquet(made)


def status(catalog: DataFrame | None, now: DataFrame) -> DataFrame:
    """Each file below the path as valid, stale or missing in the catalog."""
    if catalog is None:
        return now.select("file", F.lit("missing").alias("status"))
    return _same(catalog, now).select("file", "status")


def sidecars(catalog: DataFrame) -> DataFrame:
    """file and ``value``: what a JSON file beside each recording says about it."""
    # The names of the fields.
    utc = lambda c: F.when(F.col(c).isNotNull(), fmt_ts(F.col(c), "iso8601", "java")).alias(c.replace("_ts", "_timestamp_utc"))
    ns = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c.replace("_ts", "_timestamp_ns"))
    channel = F.struct(F.col("channel_index").alias("index"), F.col("channel").alias("name"), "datatype", F.col("physical_unit").alias("physicalunit"), F.col("n").alias("sample_count"), ns("first_ts"), ns("last_ts"), utc("first_ts"), utc("last_ts"))
    own = catalog.groupBy("file").agg(
        F.first("size").alias("size"), F.first("mtime").alias("mtime"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        F.array_sort(F.collect_list(F.when(F.col("channel_index").isNotNull(), channel))).alias("channels"),
    )
    modified = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("source_modified")
    value = F.struct(F.lit(VERSION).alias("osf_cache_version"), F.col("file").alias("source_file"), F.col("size").alias("source_size"), modified, ns("first_ts"), ns("last_ts"), utc("first_ts"), utc("last_ts"), F.when(F.col("truncated"), True).alias("truncated"), "channels")
    return own.select("file", F.to_json(value).alias("value"))


def file_ranges(catalog: DataFrame) -> DataFrame:
    """One row per file: range over its non-empty channels, samples, error."""
    return catalog.groupBy("file").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("error").alias("error"))


def prune(catalog: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Files whose range meets the interval; empty and unreadable files never do."""
    return file_ranges(catalog).where(overlaps(start_ns, end_ns) & F.col("error").isNull())


def with_catalog(channels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Channel definitions with counts and ranges by name without case; 0 where unknown."""
    known = catalog.groupBy(F.lower("channel").alias("__key")).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    out = channels.join(known, F.lower("channel") == F.col("__key"), "left").drop("__key")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def write_sidecars(catalog: DataFrame) -> int:
    """A JSON file beside each recording, named after it; gives how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = _store(file)
                with store.open_output_stream(path + SIDECAR) as f:
                    f.write(value.encode())
            yield batch.select([0])

    return sidecars(catalog).mapInArrow(run, "file string").count()


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The catalog that the JSON files below a path make up; what is no such file is left out."""
    # The names of the fields.
    channel = "struct<index:int,name:string,datatype:string,physicalunit:string,sample_count:long,first_timestamp_ns:long,last_timestamp_ns:long>"
    schema = f"osf_cache_version int, source_file string, source_size long, source_modified string, truncated boolean, channels array<{channel}>"
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{EXTENSIONS[0]}*{SIDECAR}").text(path, wholetext=True)
    found = texts.select(F.from_json("value", schema).alias("j")).where(F.col("j.osf_cache_version") == VERSION).select("j.*", F.explode_outer("j.channels").alias("c"))
    time = lambda f: F.when(F.col("c.sample_count") > 0, F.col(f"c.{f}"))
    return found.select(
        F.col("source_file").alias("file"), F.col("source_size").alias("size"), F.to_timestamp("source_modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("mtime"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.col("c.index").alias("channel_index"), F.col("c.name").alias("channel"), F.col("c.datatype").alias("datatype"), F.col("c.physicalunit").alias("physical_unit"), F.col("c.sample_count").alias("n"),
        time("first_timestamp_ns").alias("first_ts"), time("last_timestamp_ns").alias("last_ts"), F.lit(None).cast("string").alias("error"), F.lit(VERSION).alias("catalog_version"),
    )
