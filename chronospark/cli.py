"""Command line: merge, export, info, channels, stat, cache, config, convert, verify, dump, generate.

Exit codes: 0 done, 1 bad arguments, 2 not found, 3 input or output failed, 4 bad format.
Reports are tables, or JSON lines with --json.
"""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import os
import sys
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.times import NS, duration_hms
from .functions.types import is_numeric, loses_precision, numeric
from .operators import filters, stats, verify
from .sources import catalog as catalogs
from .sources import export, generate, merging
from .sources.recordings import convert, read
from .sources.wire import FormatError

OK, BAD_ARGS, NOT_FOUND, IO_ERROR, FORMAT_ERROR = range(5)
# Keys of the configuration and their defaults.
CONFIG = {"output.format": "5", "output.overlap": "skip", "export.decimal_sep": ",", "export.encoding": "iso-8859-1", "cache.enabled": "true", "cache.auto_build": "true"}
FAR_NS = 7_258_118_400 * NS  # the year 2200
log = logging.getLogger("chronospark")


def config_path() -> str:
    return os.environ.get("CHRONOSPARK_CONFIG", os.path.expanduser("~/.chronospark.json"))


def load_config() -> dict[str, str]:
    try:
        with open(config_path()) as f:
            return CONFIG | json.load(f)
    except FileNotFoundError:
        return dict(CONFIG)


def instant(text: str | None) -> int | None:
    """Nanoseconds of an ISO time (its first 19 characters) or of a number of nanoseconds."""
    if text is None:
        return None
    if text.lstrip("-").isdigit():
        return int(text)
    import calendar

    try:
        return calendar.timegm(time.strptime(text[:19].replace(" ", "T"), "%Y-%m-%dT%H:%M:%S")) * NS
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"no time: {text!r}") from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("chronospark", description=__doc__)
    p.add_argument("--json", action="store_true")
    p.add_argument("--log-level", default="WARNING")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, **({"nargs": "*"} if a == "channels" else {}))
        return v

    def span(v: argparse.ArgumentParser) -> None:
        v.add_argument("--start", type=instant)
        v.add_argument("--end", type=instant)

    m = verb("merge", "root", "out", "channels")
    span(m)
    m.add_argument("--v4", action="store_true")
    m.add_argument("--overwrite", action="store_true")
    m.add_argument("--no-cache", action="store_true")
    e = verb("export", "path", "out", "channels")
    span(e)
    e.add_argument("--format", default="csv", choices=["csv", "unified-csv", "per-channel", "hdf5", "parquet"])
    e.add_argument("--time", default="datetime", choices=["datetime", "seconds", "iso8601", "nanoseconds"])
    e.add_argument("--dialect", default="delphi", choices=["delphi", "java"])
    verb("info", "path")
    c = verb("channels", "path")
    c.add_argument("--filter")
    c.add_argument("--sort", default="INDEX", choices=["INDEX", "NAME"])
    c.add_argument("--catalog")
    span(verb("stat", "path", "channels"))
    k = verb("cache", "action", "path", "at")
    k.add_argument("--non-recursive", action="store_true")
    f = verbs.add_parser("config")
    f.add_argument("key", nargs="?")
    f.add_argument("value", nargs="?")
    v = verb("convert", "path", "out")
    v.add_argument("--v4", action="store_true")
    v.add_argument("--integrity", default="none", choices=["none", "crc32c"])
    v.add_argument("--gzip", action="store_true")
    v.add_argument("--merged", action="store_true", help="write a time for every sample")
    x = verb("verify", "path")
    x.add_argument("--strict", action="store_true")
    d = verb("dump", "path", "channels")
    d.add_argument("--limit", type=int, default=10)
    verb("generate", "out")
    return p


def show(df: DataFrame, as_json: bool) -> None:
    rows = export.to_json(df).toLocalIterator() if as_json else df.toLocalIterator()
    if not as_json:
        print("\t".join(df.columns))
    for r in rows:
        print(r["value"] if as_json else "\t".join("" if x is None else str(x) for x in r))


def _samples(spark: SparkSession, path: str, names: Sequence[str], start: int | None = None, end: int | None = None) -> DataFrame:
    return read(spark, path, channels=list(names) or None, start_ns=start, end_ns=end).withColumn("v", numeric())


def _readable(spark: SparkSession, path: str) -> DataFrame:
    """The files view; what cannot be read at all ends the verb."""
    files = read(spark, path, "files")
    first = files.where(F.col("version").isNull()).select("file", "error").first()
    if first is not None:
        raise FormatError(f"{first['file']}: {first['error']}")
    return files


def merge_verb(spark, a, config) -> int:
    catalog = None
    if not a.no_cache and config["cache.enabled"] == "true":
        catalog = catalogs.refresh(spark, a.root, a.root.rstrip("/") + "/_catalog")
    folder, name = os.path.split(a.out)
    overlap = "overwrite" if a.overwrite else config["output.overlap"]
    version = 4 if a.v4 or config["output.format"] == "4" else 5
    end = a.end if a.end is not None else time.time_ns()
    warnings = merging.merge_to_file(spark, a.root, folder or ".", name, a.start or 0, end, a.channels, overlap, version, catalog)
    show(warnings, a.json)
    return OK


def export_verb(spark, a, config) -> int:
    if (a.start is None) != (a.end is None):
        print("an interval needs both --start and --end", file=sys.stderr)
        return BAD_ARGS
    if a.start is not None:
        samples = merging.merge(spark, a.path, a.start, a.end, a.channels)[0].withColumn("v", numeric()).withColumn("block_ord", F.col("ts_ns")).withColumn("sample_ord", F.lit(0))
    else:
        samples = _samples(spark, a.path, a.channels)
    known = read(spark, a.path, "channels").select("channel_index", "channel", "comment", "physical_unit").dropDuplicates(["channel"]).orderBy("channel_index")
    chosen = [r.asDict() for r in known.collect() if not a.channels or r["channel"].lower() in {c.lower() for c in a.channels}]  # definitions, a row per channel
    if a.format == "hdf5":
        export.to_hdf5(samples, a.out).collect()
    elif a.format == "parquet":
        export.to_parquet(samples, a.out)
    elif a.format == "per-channel":
        export.write_per_channel(samples.where(F.col("v").isNotNull()), a.out, a.time)
    elif a.format == "csv":
        export.write_lines(*export.classic(samples, chosen, decimal=config["export.decimal_sep"], style=a.time), a.out, config["export.encoding"], "\r\n")
    elif a.dialect == "java":
        export.write_lines(*export.unified(samples.where(F.col("v").isNotNull()), chosen, ",", style=a.time, dialect="java"), a.out)
    else:
        export.write_lines(*export.unified(samples, chosen, decimal=config["export.decimal_sep"], style=a.time), a.out, config["export.encoding"], "\r\n")
    return OK


def info_verb(spark, a, config) -> int:
    files = _readable(spark, a.path)
    ranges = read(spark, a.path).groupBy("file").agg(F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.count("*").alias("samples"))
    out = files.join(ranges, "file", "left").withColumn("duration", F.coalesce(duration_hms(F.col("first_ts"), F.col("last_ts")), F.lit("-")))
    show(out.select("file", "version", "integrity", "compression", "creator", "created_utc", "tag", "reason", "samples", "first_ts", "last_ts", "duration", "truncated"), a.json)
    return OK


def channels_verb(spark, a, config) -> int:
    _readable(spark, a.path)
    out = read(spark, a.path, "channels")
    if a.filter:
        out = filters.by_mask(out, a.filter)
    catalog = catalogs.load(spark, a.catalog) if a.catalog else None
    if catalog is not None:
        out = catalogs.with_catalog(out, catalog)
    else:
        out = out.withColumn("n", F.lit("?"))
    show(stats.list_channels(out, a.sort).select("channel_index", "channel", "channel_type", "datatype", "physical_unit", "n"), a.json)
    return OK


def stat_verb(spark, a, config) -> int:
    _readable(spark, a.path)
    samples = _samples(spark, a.path, a.channels)
    chosen = filters.by_names(read(spark, a.path, "channels"), a.channels)
    typed = chosen.groupBy("channel").agg(F.min("datatype").alias("datatype"))
    made = stats.channel_stats(samples, a.start, a.end)
    out = stats.with_empty(made, typed).join(typed, "channel")
    out = out.withColumn("precision_loss", loses_precision(F.col("datatype")))
    for c in ("vmin", "vmax", "mean", "sd"):
        out = out.withColumn(c, F.when(is_numeric(F.col("datatype")), F.col(c)))
    show(out.orderBy("channel"), a.json)
    return OK


def cache_verb(spark, a, config) -> int:
    if a.action in ("build", "rebuild"):
        show(catalogs.file_ranges(catalogs.refresh(spark, a.path, a.at, force=a.action == "rebuild")), a.json)
    elif a.action == "status":
        show(catalogs.status(catalogs.load(spark, a.at), catalogs.listing(spark, a.path, not a.non_recursive)), a.json)
    elif a.action == "clean":
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.at)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    else:
        return BAD_ARGS
    return OK


def convert_verb(spark, a, config) -> int:
    _readable(spark, a.path)
    convert(spark, a.path, a.out, 4 if a.v4 else 5, a.integrity, "gzip" if a.gzip else None, keep_segments=not a.merged)
    return OK


def verify_verb(spark, a, config) -> int:
    found = verify.verify(read(spark, a.path, "blocks"), read(spark, a.path, "files"))
    show(found, a.json)
    return verify.exit_code(found, a.strict)


def dump_verb(spark, a, config) -> int:
    _readable(spark, a.path)
    names, unknown = filters.resolve(read(spark, a.path, "channels"), a.channels)
    for s in unknown:
        log.warning("no channel %s", s)
    if a.channels and not names:
        return NOT_FOUND
    rows = filters.by_names(_samples(spark, a.path, ()), names or None)
    show(filters.head(rows.select("channel", "block_ord", "sample_ord", "ts_ns", "v", "v_string"), a.limit, order=("block_ord", "sample_ord")), a.json)
    return OK


def config_verb(a) -> int:
    values = load_config()
    if a.key is None:
        for k, v in values.items():
            print(f"{k}={v}")
    elif a.key not in CONFIG:
        return BAD_ARGS
    elif a.value is None:
        print(values[a.key])
    else:
        with open(config_path(), "w") as f:
            json.dump({k: v for k, v in (values | {a.key: a.value}).items() if v != CONFIG[k]}, f)
    return OK


VERBS = {"merge": merge_verb, "export": export_verb, "info": info_verb, "channels": channels_verb, "stat": stat_verb, "cache": cache_verb, "convert": convert_verb, "verify": verify_verb, "dump": dump_verb}


#: Called with (verb, step, seconds) for each step of a verb: "started", "done" or "failed".
LISTENERS: list[Callable[[str, str, float], None]] = []


@contextlib.contextmanager
def progress(verb: str) -> Iterator[None]:
    """Tells the log and the listeners of a verb's steps."""
    begin = time.perf_counter()

    def tell(step: str) -> None:
        took = time.perf_counter() - begin
        log.info("%s %s after %.1f s", verb, step, took)
        for listener in LISTENERS:
            listener(verb, step, took)

    tell("started")
    try:
        yield
    except BaseException:
        tell("failed")
        raise
    tell("done")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else BAD_ARGS
    logging.basicConfig(level=a.log_level.upper())
    if a.verb == "config":
        return config_verb(a)
    if a.verb == "generate":
        print("\n".join(generate.write(a.out)))
        return OK
    spark = spark or SparkSession.builder.appName("chronospark").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        with progress(a.verb):
            return VERBS[a.verb](spark, a, load_config())
    except FormatError as e:
        print(e, file=sys.stderr)
        return FORMAT_ERROR
    except ValueError as e:
        print(e, file=sys.stderr)
        return BAD_ARGS
    except PySparkException as e:
        missing = "PATH_NOT_FOUND" in str(e)
        print(str(e).splitlines()[0], file=sys.stderr)
        return NOT_FOUND if missing else FORMAT_ERROR if "FormatError" in str(e) else IO_ERROR
    except OSError as e:
        print(e, file=sys.stderr)
        return IO_ERROR


if __name__ == "__main__":
    sys.exit(main())
