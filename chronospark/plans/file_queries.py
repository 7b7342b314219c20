"""Queries that go through files: written, listed, scanned, copied, exported, streamed."""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import text as text_functions
from ..functions import times
from ..functions.types import numeric, parse_datatype, parse_spectrum, unsigned_to_double
from ..operators import filters, merge, stats
from ..sources import catalog, export, generate, merging, recordings
from ..sources.encode import Writer
from ..sources.recordings import convert, create_view, read, register, sniff, with_definitions, write
from ..sources.views import Options, rows
from .codec_queries import _typed
from .queries import S, query
from .tables import CHANNELS, samples, shared_dir, table

DAY = 86_400_000_000_000


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as samples of recordings: a folder for each half, a file for each week in it."""
    week = F.floor(F.col("ts_ns") / (7 * DAY)).cast("string")
    name = F.concat(F.when(F.col("ord") % 2 == 0, "a/").otherwise("b/"), F.lit("w"), week)
    index = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel")).cast("int") - 1
    return _typed(samples(spark, sf_dir).withColumn("file", name)).withColumn("channel_index", index)


def recorded(spark: SparkSession, sf_dir: str, **how: Any) -> str:
    """A folder with these recordings."""
    out = folder(spark)
    write(weeks(spark, sf_dir), out, **how)
    return out


def base(path: str | Column) -> Column:
    return F.regexp_extract(path, "([ab]/[^/]*)$", 1)


ALL = f"{S} select channel, ts_ns, v from s"
FILES = f"{S}, f as (select case when event_id % 2 = 0 then 'a/' else 'b/' end || 'w' || (ts_ns // (7 * {DAY})) || '.osf' as file, * from s)"


def plain(df: DataFrame) -> DataFrame:
    return df.select("channel", "ts_ns", F.col("v_double").alias("v"))


# Sinks


@query(ALL)
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one recording in many tasks, equal names in two folders, and a second append of the same names: nothing is lost."""
    register(spark)
    out = folder(spark)
    spread = weeks(spark, sf_dir).repartition(7, "ts_ns")  # not by file
    for part in (spread.where("ts_ns % 3 = 0"), spread.where("ts_ns % 3 <> 0")):
        part.sortWithinPartitions("file", "channel", "ts_ns").write.format("recording").mode("append").save(out)
    return plain(read(spark, out))


@query(f"{FILES} select distinct file from f")
def sink_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording keeps its folder and its name."""
    return read(spark, recorded(spark, sf_dir), "files").select(base("file").alias("file"))


@query(ALL)
def convert_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies in the older version, compressed, of all folders."""
    out = folder(spark)
    convert(spark, recorded(spark, sf_dir), out, 4, compression="gzip")
    return plain(read(spark, out))


@query(f"{FILES} select channel, ts_ns, min(v) as v from f where channel <> 'none' group by 1, 2 having count(*) = 1")
def convert_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings merged into one (of times that come once)."""
    path, out = recorded(spark, sf_dir), folder(spark)
    merging.merge_to_file(spark, path, out, "all", 0, 1 << 62)
    once = samples(spark, sf_dir).groupBy("channel", "ts_ns").count().where("count = 1").drop("count")
    return plain(read(spark, out)).join(once, ["channel", "ts_ns"], "left_semi").select("channel", "ts_ns", "v")


@query(ALL)
def sink_of_a_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into recordings, a file for each batch, task and name."""
    register(spark)
    out, schema = folder(spark), table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = stream.select(F.col("event_type").alias("file"), F.lit("double").alias("datatype"), F.col("event_type").alias("channel"), F.lit(0).alias("channel_index"), times.from_timestamp(F.col("ts")).alias("ts_ns"), F.col("value").alias("v_double"))
    q = made.writeStream.format("recording").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return plain(read(spark, out))


@query(ALL)
def stream_of_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings read as a stream."""
    register(spark)
    path, out = recorded(spark, sf_dir), folder(spark)
    q = plain(spark.readStream.format("recording").load(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


# Scans


@query(ALL)
def scan_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(read(spark, recorded(spark, sf_dir)))


@query(f"{FILES} select channel, ts_ns, v from f where file like 'a/%'")
def scan_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without folders below: nothing in the upper folder, all of one in the lower."""
    path = recorded(spark, sf_dir)
    return plain(read(spark, f"{path}/a", recursive=False))


@query(f"{S} select channel, ts_ns, v from s where channel in ('click', 'view')")
def scan_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the reader takes, without regard to case: other blocks are stepped over."""
    return plain(read(spark, recorded(spark, sf_dir), channels=["CLICK", "View"]))


@query(f"{S} select channel, ts_ns, v from s where channel = 'click' and ts_ns >= 1704672000000000000 and ts_ns < 1705276800000000000")
def scan_with_pushed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the plan that the data source takes."""
    register(spark)
    out = folder(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("recording").option("pushdown", "true").load(recorded(spark, sf_dir))
        found = found.where((F.col("channel") == "click") & (F.col("ts_ns") >= 1704672000000000000) & (F.col("ts_ns") < 1705276800000000000))
        plain(found).write.parquet(out)  # while the setting holds
        return spark.read.parquet(out)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


@query(f"{FILES} select distinct file, channel from f")
def scan_of_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions only: of each file its beginning is read."""
    register(spark)
    found = spark.read.format("recording").option("view", "channels").load(recorded(spark, sf_dir))
    return found.select(base("file").alias("file"), "channel")


@query(f"{FILES} select distinct replace(file, '.osf', '.osfz') as file, 4 as version from f")
def sniffed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bytes of compressed recordings say."""
    return sniff(spark, recorded(spark, sf_dir, version=4, compression="gzip")).select(base("file").alias("file"), "version")


@query(f"{S} select channel, count(*) as n, max(v) as hi from s group by 1")
def scan_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"v_{uuid.uuid4().hex}"
    create_view(spark, name, recorded(spark, sf_dir))
    return spark.sql(f"select channel, count(*) as n, max(v_double) as hi from {name} group by channel")


@query(f"{S} select channel, count(*) as n from s group by 1")
def decode_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over files that Spark has read."""
    register(spark)
    name = f"f_{uuid.uuid4().hex}"
    spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(recorded(spark, sf_dir)).createOrReplaceTempView(name)
    return spark.sql(f"select d.channel, count(*) as n from decode_recordings(table(select path, content from {name})) d group by d.channel")


@query(f"{FILES} select file, channel, count(*) as n from f group by 1, 2")
def channel_with_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the texts of their definitions."""
    path = recorded(spark, sf_dir)
    found = with_definitions(read(spark, path), read(spark, path, "channels").withColumn("physical_unit", F.col("channel")))
    return found.groupBy(base("file").alias("file"), F.col("physical_unit").alias("channel")).agg(F.count("*").alias("n"))


# Catalog


CATALOG = "select file, channel, count(*) as n, min(ts_ns) as first_ts, max(ts_ns) as last_ts from f group by 1, 2"


@query(f"{FILES} {CATALOG}")
def catalog_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(spark, recorded(spark, sf_dir)).select(base("file").alias("file"), "channel", "n", "first_ts", "last_ts")


@query(f"{FILES} select distinct file, case when file like 'b/%' then 'missing' else 'valid' end as status from f")
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a catalog of one folder knows, and those that it does not."""
    path, at = recorded(spark, sf_dir), folder(spark)
    catalog.refresh(spark, f"{path}/a", at)
    return catalog.status(catalog.load(spark, at), catalog.listing(spark, path)).select(base("file").alias("file"), "status")


@query(f"{FILES}, c as ({CATALOG}) select file, cast(sum(n) as bigint) as samples, min(first_ts) as first_ts, count(*) as channels, 'UTC' as zone from c group by 1")
def sidecar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON beside each recording says."""
    made = catalog.sidecars(catalog.build(spark, recorded(spark, sf_dir)))
    value = F.from_json("value", "osf_cache_version int, source_size long, first_timestamp_ns long, first_timestamp_utc string, channels array<struct<name:string,sample_count:long>>")
    own = made.select(base("file").alias("file"), value.alias("j"))
    total = F.aggregate("j.channels", F.lit(0).cast("long"), lambda a, c: a + c["sample_count"])
    zone = F.when(times.parse_iso(F.col("j.first_timestamp_utc")) == F.floor(F.col("j.first_timestamp_ns") / times.NS) * times.NS, "UTC")
    return own.select("file", total.alias("samples"), F.col("j.first_timestamp_ns").alias("first_ts"), F.size("j.channels").cast("long").alias("channels"), zone.alias("zone"))


@query(f"{FILES}, c as ({CATALOG}) select file, channel, n, first_ts, last_ts, 'valid' as status from c")
def catalog_of_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written beside the recordings, read again and held against the files."""
    path = recorded(spark, sf_dir)
    catalog.write_sidecars(catalog.build(spark, path))
    known = catalog.read_sidecars(spark, path)
    return known.join(catalog.status(known, catalog.listing(spark, path)), "file").select(base("file").alias("file"), "channel", "n", "first_ts", "last_ts", "status")


@query(f"{S}, n as (select lower(channel) as channel, count(*) n, min(ts_ns) first_ts, max(ts_ns) last_ts from s group by 1) select upper(channel) as channel, n, first_ts, last_ts from n union all select 'ABSENT', 0, null, null")
def channels_with_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with counts and ranges of the catalog, by name without regard to case."""
    defined = spark.createDataFrame([(c.upper(),) for c in [*CHANNELS, "absent"]], "channel string")
    known = catalog.build(spark, recorded(spark, sf_dir))
    found = catalog.with_catalog(defined, known)
    present = spark.createDataFrame([(c,) for c in CHANNELS], "c string").join(known.select("channel").distinct(), F.col("c") == F.col("channel"), "left_semi")
    return found.join(present, F.lower("channel") == F.col("c"), "left").where("c is not null or channel = 'ABSENT'").select("channel", "n", "first_ts", "last_ts")


@query(f"{FILES}, c as ({CATALOG}), r as (select file, min(first_ts) a, max(last_ts) b, sum(n) n from c group by 1) select count(*) as found, count(*) filter (b >= 1704672000000000000 and a <= 1705276800000000000) as kept, cast(0 as bigint) as errors, cast(coalesce(sum(n) filter (b >= 1704672000000000000 and a <= 1705276800000000000), 0) as bigint) as samples from r")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = catalog.file_ranges(catalog.build(spark, recorded(spark, sf_dir)))
    return merge.report(ranges, 1704672000000000000, 1705276800000000000)


@query(f"{S}, u as (select distinct on (channel, ts_ns) channel, ts_ns from s) select channel, ts_ns, row_number() over (order by channel, ts_ns) as place from u")
def merged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged recording lists its channels one after the other, each in order of time."""
    from pyspark.sql import Window

    path, out = recorded(spark, sf_dir), folder(spark)
    merging.merge_to_file(spark, path, out, "all", 0, 1 << 62)
    place = F.row_number().over(Window.orderBy("channel", "block_ord", "sample_ord"))
    return read(spark, out).select("channel", "ts_ns", place.cast("long").alias("place"))


@query("select * from (values ('empty', true), ('inverted', true), ('nothing', true), ('fits', false)) t(name, refused)")
def interval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = recorded(spark, sf_dir)
    out = []
    for name, a, b in (("empty", 5, 5), ("inverted", 9, 5), ("nothing", 1, 2), ("fits", 1, 1 << 62)):
        try:
            merging.merge(spark, path, a, b)
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


# Writing


@query("select * from (values ('none', false, 13), ('crc32c', false, 13), ('none', true, 1)) t(integrity, wide, blocks)")
def chunks_by_length_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100,000 doubles at one rate: blocks of what two bytes, or four, can count."""
    out = []
    for integrity, wide in (("none", False), ("crc32c", False), ("none", True)):
        w = Writer(5, integrity)
        w.add_segment(w.add_channel("x", "double", **({"size_of_length_value": 4} if wide else {})), 0, 1000.0, [float(i) for i in range(100_000)])
        out.append((integrity, wide, sum(b.num_rows for b in rows("x", w.to_bytes(), Options(view="blocks")))))
    return spark.createDataFrame(out, "integrity string, wide boolean, blocks int")


@query("select cast(length as integer) as size, case when length + 13 > 65535 then 4 else 2 end as width, cast(3 as integer) as blocks from (values (10), (60000), (65523), (70000)) t(length)")
def wide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go one to a block, and their length field grows where one of them needs it."""
    out = []
    for size in (10, 60_000, 65_523, 70_000):
        w = Writer(5)
        w.add_samples(w.add_channel("x", "string"), [1, 2, 3], ["a", "b" * size, "c"])
        data = w.to_bytes()
        width = [r["size_of_length_value"] for b in rows("x", data, Options(view="channels")) for r in b.to_pylist()][0]
        out.append((size, width, sum(b.num_rows for b in rows("x", data, Options(view="blocks")))))
    return spark.createDataFrame(out, "size int, width int, blocks int")


@query("select * from (values ('mixed'), ('lengths'), ('rate'), ('empty'), ('type'), ('version'), ('integrity')) t(refused)")
def writer_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mixed():
        w = Writer()
        c = w.add_channel("x", "double")
        w.add_samples(c, [1], [1.0])
        w.add_segment(c, 1, 1.0, [1.0])

    def lengths():
        w = Writer()
        w.add_samples(w.add_channel("x", "double"), [1, 2], [1.0])

    def rate():
        w = Writer()
        w.add_segment(w.add_channel("x", "double"), 1, 0.0, [1.0])

    cases = {"mixed": mixed, "lengths": lengths, "rate": rate, "empty": lambda: Writer().to_bytes(), "type": lambda: Writer().add_channel("x", "pair"), "version": lambda: Writer(3), "integrity": lambda: Writer(4, "crc32c")}
    out = []
    for name, case in cases.items():
        with contextlib.suppress(ValueError):
            case()
            continue
        out.append((name,))
    return spark.createDataFrame(out, "refused string")


# Exports


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first week's events of the hour, with values of one decimal."""
    rows_ = samples(spark, sf_dir).withColumn("ts_ns", F.col("ts_ns") - F.pmod("ts_ns", F.lit(3_600_000_000_000)))
    typed = rows_.select(F.lit("f").alias("file"), "ord", "channel", F.lit("double").alias("datatype"), "ts_ns", (F.floor("v") + 0.5).alias("v_double"))
    empty = {"v_long": "long", "v_ulong": "decimal(20,0)", "v_bool": "boolean", "v_string": "string", "v_binary": "binary", "v_gps": "struct<latitude:double,longitude:double,altitude:double>"}
    return typed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.col("v_double").alias("v"))


HOURS = f"{S}, h as (select event_id, channel, ts_ns - ts_ns % 3600000000000 as ts_ns, floor(v) + 0.5 as v from s), w as (select ts_ns, " + ", ".join(f"arg_max(v, event_id) filter (channel = '{c}') as {c}" for c in CHANNELS) + " from h group by 1)"
TIME_TEXT = "strftime(make_timestamp(ts_ns//1000),'{0}')"


@query(f"{HOURS} select concat_ws(';', {TIME_TEXT.format('%Y-%m-%dT%H:%M:%S')} || '.000000000Z', " + ", ".join(f"coalesce(replace(cast({c} as varchar), '.', ','), '')" for c in CHANNELS) + ") as line from w union all select 'Timestamp;" + ";".join(CHANNELS) + "' union all select 'ISO8601;;;;;m'")
def export_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each time, two of header."""
    channels = [{"channel": c, "physical_unit": "m" if c == "view" else None} for c in CHANNELS]
    head, body = export.unified(_exported(spark, sf_dir), channels, style="iso8601")
    return head.union(body)


@query(f"{HOURS} select concat_ws(',', (ts_ns // 1000000000) || '.000000000', " + ", ".join(f"coalesce(cast({c} as varchar), '')" for c in CHANNELS) + ") as line from w union all select 'timestamp," + ",".join(CHANNELS) + "'")
def export_second_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, body = export.unified(_exported(spark, sf_dir), [{"channel": c} for c in CHANNELS], ",", style="seconds", dialect="java")
    return head.union(body)


@query(f"""{HOURS}, r as (select channel, row_number() over (partition by channel order by event_id) - 1 as i, {TIME_TEXT.format('%d.%m.%Y %H:%M:%S')} || '.000' as x, replace(cast(v as varchar), '.', ',') as y from h where channel in ('click', 'view'))
select concat_ws(';', '', coalesce(max(x) filter (channel = 'click'), ''), coalesce(max(y) filter (channel = 'click'), ''), coalesce(max(x) filter (channel = 'view'), ''), coalesce(max(y) filter (channel = 'view'), '')) as line from r group by i""")
def export_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels side by side, each with its times."""
    rows_ = _exported(spark, sf_dir).withColumn("block_ord", F.col("ord")).withColumn("sample_ord", F.lit(0))
    return export.classic(rows_, [{"channel": "click"}, {"channel": "view"}])[1]


@query(f"{HOURS} select channel, {TIME_TEXT.format('%Y-%m-%dT%H:%M:%SZ')} || ',' || cast(v as varchar) as line from h")
def export_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    export.write_per_channel(_exported(spark, sf_dir), out)
    return spark.read.text(out).select("channel", F.col("value").alias("line"))


@query(f"{HOURS} select channel, ts_ns, v from h")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    export.to_parquet(_exported(spark, sf_dir).select("channel", "ts_ns", "v"), out)
    return spark.read.parquet(out).select("channel", "ts_ns", "v")


@query(f"""{S}, n as (select channel, count(*) n from s group by 1 order by n desc, channel limit 3) select '{{"channel":"' || channel || '","n":' || n || '}}' as value from n""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.to_json(stats.top_channels(samples(spark, sf_dir), 3))


# Command line


def spoken(spark: SparkSession, *args: str) -> list[dict]:
    """The JSON lines that a verb prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(["--json", *args], spark)
    if code:
        raise ValueError(f"{args[0]} ended with {code}")
    return [json.loads(x) for x in out.getvalue().splitlines() if x.startswith("{")]


def said(spark: SparkSession, lines: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in lines], schema)


@query(f"{FILES} select file, count(*) as samples, min(ts_ns) as first_ts, max(ts_ns) as last_ts, 5 as version from f group by 1")
def verb_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = said(spark, spoken(spark, "info", recorded(spark, sf_dir)), "file string, samples long, first_ts long, last_ts long, version int")
    return found.withColumn("file", base("file"))


@query(f"{FILES} select channel, count(distinct file) as files from f where channel in ('click', 'view') group by 1")
def verb_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spoken(spark, "channels", recorded(spark, sf_dir), "--filter", "*i?w", "--sort", "NAME") + spoken(spark, "channels", recorded(spark, sf_dir), "--filter", "CL*")
    return said(spark, lines, "channel string").groupBy("channel").agg(F.count("*").alias("files"))


@query(f"{S} select channel, count(*) as n, min(v) as vmin, max(v) as vmax, avg(v) as mean from s where channel in ('click', 'error') group by 1")
def verb_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, spoken(spark, "stat", recorded(spark, sf_dir), "click", "Error"), "channel string, n long, vmin double, vmax double, mean double")


@query(f"{FILES} select file, count(*) as n, min(ts_ns) as first_ts from f group by 1")
def verb_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = said(spark, spoken(spark, "cache", "build", recorded(spark, sf_dir), folder(spark)), "file string, n long, first_ts long")
    return found.withColumn("file", base("file"))


@query(f"{S} select channel, count(distinct ts_ns) as n from s where channel = 'click' group by 1")
def verb_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = recorded(spark, sf_dir), folder(spark)
    spoken(spark, "merge", path, f"{out}/one", "click", "--no-cache")
    return read(spark, out).groupBy("channel").agg(F.count("*").alias("n"))


@query(ALL)
def verb_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    spoken(spark, "convert", recorded(spark, sf_dir), out, "--v4", "--gzip")
    return plain(read(spark, out))


@query(f"{S} select channel, count(*) as n from s group by 1")
def verb_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark)
    spoken(spark, "export", recorded(spark, sf_dir), out, "--format", "parquet")
    return spark.read.parquet(out).groupBy("channel").agg(F.count("*").alias("n"))


@query("select n_name as file, 'error' as level, 'CrcMismatch' as code from nation where n_nationkey % 3 > 0 and n_nationkey % 2 = 1")
def verb_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with good and bad checksums, as files, and what the verb finds."""
    from .block_queries import _signed, nations

    out = folder(spark)
    store, base_ = recordings._store(out)
    store.create_dir(base_, recursive=True)
    for r in nations(spark, sf_dir, _signed).collect():  # 25 small files
        with store.open_output_stream(f"{base_}/{r['file']}.osf") as f:
            f.write(bytes(r["content"]))
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        if cli.main(["--json", "verify", out], spark) != cli.FORMAT_ERROR:
            raise ValueError("errors must show in the exit code")
    found = said(spark, [json.loads(x) for x in printed.getvalue().splitlines() if x.startswith("{")], "file string, level string, code string")
    return found.withColumn("file", F.regexp_extract("file", "([^/]*)[.]osf$", 1))


@query(f"{FILES}, k as (select channel, ts_ns, v, row_number() over (partition by channel order by file, ts_ns, event_id) as k from f where channel = 'click' and file like 'a/%') select channel, count(*) as n from (select * from k limit 4) group by 1")
def verb_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spoken(spark, "dump", f"{recorded(spark, sf_dir)}/a", "click", "--limit", "4")
    return said(spark, lines, "channel string").groupBy("channel").agg(F.count("*").alias("n"))


@query("select * from (values ('config', 'output.overlap', 'skip'), ('config', 'export.decimal_sep', ',')) t(verb, key, value)")
def verb_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("output.overlap", "export.decimal_sep")
    return spark.createDataFrame([("config", k, cli.CONFIG[k]) for k in keys], "verb string, key string, value string")


@query("select * from (values ('arguments', 1), ('verb', 1), ('absent', 2), ('format', 4), ('dump', 2)) t(name, code)")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad arguments, what is not there, what is no recording."""
    path, bad = recorded(spark, sf_dir), folder(spark)
    spark.createDataFrame([("no recording",)], "value string").coalesce(1).write.text(bad)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(bad).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(hadoop.Path(bad)) if f.getPath().getName().startswith("part-"))
    store.rename(part, hadoop.Path(f"{bad}/x.osf"))
    calls = {"arguments": ["info"], "verb": ["nonsense"], "absent": ["info", "file:///nowhere/at/all"], "format": ["info", f"{bad}/x.osf"], "dump": ["dump", path, "no such channel"]}
    out = []
    for name, args in calls.items():
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            out.append((name, cli.main(args, spark)))
    return spark.createDataFrame(out, "name string, code int")


@query("select * from (values (23)) t(recordings)")
def corpus_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's recordings that can be read without an error."""
    made = [(name, bytearray(data)) for name, data in generate.corpus().items()]
    from .block_queries import view

    content = spark.createDataFrame(made, "file string, content binary")
    return view(content, "files").where("error is null").agg(F.count("*").cast("int").alias("recordings"))


# Choosing and functions


@query(f"{S} select event_id, ts_ns from s where ts_ns >= 1705276800000000000")
def interval_without_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound that is missing, or not above 0, is none."""
    found = filters.interval(samples(spark, sf_dir, 1705276800000000000), 1705276800000000000, -1)
    return found.select(F.col("ord").alias("event_id"), "ts_ns")


@query("select * from (values (1, 'error'), (2, 'view'), (3, 'click')) t(place, channel) union all select 9, 'VIEW' union all select 9, '77'")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and exact names in the order asked for, then (as 9) those that name nothing."""
    channels = spark.createDataFrame(list(enumerate(CHANNELS)), "channel_index int, channel string")
    chosen, unknown = filters.resolve(channels, ["1", "view", "0", "VIEW", "77"])
    return spark.createDataFrame([*enumerate(chosen, 1), *((9, u) for u in unknown)], "place int, channel string")


@query("select p_partkey as channel_index, p_name as channel, row_number() over (order by p_partkey) as by_index, row_number() over (order by p_name, p_partkey) as by_name from part")
def channels_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in order of index and in order of name."""
    defined = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel_index"), F.col("p_name").alias("channel"))
    place = lambda df, name: df.withColumn(name, F.monotonically_increasing_id()).select("channel_index", name)
    one = place(stats.list_channels(defined, "INDEX").coalesce(1), "i")
    two = place(stats.list_channels(defined.orderBy("channel_index"), "NAME").coalesce(1), "j")
    ties = defined.join(one, "channel_index").join(two, "channel_index")
    from pyspark.sql import Window

    # Equal names may come in any order; they are told apart by index.
    return ties.select("channel_index", "channel", (F.col("i") + 1).alias("by_index"), F.row_number().over(Window.orderBy(F.min("j").over(Window.partitionBy("channel")), "channel_index")).cast("long").alias("by_name"))


@query(f"{S}, x as (select event_id % 10 as k, case when event_id % 7 = 0 then cast('nan' as double) else v end as v from s) select 'k' || k as channel, count(*) as n, min(v) filter (not isnan(v)) as vmin, max(v) filter (not isnan(v)) as vmax, count(*) filter (isnan(v)) > 0 as undefined from x group by 1")
def stats_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is left out of the extremes and makes the mean NaN."""
    v = F.when(F.col("ord") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v"))
    rows_ = samples(spark, sf_dir).select(F.concat(F.lit("k"), (F.col("ord") % 10).cast("string")).alias("channel"), "ts_ns", v.alias("v"))
    return stats.channel_stats(rows_).select("channel", "n", "vmin", "vmax", F.isnan("mean").alias("undefined"))


@query(f"{S} select event_id, strftime(make_timestamp(ts_ns//1000),'%d.%m.%Y %H:%M:%S') as t from s")
def fmt_datetime_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), times.fmt_ts(F.col("ts_ns"), "seconds").alias("t"))


@query(f"{S} select event_id, cast(ts_ns as varchar) as t from s")
def fmt_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), times.fmt_ts(F.col("ts_ns"), "nanoseconds").alias("t"))


@query(f"{S} select event_id, strftime(make_timestamp(ts_ns//1000),'%Y-%m-%d %H:%M:%S.%g') as a, (ts_ns//1000000000) || '.' || lpad(cast(ts_ns % 1000000000 as varchar),9,'0') as b, strftime(make_timestamp(ts_ns//1000),'%Y-%m-%dT%H:%M:%SZ') as c, cast(ts_ns as varchar) as d from s")
def fmt_second_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = zip(("datetime", "seconds", "iso8601", "nanoseconds"), "abcd")
    return samples(spark, sf_dir).select(F.col("ord").alias("event_id"), *[times.fmt_ts(F.col("ts_ns"), x, "java").alias(n) for x, n in styles])


@query("select doc_id, case when n >= 1048576 then printf('%.2f MiB', n / 1048576.0) when n >= 1024 then printf('%.2f KiB', n / 1024.0) else n || ' B' end as size from (select doc_id, n_chars * 128 + 1 as n from documents where doc_id is not null and n_chars is not null)")
def bytes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null and n_chars is not null")
    return d.select("doc_id", text_functions.fmt_bytes(F.col("n_chars").cast("long") * 128 + 1).alias("size"))


@query("select o_orderkey, cast(cast(18446744073709551615 as hugeint) - o_orderkey as double) as v from orders")
def unsigned_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey").cast("decimal(20,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", unsigned_to_double(big).alias("v"))


@query("select * from (values ('bytearray', 'binary', 'amplitude'), ('int16', 'int16', 'amplitude'), ('Phase', 'Phase', 'phase'), ('realImag', 'realImag', 'realimag'), ('odd', 'odd', 'amplitude')) t(word, datatype, spectrum)")
def words_to_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(x,) for x in ("bytearray", "int16", "Phase", "realImag", "odd")], "word string")
    return words.select("word", parse_datatype(F.col("word")).alias("datatype"), parse_spectrum(F.col("word")).alias("spectrum"))


@query("select n_nationkey as k, cast(100 + trunc((1000 - greatest(1, trunc(1000 * 0.5))) * 0.5) as bigint) + k * 0 as zoom_start, cast(600 as bigint) + 250 as zoom_end, cast(100 + 10 * k as bigint) as pan_start, cast(1100 + 10 * k as bigint) as pan_end from (select n_nationkey, n_nationkey as k from nation)")
def zoom_and_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range scaled about its middle, and moved by a share of its length."""
    out = []
    for k in range(25):
        a, b = times.zoom(100, 1100, 0.5)
        c, d = times.pan(100, 1100, k / 100)
        out.append((k, a, b, c, d))
    return spark.createDataFrame(out, "k int, zoom_start long, zoom_end long, pan_start long, pan_end long")


@query(f"{S} select channel, cast(sum(v) as double) as total from s group by 1")
def numeric_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric view over recordings."""
    return read(spark, recorded(spark, sf_dir)).groupBy("channel").agg(F.sum(numeric()).alias("total"))
