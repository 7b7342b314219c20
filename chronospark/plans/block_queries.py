"""Queries over recordings whose bytes are put together here, block by block.

Nothing of the writer is used for them: header, metablock and blocks follow the layout of
the format, so the reader is held against it and not against its own counterpart.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, stats, timebase
from ..operators.ordered import id_bucket, numbered
from ..sources.checksums import crc32c
from ..sources.live import LiveRecording
from ..sources.recordings import decoded
from ..sources.views import Options, rows
from .queries import S, query
from .tables import samples, table

# Block types, the many-samples bit, reserved channels, the trailer's tag.
DEPRECATED, STATUS, MESSAGE, CONTINUED, START, RELATIVE, ABSOLUTE, RESERVED = 1, 3, 4, 5, 6, 7, 8, 9
MANY = 0x80
SIGNATURE, TRAILER = 0xFFFE, 0xFFFF
TAG = b"OSF_STREAM_END".ljust(40, b" ")


def block(channel: int, control: int, body: bytes, width: int = 2, checked: bool = False) -> bytes:
    length = 1 + len(body) + (4 if checked else 0)
    frame = struct.pack("<H", channel) + length.to_bytes(width, "little") + bytes([control]) + body
    return frame + struct.pack("<I", crc32c(frame)) if checked else frame


def recording(channels: list[dict[str, Any]], blocks: bytes, version: int = 5, tokens: str = "", **info: Any) -> bytes:
    if version == 5:
        meta = json.dumps({"osf": {"format": "osf5", "version": 5, "file": info, "channels": channels}}).encode()
    else:
        lines = "".join("<channel " + " ".join(f'{k}="{v}"' for k, v in c.items()) + "/>" for c in channels)
        meta = f'<recording version="4"><channels count="{len(channels)}">{lines}</channels></recording>'.encode()
    if tokens:
        tokens = tokens.replace("*", f"{crc32c(meta):08X}")
    return f"OSF{version} {len(meta)}{tokens}\n".encode() + meta + blocks


def channel(index: int, datatype: str, **more: Any) -> dict[str, Any]:
    return {"index": index, "name": more.pop("name", f"c{index}"), "channeltype": "scalar", "datatype": datatype, "sizeoflengthvalue": more.pop("width", 2)} | more


def packed(df: DataFrame, make: Callable[[list[dict]], bytes], order: str = "ord") -> DataFrame:
    """One recording (file, content) of the rows of each ``file``."""

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"file": [t.column("file")[0].as_py()], "content": pa.array([make(t.sort_by(order).to_pylist())], pa.binary())})

    return df.groupBy("file").applyInArrow(pack, "file string, content binary")


def view(content: DataFrame, name: str = "samples", **options: Any) -> DataFrame:
    """A view of recordings (file, content), as the reader gives it."""
    return decoded(content, Options.of({"view": name} | {k: str(v) for k, v in options.items()}))


def nations(spark: SparkSession, sf_dir: str, make: Callable[[int], bytes]) -> DataFrame:
    """A recording for each nation, from its key."""
    rows_ = table(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").cast("long").alias("ord"))
    return packed(rows_, lambda r: make(r[0]["ord"]))


# Kinds of blocks


def _segments(rows_: list[dict]) -> bytes:
    """Blocks of rows that begin with a segment."""
    out = []
    for at in range(0, len(rows_), 10):
        own = rows_[at : at + 10]
        head = struct.pack("<qd", min(r["ts_ns"] for r in own), 3.0) if at % 40 == 0 else b""
        many = len(own) > 1
        body = head + (struct.pack("<I", len(own)) if many else b"") + struct.pack(f"<{len(own)}d", *[r["v"] for r in own])
        out.append(block(0, (START if at % 40 == 0 else CONTINUED) | (MANY if many else 0), body))
    return b"".join(out)


#: Rows of a run of whole segments, which one call makes into blocks.
RUN_ROWS = 40 * 250


def in_runs(df: DataFrame, make: Callable[[list[dict]], bytes], begin: bytes) -> DataFrame:
    """One recording of the rows of each ``file``, whose blocks are made run by run: no task
    holds all rows of a recording, only its bytes."""
    numbered_ = numbered(df, ["file"], ["ord"], id_bucket(F.col("ord")), "rn").withColumn("run", F.floor(F.col("rn") / RUN_ROWS))

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"file": t.column("file")[:1], "run": t.column("run")[:1], "blocks": pa.array([make(t.sort_by("rn").to_pylist())], pa.binary())})

    made = numbered_.groupBy("file", "run").applyInArrow(pack, "file string, run long, blocks binary")
    runs = F.array_sort(F.collect_list(F.struct("run", F.hex("blocks").alias("hex"))))
    return made.groupBy("file").agg(F.concat(F.lit(begin), F.unhex(F.array_join(F.transform(runs, lambda r: r["hex"]), ""))).alias("content"))


@query(f"""{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 rn from s), q as (select *, rn//40 seg, rn%40 i from r), z as (select channel, seg, min(ts_ns) filter (i<10) start_ns from q group by 1,2)
select channel, cast(seg as int) seg_id, start_ns + cast(trunc(i*1e9/3.0) as bigint) ts_ns, v from q join z using (channel, seg)""")
def block_start_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equidistant segments: start blocks, and continued ones that go on with them."""
    content = in_runs(samples(spark, sf_dir).withColumnRenamed("channel", "file"), _segments, recording([channel(0, "double")], b""))
    return view(content).select(F.col("file").alias("channel"), "seg_id", "ts_ns", F.col("v_double").alias("v"))


def _relative(rows_: list[dict]) -> bytes:
    out = [block(0, ABSOLUTE, struct.pack("<qf", rows_[0]["ts_ns"], rows_[0]["v"]))]
    rest = rows_[1:]
    if rest:
        body = b"".join(struct.pack("<If", r["ord"] % 977 * 1000, r["v"]) for r in rest)
        out.append(block(0, RELATIVE | MANY, struct.pack("<I", len(rest)) + body))
    return recording([channel(0, "float")], b"".join(out))


@query(f"""{S}, f as (select *, 'r' || (event_id // 50) as file from s),
e as (select *, first_value(ts_ns) over w a, row_number() over w k, sum(event_id % 977 * 1000) over w - first_value(event_id % 977 * 1000) over w d from f window w as (partition by file order by event_id rows unbounded preceding))
select file, cast(a + d as bigint) ts_ns, cast(cast(v as float) as double) v from e""")
def block_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in nanoseconds from the sample before, after one absolute time."""
    named = samples(spark, sf_dir).withColumn("file", F.concat(F.lit("r"), F.floor(F.col("ord") / 50).cast("string")))
    return view(packed(named, _relative)).select("file", "ts_ns", F.col("v_double").alias("v"))


def _texts(rows_: list[dict], datatype: str, version: int, message: bool = False) -> bytes:
    out = []
    for r in rows_:
        raw = r["text"].encode()
        if message:
            out.append(block(0, MESSAGE, struct.pack("<qI", r["ord"] * 1000, len(raw)) + raw, 4))
        else:
            out.append(block(0, ABSOLUTE, struct.pack("<q", r["ord"] * 1000) + raw + (b"\0" if version == 4 else b""), 4))
    return recording([channel(0, datatype, width=4)], b"".join(out), version)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return d.select(F.concat(F.lit("t"), F.floor(F.col("doc_id") / 16).cast("string")).alias("file"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


_TEXT_SQL = "select doc_id * 1000 as ts_ns, coalesce(text, '') as v from documents where doc_id is not null"


@query(_TEXT_SQL)
def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = packed(_documents(spark, sf_dir), lambda r: _texts(r, "string", 5))
    return view(content).select("ts_ns", F.col("v_string").alias("v"))


@query(_TEXT_SQL)
def block_text_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older version ends each text with a zero byte that is none of it."""
    content = packed(_documents(spark, sf_dir), lambda r: _texts(r, "string", 4))
    return view(content).select("ts_ns", F.col("v_string").alias("v"))


@query(_TEXT_SQL)
def block_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = packed(_documents(spark, sf_dir), lambda r: _texts(r, "string", 5, message=True))
    return view(content).select("ts_ns", F.col("v_string").alias("v"))


@query("select doc_id * 1000 as ts_ns, strlen(coalesce(text, '')) as n, md5(coalesce(text, '')) as digest from documents where doc_id is not null")
def block_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = packed(_documents(spark, sf_dir), lambda r: _texts(r, "bytearray", 5))
    return view(content).select("ts_ns", F.octet_length("v_binary").cast("long").alias("n"), F.md5("v_binary").alias("digest"))


def _positions(rows_: list[dict]) -> bytes:
    body = b"".join(struct.pack("<q3d", r["ord"], r["a"], r["b"], r["c"]) for r in rows_)
    blocks = block(7, ABSOLUTE | MANY, struct.pack("<I", len(rows_)) + body, 4)
    return recording([channel(7, "gpslocation", width=4)], blocks)


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    made = c.select(F.col("c_nationkey").cast("string").alias("file"), F.col("c_custkey").cast("long").alias("ord"), (F.col("c_acctbal") / 200).alias("a"), (F.col("c_custkey") % 180).cast("double").alias("b"), F.col("c_acctbal").cast("double").alias("c"))
    return view(packed(made, _positions))


@query("select 'c7' as channel, c_custkey as ts_ns, c_acctbal / 200 as latitude, cast(c_custkey % 180 as double) as longitude, cast(c_acctbal as double) as altitude from customer")
def block_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.positions(_located(spark, sf_dir))


@query("select c_custkey as ts_ns, c_acctbal / 200 as v from customer")
def single_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chart shows of positions: their latitudes."""
    from ..functions.types import single_axis as axis_of

    return _located(spark, sf_dir).select("ts_ns", axis_of().alias("v"))


# Codes of struct for the numeric types.
CODES = {"bool": "?", "int8": "b", "int16": "h", "int32": "i", "int64": "q", "uint8": "B", "uint16": "H", "uint32": "I", "uint64": "Q", "float": "f", "double": "d"}


def _integers(rows_: list[dict]) -> bytes:
    out = []
    for k, (name, code) in enumerate(CODES.items()):
        size = struct.calcsize(code) * 8
        for r in rows_:
            v = r["v"]
            if name == "bool":
                v = v % 2 == 1
            elif name in ("float", "double"):
                v = v / 4
            elif name.startswith("u"):
                v = (1 << size) - 1 - v % 256
            else:
                v = v % 100 - (1 << (size - 1))
            out.append(block(k, ABSOLUTE, struct.pack("<q" + code, r["ord"], v)))
    return recording([channel(k, name) for k, name in enumerate(CODES)], b"".join(out))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")).alias("file"), F.col("s_suppkey").cast("long").alias("ord"), F.col("s_suppkey").cast("long").alias("v"))
    return packed(made, _integers)


_TYPED = """t(datatype, size) as (values ('bool',0),('int8',8),('int16',16),('int32',32),('int64',64),('uint8',8),('uint16',16),('uint32',32),('uint64',64),('float',0),('double',0)),
x as (select datatype, s_suppkey as ts_ns, case when datatype = 'bool' then cast(s_suppkey % 2 as hugeint) when datatype like 'u%' then cast(power(cast(2 as double), size) as hugeint) - 1 - s_suppkey % 256 when datatype like 'int%' then s_suppkey % 100 - cast(power(cast(2 as double), size - 1) as hugeint) end as i, s_suppkey / 4.0 as d from supplier, t)"""


@query(f"with {_TYPED} select datatype, ts_ns, case when datatype = 'bool' then case when i = 1 then 'True' else 'False' end when i is null then cast(cast(d as double) as varchar) else cast(i as varchar) end as v from x")
def value_as_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every numeric type as text."""
    from ..functions.types import value_as_string as text_of

    return view(_typed(spark, sf_dir)).select("datatype", "ts_ns", text_of().alias("v"))


@query(f"with {_TYPED} select datatype, ts_ns, case when i is null then cast(d as double) else cast(i as double) end as v from x")
def typed_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric view of every numeric type, unsigned ones too."""
    found = view(_typed(spark, sf_dir))
    return filters.typed(found, "doubles").join(found.select("channel", "datatype").distinct(), "channel").select("datatype", "ts_ns", "v")


@query(f"with {_TYPED} select ts_ns, cast(i as bigint) as v from x where datatype in ('int8', 'int64')")
def typed_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.typed(filters.by_datatype(view(_typed(spark, sf_dir)), "int8", "int64"), "longs").select("ts_ns", "v")


@query(f"with {_TYPED} select ts_ns, cast(i as varchar) as v from x where datatype = 'uint64'")
def unsigned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit values without sign, which no long holds."""
    from ..functions.types import reinterpret_unsigned

    found = filters.typed(filters.by_datatype(view(_typed(spark, sf_dir)), "uint64"), "ulongs")
    bits = (F.col("v") - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("long")  # as a language without them holds it
    return found.select("ts_ns", reinterpret_unsigned(bits).cast("string").alias("v"))


@query(f"with {_TYPED} select s_suppkey as ts_ns, s_suppkey % 2 = 1 as v from supplier")
def channel_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_index(view(_typed(spark, sf_dir)), 0).select("ts_ns", F.col("v_bool").alias("v"))


@query("select distinct 's' || (s_suppkey % 7) as file, t.* from supplier, (values (0,'c0','bool'),(1,'c1','int8'),(2,'c2','int16'),(3,'c3','int32'),(4,'c4','int64'),(5,'c5','uint8'),(6,'c6','uint16'),(7,'c7','uint32'),(8,'c8','uint64'),(9,'c9','float'),(10,'c10','double')) t(channel_index, channel, datatype)")
def channel_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(_typed(spark, sf_dir), "channels").select("file", "channel_index", "channel", "datatype")


# What is skipped, cut or wrong


def _skips(key: int) -> bytes:
    one = struct.pack("<qd", key, 1.0)
    blocks = [
        block(0, ABSOLUTE, one), struct.pack("<HH", 0, 0), block(0, RESERVED, one), block(0, DEPRECATED, one), block(0, STATUS, one), block(1, ABSOLUTE, b"xyz" + bytes([key])),
        block(0, MESSAGE, one), block(0, ABSOLUTE | MANY, struct.pack("<I", 2) + one + one),
    ]
    return recording([channel(0, "double"), channel(1, "novelty")], b"".join(blocks))


_SKIPS = "nation, (values (0,0,'absolute',1,null),(1,0,'skipped',0,'ZeroLengthBlock'),(2,0,'skipped',0,'ReservedBlockType'),(3,0,'skipped',0,'DeprecatedBlockType'),(4,0,'skipped',0,'StatusEvent'),(5,1,'skipped',0,'UnsupportedDataType'),(6,0,'skipped',0,'ReservedBlockType'),(7,0,'absolute',2,null)) t(block_ord, channel_index, kind, n, skip_reason)"


@query(f"select n_name as file, cast(block_ord as bigint) block_ord, channel_index, kind, cast(n as bigint) n, skip_reason from {_SKIPS}")
def block_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason to skip a block; what stands around stays."""
    return view(nations(spark, sf_dir, _skips), "blocks").select("file", "block_ord", "channel_index", "kind", "n", "skip_reason")


@query("select n_name as file, lower(hex(n_nationkey)) as last, '0178797a' as head from nation where false union all select n_name, lpad(lower(hex(n_nationkey)), 2, '0'), '0878797a' from nation")
def block_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of blocks of a type that is not known, on demand."""
    found = view(nations(spark, sf_dir, _skips), "blocks", captureSkipped="true").where("skip_reason = 'UnsupportedDataType'")
    raw = F.lower(F.hex("payload"))
    return found.select("file", F.substring(raw, 9, 2).alias("last"), F.substring(raw, 1, 8).alias("head"))


@query(f"""select n_name as file, cast(count(*) as bigint) blocks_total, cast(count(*) filter (skip_reason is null) as bigint) blocks_read, cast(count(*) filter (skip_reason = 'ZeroLengthBlock') as bigint) zero,
cast(count(*) filter (skip_reason = 'StatusEvent') as bigint) status, cast(count(distinct channel_index) filter (skip_reason is null and n > 0) as bigint) channels_with_data from {_SKIPS} group by 1""")
def telemetry_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over blocks that the reader has given."""
    t = stats.file_telemetry(view(nations(spark, sf_dir, _skips), "blocks"))
    return t.select("file", "blocks_total", "blocks_read", F.col("skipped_ZeroLengthBlock").alias("zero"), F.col("skipped_StatusEvent").alias("status"), "channels_with_data")


def _unknown(key: int) -> bytes:
    one = block(0, ABSOLUTE, struct.pack("<qd", key, 1.0))
    return recording([channel(0, "double")], one + block(9, ABSOLUTE, struct.pack("<qd", 0, 0.0)) + one)


@query("select n_name as file, cast(1 as bigint) as samples, true as truncated, true as named from nation")
def block_unknown_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel that is not defined ends the reading; what came before is kept."""
    content = nations(spark, sf_dir, _unknown)
    found = view(content).groupBy("file").agg(F.count("*").alias("samples"))
    files = view(content, "files").select("file", "truncated", F.col("error").contains("unknown channel 9").alias("named"))
    return found.join(files, "file").select("file", "samples", "truncated", "named")


@query("select n_name as file, 'unknown channel 9' as error from nation")
def failfast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict mode raises; here each file's error is caught and shown."""
    from ..sources.wire import FormatError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    list(rows(file, data.as_py(), Options(mode="FAILFAST")))
                    errors.append(None)
                except FormatError as e:
                    errors.append(str(e).split(" at byte")[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["file", "error"])

    return nations(spark, sf_dir, _unknown).mapInArrow(run, "file string, error string")


def _trailed(key: int) -> bytes:
    body = f"<statistics samples='{key}'/>".encode()
    return recording([channel(0, "double")], block(0, ABSOLUTE, struct.pack("<qd", key, 1.0)) + struct.pack("<HI", TRAILER, len(body)) + body + TAG)


@query("select n_name as file, n_nationkey % 2 = 0 as trailer_seen, false as truncated, cast(n_nationkey as bigint) as ts_ns from nation")
def block_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailer behind the last block, or none."""
    content = nations(spark, sf_dir, lambda k: _trailed(k) if k % 2 == 0 else recording([channel(0, "double")], block(0, ABSOLUTE, struct.pack("<qd", k, 1.0))))
    return view(content, "files").join(view(content).select("file", "ts_ns"), "file").select("file", "trailer_seen", "truncated", "ts_ns")


def _signed(key: int) -> bytes:
    one = struct.pack("<qd", key, 1.0)
    signature = struct.pack("<HI", SIGNATURE, 96) + bytes(96)
    good = block(0, ABSOLUTE, one, checked=True)
    bad = good[:-1] + bytes([good[-1] ^ 1])
    level = key % 3
    tokens = ("", " crc32c:*", " crc32c:* ed25519:0123456789abcdef")[level]
    return recording([channel(0, "double")], good + (bad if key % 2 else good) + (signature if level == 2 else b"") if level else block(0, ABSOLUTE, one), 5, tokens)


@query("""select n_name as file, case n_nationkey % 3 when 0 then 'none' when 1 then 'crc32c' else 'signed' end as integrity, case when n_nationkey % 3 = 0 then 'none' when n_nationkey % 2 = 1 then 'invalid' when n_nationkey % 3 = 2 then 'signature_unverifiable' else 'crc_valid' end as status,
cast(case when n_nationkey % 3 = 2 then 1 else 0 end as bigint) as signatures, cast(case when n_nationkey % 3 > 0 and n_nationkey % 2 = 0 then 2 else 1 end as bigint) as samples from nation""")
def block_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of blocks, signature blocks, and what the three levels say of a file."""
    content = nations(spark, sf_dir, _signed)
    t = stats.file_telemetry(view(content, "blocks"))
    found = view(content).groupBy("file").agg(F.count("*").alias("samples"))
    status = stats.verification_status(F.col("integrity"), F.col("skipped_CrcMismatch"))
    return view(content, "files").select("file", "integrity").join(t, "file").join(found, "file").select("file", "integrity", status.alias("status"), F.col("skipped_SignatureBlock").alias("signatures"), "samples")


def _cut(key: int) -> bytes:
    one = b"".join(block(0, ABSOLUTE, struct.pack("<qd", k, 1.0)) for k in range(10))
    return recording([channel(0, "double")], one)[: -(1 + key * 8)]


@query("select n_name as file, (1 + n_nationkey * 8) % 21 <> 0 as truncated, cast(10 - ceil((1 + n_nationkey * 8) / 21.0) as bigint) as samples from nation")
def block_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording that ends in the middle of a block keeps all whole ones."""
    content = nations(spark, sf_dir, _cut)
    found = view(content).groupBy("file").agg(F.count("*").alias("samples"))
    files = view(content, "files").select("file", "truncated")
    return files.join(found, "file", "left").select("file", "truncated", F.coalesce("samples", F.lit(0)).alias("samples"))


@query("select n_name as file, cast(missing as integer) as missing, cast(10 - ceil(missing / 21.0) as bigint) as samples from nation, unnest(range(0, 211)) t(missing)")
def truncation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are left when a recording of ten blocks ends at any byte of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                left = [sum(b.num_rows for b in rows(file, data[: len(data) - k], Options())) for k in range(211)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * 211), pa.array(range(211), pa.int32()), pa.array(left, pa.int64())], ["file", "missing", "samples"])

    whole = nations(spark, sf_dir, lambda key: recording([channel(0, "double")], b"".join(block(0, ABSOLUTE, struct.pack("<qd", k, 1.0)) for k in range(10))))
    return whole.mapInArrow(run, "file string, missing int, samples long")


def _families(key: int) -> bytes:
    absolute, start = block(0, ABSOLUTE, struct.pack("<qd", key, 1.0)), block(0, START, struct.pack("<qdd", key, 1.0, 1.0))
    return recording([channel(0, "double")], (absolute + start, start + absolute, block(0, CONTINUED, struct.pack("<d", 1.0)) + absolute, block(0, RELATIVE, struct.pack("<Id", 5, 1.0)) + start)[key % 4])


@query("""select n_name as file, case n_nationkey % 4 when 0 then 1 when 1 then 1 else 0 end as block_ord, case n_nationkey % 4 when 0 then 'ChannelMixedBlockTypes' when 1 then 'ChannelMixedBlockTypes' when 2 then 'ContinuedDataWithoutStart' else 'RelativeStampWithoutAnchor' end as skip_reason from nation""")
def family_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel is equidistant or stamped; blocks that do not fit are left out with a reason."""
    found = view(nations(spark, sf_dir, _families), "blocks").where("skip_reason is not null")
    return found.select("file", F.col("block_ord").cast("int").alias("block_ord"), "skip_reason")


@query("select n_name as file, 'channel 0: scale is ignored; channel 0: physicalunit2 is ignored' as warnings from nation where n_nationkey % 2 = 0 union all select n_name, null from nation where n_nationkey % 2 = 1")
def deprecated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of older versions are passed over with a warning, in both forms of the metablock."""
    content = nations(spark, sf_dir, lambda k: recording([channel(0, "double", **({"scale": 1.0, "physicalunit2": "m"} if k % 2 == 0 else {}))], b"", 5 if k % 3 else 4))
    return view(content, "files").select("file", "warnings")


@query("select * from (values ('zeros', '8A9136AA'), ('ones', '62A8AB43'), ('rising', '46DD794E'), ('falling', '113FDB5C'), ('digits', 'E3069283')) t(name, crc)")
def crc32c_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of byte strings whose values a public specification lists."""
    known = {"zeros": bytes(32), "ones": b"\xff" * 32, "rising": bytes(range(32)), "falling": bytes(range(31, -1, -1)), "digits": b"123456789"}
    data = spark.createDataFrame([(k, bytearray(v)) for k, v in known.items()], "name string, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{crc32c(d.as_py()):08X}" for d in batch.column(1)])], ["name", "crc"])

    return data.mapInArrow(run, "name string, crc string")


@query(f"{S}, r as (select *, row_number() over (partition by channel order by event_id)-1 i from s), z as (select channel, min(ts_ns) a from s group by 1) select channel, a + i * 1000 as ts_ns from r join z using (channel)")
def timebase_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and place times the channel's increment, whatever segments and rates say."""
    rows_ = numbered(samples(spark, sf_dir), ["channel"], ["ord"], id_bucket(F.col("ord")), "i")
    start = timebase.time_range(samples(spark, sf_dir)).select("channel", F.col("first_ts").alias("a"))
    step: Column = F.lit(1000).cast("double")
    return rows_.join(start, "channel").select("channel", timebase.equidistant_ts(F.col("a"), step, F.col("i"), "increment").alias("ts_ns"))


def _live(key: int) -> bytes:
    """One recording, written block by block."""
    out = io.BytesIO()
    r = LiveRecording(out, integrity="crc32c" if key % 2 else "none")
    a, b, c = r.add_channel("a", "double"), r.add_channel("b", "int32"), r.add_channel("c", "string")
    r.start()
    for k in range(key):
        r.samples(a, [k * 10], [float(k)])
        r.samples(c, [k * 10], [f"text {k}"])
    r.segment(b, 1000, 1e9, [0, 1])
    r.more(b, [2])
    r.more(b, [3, 4])
    r.close()
    return out.getvalue()


@query("""select n_name as file, 'a' as channel, k * 10 as ts_ns, cast(cast(k as double) as varchar) as v from nation, unnest(range(0, n_nationkey)) t(k)
union all select n_name, 'c', k * 10, 'text ' || k from nation, unnest(range(0, n_nationkey)) t(k) union all select n_name, 'b', 1000 + k, cast(k as varchar) from nation, unnest(range(0, 5)) t(k)""")
def live_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that grew sample by sample, with a segment that went on."""
    from ..functions.types import value_as_string as text_of

    return view(nations(spark, sf_dir, _live)).select("file", "channel", "ts_ns", text_of().alias("v"))


@query("select n_name as file, cast(k as integer) as blocks, cast(k as bigint) as samples from nation, unnest(range(0, 6)) t(k)")
def live_power_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After any of its blocks a growing recording can be read up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out, left = io.BytesIO(), []
                r = LiveRecording(out)
                c = r.add_channel("a", "double")
                r.start()
                for k in range(6):
                    left.append(sum(b.num_rows for b in rows(file, out.getvalue(), Options())))
                    r.samples(c, [k], [1.0])
                yield pa.RecordBatch.from_arrays([pa.array([file] * 6), pa.array(range(6), pa.int32()), pa.array(left, pa.int64())], ["file", "blocks", "samples"])

    return table(spark, sf_dir, "nation").select("n_name").mapInArrow(run, "file string, blocks int, samples long")
