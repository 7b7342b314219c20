"""Reading and writing recordings with Spark.

``read`` goes through Spark's own file source, so it reaches every store that Spark
reads; files are decoded on the executors, one task for one or more files.  ``register``
adds the same as a data source (format "recording") with options, pushed filters, a
stream reader and a sink, for paths that the workers can open themselves.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .encode import Spooled, Writer, numeric_value
from .frames import DTYPES
from .views import VIEWS, Options, rows
from .wire import EXTENSIONS, FormatError, compressed, head, peek, read_meta

FORMAT = "recording"
GLOB = "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}"


def read(spark: SparkSession, path: str | list[str], view: str = "samples", recursive: bool = True, paths: list[str] | None = None, **options: Any) -> DataFrame:
    """One view of all recordings below a path, or of the given files only (``paths``)."""
    chosen = Options.of({"view": view} | {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items() if v is not None})
    reader = spark.read.format("binaryFile")
    if paths is None:
        reader = reader.option("pathGlobFilter", GLOB).option("recursiveFileLookup", str(recursive).lower())
    return decoded(reader.load(path if paths is None else paths).select("path", "content"), chosen)


#: Bytes of recordings that go to a worker at once, unless one alone is larger.
WORKER_BYTES = "8m"


def decoded(content: DataFrame, chosen: Options) -> DataFrame:
    """A view of recordings: their names and bytes in two columns."""
    content.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", WORKER_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _decode(batch, chosen)

    return content.mapInArrow(run, VIEWS[chosen.view])


def _decode(batch: pa.RecordBatch, chosen: Options) -> Iterator[pa.RecordBatch]:
    for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield from rows(name, memoryview(data.as_buffer()).cast("B"), chosen)  # not copied


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """file, version (none if it is no recording) from the first bytes of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = []
            for data in batch.column(1):
                versions.append(peek(head(bytes(memoryview(data.as_buffer())[:1024]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(versions, pa.int32())], ["file", "version"])

    return files.mapInArrow(run, "file string, version int")


# The data source


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def _listed(path: str, recursive: bool) -> list[tuple[str, int]]:
    store, base = _store(path)
    info = store.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(base, info.size)]
    found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=recursive))
    inside = [f for f in found if f.type == pafs.FileType.File and f.path.endswith(EXTENSIONS) and not any(p.startswith(("_", ".")) for p in f.path[len(base) :].split("/") if p)]
    return sorted((f.path, f.size) for f in inside)


def _bytes(path: str, base: str) -> bytes:
    store, _ = _store(base)
    with store.open_input_stream(path) as f:
        return f.read()


def _metadata(path: str, base: str, first: int = 1 << 16) -> bytes:
    """The beginning of a file up to its metablock, which is all that definitions need."""
    store, _ = _store(base)
    data, step = b"", first
    with store.open_input_stream(path) as f:
        while piece := f.read(step):
            data, step = data + piece, len(data) + len(piece)
            try:
                read_meta(data)
                break
            except FormatError:
                continue  # cut, unless the rest does not help either
    return data


@dataclass
class OneFile(InputPartition):
    path: str
    begin: int = 0
    end: int | None = None


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], Options.of(options)
        self.recursive = options.get("recursiveFileLookup", options.get("recursivefilelookup", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p, _ in _listed(self.path, self.recursive)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        data = _metadata(partition.path, self.path) if self.options.view in ("channels", "infos") else _bytes(partition.path, self.path)
        yield from rows(partition.path, data, self.options)


class FilteringReader(RecordingReader):
    """Takes filters on channel, channel_index and ts_ns; blocks of other channels are not decoded.

    Only used with the option pushdown, as it needs spark.sql.python.filterPushdown.enabled.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        o = self.options
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("channel",) and isinstance(f, (EqualTo, In)):
                o = replace(o, channels=tuple(str(v).lower() for v in ([f.value] if isinstance(f, EqualTo) else f.value)))
                yield f  # names are matched without case here, so Spark looks again
            elif name == ("channel_index",) and isinstance(f, (EqualTo, In)):
                o = replace(o, indices=tuple(int(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)))
            elif name == ("ts_ns",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                o = replace(o, start_ns=low if o.start_ns is None else max(low, o.start_ns))
            elif name == ("ts_ns",) and isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                o = replace(o, end_ns=high if o.end_ns is None else min(high, o.end_ns))
            else:
                yield f
        self.options = o


class RecordingStream(DataSourceStreamReader):
    """Growing files: each batch holds the blocks that became whole since the last one.

    The offset is the size of each file in the listing, so the driver opens none; the
    tasks find the blocks that end between two sizes.  Compressed files count when they
    are first seen, and whole.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], Options.of(options)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(dict(_listed(self.path, True)), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        return [OneFile(p, a.get(p, 0), n) for p, n in sorted(b.items()) if n > a.get(p, 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        data = _bytes(partition.path, self.path)[: partition.end]
        if compressed(data):
            if partition.begin == 0:
                yield from rows(partition.path, data, self.options)
            return
        yield from rows(partition.path, data, replace(self.options, begin=partition.begin, end=partition.end))

    def commit(self, end: dict) -> None:
        return None


@dataclass
class Written(WriterCommitMessage):
    """Temporary files and the recordings (values of ``file``) they hold."""

    files: list[tuple[str, str]]


def stem_of(file: str, root: str | None = None) -> str:
    """Where a recording goes below the target, without extension: a relative name keeps
    its folders, as does a path below ``root``; of any other path the last name counts."""
    plain = lambda p: p.split("://", 1)[-1].removeprefix("file:")
    name = plain(file)
    if root and name.startswith(plain(root).rstrip("/") + "/"):
        name = name[len(plain(root).rstrip("/")) + 1 :]
    elif name.startswith("/") or "://" in file:
        name = posixpath.basename(name)
    parts = [p for p in name.split("/") if p not in ("", ".", "..")] or ["recording"]
    parts[-1] = parts[-1].removesuffix(EXTENSIONS[1]).removesuffix(EXTENSIONS[0]) or "recording"
    return "/".join(parts)


def placed(made: list[tuple[str, str]], taken: set[str], root: str | None, extension: str) -> list[tuple[str, str]]:
    """(temporary file, final name) of what the tasks wrote, no two with the same name.

    A recording whose rows were in several tasks, or that meets a name that is taken,
    gets a number behind its name, so nothing is ever replaced.
    """
    used, out = set(taken), []
    for temporary, file in sorted(made, key=lambda x: (x[1], x[0])):
        stem, k = stem_of(file, root), 1
        while (name := (stem if k == 1 else f"{stem}-{k}") + extension) in used:
            k += 1
        used.add(name)
        out.append((temporary, name))
    return out


class _Files:
    """What the two sinks share: rows of samples to files, renamed when all tasks are done."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite, self.job = low["path"], overwrite, uuid.uuid4().hex
        self.version = int(low.get("version", "5"))
        self.integrity = low.get("integrity", "none")
        self.compression = low.get("compression")
        self.tag, self.creator = low.get("tag", "preview"), low.get("creator", "chronospark")
        self.root = low.get("root")
        self.extension = EXTENSIONS[1] if self.compression else EXTENSIONS[0]

    def write_batches(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows are put in order some MB at a time, so a task holds no more than these.

        Rows that come in the order of recordings give one file for each; what comes later
        and belongs before gives another part.
        """
        store, base = _store(self.path)
        out: list[tuple[str, str]] = []
        growing: Growing | None = None
        current = None

        def finish() -> None:
            if growing is not None:
                temporary = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}"
                store.create_dir(posixpath.dirname(temporary), recursive=True)
                with store.open_output_stream(temporary) as f:
                    growing.write_to(f)
                out.append((temporary, current or "recording"))

        for table in _gathered(batches):
            table = _ordered(table, ("file",) + _order(table))
            names = table.column("file")
            edges = _changes(table, ("file",))
            for at, end in zip(edges[:-1], edges[1:]):
                name, part = names[at].as_py(), table.slice(at, end - at)
                if growing is None or name != current or not growing.goes_on(part):
                    finish()
                    growing, current = Growing(self.version, self.integrity, self.compression, tag=self.tag, creator=self.creator), name
                growing.add(part)
        finish()
        return Written(out)

    def _present(self) -> set[str]:
        """Names below the target."""
        _, base = _store(self.path)
        return {p[len(base) :].lstrip("/") for p, _ in _listed(self.path, True) if p != base}

    def finish(self, messages: list[Written | None], stale: set[str] | None = None, prefix: str = "") -> None:
        """Move the files to their names, then delete what they replace."""
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        made = [x for m in messages if m is not None for x in m.files]
        old = self._present()
        stale = old if self.overwrite else stale or set()
        final = placed(made, old - stale, self.root, self.extension)
        if prefix:
            final = [(t, posixpath.join(posixpath.dirname(n), prefix + posixpath.basename(n))) for t, n in final]
        for temporary, name in final:
            store.create_dir(posixpath.dirname(f"{base}/{name}"), recursive=True)
            store.move(temporary, f"{base}/{name}")
        for name in stale - {n for _, n in final}:
            store.delete_file(f"{base}/{name}")
        self.drop()

    def drop(self) -> None:
        store, base = _store(self.path)
        folder = f"{base}/_temporary-{self.job}"
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class RecordingSink(_Files, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.write_batches(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.finish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.drop()


class RecordingStreamSink(_Files, DataSourceStreamArrowWriter):
    """Files of each batch, named after it; a batch that is written again replaces its own."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.write_batches(iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        prefix = f"b{batchId}-"
        self.finish(messages, {n for n in self._present() if posixpath.basename(n).startswith(prefix)}, prefix)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.drop()


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return VIEWS[Options.of(dict(self.options)).view]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown", "false").lower() == "true" else RecordingReader)(options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return RecordingStream(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordingSink(dict(self.options), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return RecordingStreamSink(dict(self.options))


class DecodeRecording:
    """Rows of samples from a file's name and bytes, for SQL over binary files.

    Spark takes all rows of a call at once, so this is for small files.
    """

    def eval(self, file: str, content: bytes):
        for batch in rows(file, bytes(content), Options()):
            for r in batch.to_pylist():
                yield tuple(r.values())


class DecodeRecordings:
    """The same from a table of names and bytes, some MB of samples at a time."""

    def eval(self, files: pa.RecordBatch):
        yield from _decode(files, Options())


def register(spark: SparkSession) -> None:
    """The format "recording", and the table functions decode_recording(file, content) and
    decode_recordings(table(select file, content ...)), for files of any size."""
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", WORKER_BYTES)
    spark.udtf.register("decode_recordings", arrow_udtf(DecodeRecordings, returnType=VIEWS["samples"]))
    spark.udtf.register("decode_recording", udtf(DecodeRecording, returnType=VIEWS["samples"]))


def create_view(spark: SparkSession, name: str, path: str, view: str = "samples", **options: Any) -> None:
    """A temporary view over recordings, for SQL."""
    read(spark, path, view, **options).createOrReplaceTempView(name)


# Writing

_UNITS = ("physical_unit", "physical_dimension", "display_name", "comment", "reference", "mime_type", "channel_type")


#: Bytes of rows that a writing task puts in order at once.
GATHERED = 32 << 20


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _order(table: pa.Table) -> tuple[str, ...]:
    """Columns by which the rows of a recording are in order."""
    return tuple(c for c in ("channel_index", "channel", "block_ord", "sample_ord", "ts_ns") if c in table.column_names)


def _ordered(table: pa.Table, keys: tuple[str, ...]) -> pa.Table:
    """The rows in order; those that are already are not sorted again."""
    n = table.num_rows
    table = table.combine_chunks()
    tie = np.ones(max(n - 1, 0), bool)
    for k in keys:
        a, b = table.column(k).slice(0, max(n - 1, 0)), table.column(k).slice(1)
        same, less = (f(a, b).fill_null(False).to_numpy() for f in (pc.equal, pc.less))
        if (tie & ~same & ~less).any():
            return table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        tie &= same
    return table


def _changes(table: pa.Table, keys: tuple[str, ...]) -> list[int]:
    """Places where another value begins, with both ends."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        a, b = table.column(k).slice(0, max(n - 1, 0)), table.column(k).slice(1)
        # Nulls are equal to nulls only.
        differ = pc.not_equal(a, b).fill_null(False).to_numpy() | (a.is_null().to_numpy() != b.is_null().to_numpy())
        new |= differ
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def _plain(column: pa.ChunkedArray, datatype: str) -> Any:
    """Values of a channel as the writer takes them; nothing is cut to fit."""
    name = numeric_value(datatype)
    if name in ("v_string", "v_binary"):
        return column.to_pylist()
    if name == "v_double":
        return column.to_numpy()
    if column.null_count:
        raise ValueError(f"{datatype} channels have no nulls")
    if name == "v_ulong":
        return [int(v) for v in column.to_pylist()]
    if name == "v_gps":
        parts = column.combine_chunks()
        return np.stack([parts.field(f).to_numpy(zero_copy_only=False) for f in ("latitude", "longitude", "altitude")], 1)
    if name == "v_bool":
        return column.cast(pa.uint8()).to_numpy()
    values, room = column.to_numpy(), np.iinfo(DTYPES[datatype])
    if len(values) and (values.min() < room.min or values.max() > room.max):
        raise OverflowError(f"a value does not fit {datatype}")
    return values


class Growing(Spooled):
    """A recording of samples that come in order, a table at a time.

    Equidistant channels keep their segments where the column rate_hz gives their rates;
    all others are written with a time for each sample.
    """

    def __init__(self, version: int = 5, integrity: str = "none", compression: str | None = None, **info: Any):
        super().__init__(Writer(version, integrity, compression, **info))
        self.last: tuple | None = None
        self.segment: tuple | None = None

    def _place(self, table: pa.Table, row: int) -> tuple:
        return tuple(table.column(k)[row].as_py() for k in _order(table))

    def goes_on(self, table: pa.Table) -> bool:
        """Whether the rows belong behind those that are there."""
        try:
            return self.last is None or self._place(table, 0) >= self.last
        except TypeError:  # of nulls none is the first
            return False

    def add(self, table: pa.Table) -> None:
        keys = tuple(k for k in ("channel_index", "channel") if k in table.column_names)
        label = lambda t, row: tuple(t.column(k)[row].as_py() for k in keys)
        edges = _changes(table, keys)
        for at, end in zip(edges[:-1], edges[1:]):
            if at < end:
                self._add(label(table, at), table.slice(at, end - at))
        self.last = self._place(table, table.num_rows - 1)
        self.flush()

    def _add(self, key: tuple, part: pa.Table) -> None:
        w = self.writer
        if key != getattr(self, "key", None):
            first = {c: part.column(c)[0].as_py() for c in part.column_names}
            more = {k: first[k] for k in _UNITS if first.get(k) is not None}
            self.channel = w.add_channel(first["channel"], first["datatype"], **more)
            self.key, self.segment = key, None
            self.equidistant = first.get("mode") == "equidistant" and bool(first.get("rate_hz"))
        datatype = w.channels[self.channel].datatype
        if part.column("ts_ns").null_count:
            raise ValueError("samples have times")
        ts, values = part.column("ts_ns").to_numpy(), _plain(part.column(numeric_value(datatype)), datatype)
        if not self.equidistant:
            w.add_samples(self.channel, ts, values)
            return
        rates, edges = part.column("rate_hz"), _changes(part, ("seg_id",))
        for i, j in zip(edges[:-1], edges[1:]):
            segment = (part.column("seg_id")[i].as_py(),)
            if segment == self.segment:
                w.more(self.channel, values[i:j])
            else:
                w.add_segment(self.channel, int(ts[i]), rates[i].as_py(), values[i:j])
            self.segment = segment


def encode_samples(table: pa.Table, version: int = 5, integrity: str = "none", compression: str | None = None, **info: Any) -> bytes:
    """One recording from its samples: channels by index (or name), samples in order."""
    growing, out = Growing(version, integrity, compression, **info), io.BytesIO()
    if table.num_rows:
        growing.add(_ordered(table, _order(table)))
    growing.write_to(out)
    return out.getvalue()


def with_rates(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    """Samples with the rate of their segment, for a copy that keeps segments."""
    starts = blocks.where("kind = 'start' and skip_reason is null")
    over = Window.partitionBy("file", "channel_index").orderBy("block_ord")
    rates = starts.select("file", "channel_index", (F.row_number().over(over) - 1).alias("seg_id"), "rate_hz")
    return samples.join(rates, ["file", "channel_index", "seg_id"], "left")


def with_definitions(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Samples with units and other texts of their channels."""
    return samples.join(channels.select("file", "channel_index", *_UNITS), ["file", "channel_index"], "left")


def write(samples: DataFrame, path: str, version: int = 5, integrity: str = "none", compression: str | None = None, mode: str = "append", tasks: int | None = None, **options: str) -> None:
    """One recording for each value of ``file``; each file is sorted and written by one task."""
    spark = samples.sparkSession
    register(spark)
    order = [c for c in ("file", "channel_index", "channel", "block_ord", "sample_ord", "ts_ns") if c in samples.columns]
    spread = samples.repartition(tasks, "file") if tasks else samples.repartition("file")
    out = spread.sortWithinPartitions(*order).write.format(FORMAT).mode(mode).option("version", version).option("integrity", integrity)
    if compression:
        out = out.option("compression", compression)
    out.options(**options).save(path)


def convert(spark: SparkSession, source: str, target: str, version: int = 5, integrity: str = "none", compression: str | None = None, keep_segments: bool = True) -> None:
    """Copy recordings to another version; with segments, or with a time for every sample.

    Folders below the source are kept.
    """
    samples = with_definitions(read(spark, source), read(spark, source, "channels"))
    if keep_segments:
        samples = with_rates(samples, read(spark, source, "blocks"))
    write(samples, target, version, integrity, compression, mode="append", root=source)
