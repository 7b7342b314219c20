"""A recording's bytes as rows of one of five views."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..functions.types import BLOCKS, CHANNELS, FILES, INFOS, SAMPLES
from .encode import numeric_value
from .frames import Block, Reader, Timeline
from .wire import FormatError, Meta, read_meta

VIEWS: dict[str, T.StructType] = {"samples": SAMPLES, "channels": CHANNELS, "files": FILES, "infos": INFOS, "blocks": BLOCKS}
_MODES = {"equidistant": "equidistant", "timestamped": "timestamped", "variable": "variable"}


@dataclass(frozen=True)
class Options:
    """How files are read; the same names serve as options of the source."""

    view: str = "samples"
    channels: tuple[str, ...] = ()
    indices: tuple[int, ...] = ()
    start_ns: int | None = None
    end_ns: int | None = None
    mode: str = "PERMISSIVE"
    time_model: str = "exact"
    capture_skipped: bool = False
    utf8: str = "strict"
    begin: int = 0
    end: int | None = None

    @staticmethod
    def of(options: dict[str, str]) -> Options:
        low = {k.lower(): v for k, v in options.items()}
        view = low.get("view", "samples")
        if view not in VIEWS:
            raise ValueError(f"view is one of {', '.join(VIEWS)}, not {view!r}")
        number = lambda k: int(low[k]) if low.get(k) else None
        return Options(
            view, tuple(x.strip().lower() for x in low.get("channels", "").split(",") if x.strip()), (), number("start_ns"), number("end_ns"),
            low.get("mode", "PERMISSIVE").upper(), low.get("timemodel", "exact"), low.get("captureskipped", "false").lower() == "true", low.get("utf8", "strict"),
        )


@functools.cache
def arrow_schema(view: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(VIEWS[view])


def _table(view: str, rows: list[dict[str, Any]]) -> pa.RecordBatch:
    schema = arrow_schema(view)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _wanted(meta: Meta, options: Options) -> set[int] | None:
    if not options.channels and not options.indices:
        return None
    return {c.index for c in meta.channels if (not options.channels or c.name.lower() in options.channels) and (not options.indices or c.index in options.indices)}


#: Rows, and bytes of blocks, after which a batch of samples is made.
BATCH_ROWS, BATCH_BYTES = 1 << 14, 4 << 20


class _Samples:
    """Blocks of samples, however small, as batches of many rows."""

    def __init__(self, file: str, options: Options, channels: dict[int, Any]):
        self.file, self.options, self.channels = file, options, channels
        self.bounded = options.start_ns is not None or options.end_ns is not None
        self.columns = {c.index: numeric_value(c.datatype) for c in channels.values() if c.supported}
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.rows = self.bytes = 0

    def add(self, block: Block, segment: int, family: str, ts: np.ndarray) -> None:
        values, places = block.values, None
        if self.bounded:
            keep, o = np.ones(block.n, bool), self.options
            if o.start_ns is not None:
                keep &= ts >= o.start_ns
            if o.end_ns is not None:
                keep &= ts <= o.end_ns
            if not keep.any():
                return
            if not keep.all():
                places = np.flatnonzero(keep)
                ts, values = ts[keep], [values[i] for i in places] if isinstance(values, list) else values[keep]
        self.parts.append((block.channel, block.ord, segment if family == "equidistant" else -1, _MODES[family], ts, values, places))
        self.rows += len(ts)
        self.bytes += block.length

    def full(self) -> bool:
        return self.rows >= BATCH_ROWS or self.bytes >= BATCH_BYTES

    def _values(self, column: str, kind: pa.DataType, parts: list[tuple], own: np.ndarray) -> pa.Array:
        """A column of values: those of the parts, null elsewhere."""
        n = len(own)
        if column in ("v_string", "v_binary", "v_ulong"):
            flat = [v for p in parts for v in (p[5] if isinstance(p[5], list) else map(Decimal, p[5].tolist()))]
            data = pa.array(flat, kind)
        elif column == "v_gps":
            v = np.concatenate([p[5] for p in parts])
            data = pa.StructArray.from_arrays([pa.array(v[:, k]) for k in range(3)], ["latitude", "longitude", "altitude"]).cast(kind)
        elif column == "v_bool":
            data = pa.array(np.concatenate([p[5] for p in parts]) != 0)
        else:
            data = pa.array(np.concatenate([p[5].astype(np.float64 if column == "v_double" else np.int64) for p in parts]))
        if len(data) == n:
            return data
        return data.take(pa.array(np.cumsum(own) - 1, mask=~own))

    def take(self) -> pa.RecordBatch:
        """One batch of all that was added since the last one."""
        parts, n, schema = self.parts, self.rows, arrow_schema("samples")
        counts = np.array([len(p[4]) for p in parts])
        index = np.repeat(np.array([p[0] for p in parts], np.int32), counts)
        segment = np.repeat(np.array([p[2] for p in parts], np.int32), counts)

        def named(of: list[str]) -> pa.Array:
            """A text for each part, for its rows."""
            known = {x: k for k, x in enumerate(dict.fromkeys(of))}
            return pa.array(list(known), pa.string()).take(pa.array(np.repeat(np.array([known[x] for x in of]), counts)))

        made = {
            "file": pa.repeat(pa.scalar(self.file, pa.string()), n), "channel_index": pa.array(index), "channel": named([self.channels[p[0]].name for p in parts]), "datatype": named([self.channels[p[0]].datatype for p in parts]), "mode": named([p[3] for p in parts]),
            "block_ord": pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), counts)), "seg_id": pa.array(segment, mask=segment < 0), "ts_ns": pa.array(np.concatenate([p[4] for p in parts])),
            "sample_ord": pa.array(np.concatenate([np.arange(len(p[4])) if p[6] is None else p[6] for p in parts]).astype(np.int32)),
        }
        kinds: dict[str, list[tuple]] = {}
        for p in parts:
            kinds.setdefault(self.columns[p[0]], []).append(p)
        column = np.repeat(np.array([self.columns[p[0]] for p in parts]), counts)
        for name, own in kinds.items():
            made[name] = self._values(name, schema.field(name).type, own, column == name)
        self.clear()
        out = [made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(out, schema=schema)


def _file_row(file: str, size: int, meta: Meta | None, error: str | None, reader: Reader | None = None, cut: bool = False) -> dict[str, Any]:
    row: dict[str, Any] = {"file": file, "file_size": size, "error": error, "truncated": cut, "trailer_seen": False}
    if meta is not None:
        row |= {"version": meta.version, "integrity": meta.integrity, "metablock_crc": meta.crc, "compression": meta.compression, "header_bytes": meta.header_bytes, "metablock_bytes": meta.metablock_bytes, "warnings": "; ".join(meta.warnings) or None} | meta.info
    if reader is not None:
        row |= {"trailer_seen": reader.trailer_seen, "truncated": cut or reader.truncated, "error": error or reader.error}
    return row


def rows(file: str, data: bytes, options: Options) -> Iterator[pa.RecordBatch]:
    """Batches of the chosen view.  In PERMISSIVE mode a file that cannot be read gives a
    row of the view "files" with its error, and none of the others."""
    view = options.view
    try:
        meta, plain, cut = read_meta(data)
    except FormatError as e:
        if options.mode == "FAILFAST":
            raise FormatError(f"{file}: {e}") from e
        if view == "files":
            yield _table(view, [_file_row(file, len(data), None, str(e))])
        return
    if view == "channels":
        fields = ("reference", "channel_type", "datatype", "time_increment_ns", "size_of_length_value", "mime_type", "spectrum_type", "physical_unit", "physical_dimension", "display_name", "comment", "supported")
        wanted = _wanted(meta, options)
        yield _table(view, [{"file": file, "channel_index": c.index, "channel": c.name} | {k: getattr(c, k) for k in fields} for c in meta.channels if wanted is None or c.index in wanted])
        return
    if view == "infos":
        yield _table(view, [{"file": file} | x for x in meta.infos])
        return
    reader = Reader(plain, meta, options.mode, _wanted(meta, options), options.capture_skipped, options.utf8)
    lines: dict[int, Timeline] = {}
    made: list[dict[str, Any]] = []
    samples = _Samples(file, options, reader.channels)
    for block in reader:
        line = lines.setdefault(block.channel, Timeline())
        ts = line.place(block, options.time_model) if block.skip_reason is None else None
        if ts is None and block.skip_reason not in (None, "CrcMismatch") and options.mode == "FAILFAST" and block.skip_reason.startswith(("Channel", "Continued", "Relative")):
            raise FormatError(f"{file}: {block.skip_reason} in block {block.ord}")
        if reader.at <= options.begin:
            continue  # was whole before
        if view == "samples":
            if ts is not None and block.n:
                samples.add(block, line.segment, line.family, ts)
                if samples.full():
                    yield samples.take()
        elif view == "blocks":
            own = ts is not None and len(ts) > 0
            made.append({
                "file": file, "block_ord": block.ord, "byte_offset": block.offset, "channel_index": block.channel, "length": block.length, "control": block.control, "kind": block.kind if block.skip_reason is None else "skipped",
                "multi": block.multi, "n": block.n if block.skip_reason is None else 0, "start_ns": block.start_ns, "rate_hz": block.rate_hz, "first_ts": int(ts[0]) if own else None, "last_ts": int(ts[-1]) if own else None,
                "skip_reason": block.skip_reason, "crc_ok": block.crc_ok, "payload": block.payload,
            })
            if len(made) >= 10_000:
                yield _table(view, made)
                made = []
    if samples.parts:
        yield samples.take()
    if view == "blocks" and made:
        yield _table(view, made)
    if view == "files":
        yield _table(view, [_file_row(file, len(data), meta, None, reader, cut)])
