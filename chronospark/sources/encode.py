"""Writing a recording: metablock, blocks cut to their length fields, checksums."""

from __future__ import annotations

import gzip
import struct
import tempfile
from collections.abc import Iterable, Sequence
from typing import Any, BinaryIO

import numpy as np

from ..functions.types import NUMERIC
from .checksums import crc32c
from .frames import ABSOLUTE, CONTINUED, DTYPES, START
from .wire import Channel, build_header, build_metablock, pack

EQUIDISTANT_TYPES = ("float", "double", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


class Writer:
    """Collects the samples of a recording and gives its bytes.

    A channel is equidistant or stamped, never both; lengths must agree; an empty
    recording is an error.  Text and bytes are written one sample per block, and their
    length field grows to four bytes where one of them needs it.
    """

    def __init__(self, version: int = 5, integrity: str = "none", compression: str | None = None, **info: Any):
        if version not in (4, 5):
            raise ValueError(f"version 4 or 5, not {version}")
        if integrity not in ("none", "crc32c") or integrity != "none" and version == 4:
            raise ValueError(f"integrity {integrity!r} is not possible in version {version}")
        self.version, self.integrity, self.compression, self.info = version, integrity, compression, {"creator": "chronospark", "tag": "preview"} | info
        self.channels: list[Channel] = []
        self.infos: list[dict[str, Any]] = []
        self.data: dict[int, list[tuple]] = {}
        self.family: dict[int, str] = {}

    def add_channel(self, name: str, datatype: str, **more: Any) -> int:
        if datatype not in DTYPES and datatype not in ("string", "binary"):
            raise ValueError(f"datatype {datatype!r} cannot be written")
        self.channels.append(Channel(len(self.channels), name, datatype, **more))
        self.data[len(self.channels) - 1] = []
        return len(self.channels) - 1

    def _claim(self, channel: int, family: str) -> Channel:
        if not 0 <= channel < len(self.channels):
            raise ValueError(f"no channel {channel}")
        if self.family.get(channel, family) != family:
            raise ValueError(f"channel {channel} is {self.family[channel]}, not {family}")
        return self.channels[channel]

    def add_segment(self, channel: int, start_ns: int, rate_hz: float, values: Sequence) -> None:
        c = self._claim(channel, "equidistant")
        if c.datatype not in EQUIDISTANT_TYPES:
            raise ValueError(f"{c.datatype} channels cannot be equidistant")
        if not rate_hz > 0:
            raise ValueError("the rate must be above 0")
        self.family[channel] = "equidistant"
        self.data[channel].append((start_ns, rate_hz, np.asarray(values, DTYPES[c.datatype])))

    def more(self, channel: int, values: Sequence) -> None:
        """Values that go on with the last segment."""
        c = self._claim(channel, "equidistant")
        self.data[channel].append((None, None, np.asarray(values, DTYPES[c.datatype])))

    def add_samples(self, channel: int, ts: Sequence[int], values: Sequence) -> None:
        c = self._claim(channel, "stamped")
        if len(ts) != len(values):
            raise ValueError("as many times as values are needed")
        self.family[channel] = "stamped"
        if c.datatype in ("string", "binary"):
            raw = [v.encode() if isinstance(v, str) else bytes(v) for v in values]
            self.data[channel].append((np.asarray(ts, np.int64), raw))
            end = 1 if self.version == 4 else 0
            if max(map(len, raw), default=0) + 9 + end + 4 > 0xFFFF:
                c.size_of_length_value = 4
            return
        v = np.asarray(values, np.float64 if c.datatype == "gpslocation" else DTYPES[c.datatype])
        self.data[channel].append((np.asarray(ts, np.int64), v.reshape(len(ts), 3) if c.datatype == "gpslocation" else v))

    def _block(self, c: Channel, control: int, body: bytes) -> bytes:
        length = 1 + len(body) + (4 if self.integrity == "crc32c" else 0)
        frame = struct.pack("<HI" if c.size_of_length_value == 4 else "<HH", c.index, length) + bytes([control]) + body
        return frame + struct.pack("<I", crc32c(frame)) if self.integrity == "crc32c" else frame

    def _room(self, c: Channel) -> int:
        """Bytes of a block for samples: a length field of 2 bytes, or 1 MB of 4."""
        return (0xFFFF if c.size_of_length_value == 2 else 1 << 20) - 1 - 4 - 4

    def _blocks(self, c: Channel) -> Iterable[bytes]:
        for part in self.data[c.index]:
            if len(part) == 3:
                start, rate, v = part
                step = max(1, (self._room(c) - 16) // v.dtype.itemsize)
                for i in range(0, len(v), step):
                    piece = v[i : i + step]
                    many = len(piece) > 1
                    first = i == 0 and start is not None
                    head = struct.pack("<qd", start, rate) if first else b""
                    count = struct.pack("<I", len(piece)) if many else b""
                    yield self._block(c, (START if first else CONTINUED) | (0x80 if many else 0), head + count + piece.tobytes())
            elif c.datatype in ("string", "binary"):
                for t, raw in zip(part[0].tolist(), part[1]):
                    yield self._block(c, ABSOLUTE, struct.pack("<q", t) + raw + (b"\0" if self.version == 4 else b""))
            else:
                ts, v = part
                value = np.dtype(("<f8", (3,))) if c.datatype == "gpslocation" else np.dtype(DTYPES[c.datatype])
                rows = np.zeros(len(ts), np.dtype([("t", "<i8"), ("v", value)]))
                rows["t"], rows["v"] = ts, v
                step = max(1, self._room(c) // rows.dtype.itemsize)
                for i in range(0, len(rows), step):
                    piece = rows[i : i + step]
                    many = len(piece) > 1
                    yield self._block(c, ABSOLUTE | (0x80 if many else 0), (struct.pack("<I", len(piece)) if many else b"") + piece.tobytes())

    def to_bytes(self) -> bytes:
        if not self.channels:
            raise ValueError("a recording needs a channel")
        meta = build_metablock(self.version, self.info, self.channels, self.infos)
        parts = [build_header(self.version, meta, self.integrity), meta]
        for c in self.channels:
            parts += self._blocks(c)
        return pack(b"".join(parts), self.compression)


#: Bytes of a recording's blocks that stay in memory until it is whole.
SPOOL = 8 << 20


class Spooled:
    """A recording that grows: its blocks lie in a temporary file, so only what is added at
    once is in memory; header and metablock, which need all channels, come when it is written."""

    def __init__(self, writer: Writer):
        self.writer, self.body = writer, tempfile.SpooledTemporaryFile(SPOOL)
        self.runs: list[tuple[int, int, int]] = []  # channel, bytes, width of the length fields

    def flush(self) -> None:
        """Blocks of what the writer holds go to the file."""
        w = self.writer
        for c in w.channels:
            if w.data[c.index]:
                size = sum(self.body.write(b) for b in w._blocks(c))
                w.data[c.index] = []
                self.runs.append((c.index, size, c.size_of_length_value))

    def _widened(self, c: Channel, raw: bytes) -> Iterable[bytes]:
        """Blocks with length fields of 2 bytes, as the channel has them since: of 4."""
        at, end = 0, 4 if self.writer.integrity == "crc32c" else 0
        while at < len(raw):
            length = struct.unpack_from("<H", raw, at + 2)[0]
            yield self.writer._block(c, raw[at + 4], raw[at + 5 : at + 4 + length - end])
            at += 4 + length

    def write_to(self, out: BinaryIO) -> None:
        self.flush()
        w = self.writer
        if not w.channels:
            raise ValueError("a recording needs a channel")
        packed = gzip.GzipFile("", "wb", fileobj=out, mtime=0) if w.compression == "gzip" else None
        meta = build_metablock(w.version, w.info, w.channels, w.infos)
        to = packed or out
        to.write(build_header(w.version, meta, w.integrity) + meta)
        self.body.seek(0)
        for index, size, width in self.runs:
            c = w.channels[index]
            if width != c.size_of_length_value:
                for b in self._widened(c, self.body.read(size)):
                    to.write(b)
                continue
            while size:
                piece = self.body.read(min(size, 1 << 20))
                to.write(piece)
                size -= len(piece)
        if packed:
            packed.close()
        self.body.close()


def numeric_value(datatype: str) -> str:
    """The sample column that holds values of a datatype."""
    if datatype in ("float", "double"):
        return "v_double"
    if datatype == "uint64":
        return "v_ulong"
    if datatype == "bool":
        return "v_bool"
    if datatype in NUMERIC:
        return "v_long"
    return {"string": "v_string", "binary": "v_binary", "gpslocation": "v_gps"}[datatype]
