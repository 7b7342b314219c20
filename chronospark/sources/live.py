"""A recording that grows while it is measured: every block is whole before the next begins.

For one process at the source of the data; Spark's own sink writes whole files.  What was
written can be read at any time, up to the last block, also after a loss of power.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence
from typing import Any, BinaryIO

import numpy as np

from .encode import Writer
from .frames import CONTINUED, DTYPES
from .wire import EXTENSIONS, build_header, build_metablock, pack


class LiveRecording:
    """Channels first, then ``start``, then samples, then ``close``.

    The target is a path, whose blocks are made durable one by one, or an open file.
    Text and bytes have length fields of four bytes, as longer ones may come later.
    """

    def __init__(self, target: str | BinaryIO, version: int = 5, integrity: str = "none", **info: Any):
        self.writer = Writer(version, integrity, None, **info)
        self.target, self.file, self.state = target, None, "new"
        self.open: set[int] = set()

    def _must(self, state: str) -> None:
        if self.state != state:
            raise ValueError(f"the recording is {self.state}, not {state}")

    def add_channel(self, name: str, datatype: str, **more: Any) -> int:
        self._must("new")
        if datatype in ("string", "binary"):
            more.setdefault("size_of_length_value", 4)
        return self.writer.add_channel(name, datatype, **more)

    def start(self) -> None:
        """Write header and metablock, which never change any more."""
        self._must("new")
        w = self.writer
        if not w.channels:
            raise ValueError("a recording needs a channel")
        meta = build_metablock(w.version, w.info, w.channels, w.infos)
        self.file = open(self.target, "xb") if isinstance(self.target, str) else self.target
        self.state = "started"
        self._put(build_header(w.version, meta, w.integrity) + meta)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.file.flush()
        if isinstance(self.target, str):
            os.fsync(self.file.fileno())

    def _drain(self, channel: int) -> None:
        for block in self.writer._blocks(self.writer.channels[channel]):
            self._put(block)
        self.writer.data[channel] = []

    def samples(self, channel: int, ts: Sequence[int], values: Sequence) -> None:
        """Samples with a time each, in any order of time."""
        self._must("started")
        self.writer.add_samples(channel, ts, values)
        self._drain(channel)

    def segment(self, channel: int, start_ns: int, rate_hz: float, values: Sequence) -> None:
        """A new segment of equidistant samples."""
        self._must("started")
        self.writer.add_segment(channel, start_ns, rate_hz, values)
        self.open.add(channel)
        self._drain(channel)

    def more(self, channel: int, values: Sequence) -> None:
        """Further samples of the channel's last segment."""
        self._must("started")
        if channel not in self.open:
            raise ValueError(f"channel {channel} has no segment to go on with")
        c = self.writer.channels[channel]
        v = np.asarray(values, DTYPES[c.datatype])
        step = max(1, self.writer._room(c) // v.dtype.itemsize)
        for i in range(0, len(v), step):
            piece = v[i : i + step]
            many = len(piece) > 1
            self._put(self.writer._block(c, CONTINUED | (0x80 if many else 0), (struct.pack("<I", len(piece)) if many else b"") + piece.tobytes()))

    def close(self, compression: str | None = None) -> str | None:
        """End the recording; a compressed copy replaces it only when that is durable."""
        self._must("started")
        self.state = "closed"
        if not isinstance(self.target, str):
            return None
        self.file.close()
        if not compression:
            return self.target
        made = self.target.removesuffix(EXTENSIONS[0]) + EXTENSIONS[1]
        with open(self.target, "rb") as f:
            data = pack(f.read(), compression)
        with open(made + ".part", "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(made + ".part", made)
        os.remove(self.target)
        return made

    def __enter__(self) -> LiveRecording:
        self.start()
        return self

    def __exit__(self, *_: object) -> None:
        if self.state == "started":
            self.close()
