"""Vectorised words and hashes of whole Arrow string columns.

All positions are bytes of UTF-8.  The separators of words are ASCII, so words can be
found without decoding.  Hashes have 64 bits and are trees of mixing steps that are not
linear in any ring, so no family of texts collides by construction; they are the same on
every machine and in every run.  Two lanes give two independent hashes: where equal
hashes stand for equal texts over a whole corpus, both are used (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Odd multipliers and a start value for each of two independent hashes ("lanes").
_LANES = tuple((int(mix(np.array([k], U))[0]) | 1, int(mix(np.array([k + 1], U))[0]) | 1, int(mix(np.array([k + 2], U))[0])) for k in (11, 23))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the ordered pairs (a, b); for either value a bijection of the other one."""
    one, two, _ = _LANES[lane]
    x = a * U(one)
    x ^= x >> U(29)
    x += b
    x *= U(two)
    x ^= x >> U(32)
    return x


def run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of values[first:end] for each run: a binary tree over it, then its length.

    Neighbours are joined until one value is left, so nothing adds up as it would in a
    polynomial, and a run of any length takes a few steps for all runs at once.
    """
    size = (end - first).astype(np.int64)
    out = np.zeros(len(size), U)
    live = np.flatnonzero(size > 0)
    n = size[live]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = values[np.repeat(first[live], n) + at]
    while len(live):
        begin = np.cumsum(n) - n
        single = n == 1
        out[live[single]] = h[begin[single]]
        if single.all():
            break
        if single.any():
            h, at = h[np.repeat(~single, n)], at[np.repeat(~single, n)]
            live, n = live[~single], n[~single]
            begin = np.cumsum(n) - n
        left = np.flatnonzero(at % 2 == 0)
        paired = at[left] + 1 < np.repeat(n, (n + 1) // 2)
        up = h[left]
        up[paired] = joined(up[paired], h[left[paired] + 1], lane)
        h, at, n = up, at[left] // 2, (n + 1) // 2
    return mix(out + size.astype(U) * U(_LANES[lane][2] | 1))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the bytes data[start:end] for each span, eight bytes at a time."""
    size = (end - start).astype(np.int64)
    padded = np.append(data, np.zeros(8, np.uint8))
    octets = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    masks = U(_MASK) >> np.arange(64, -1, -8).astype(U)
    masks[0] = 0
    salt = U(_LANES[lane][2])
    out = mix((octets[start] & masks[np.minimum(size, 8)]) ^ salt)
    if len(long := np.flatnonzero(size > 8)):
        own = size[long]
        pieces = (own + 7) // 8
        last = np.cumsum(pieces)
        at = (np.arange(int(last[-1])) - np.repeat(last - pieces, pieces)) * 8
        value = octets[np.repeat(start[long], pieces) + at] & masks[np.minimum(np.repeat(own, pieces) - at, 8)]
        out[long] = run_hashes(mix(value ^ salt), last - pieces, last, lane)
    out += size.astype(U) * U(_LANES[lane][0])
    return mix(out)


def window_hashes(words: np.ndarray, begin: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hashes of words[b : b + size] for each b: windows of 1, 2, 4 ... words, joined by the bits of ``size``."""
    if not len(begin):
        return np.zeros(0, U)
    level, width, offset, out = words, 1, 0, None
    while True:
        if size & width:
            own = level[begin + offset]
            out = own if out is None else joined(out, own, lane)
            offset += width
        if 2 * width > size:
            return mix(out + U(size))
        level, width = joined(level[:-width], level[width:], lane), 2 * width


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may have any extent
        valid = np.asarray(column.is_valid())
        size = np.where(valid, np.diff(off), 0)
        if (size != np.diff(off)).any():
            return column_bytes(column.fill_null(""))
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = (1 << 19) - 2) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row if it is longer."""
    index = batch.schema.get_field_index(text)
    size = np.diff(column_bytes(batch.column(index))[1])
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        floor = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, floor + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: bytes start to end, and row ``doc``.

    ``first[d]`` to ``first[d + 1]`` are the words of row d.
    """

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = column_bytes(column)
        n = len(self.buf)
        word = ~_SEP[self.buf]
        begin = word.copy()
        edges = self.offsets[1:-1]
        edges = edges[edges < n]
        begin[1:] &= ~word[:-1]
        begin[edges] = word[edges]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = edges[edges > 0] - 1
        last[inner] = word[inner]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False, lane: int = 0) -> np.ndarray:
        return span_hashes(_LOWER[self.buf] if lower else self.buf, self.start, self.end, lane)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which ``size`` words of one row begin."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return np.flatnonzero(room >= size)
