"""Hashes on their way to be counted: cut to leading bits, dealt to slices, packed.

Sorted values of one slice lie close together, so their differences need few bytes: some
three for each value, where a row of a table would need thirty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._text import U


def packed(value: np.ndarray) -> bytes:
    """Sorted values: their low 16 bits, then the differences of what is above them as
    bytes, 255 of which says that one more number follows in the list at the end."""
    high = value >> U(16)
    step = np.diff(high, prepend=U(0))
    far = step >= U(255)
    count = np.array([len(value)], "<u8")
    return count.tobytes() + (value & U(0xFFFF)).astype("<u2").tobytes() + np.where(far, U(255), step).astype(np.uint8).tobytes() + step[far].astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    low = np.frombuffer(data, "<u2", n, 8).astype(U)
    step = np.frombuffer(data, np.uint8, n, 8 + 2 * n).astype(U)
    step[step == U(255)] = np.frombuffer(data, "<u8", offset=8 + 3 * n)
    return (np.cumsum(step) << U(16)) | low


def count_bits(df: DataFrame) -> int:
    """Leading bits by which shingles are counted: 40, and more for more than 8 GB."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(56, 40 + max(0, (size >> 33).bit_length()))


def sliced(value: np.ndarray, bits: int, own: int) -> tuple[np.ndarray, list[bytes]]:
    """The slices (the first ``own`` bits) that the values fall into, and what each gets:
    the rest of the leading ``bits`` bits of its values, packed."""
    value = np.sort(value) >> U(64 - bits)
    edge = np.searchsorted(value, np.arange((1 << own) + 1, dtype=U) << U(bits - own))
    inside = (U(1) << U(bits - own)) - U(1)
    live = np.flatnonzero(np.diff(edge))
    return live.astype(np.int64), [packed(value[edge[i] : edge[i + 1]] & inside) for i in live]


def slices_for(df: DataFrame) -> int:
    """A power of two of slices, some for each shuffle partition."""
    from ._store import partitions

    return 1 << max(4, (4 * partitions(df.sparkSession) - 1).bit_length())
