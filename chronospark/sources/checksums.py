"""CRC32C of byte strings: a table for short ones, parallel lanes for long ones."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_BYTE = _table()
_WIDE = np.array(_BYTE, np.uint32)
#: Strings below this size are summed byte by byte.
SHORT = 1024


def _plain(data: bytes, state: int) -> int:
    table = _BYTE
    for b in data:
        state = table[(state ^ b) & 255] ^ (state >> 8)
    return state


def _apply(columns: tuple[int, ...], state: int) -> int:
    out = 0
    for i, c in enumerate(columns):
        if state >> i & 1:
            out ^= c
    return out


@lru_cache(maxsize=64)
def _zeros(n: int) -> tuple[int, ...]:
    """What n zero bytes make of each bit of the state."""
    if n == 1:
        return tuple(_plain(b"\0", 1 << i) for i in range(32))
    half = _zeros(n // 2)
    out = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_zeros(1), c) for c in out) if n % 2 else out


@lru_cache(maxsize=64)
def _shift(n: int) -> np.ndarray:
    """What n zero bytes make of each value of each byte of the state."""
    columns = np.array(_zeros(n), np.uint32).reshape(4, 8)
    out = np.zeros((4, 256), np.uint32)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] ^ columns[:, i : i + 1]
    return out


def crc32c(data: bytes) -> int:
    """The checksum of the whole string.

    A long one is cut into lanes of 2 ** k bytes, about as many as a lane has bytes; the
    lanes' states are then joined in pairs, so that only powers of two are ever shifted by.
    """
    state, n = 0xFFFFFFFF, len(data)
    if n < SHORT:
        return _plain(data, state) ^ 0xFFFFFFFF
    each = 1 << max(5, n.bit_length() // 2 - 1)
    count = n // each
    lanes = np.frombuffer(data, np.uint8, each * count).reshape(count, each)
    states = np.zeros(1 << (count - 1).bit_length(), np.uint32)  # zeros in front change nothing
    own = states[len(states) - count :]
    own[0] = state
    for column in np.ascontiguousarray(lanes.T):
        own[:] = _WIDE[(own ^ column) & 255] ^ (own >> 8)
    width = each
    while len(states) > 1:
        left, table = states[0::2], _shift(width)
        states = table[0][left & 255] ^ table[1][(left >> 8) & 255] ^ table[2][(left >> 16) & 255] ^ table[3][left >> 24] ^ states[1::2]
        width *= 2
    return _plain(data[each * count :], int(states[0])) ^ 0xFFFFFFFF
