"""A bit set of 64-bit hashes with a fixed upper size, for dropping rows before a shuffle.

It never loses a member; above its capacity it only lets more non-members pass.  The
bits are dealt to slices by the top bits of the hash, so tasks build disjoint slices
and the driver puts at most 2 ** bits / 8 bytes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import giving_back
from ._text import U, mix

SLICES_LOG = 8


def size_for(members: int, most: int) -> int:
    """log2 of the bits: at least 24 for each member, within 18 and ``most``."""
    return int(min(most, max(18, (max(1, members) * 24 - 1).bit_length())))


def _probes(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Position of the k-th probe of each hash inside its slice."""
    return (mix(h ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> U(64 - (bits - SLICES_LOG))).astype(np.int64)


class BitFilter:
    PROBES = 4

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits = bits
        each = 1 << (bits - SLICES_LOG - 3)
        data = bytearray(each << SLICES_LOG)
        for s, raw in slices.items():
            data[s * each : (s + 1) * each] = raw
        self.data = bytes(data)

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], U))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be members."""
        data, width = np.frombuffer(self.data, np.uint8), self.bits - SLICES_LOG
        out = np.zeros(len(h), bool)
        live, own = np.arange(len(h)), h
        for k in range(self.PROBES):
            at = ((own >> U(64 - SLICES_LOG)).astype(np.int64) << width) + _probes(own, self.bits, k)
            good = (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, own = live[good], own[good]
        out[live] = True
        return out


def build(hashes: DataFrame, bits: int, flags: tuple[str, ...] = ()) -> list[BitFilter]:
    """A filter of all values of the column h, then one for each flag column's true rows."""
    spark = hashes.sparkSession
    names = ["all", *flags]
    rows = hashes.select("h", *flags).withColumn("slice", F.shiftrightunsigned("h", 64 - SLICES_LOG).cast("int"))
    n = min(1 << SLICES_LOG, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "slice").sortWithinPartitions("slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits - SLICES_LOG
        current, sets = None, []

        def done() -> pa.RecordBatch:
            packed = [np.packbits(s, bitorder="little").tobytes() for s in sets]
            return pa.RecordBatch.from_arrays([pa.array([current] * len(sets), pa.int32()), pa.array(list(range(len(sets))), pa.int32()), pa.array(packed, pa.binary())], ["slice", "flag", "data"])

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            piece = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            marks = [np.ones(len(h), bool)] + [batch.column(1 + i).to_numpy(zero_copy_only=False).astype(bool) for i in range(len(flags))]
            for s in np.unique(piece):
                if s != current:
                    if current is not None:
                        yield done()
                    current, sets = int(s), [np.zeros(1 << width, bool) for _ in names]
                for bitset, mark in zip(sets, marks):
                    own = h[(piece == s) & mark]
                    for k in range(BitFilter.PROBES):
                        bitset[_probes(own, bits, k)] = True
        if current is not None:
            yield done()

    found: list[dict[int, bytes]] = [{} for _ in names]
    for r in rows.mapInArrow(giving_back(run), "slice int, flag int, data binary").toLocalIterator():
        found[r["flag"]][r["slice"]] = bytes(r["data"])
    return [BitFilter(bits, f) for f in found]
