"""Bands of values, interpolation and axis maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band_index(v: Column, inner: Sequence[float]) -> Column:
    """How many inner bounds are at or below the value; the ends are open."""
    out = F.lit(len(inner))
    for i in range(len(inner) - 1, -1, -1):
        out = F.when(v < inner[i], F.lit(i)).otherwise(out)
    return F.when(v.isNotNull(), out)


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear interpolation, constant outside the ends."""
    inside = v0 + (v1 - v0) * ((t - t0) / (t1 - t0).cast("double"))
    return F.when(t0.isNull(), v1).when(t1.isNull() | (t1 == t0), v0).otherwise(inside)


def axis(v: Column, lo: float, hi: float, width: float) -> Column:
    """Position of a value on an axis of the given width; an empty range counts as 1."""
    return (v - lo) / (float(hi - lo) or 1.0) * width


def axis_value(x: Column, lo: float, hi: float, width: float) -> Column:
    return x / (width or 1.0) * (float(hi - lo) or 1.0) + lo
