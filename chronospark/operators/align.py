"""Wide tables: channels side by side on equal times or on equal places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import id_bucket, numbered


def timeline(samples: DataFrame) -> DataFrame:
    """Distinct times over all channels."""
    return samples.select("ts_ns").distinct()


def align_wide(samples: DataFrame, channels: Sequence[str], on: str = "ts_ns", order: str = "ord", value: str = "v") -> DataFrame:
    """One row per time, a column per channel; of equal times the last one counts.

    The channels are given, so no job is needed to find them, and every task combines
    its own rows before the exchange.
    """
    return samples.groupBy(on).pivot("channel", list(channels)).agg(F.max_by(value, order))


def align_by_index(samples: DataFrame, channels: Sequence[str], order: str = "ord", value: str = "v", bucket: Column | None = None) -> DataFrame:
    """Row i holds the i-th sample of every channel; short channels end in nulls."""
    rows = numbered(samples.where(F.col("channel").isin(*channels)), ["channel"], [order], id_bucket(F.col(order)) if bucket is None else bucket, "i")
    return rows.groupBy("i").pivot("channel", list(channels)).agg(F.max(value))
