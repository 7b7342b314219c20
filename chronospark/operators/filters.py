"""Choosing channels, samples and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_pattern
from ..functions.types import NUMERIC, numeric


def by_name(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("channel") == name)


def by_index(df: DataFrame, index: int) -> DataFrame:
    return df.where(F.col("channel_index") == index)


def by_datatype(df: DataFrame, *datatypes: str) -> DataFrame:
    return df.where(F.col("datatype").isin(*datatypes))


def by_names(df: DataFrame, names: Sequence[str] | None, known: Sequence[str] | None = None) -> DataFrame:
    """Names without regard to case; no list means all.

    With the ``known`` spellings (names of definitions) the filter is one on the stored
    column, which reaches the scan.
    """
    if not names:
        return df
    wanted = {n.lower() for n in names}
    if known is not None:
        return df.where(F.col("channel").isin([k for k in known if k.lower() in wanted]))
    return df.where(F.lower("channel").isin(sorted(wanted)))


def by_mask(df: DataFrame, mask: str, column: str = "channel", known: Sequence[str] | None = None) -> DataFrame:
    if known is not None:
        import re

        return df.where(F.col(column).isin([k for k in known if re.search(mask_pattern(mask), k.lower())]))
    return df.where(F.lower(column).rlike(mask_pattern(mask)))


def numeric_only(df: DataFrame, datatype: str = "datatype") -> DataFrame:
    return df.where(F.col(datatype).isin(*NUMERIC))


def resolve(channels: DataFrame, selectors: Sequence[str]) -> tuple[list[str], list[str]]:
    """Channel names in the order asked for, and the selectors that name none.

    A selector is an index if it is a number, else an exact name.  Channels are
    definitions, not samples: at most 65,535 in a file.
    """
    rows = channels.select("channel_index", "channel").distinct().orderBy("channel_index").collect()
    index, names = {r[0]: r[1] for r in rows}, {r[1] for r in rows}
    out, unknown = [], []
    for s in selectors:
        name = index.get(int(s)) if s.lstrip("-").isdigit() else None
        name = name or (s if s in names else None)
        if name is None:
            unknown.append(s)
        else:
            out.append(name)
    return out, unknown


def interval(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None, column: str = "ts_ns") -> DataFrame:
    """Both ends belong to it; a missing bound, or one at or below 0, is none."""
    if start_ns is not None and start_ns > 0:
        df = df.where(F.col(column) >= start_ns)
    if end_ns is not None and end_ns > 0:
        df = df.where(F.col(column) <= end_ns)
    return df


def overlaps(start_ns: int, end_ns: int, first: str = "first_ts", last: str = "last_ts") -> Column:
    """Of a file's range; a null range is empty."""
    return F.coalesce((F.col(last) >= start_ns) & (F.col(first) <= end_ns), F.lit(False))


def non_empty(channels: DataFrame, samples: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    return channels.join(samples.select(*keys).distinct(), list(keys), "left_semi")


#: Columns of a sample that hold each kind of value.
TYPED = {"doubles": "v_double", "longs": "v_long", "ulongs": "v_ulong", "booleans": "v_bool", "strings": "v_string", "binaries": "v_binary", "gps": "v_gps"}


def typed(samples: DataFrame, kind: str) -> DataFrame:
    """channel, ts_ns and v as the kind asked for; a sample of another type fails the job.

    "doubles" takes every numeric type, as statistics do.
    """
    if kind not in TYPED:
        raise ValueError(f"kind is one of {', '.join(TYPED)}, not {kind!r}")
    value = numeric() if kind == "doubles" else F.col(TYPED[kind])
    checked = F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"no {kind} in channel "), F.col("channel"))).cast(samples.schema[TYPED[kind]].dataType))
    return samples.select("channel", "ts_ns", F.coalesce(value, checked).alias("v"))


def positions(samples: DataFrame) -> DataFrame:
    """channel, ts_ns, latitude, longitude and altitude of positions."""
    return samples.where(F.col("datatype") == "gpslocation").select("channel", "ts_ns", "v_gps.*")


def head(df: DataFrame, n: int, keys: Sequence[str] = ("channel",), order: Sequence[str] = ("ord",)) -> DataFrame:
    """The first n rows of each key: an aggregate, so no key is gathered in one task."""
    others = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, F.struct(*order, *[c for c in others if c not in order]).alias("__r"))
    # Per task first, then over all: at most n rows of each key and task travel.
    task = F.spark_partition_id()
    first = rows.withColumn("__t", task)
    near = first.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__t").orderBy("__r"))).where(F.col("__k") <= n)
    top = near.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__r"))).where(F.col("__k") <= n)
    return top.select(*keys, "__r.*").select(*df.columns)
