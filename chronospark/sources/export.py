"""Exports: CSV in four layouts, HDF5 where its library is installed, Parquet, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_escape, decimal_sep, name_path, render_double
from ..functions.times import fmt_ts
from ..functions.types import NUMERIC, value_as_string
from ..operators.ordered import id_bucket, numbered

# Labels of the classic and the unified layout.
CLASSIC_ROWS = ("Name:", "Channel-Typ:", "Comment:", "Unit:", "Start-Timestamp:", "Last-Timestamp:")
CLASSIC_CELLS = {"label": "time", "unit": "s", "kind": "XY", "x": "X-Values", "y": "Y-Values"}
UNIFIED_HEAD = "Timestamp"
STYLE_LABELS = {"datetime": "DateTime", "seconds": "Seconds", "iso8601": "ISO8601", "nanoseconds": "Nanoseconds"}


def _lines(body: DataFrame, order: Sequence[str], head: list[str]) -> tuple[DataFrame, DataFrame]:
    """Header lines, and the body's column ``line``, each in order."""
    spark = body.sparkSession
    top = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "at long, line string")
    rows = body.select(F.struct(*order).alias("__o"), "line").orderBy("__o")
    return top.orderBy("at").select("line"), rows.select("line")


def write_lines(head: DataFrame, body: DataFrame, path: str, encoding: str = "UTF-8", line_sep: str = "\n") -> None:
    """An ordered folder of text parts: part 0 is the header, the others follow sorted.

    The parts can be joined in the order of their names; no task holds the whole export.
    """
    if encoding.upper() not in ("UTF-8", "UTF8"):  # the text sink writes the bytes of a string as they are
        raw = F.encode(F.regexp_replace("line", "[^\\x00-\\xFF]", "?"), encoding).cast("string").alias("line")
        head, body = head.select(raw), body.select(raw)
    options = {"lineSep": line_sep}
    body.write.mode("overwrite").options(**options).text(path.rstrip("/") + "/body")
    head.coalesce(1).write.mode("overwrite").options(**options).text(path.rstrip("/") + "/head")


def _cell(sep: str) -> Column:
    numeric = F.col("datatype").isin(*NUMERIC)
    return decimal_sep(value_as_string(), numeric, sep)


def classic(samples: DataFrame, channels: Sequence[dict], sep: str = ";", decimal: str = ",", style: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Samples side by side by their place: a time and a value column for each channel.

    ``channels`` gives name, unit and comment in the order of the columns.
    """
    names = [c["channel"] for c in channels]
    order = [c for c in ("block_ord", "sample_ord") if c in samples.columns] or ["ts_ns"]
    cells = samples.where(F.col("channel").isin(names)).select("channel", *order, "ts_ns", fmt_ts(F.col("ts_ns"), style).alias("x"), _cell(decimal).alias("y"))
    spans = {r["channel"]: r for r in cells.groupBy("channel").agg(F.min_by("x", F.struct(*order)).alias("a"), F.max_by("x", F.struct(*order)).alias("b")).collect()}  # a row per channel
    placed = numbered(cells, ["channel"], order, id_bucket(F.col(order[0])), "i")
    wide = placed.groupBy("i").pivot("channel", names).agg(F.max(F.struct("x", "y")))
    blank = F.lit("")
    line = F.concat_ws(sep, blank, *[x for n in names for x in (F.coalesce(F.col(f"`{n}`.x"), blank), F.coalesce(F.col(f"`{n}`.y"), blank))])
    c = CLASSIC_CELLS
    own = lambda f: "".join(sep + x + sep + y for x, y in map(f, channels))
    at = lambda n, k: spans[n][k] if n in spans else ""
    head = [
        CLASSIC_ROWS[0] + own(lambda x: (c["label"], x["channel"])), CLASSIC_ROWS[1] + own(lambda x: (c["kind"], "")), CLASSIC_ROWS[2] + own(lambda x: ("", x.get("comment") or "")),
        CLASSIC_ROWS[3] + own(lambda x: (c["unit"], x.get("physical_unit") or "")), CLASSIC_ROWS[4] + own(lambda x: (at(x["channel"], "a"), "")), CLASSIC_ROWS[5] + own(lambda x: (at(x["channel"], "b"), "")),
        "", own(lambda x: (c["x"], c["y"])),
    ]
    return _lines(wide.select("i", line.alias("line")), ["i"], head)


def unified(samples: DataFrame, channels: Sequence[dict], sep: str = ";", decimal: str = ",", style: str = "datetime", dialect: str = "delphi") -> tuple[DataFrame, DataFrame]:
    """One line per time with a cell for each channel; of equal times the last one counts."""
    names = [c["channel"] for c in channels]
    order = F.struct(*[c for c in ("file", "block_ord", "sample_ord", "ord") if c in samples.columns], F.lit(0).alias("z"))
    java = dialect == "java"
    cell = render_double(F.col("v")) if java else _cell(decimal)
    cells = samples.where(F.col("channel").isin(names)).select("channel", "ts_ns", order.alias("o"), cell.alias("c"))
    wide = cells.groupBy("ts_ns").pivot("channel", names).agg(F.max_by("c", "o"))
    line = F.concat_ws(sep, fmt_ts(F.col("ts_ns"), style, dialect), *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])
    if java:
        escaped = samples.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", csv_escape(F.col("n")).alias("n"))
        head = ["timestamp" + sep + sep.join(r["n"] for r in escaped.orderBy("i").collect())]  # a row per channel
    else:
        head = [sep.join([UNIFIED_HEAD, *names]), sep.join([STYLE_LABELS[style], *[c.get("physical_unit") or "" for c in channels]])]
    return _lines(wide.select("ts_ns", line.alias("line")), ["ts_ns"], head)


def per_channel(samples: DataFrame, style: str = "iso8601") -> DataFrame:
    """channel, ord and the line "timestamp,value" of each sample."""
    return samples.select("channel", "ts_ns", F.concat_ws(",", fmt_ts(F.col("ts_ns"), style, "java"), render_double(F.col("v"))).alias("line"))


def write_per_channel(samples: DataFrame, path: str, style: str = "iso8601") -> None:
    """A folder for each channel with its lines in order."""
    per_channel(samples, style).repartitionByRange("channel", "ts_ns").sortWithinPartitions("channel", "ts_ns").select("channel", "line").write.mode("overwrite").partitionBy("channel").text(path)


def to_parquet(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("channel").parquet(path)


def to_hdf5(samples: DataFrame, path: str, chunk: int = 8192, level: int = 4, shuffle: bool = True, sep: str = ".") -> DataFrame:
    """One file per channel with compound samples; gives channel, file and error.

    Needs the h5py library on the workers; where it is missing use ``to_parquet``.
    """
    import importlib.util

    if importlib.util.find_spec("h5py") is None:
        raise RuntimeError("h5py is not installed; to_parquet writes the same samples")
    grouped = samples.where(F.col("datatype") != "binary").withColumn("group", name_path(F.col("channel"), sep))

    def run(pdf):
        import h5py
        import pandas as pd

        name, error, target = pdf["channel"].iloc[0], None, None
        try:
            pdf = pdf.sort_values("ts_ns")
            target = f"{path}/{pdf['group'].iloc[0].strip('/').replace('/', '_')}.h5"
            with h5py.File(target, "w") as f:
                rows = pdf[["ts_ns", "v"]].rename(columns={"ts_ns": "timestamp_ns", "v": "value"}).to_records(index=False)
                f.create_dataset(pdf["group"].iloc[0], data=rows, chunks=(min(chunk, max(1, len(rows))),), compression="gzip", compression_opts=level, shuffle=shuffle)
        except Exception as e:  # one channel's failure leaves the others alone
            error = str(e)
        return pd.DataFrame({"channel": [name], "file": [target], "error": [error]})

    return grouped.select("channel", "group", "ts_ns", "v").groupBy("channel").applyInPandas(run, "channel string, file string, error string")


def to_json(report: DataFrame) -> DataFrame:
    """Any report as one JSON text per row."""
    return report.select(F.to_json(F.struct("*")).alias("value"))
