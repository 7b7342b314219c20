"""Nanosecond times: rendering in two dialects, parsing, durations.

A time is a long count of nanoseconds since 1970 in UTC.  Timestamps hold microseconds,
so they only serve for rendering and windows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def to_timestamp(ts_ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ts_ns, 1000))


def from_timestamp(ts: Column) -> Column:
    """Nanoseconds of a timestamp; one without a zone counts as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def _text(ts_ns: Column, pattern: str) -> Column:
    return F.date_format(to_timestamp(ts_ns), pattern)


def _nine(ts_ns: Column) -> Column:
    return F.lpad(F.pmod(ts_ns, F.lit(NS)).cast("string"), 9, "0")


def fmt_ts(ts_ns: Column, style: str = "datetime", dialect: str = "delphi") -> Column:
    """Styles datetime, seconds, iso8601 and nanoseconds, which differ by dialect."""
    style, both = style.lower(), (dialect.lower(), style.lower())
    if style == "nanoseconds":
        return ts_ns.cast("string")
    if both == ("delphi", "datetime"):
        return _text(ts_ns, "dd.MM.yyyy HH:mm:ss.SSS")
    if both == ("delphi", "seconds"):
        return _text(ts_ns, "dd.MM.yyyy HH:mm:ss")
    if both == ("delphi", "iso8601"):
        return F.concat(_text(ts_ns, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), _nine(ts_ns), F.lit("Z"))
    if both == ("java", "datetime"):
        return _text(ts_ns, "yyyy-MM-dd HH:mm:ss.SSS")
    if both == ("java", "seconds"):
        return F.concat(floor_div(ts_ns, NS).cast("string"), F.lit("."), _nine(ts_ns))
    if both == ("java", "iso8601"):
        return _text(ts_ns, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raise ValueError(f"unknown time style {style!r} of dialect {dialect!r}")


def parse_iso(text: Column) -> Column:
    """Nanoseconds of the first 19 characters; null if they are no date and time."""
    head = F.when(F.length(text) >= 19, F.translate(F.substring(text, 1, 19), "T", " "))
    return F.unix_micros(F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss"))) * 1000


def duration_hms(first: Column, last: Column) -> Column:
    """"1h 2m 3s" of a range; "-" where it is empty or inverted."""
    s = F.call_function("div", last - first, F.lit(NS))
    text = F.format_string("%dh %dm %ds", F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60)), s % 60)
    return F.when(last > first, text).otherwise(F.lit("-"))


def zoom(start: int, end: int, factor: float, about: float = 0.5) -> tuple[int, int]:
    """A range scaled about a share of itself; never empty."""
    span = end - start
    new = max(1, int(span * factor))
    begin = int(start + (span - new) * about)
    return begin, begin + new


def pan(start: int, end: int, share: float) -> tuple[int, int]:
    move = int((end - start) * share)
    return start + move, end + move
