"""What the two finders of spans share: records, digests and linear matchers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (kind, start, end, base): code points, end exclusive; base: found by the fixed rules.
Span = tuple[str, int, int, bool]

SPAN_TYPE = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def ordered(spans: Sequence[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
