"""Row numbers, neighbours and running values in order, without one task per key.

A window over a whole channel puts it into a single task.  Here every key is cut into
buckets along its order (a column that never falls when the order goes on, such as a
day number); windows run inside the buckets, and what must pass from one bucket to the
next goes through a small table with one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nanoseconds of a bucket of times to begin with, and rows of a bucket of dense ids.
DAY_NS = 86_400_000_000_000
ID_BUCKET = 1 << 16
#: Rows that a bucket of times may hold of one key, and how often smaller ones are tried.
BUCKET_ROWS, BUCKET_TRIALS = 1 << 22, 6


def time_bucket(ts_ns: Column, size: int = DAY_NS) -> Column:
    return F.floor(ts_ns / F.lit(size)).cast("long")


def bucket_size(df: DataFrame, keys: Sequence[str], column: str = "ts_ns", size: int = DAY_NS, rows: int = BUCKET_ROWS) -> int:
    """Nanoseconds of a bucket such that the fullest one of any key holds about ``rows`` rows.

    Only the fullest bucket's count and extent go to the driver for each trial; a key whose
    times are dense in places needs several.  Rows with equal times cannot be told apart and stay together.
    """
    for _ in range(BUCKET_TRIALS):
        counts = df.groupBy(*keys, time_bucket(F.col(column), size).alias("__bucket")).agg(F.count("*").alias("n"), (F.max(column) - F.min(column) + 1).alias("span"))
        most = counts.agg(F.max(F.struct("n", "span")).alias("m")).first()["m"]
        if most is None or most["n"] <= rows or size <= 1:
            break
        size = max(1, min(size // 2, (most["span"] or 1) * rows // most["n"]))
    return size


def id_bucket(ord_: Column, size: int = ID_BUCKET) -> Column:
    return F.floor(ord_ / F.lit(size)).cast("long")


def _inside(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys, "__bucket").orderBy(*order)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, name: str = "idx") -> DataFrame:
    """The 0-based place of each row among those of its key."""
    rows = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    table = table.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = rows.withColumn("__at", F.row_number().over(_inside(keys, order)) - 1)
    return place.join(table, [*keys, "__bucket"]).withColumn(name, F.col("__before") + F.col("__at")).drop("__bucket", "__before", "__at")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, value: Column, name: str = "total") -> DataFrame:
    """The sum of a value over the rows of the key up to and with each row."""
    rows = df.withColumn("__bucket", bucket).withColumn("__x", value)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(*keys, "__bucket").agg(F.sum("__x").alias("__n"))
    table = table.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.sum("__x").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__at", inside).join(table, [*keys, "__bucket"])
    return out.withColumn(name, F.col("__before") + F.coalesce("__at", F.lit(0))).drop("__bucket", "__x", "__before", "__at")


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    """Columns of the following row of the same key: {new name: column}."""
    return _neighbour(df, keys, order, bucket, values, True)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    return _neighbour(df, keys, order, bucket, values, False)


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str], after: bool) -> DataFrame:
    rows = df.withColumn("__bucket", bucket).withColumn("__v", F.struct(*[F.col(c).alias(n) for n, c in values.items()]))
    place = F.struct(*order)
    edge = (F.min_by if after else F.max_by)("__v", place)
    table = rows.groupBy(*keys, "__bucket").agg(edge.alias("__edge"))
    over = Window.partitionBy(*keys).orderBy("__bucket")
    table = table.select(*keys, "__bucket", (F.lead if after else F.lag)("__edge").over(over).alias("__far"))
    near = (F.lead if after else F.lag)("__v").over(_inside(keys, order))
    out = rows.withColumn("__near", near).join(table, [*keys, "__bucket"]).withColumn("__v", F.coalesce("__near", "__far"))
    for n in values:
        out = out.withColumn(n, F.col(f"__v.{n}"))
    return out.drop("__bucket", "__v", "__near", "__far")


def with_nearest(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, back: str | None = "lo", forward: str | None = "hi") -> DataFrame:
    """The last non-null value at or before each row, and the first at or after it.

    What follows is looked for in descending order, as a frame that ends with the
    partition would be gone through anew for each of its rows.
    """
    rows = df.withColumn("__bucket", bucket).withColumn("__v", value)
    place = F.when(F.col("__v").isNotNull(), F.struct(*order))
    before = lambda *o: Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(*keys, "__bucket").agg(F.max_by("__v", place).alias("__last"), F.min_by("__v", place).alias("__first"))
    carried = [F.last("__last", True).over(before("__bucket")).alias("__from"), F.last("__first", True).over(before(F.desc("__bucket"))).alias("__to")]
    table = table.select(*keys, "__bucket", *carried)
    so_far = lambda o: F.last("__v", True).over(_inside(keys, o).rowsBetween(Window.unboundedPreceding, 0))
    if back:
        rows = rows.withColumn("__lo", so_far(order))
    if forward:
        rows = rows.withColumn("__hi", so_far([F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order]))
    out = rows.join(table, [*keys, "__bucket"]) if keys else rows.join(table, "__bucket")
    if back:
        out = out.withColumn(back, F.coalesce("__lo", "__from"))
    if forward:
        out = out.withColumn(forward, F.coalesce("__hi", "__to"))
    return out.drop("__bucket", "__v", "__from", "__to", "__lo", "__hi")
