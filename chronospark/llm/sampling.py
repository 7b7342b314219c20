"""Bounded samples for training: the rows with the smallest hashes, however dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, col: str, rows: int) -> DataFrame:
    """About ``rows`` rows with distinct values of ``col``; the same ones for the same input.

    Only hashes are ordered over all tasks; the rows themselves are then picked by the
    largest hash that is still in the sample, so no task gathers texts of the others.
    """
    hashed = df.where(F.col(col).isNotNull()).withColumn("__h", F.xxhash64(F.lit(97), F.col(col)))
    top = hashed.select("__h").orderBy("__h").limit(2 * rows).agg(F.max("__h")).first()[0]
    if top is None:
        return df.limit(0)
    return hashed.where(F.col("__h") <= top).dropDuplicates(["__h"]).orderBy("__h").limit(rows).drop("__h")
