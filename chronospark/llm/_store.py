"""Shared scratch tables: how the operators of this subpackage cut lineage.

Executors and the driver only share ``spark.checkpoint.dir``.  A table written there
survives the loss of any executor, so a lost task is recomputed from the table and
not from the beginning.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only in local mode, where there is but one machine, an unset one is made up.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    After a ``large`` step its shuffles are freed at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if large:
        free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice which shuffles no plan refers to any more.

    Their files go when the driver's memory is cleaned; without a nudge that may take
    half an hour, and every step of a job would keep its files until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; long texts then reach the workers a few MB at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function; its worker then returns unused memory to the machine.

    Workers are kept for later tasks, and what they have once used would stay taken from
    the executor's share.
    """

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
