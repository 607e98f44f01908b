"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.staging import drop_staged, shared_dir, staged, staged_path

__all__ = ["BATCH", "by_id", "drop_staged", "free_heaps", "free_shuffles", "lean", "running_total", "shared_dir", "slices", "staged", "staged_path", "table", "text_batches"]


BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """A mapInArrow function that gives unused memory back when its task ends, Arrow's and,
    where the C library can, that of its heap: the worker process lives on and serves other
    operators."""

    def task(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver look for garbage: shuffle files of queries that are over stay on the
    executors' disks until it does."""
    spark._jvm.System.gc()


def free_heaps(spark: SparkSession) -> None:
    """Have the executors collect their garbage, a task for each core. A heap that a step has
    filled stays as large as it was, beside the Python workers of the next, until then."""
    spark.range(0, (n := spark.sparkContext.defaultParallelism), 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside, as each row has a whole text."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``; one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def running_total(df: DataFrame, order: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of a smaller ``order`` (unique
    integers from 0). Two levels, so that no task holds more than ``width`` rows, or one
    row for each ``width`` of them."""
    from pyspark.sql import Window

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__top", F.floor(F.col(order) / width))
    tops = df.groupBy("__top").agg(F.sum(value).alias("__sum"))
    tops = tops.select(
        "__top",
        F.coalesce(F.sum("__sum").over(before(Window.partitionBy(F.lit(0)).orderBy("__top"))), F.lit(0)).alias("__base"),
    )
    inner = F.coalesce(F.sum(value).over(before(Window.partitionBy("__top").orderBy(order))), F.lit(0))
    return df.withColumn("__in", inner).join(tops, "__top").withColumn(out, F.col("__in") + F.col("__base")).drop("__top", "__in", "__base")


def by_id(df: DataFrame, ids: DataFrame, column: str, how: str, most: int = 1_000_000) -> DataFrame:
    """Semi or anti join of wide rows with a staged table of ids. Up to ``most`` ids (a few
    tens of MB) travel to the rows; more of them meet the rows in a shuffle."""
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, column, how)
