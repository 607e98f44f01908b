"""Tables staged in the folder that driver and executors share, which cut lineage: a lost
executor costs no recomputation before them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
_sessions: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that has none gets a temporary
    one, once; on a cluster, where each machine would write to its own, that is an error."""
    base = spark.conf.get(SHARED, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {SHARED} to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barlab-')}"
        spark.conf.set(SHARED, base)
    return base


def _own_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/barlab/{spark.sparkContext.applicationId}"
    if path not in _sessions:
        _sessions.add(path)
        atexit.register(_drop_if_alive, spark, path)
    return path


def _drop_if_alive(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_staged(spark, path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path for a staged table."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, and its path. What is
    left when the session's process ends is removed then, or before by drop_all_staged.
    ``compression`` is Parquet's, by default the session's."""
    path = staged_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(schema).parquet(path), path


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_all_staged(spark: SparkSession) -> None:
    """Remove every table that this session has staged; frames that read them end with it."""
    drop_staged(spark, f"{shared_dir(spark)}/barlab/{spark.sparkContext.applicationId}")
