"""Digests of files and of whole datasets, taken by the executors a piece at a time."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
PREFIX = 3  # hex digits of a path's hash that name its bucket: 4,096 buckets


def opened(path: str):
    """A stream of the file at a Spark path, by the file system that its scheme names."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest:
        scheme, rest = "file", path
    uri = f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest if rest.startswith('//') else '//' + rest}".replace("////", "//")
    filesystem, inner = fs.FileSystem.from_uri(uri if scheme != "file" else "file:///" + rest.lstrip("/").replace("%", "%25").replace(" ", "%20").replace("#", "%23").replace("?", "%3F"))
    return filesystem.open_input_stream(inner)


def _reachable(path: str) -> bool:
    try:
        opened(path).close()
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


def _digests(batches):
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            h = hashlib.sha256()
            with opened(path) as stream:
                while piece := stream.read(PIECE):
                    h.update(piece)
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(1)], names=["path", "sha256", "length"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of every file under a path, each read by one task, a MiB at a
    time, so that files of any size have a digest; empty files are left out. Files of a store that only Spark's own
    readers reach are read whole instead, up to the 2 GB that a row holds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = files.select("path").first()
    if first is None or _reachable(first.path):
        return files.select("path", "length").mapInArrow(_digests, "path string, sha256 string, length bigint")
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def below(digests: DataFrame, root: str) -> DataFrame:
    """The digests of files in the folder ``root``, with their paths below it, so that a copy
    elsewhere has the same ones; Spark's marks and other hidden files are left out."""
    spark = digests.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    inside = digests.filter(F.startswith(F.col("path"), F.lit(whole + "/"))).withColumn("path", F.substring("path", len(whole) + 2, 1 << 30))
    return inside.filter(~F.substring_index("path", "/", -1).rlike("^[_.]"))


def tree_digest(digests: DataFrame) -> str:
    """One digest of many files (path, sha256), by their names and contents: each of 4,096
    buckets of paths has that of its sorted entries, and the buckets' make the root. So no
    task has more than a bucket's entries, and no file's order or partition matters."""
    entry = F.concat_ws(":", "path", "sha256")
    bucket = F.substring(F.sha2("path", 256), 1, PREFIX)
    parts = digests.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list(entry)).alias("e")).select("bucket", F.sha2(F.array_join("e", "\n"), 256).alias("digest"))
    lines = sorted(f"{r.bucket}:{r.digest}" for r in parts.collect())  # 16^PREFIX at most
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def dataset_digest(spark: SparkSession, path: str) -> str:
    """The digest of a dataset: of a single file its own, of a folder that of its tree."""
    found = file_digests(spark, path)
    few = found.limit(2).collect()
    inside = below(found, path)
    if len(few) == 1 and not inside.limit(1).count():
        return few[0].sha256
    return tree_digest(inside if inside.limit(1).count() else found)
