"""Ledgers with commits: rows in buckets of their key, and manifests that name the files of
each version. A version is there once its manifest is, which only one writer can publish;
so two writers never both append, and a reader sees whole versions only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlab.operators.ledger import conflicts, insert

BUCKETS, SNAPSHOT_EVERY = 64, 16


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Ledger:
    """A ledger at a path of any file system that Spark has, with a schema and a key.

    ``rows/bucket=<n>/`` has the data, ``commits/<version>.json`` the manifests: the files
    that the version adds, and every SNAPSHOT_EVERY versions all files so far, so that a
    reader lists few manifests. Files that no manifest names, of writers that failed or
    lost, are never read."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], digest: str = "digest"):
        self.spark, self.path, self.key, self.digest = spark, path.rstrip("/"), key, digest
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        where = self._path(f"{self.path}/commits")
        if not self._fs.exists(where):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(where))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def files(self, version: int | None = None) -> tuple[int, list[tuple[int, str]]]:
        """The version (the latest, or the one asked for) and its files (bucket, path)."""
        versions = [v for v in self._versions() if version is None or v <= version]
        out: list[tuple[int, str]] = []
        for v in reversed(versions):
            m = json.loads(self._read(self._path(f"{self.path}/commits/{v:012}.json")))
            out += [(f["bucket"], f["path"]) for f in m["all" if "all" in m else "added"]]
            if "all" in m:
                break
        return (versions[-1] if versions else 0), out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int")

    def _rows(self, files: list[tuple[int, str]]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for _, p in files))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._rows(self.files(version)[1])

    def touched(self, new: DataFrame, files: list[tuple[int, str]]) -> DataFrame:
        """The stored rows in the buckets of the keys of ``new``: no other file is read."""
        wanted = {r.b for r in new.select(self.bucket().alias("b")).distinct().collect()}  # BUCKETS at most
        return self._rows([f for f in files if f[0] in wanted])

    def _write(self, rows: DataFrame) -> list[tuple[int, str]]:
        """Files of the rows, which no reader sees yet."""
        mine = f"rows/{uuid.uuid4().hex}"
        rows.select(*self.schema.names, self.bucket().alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{mine}")
        found, out = self._fs.listFiles(self._path(f"{self.path}/{mine}"), True), []
        while found.hasNext():
            p = found.next().getPath()
            if p.getName().endswith(".parquet") and p.getParent().getName().startswith("bucket="):
                bucket = p.getParent().getName()
                out.append((int(bucket.partition("=")[2]), f"{mine}/{bucket}/{p.getName()}"))
        return sorted(out)

    def _publish(self, version: int, manifest: dict) -> None:
        """Make the version's manifest, whole, unless there is one."""
        final, draft = self._path(f"{self.path}/commits/{version:012}.json"), self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a link is made or refused in one step; local renames replace what is there
                local = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(self._fs.makeQualified(final)), local(self._fs.makeQualified(draft)))
                taken = False
            else:
                taken = not self._fs.rename(draft, final)
        except Py4JJavaError as e:
            if not self._fs.exists(final):
                raise
            raise Conflict(f"version {version} is there") from e
        finally:
            self._fs.delete(draft, False)
        if taken:
            raise Conflict(f"version {version} is there")

    def append(self, new: DataFrame, tries: int = 10, check: Callable[[DataFrame], None] | None = None) -> tuple[int, int]:
        """(version, rows): add the rows whose key is not stored, as one version. A stored key
        with other content stops it. A writer that another one overtakes looks again at the
        buckets it touches, so that what both bring is stored once. ``check`` is called with
        all rows of the version that the new one follows, and stops the append by raising:
        what it finds still holds when the version is published, as no other came between."""
        new = new.select(*self.schema.names)
        for _ in range(tries):
            version, files = self.files()
            if check is not None:
                check(self._rows(files))
            rows = insert(new, self.touched(new, files), self.key, self.digest)
            added = self._write(rows)
            if not added:
                return version, 0
            n = self._rows(added).count()
            manifest = {"version": version + 1, "added": [{"bucket": b, "path": p} for b, p in added]}
            if (version + 1) % SNAPSHOT_EVERY == 0:
                manifest["all"] = [{"bucket": b, "path": p} for b, p in [*files, *added]]
            try:
                self._publish(version + 1, manifest)
            except Conflict:
                continue
            return version + 1, n
        raise Conflict(f"no version after {tries} tries")

    def conflicts(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` whose key is stored with other content."""
        return conflicts(new, self.touched(new, self.files()[1]), self.key, self.digest)
