"""Versions of tables in a folder, published as a whole.

A publication writes every table to a new version folder and then replaces one
small manifest, so a reader sees the old version or the new one, never a
mixture, and a failed write leaves the old one in place.  Writers exclude each
other by a lock file (`locked`), held from reading what a change begins with to
publishing it.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_class = spark._jvm.org.apache.hadoop.fs
        self._held = False

    def _path(self, *parts: str):
        return self._fs_class.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{"version": name, "tables": {name: partition columns}} of the current version, or an empty one."""
        p = self._path("CURRENT")
        if not self._fs().exists(p):
            return {"version": None, "tables": {}, "more": {}}
        rows = self.spark.read.text(p.toString()).collect()  # one small line
        return json.loads(rows[0][0])

    @contextmanager
    def locked(self, timeout: float = 600.0, stale: float = 24 * 3600.0):
        """Holds the folder's lock; waits for another writer, at most `timeout` seconds.  A lock older than `stale` seconds
        belongs to a writer that has died, and is taken."""
        if self._held:
            yield self
            return
        fs, lock, began = self._fs(), self._path("LOCK"), time.monotonic()
        fs.mkdirs(self._path())
        while not self._take(fs, lock):
            if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
                fs.delete(lock, False)
            elif time.monotonic() - began > timeout:
                raise TimeoutError(f"{self.folder} is locked by another writer")
            else:
                time.sleep(0.1)
        self._held = True
        try:
            yield self
        finally:
            self._held = False
            fs.delete(lock, False)

    @staticmethod
    def _take(fs, lock) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            fs.create(lock, False).close()
        except Py4JJavaError:  # there is one
            return False
        return True

    def exists(self, *tables: str) -> bool:
        have = self.manifest()["tables"]
        return bool(have) and all(t in have for t in tables)

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, more: dict | None = None, keep: int = 2) -> str:
        """Writes the tables as a new version and makes it the current one; older versions beyond `keep` are removed."""
        if not tables:
            raise ValueError("nothing to publish")
        with self.locked():
            return self._publish(tables, partition_by or {}, more or {}, keep)

    def _publish(self, tables: dict[str, DataFrame], by: dict[str, list[str]], more: dict, keep: int) -> str:
        version = f"v-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                w = df.write.mode("error")
                (w.partitionBy(*by[name]) if name in by else w).parquet(self._path(version, name).toString())
        except Exception:
            self._fs().delete(self._path(version), True)
            raise
        before = self.manifest()
        self._replace({"version": version, "tables": {n: by.get(n, []) for n in tables}, "more": more, "older": [v for v in [before["version"], *before.get("older", [])] if v][:keep - 1]})
        for old in ([before["version"], *before.get("older", [])] if before["version"] else [])[keep - 1:]:
            self._fs().delete(self._path(old), True)
        return version

    def _replace(self, manifest: dict) -> None:
        fs, new, now = self._fs(), self._path(f".CURRENT-{uuid.uuid4().hex}"), self._path("CURRENT")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._fs_class.FileContext.getFileContext(now.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = option
        context.rename(new, now, array)

    def read(self, table: str) -> DataFrame:
        """A table of the version that is current now; the result stays with that version."""
        m = self.manifest()
        if table not in m["tables"]:
            raise FileNotFoundError(f"{self.folder} has no table {table}")
        return self.spark.read.parquet(self._path(m["version"], table).toString())

    def clear(self) -> None:
        with self.locked():
            fs = self._fs()
            for f in fs.listStatus(self._path()):
                if f.getPath().getName() != "LOCK":
                    fs.delete(f.getPath(), True)
