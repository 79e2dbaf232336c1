"""Versioned tables on plain Parquet: versions are written, then one manifest names those of all tables. A table's version is a folder, or
one for each value of a column (a bucket), so that a batch writes anew only the parts that it touches.

Readers see a manifest or the next, never a mix, so changes to several tables are all or nothing. The manifest is written through
Spark's file system layer, so the folder can be in any store that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        at = self._path(f"{self.root}/_manifest")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> dict[str, str | dict[str, str]]:
        """Table to folder, or to its parts' folders by value, as of the latest manifest."""
        names = [n for n in self._manifests() if n.endswith(".json")]
        if not names:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return name in self.versions()

    def read(self, name: str, part: str | None = None) -> DataFrame:
        """A table, or one part of it."""
        at = self.versions()[name]
        folders = [at] if isinstance(at, str) else [f for v, f in sorted(at.items()) if part is None or v == part]
        if not folders:  # a part that isn't there
            return self.read(name).limit(0)
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/{f}" for f in folders))

    def read_or(self, name: str, empty: DataFrame, part: str | None = None) -> DataFrame:
        return self.read(name, part) if self.exists(name) else empty.limit(0)

    def parts(self, name: str) -> list[str]:
        at = self.versions().get(name, {})
        return [] if isinstance(at, str) else sorted(at)

    def commit(self, tables: dict[str, DataFrame | None], parts: dict[str, dict[str, DataFrame | None]] | None = None) -> None:
        """Write new versions of tables, and of parts of tables (None drops one), and publish them together."""
        now = self.versions()
        for name, df in tables.items():
            if df is None:
                now.pop(name, None)
            else:
                now[name] = self._write(name, df)
        for name, values in (parts or {}).items():
            own = dict(now.get(name, {}))
            for value, df in values.items():
                if df is None:
                    own.pop(value, None)
                else:
                    own[value] = self._write(name, df)
            now[name] = own
            if not own:
                now.pop(name)
        n = len(self._manifests())
        draft = self._path(f"{self.root}/_manifest/{n:08d}.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        finally:
            out.close()
        # a rename onto an existing name fails, so of two writers one wins
        if not self._fs.rename(draft, self._path(f"{self.root}/_manifest/{n:08d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer published first")

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def vacuum(self) -> list[str]:
        """Delete the folders that the latest manifest doesn't name; run it when no reader is at an older one and nothing is being written."""
        kept = {f for at in self.versions().values() for f in ([at] if isinstance(at, str) else at.values())}
        gone = []
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name.startswith("_") or not table.isDirectory():
                continue
            for v in self._fs.listStatus(table.getPath()):
                folder = f"{name}/{v.getPath().getName()}"
                if folder not in kept:
                    self._fs.delete(v.getPath(), True)
                    gone.append(folder)
        return gone

    def undeploy(self) -> None:
        """Drop all tables; refused while one has rows."""
        for name in self.versions():
            if not self.read(name).isEmpty():
                raise RuntimeError(f"{name} has rows")
        self._fs.delete(self._path(self.root), True)
