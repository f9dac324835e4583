"""Versioned Parquet tables, published by markers that must not exist yet.

A version is a file ``versions/N`` that names the folders its rows are in; the largest number is the current version.
Data is written first, then the marker is put in its place whole by a rename that fails where there is one already: a
writer that dies before that leaves folders nobody reads, and of two writers of one version the second gets an error.
Nothing that is current is ever deleted or written over, and an append writes its own rows only.  The marker also
holds a digest of each folder's rows, which ``verify`` and ``restore`` take anew.

Names and renames go through Hadoop's file system, so any store that Spark reaches will do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import latest_wins, table_digest, upsert
from lodestone.storage import drop_path


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Damaged(RuntimeError):
    """A folder's rows aren't those that were written."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ---- versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        """The current version, or None of a new table."""
        return max(self.versions(), default=None)

    def _parts(self, version: int) -> list[dict]:
        """``folder, n_rows, digest`` of each folder of a version."""
        if version not in self.versions():
            raise ValueError(f"{self.root} has no version {version}")
        lines = self.spark.sparkContext._jvm.java.io.BufferedReader(self.spark.sparkContext._jvm.java.io.InputStreamReader(self._fs.open(self._path(f"{self.root}/versions/{version}"))))
        try:
            return json.loads(lines.readLine())["parts"]
        finally:
            lines.close()

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        if n is None:
            raise ValueError(f"nothing written to {self.root}")
        parts = [self.spark.read.parquet(f"{self.root}/{p['folder']}") for p in self._parts(n)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _stored(self, rows: DataFrame, *partition_by: str) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        return {"folder": folder, **self._sums(folder)}

    def _sums(self, folder: str) -> dict:
        written = self.spark.read.parquet(f"{self.root}/{folder}")
        return table_digest(written, written.columns).first().asDict()

    def _publish(self, version: int, parts: list[dict]) -> int:
        fresh, place = self._path(f"{self.root}/pending/{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{version}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        # A rename of FileContext, other than one of FileSystem, never replaces a file.
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(place), none)
        except Exception as e:
            self._fs.delete(fresh, False)
            if self._fs.exists(place):
                raise Conflict(f"version {version} of {self.root} is there already") from e
            raise
        return version

    # ---- writes

    def write(self, df: DataFrame, *partition_by: str, base: int | None = None) -> int:
        """A version of these rows alone.  ``base`` is the version that they were made from, the current one unless given: where
        another writer has gone on from it, this is a Conflict."""
        before = (self.version() or 0) if base is None else base
        return self._publish(before + 1, [self._stored(df, *partition_by)])

    def append(self, rows: DataFrame) -> int:
        before = self.version() or 0
        return self._publish(before + 1, [*(self._parts(before) if before else []), self._stored(rows)])

    def upsert(self, rows: DataFrame, keys: Sequence[str]) -> int:
        n = self.version()
        return self.write(rows if n is None else upsert(self.read(n), rows, keys), base=n or 0)

    def insert_absent(self, rows: DataFrame, keys: Sequence[str]) -> int:
        """Only the rows whose keys are new are written."""
        fresh = rows.dropDuplicates(list(keys))
        return self.append(fresh if self.version() is None else fresh.join(self.read().select(*keys), list(keys), "left_anti"))

    def replace(self, rows: DataFrame, keys: Sequence[str], order: str) -> int:
        """The latest row of each key, old and new."""
        n = self.version()
        both = rows if n is None else self.read(n).unionByName(rows)
        return self.write(latest_wins(both, keys, F.col(order).desc()), base=n or 0)

    def compact(self) -> int:
        """The current rows in one folder."""
        n = self.version()
        return self.write(self.read(n), base=n)

    # ---- checks

    def manifest(self, version: int | None = None) -> DataFrame:
        """``folder, n_rows, digest`` of a version, the current one unless given."""
        n = self.version() if version is None else version
        return self.spark.createDataFrame([(p["folder"], p["n_rows"], p["digest"]) for p in self._parts(n)], "folder string, n_rows long, digest string")

    def verify(self, version: int | None = None) -> None:
        """Raises Damaged unless each folder holds the rows that were written."""
        n = self.version() if version is None else version
        for p in self._parts(n):
            try:
                now = self._sums(p["folder"])
            except Exception as e:  # a file that is gone or can't be read, whatever Spark says of it
                raise Damaged(f"{p['folder']} of version {n} can't be read") from e
            if (now["n_rows"], now["digest"]) != (p["n_rows"], p["digest"]):
                raise Damaged(f"{p['folder']} of version {n} has {now['n_rows']} rows, not the {p['n_rows']} that were written")

    def restore(self, version: int) -> int:
        """Makes an older version current again, as a new one over the same folders, if they are whole."""
        self.verify(version)
        return self._publish((self.version() or 0) + 1, self._parts(version))

    def prune(self, keep: int = 1) -> None:
        """Forgets all but the last ``keep`` versions and deletes the folders that no version names.  No other writer may be at work."""
        gone = self.versions()[:-keep]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/versions/{n}"), False)
        named = {p["folder"] for n in self.versions() for p in self._parts(n)}
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in named:
                drop_path(self.spark, f"{self.root}/data/{s.getPath().getName()}")


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
