"""A Python data source for source trees.

Spark's own file readers pass over names that start with ``_`` or ``.``, such as
``__init__.py``.  This one opens a folder through Arrow's file systems (local, HDFS, S3, ...).
The driver lists only the upper folders, until there are enough branches; tasks list
what is below and read the files.  Links aren't followed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, length long, content binary"
FILES_PER_TASK = 256
BRANCHES = 1024  # folders that the driver looks into at most


class Branch(InputPartition):
    """Files of upper folders by name, or a folder with all that is below."""

    def __init__(self, names: list[str], below: bool):
        self.names, self.below = names, below


class TreeReader(DataSourceReader):
    def __init__(self, root: str, max_bytes: int):
        self.root, self.max_bytes = root, max_bytes

    def _open(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        return where, path.rstrip("/")

    def _inside(self, folder: str) -> tuple[list[tuple], list[str]]:
        """Files ``(name, path, size, changed)`` and folders right in ``folder``; names are relative to the root."""
        from pyarrow import fs

        where, root = self._open()
        local = isinstance(where, fs.LocalFileSystem)
        files, folders = [], []
        for i in where.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/") or "/", recursive=False, allow_not_found=bool(folder))):
            name = f"{folder}/{i.base_name}" if folder else i.base_name
            if local and os.path.islink(i.path):
                continue
            if i.type == fs.FileType.File:
                files.append((name, i.path, i.size, i.mtime_ns))
            elif i.type == fs.FileType.Directory and i.base_name != ".git":
                folders.append(name)
        return sorted(files), sorted(folders)

    def walk(self, folder: str) -> Iterator[tuple]:
        """All files below, a folder's listing in memory at a time."""
        open_ = [folder]
        while open_:
            files, folders = self._inside(open_.pop())
            yield from files
            open_ += reversed(folders)

    def partitions(self) -> list[InputPartition]:
        names, folders, looked = [], [""], 0
        while folders and looked + len(folders) <= BRANCHES:
            deeper = []
            for folder in folders:
                files, inside = self._inside(folder)
                names += [f[0] for f in files]
                deeper += inside
            looked, folders = looked + len(folders), deeper
            if len(folders) >= 64:
                break
        upper = [Branch(names[a : a + FILES_PER_TASK], False) for a in range(0, len(names), FILES_PER_TASK)]
        return [*upper, *(Branch([f], True) for f in folders)] or [Branch([], False)]

    def read(self, partition: Branch) -> Iterator[tuple]:
        where, root = self._open()
        if partition.below:
            files = (f[:3] for folder in partition.names for f in self.walk(folder))
        else:
            files = ((i.path[len(root) + 1 :], i.path, i.size) for i in where.get_file_info([f"{root}/{n}" for n in partition.names]) if i.is_file)
        for name, path, size in files:
            content = None  # too large files have a row without content, so that callers can tell that they exist
            if size <= self.max_bytes:
                try:
                    with where.open_input_stream(path) as f:
                        content = f.read()
                except FileNotFoundError:  # gone since it was listed
                    continue
            yield name, size, content


class TreeSource(DataSource):
    """``spark.read.format("sourcetree").option("maxBytes", n).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("maxBytes", 1_000_000)))
