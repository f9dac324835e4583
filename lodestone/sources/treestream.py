"""A stream over a source tree: a batch holds the whole tree whenever it differs from the batch before.

The offset is a fingerprint of the tree (number of files and a sum of hashes of names, sizes and times of change, so its memory
doesn't grow with the tree).  A tree that is as it was gives no batch.  A batch that is run again after a crash reads the
tree as it's then; where that differs from the fingerprint, the next batch follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.treesource import SCHEMA, Branch, TreeReader


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, max_bytes: int):
        self.tree = TreeReader(root, max_bytes)

    def initialOffset(self) -> dict:
        return {"files": -1, "tree": ""}

    def latestOffset(self) -> dict:
        n = total = 0
        for name, _, size, at in self.tree.walk(""):
            digest = hashlib.blake2b(f"{name}\0{size}\0{at}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            n, total = n + 1, (total + int.from_bytes(digest, "big")) % (1 << 128)
        return {"files": n, "tree": f"{total:032x}"}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start == end else self.tree.partitions()

    def read(self, partition: Branch) -> Iterator[tuple]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeStream(DataSource):
    """``spark.readStream.format("sourcetreestream").option("maxBytes", n).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "sourcetreestream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeStreamReader(self.options["path"], int(self.options.get("maxBytes", 1_000_000)))
