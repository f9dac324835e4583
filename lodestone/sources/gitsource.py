"""A Python data source for the files of a git repository that every executor can reach.

A revision's tree is listed once by the driver; tasks read a bounded number of blobs each, through one ``git cat-file``
process.  Without a revision it is the working tree as git sees it: tracked files and those it doesn't ignore.
Links and submodules are left out."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.treesource import FILES_PER_TASK, SCHEMA


def _git(root: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {arguments[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def commit_of(root: str, revision: str) -> str:
    """The commit that a name stands for; an error where there is none."""
    return _git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().split()[-1]


def commits(root: str, revision: str = "HEAD") -> list[str]:
    """The commits that lead to a revision along first parents, oldest first."""
    return _git(root, "rev-list", "--reverse", "--first-parent", commit_of(root, revision)).decode().split()


class Blobs(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class GitReader(DataSourceReader):
    def __init__(self, root: str, revision: str, max_bytes: int):
        self.root, self.max_bytes = root, max_bytes
        self.commit = commit_of(root, revision) if revision else ""

    def partitions(self) -> list[InputPartition]:
        if self.commit:
            found = []
            for entry in _git(self.root, "ls-tree", "-r", "-z", "-l", self.commit).split(b"\0"):
                if entry:
                    about, path = entry.split(b"\t", 1)
                    mode, _, blob, size = about.decode().split()
                    if mode.startswith("100"):
                        found.append((path.decode(errors="replace"), blob, int(size)))
        else:
            names = [os.fsdecode(n) for n in _git(self.root, "ls-files", "--cached", "--others", "--exclude-standard", "-z").split(b"\0") if n]
            at = lambda n: os.path.join(self.root, n)
            found = [(n, "", os.path.getsize(at(n))) for n in sorted(set(names)) if os.path.isfile(at(n)) and not os.path.islink(at(n))]
        return [Blobs(found[a : a + FILES_PER_TASK]) for a in range(0, len(found), FILES_PER_TASK)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        if not self.commit:
            for name, _, size in partition.files:
                content = None
                if size <= self.max_bytes:
                    with open(os.path.join(self.root, name), "rb") as f:
                        content = f.read()
                yield name, size, content
            return
        command = ["git", "-c", "safe.directory=*", "-C", self.root, "cat-file", "--batch"]
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for name, blob, size in partition.files:
                content = None
                if size <= self.max_bytes:
                    git.stdin.write(f"{blob}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if len(head) != 3:
                        raise ValueError(f"no blob {blob}")
                    content = git.stdout.read(int(head[2]))
                    git.stdout.read(1)  # its line end
                yield name, size, content
            git.stdin.close()


class GitSource(DataSource):
    """``spark.read.format("gittree").option("revision", name).option("maxBytes", n).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GitReader(self.options["path"], self.options.get("revision", ""), int(self.options.get("maxBytes", 1_000_000)))
