"""Source trees, change logs, coverage reports and policies as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.exprs import included, normalised_path
from lodestone.sources.gitsource import GitSource
from lodestone.sources.treesource import TreeSource
from lodestone.sources.treestream import TreeStream


def tree(spark: SparkSession, root: str, include: Sequence[str] = (), ignore: Sequence[str] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """``path, size, raw_hash, text`` of analysable files below a folder.

    Too large and binary files (a NUL in the first 8192 bytes) and those the policy keeps out are left out."""
    spark.dataSource.register(TreeSource)
    return analysable(spark.read.format("sourcetree").option("maxBytes", max_bytes).load(root), include, ignore)


def tree_stream(spark: SparkSession, root: str, max_bytes: int = 1_000_000) -> DataFrame:
    """``path, length, content`` as a stream: the whole tree whenever it changed.  ``analysable`` makes of a batch what ``tree`` gives."""
    spark.dataSource.register(TreeStream)
    return spark.readStream.format("sourcetreestream").option("maxBytes", max_bytes).load(root)


def git_tree(spark: SparkSession, root: str, revision: str = "", include: Sequence[str] = (), ignore: Sequence[str] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """As ``tree``: the files of a revision of a git repository, or of its working tree as git lists it."""
    spark.dataSource.register(GitSource)
    return analysable(spark.read.format("gittree").option("revision", revision).option("maxBytes", max_bytes).load(root), include, ignore)


def analysable(found: DataFrame, include: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    named = found.where(F.col("content").isNotNull() & included("path", include, ignore)).select("path", F.col("length").alias("size"), "content")
    binary = F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))
    return named.where(~binary).select("path", "size", F.sha2("content", 256).alias("raw_hash"), F.call_function("decode", "content", F.lit("UTF-8")).alias("text"))


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """``sha, at, author, subject, path, additions, deletions`` of a log whose records start with 0x1E, whose
    header fields are split by 0x1F, and whose other lines are ``additions TAB deletions TAB path`` (``-``: binary)."""
    record = spark.read.option("lineSep", "\x1e").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.trim("value"), "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x1f")
    one = record.select(F.get(head, F.lit(0)).alias("sha"), F.try_to_timestamp(F.get(head, F.lit(1))).alias("at"), F.get(head, F.lit(2)).alias("author"), F.get(head, F.lit(3)).alias("subject"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    cell = F.split("line", "\t")
    return one.where(F.size(cell) == 3).select("sha", "at", "author", "subject", normalised_path(F.get(cell, F.lit(2))).alias("path"), F.get(cell, F.lit(0)).try_cast("long").alias("additions"), F.get(cell, F.lit(1)).try_cast("long").alias("deletions"))


def tree_changes(spark: SparkSession, path: str) -> DataFrame:
    """``kind, similarity, old_path, path`` of a name-status listing: one path for A, M, D and T, two for R and C."""
    cell = F.split("value", "\t")
    kind = F.substring(F.get(cell, F.lit(0)), 1, 1)
    two = kind.isin("R", "C")
    return spark.read.text(path).where(F.length("value") > 0).select(
        kind.alias("kind"), F.substring(F.get(cell, F.lit(0)), 2, 3).try_cast("int").alias("similarity"),
        F.when(two | kind.isin("D", "M", "T"), F.get(cell, F.lit(1))).alias("old_path"), F.when(two, F.get(cell, F.lit(2))).when(kind != "D", F.get(cell, F.lit(1))).alias("path"),
    )


def refs(spark: SparkSession, path: str) -> DataFrame:
    """``kind, name, sha`` of a listing of ``sha refs/tags/name`` and ``sha refs/heads/name`` lines."""
    found = lambda i: F.regexp_extract("value", r"^(\w+)\s+refs/(tags|heads)/(.+)$", i)
    return spark.read.text(path).select(F.when(found(2) == "tags", "tag").otherwise("branch").alias("kind"), found(3).alias("name"), found(1).alias("sha")).where("name <> ''")


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_rate, branch_rate, total_lines, covered_lines`` per class of a Cobertura report.  Classes with a rate that
    isn't a number are left out; a line whose hits aren't one isn't covered."""
    schema = "_filename string, `_line-rate` string, `_branch-rate` string, lines struct<line: array<struct<_number: string, _hits: string>>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    lines = F.coalesce("lines.line", F.array().cast("array<struct<_number: string, _hits: string>>"))
    rate = lambda c: F.trim(F.col(f"`{c}`")).try_cast("double")
    bad = lambda c: F.col(f"`{c}`").isNotNull() & rate(c).isNull()
    return rows.where(~bad("_line-rate") & ~bad("_branch-rate")).select(
        normalised_path("_filename").alias("path"), rate("_line-rate").alias("line_rate"), rate("_branch-rate").alias("branch_rate"), F.size(lines).alias("total_lines"), F.size(F.filter(lines, lambda x: F.trim(x["_hits"]).try_cast("long") > 0)).alias("covered_lines"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_rate, branch_rate, total_lines, covered_lines`` per record of an LCOV report."""
    record = spark.read.option("lineSep", "end_of_record").text(path)
    own = lambda key: F.regexp_extract("value", rf"(?m)^{key}:(.*)$", 1)
    n = lambda key: own(key).try_cast("int")
    rows = record.select(normalised_path(F.trim(own("SF"))).alias("path"), n("LF").alias("total_lines"), n("LH").alias("covered_lines"), n("BRF").alias("_b"), n("BRH").alias("_h"))
    return rows.where("path <> ''").select("path", (F.col("covered_lines") / F.nullif("total_lines", F.lit(0))).alias("line_rate"), (F.col("_h") / F.nullif("_b", F.lit(0))).alias("branch_rate"), "total_lines", "covered_lines")


def policy(text: str) -> dict:
    """A YAML policy: groups (name, patterns, parent), rules, aliases, include and ignore patterns.  Names must differ."""
    data = yaml.safe_load(text) or {}
    for part, key in (("groups", "name"), ("rules", "id")):
        names = [g[key] for g in data.get(part, [])]
        if len(names) != len(set(names)):
            raise ValueError(f"{part}: {key} given twice")
    return {"groups": [], "rules": [], "aliases": {}, "include": [], "ignore": []} | data


def policy_groups(spark: SparkSession, loaded: dict) -> DataFrame:
    rows = [(n, g["name"], g.get("parent"), list(g.get("paths", []))) for n, g in enumerate(loaded["groups"])]
    return spark.createDataFrame(rows, "place int, name string, parent string, patterns array<string>")


def registry(text: str) -> list[dict]:
    """Repositories ``(name, path)`` of a YAML registry; names and paths must differ."""
    rows = (yaml.safe_load(text) or {}).get("repositories", [])
    for key in ("name", "path"):
        values = [r[key] for r in rows]
        if len(values) != len(set(values)):
            raise ValueError(f"{key} given twice")
    return rows
