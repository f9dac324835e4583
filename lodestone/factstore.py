"""Facts of contents, kept by content: each (blob, language) is parsed once per version of the analyser.

Files of a frame are joined to the facts of their contents; only contents that have none are read, so a frame costs what
changed in it, and copies cost nothing.  The store grows by appends of new folders."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.exprs import content_digest
from lodestone.operators import extract
from lodestone.sources.versioned import VersionedTable
from lodestone.storage import checkpointed, release

ANALYZER = "2"
KEY = ["raw_hash", "language", "analyzer"]
_FACTS = (
    "raw_hash string, language string, analyzer string, structural_hash string, lines_of_code int, complexity double, summary string, symbols array<string>, "
    "imports array<struct<module: string, name: string, line: int>>, scripts array<string>"
)
PARTS_AT_MOST = 32


def keyed(tree: DataFrame, analyzer: str = ANALYZER) -> DataFrame:
    """``tree`` with the columns of KEY; languages follow from paths, "" where unknown."""
    return tree.withColumn("language", F.coalesce(extract.language("path"), F.lit(""))).withColumn("analyzer", F.lit(analyzer))


def unseen(contents: DataFrame, known: DataFrame | None, key: list[str]) -> DataFrame:
    """A row of each key of ``contents`` that ``known`` lacks."""
    fresh = contents if known is None else contents.join(known.select(*key).distinct(), key, "left_anti")
    return fresh.dropDuplicates(key)


def parsed(contents: DataFrame) -> DataFrame:
    """The facts of contents with KEY and ``text``."""
    lines = extract.line_facts(contents.withColumn("_lang", F.nullif(F.col("language"), F.lit(""))), lang="_lang")
    names = F.transform("symbols", lambda s: s["name"]).alias("symbols")
    python = extract.parse_python(contents.where(F.col("language") == "python"), "raw_hash").select("raw_hash", F.lit("python").alias("language"), "structural_hash", F.lit(None).cast("int").alias("own_lines"), F.col("complexity").cast("double").alias("own"), "summary", names, "imports", F.lit(None).cast("array<string>").alias("scripts"))
    read = python
    for name in extract.SCRIPTS:  # a content may come as several of them
        own = extract.parse_scripts(contents.where(F.col("language") == name), "raw_hash")
        read = read.unionByName(own.select("raw_hash", F.lit(name).alias("language"), "structural_hash", F.col("lines_of_code").alias("own_lines"), F.col("complexity").cast("double").alias("own"), F.lit(None).cast("string").alias("summary"), names, F.lit(None).cast(python.schema["imports"].dataType).alias("imports"), F.col("imports").alias("scripts")))
    out = lines.join(read, ["raw_hash", "language"], "left")
    return out.select(
        *KEY, F.coalesce("structural_hash", content_digest("text")).alias("structural_hash"), F.coalesce("own_lines", "lines_of_code").cast("int").alias("lines_of_code"), F.coalesce("own", (F.col("branches") + 1).cast("double")).alias("complexity"),
        "summary", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.coalesce("imports", F.array().cast(python.schema["imports"].dataType)).alias("imports"), F.coalesce("scripts", F.array().cast("array<string>")).alias("scripts"),
    )


class FactStore:
    """The facts in a folder, or of one session where none is given."""

    def __init__(self, spark: SparkSession, folder: str | None = None, analyzer: str = ANALYZER):
        self.spark, self.analyzer = spark, analyzer
        self.table = None if folder is None else VersionedTable(spark, folder)
        self._own: DataFrame | None = None

    def facts(self) -> DataFrame:
        if self.table is None:
            return self.spark.createDataFrame([], _FACTS) if self._own is None else self._own
        return self.spark.createDataFrame([], _FACTS) if self.table.version() is None else self.table.read()

    def learn(self, tree: DataFrame) -> int:
        """Parses the contents of ``tree (path, raw_hash, text)`` that have no facts yet.  How many those were."""
        contents = keyed(tree, self.analyzer).select(*KEY, "text")
        fresh = checkpointed(unseen(contents, self.facts(), KEY))
        n = fresh.count()
        if n and self.table is None:
            self._own = checkpointed(functools.reduce(DataFrame.unionByName, [x for x in (self._own, parsed(fresh)) if x is not None]))
        elif n:
            self.table.append(parsed(fresh))
            if self.table.manifest().count() > PARTS_AT_MOST:
                self.table.compact()
        release(fresh)
        return n

    def of(self, tree: DataFrame) -> DataFrame:
        """``path`` and the facts of its content, for each file; all contents must have been learnt."""
        return keyed(tree, self.analyzer).select("path", *KEY).join(self.facts(), KEY)
