"""Whole states of some snapshots, kept beside sparse deltas.

Each generation of states is one folder, cut by snapshot; an index names the live ones with their digests.  When a snapshot is
rewritten, the states of all its descendants are dropped with it, and can be built again from the nearest state that is left; the
index keeps the digest of what was dropped, so a rebuilt state shows whether anything changed."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import lineage
from lodestone.sources.versioned import VersionedTable
from lodestone.storage import checkpointed, drop_path, path_exists

INDEX = "snapshot long, generation string, n_rows long, digest string, live boolean"


def snapshot_digests(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``snapshot, n_rows, digest``: of the number and the sums of row hashes of each snapshot's rows, which combine before the shuffle."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    sums = states.groupBy("snapshot").agg(F.count("*").alias("n_rows"), *parts)
    return sums.select("snapshot", "n_rows", F.sha2(F.concat_ws("|", "n_rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))


class CheckpointStore:
    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], values: Sequence[str]):
        self.spark, self.folder, self.keys, self.values = spark, folder.rstrip("/"), list(keys), list(values)
        self.table = VersionedTable(spark, f"{self.folder}/index")

    def index(self) -> DataFrame:
        """``snapshot, generation, n_rows, digest, live``."""
        return self.spark.createDataFrame([], INDEX) if self.table.version() is None else self.table.read()

    def states(self) -> DataFrame:
        """``snapshot``, keys and values of all live states, of which there must be some."""
        live = self.index().where("live").select("snapshot", "generation")
        names = [r[0] for r in live.select("generation").distinct().collect()]  # as many as there were calls of put
        parts = [self.spark.read.parquet(f"{self.folder}/states/{g}").select(F.col("snapshot").cast("long"), *self.keys, *self.values).withColumn("generation", F.lit(g)) for g in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(live, ["snapshot", "generation"], "left_semi").drop("generation")

    def put(self, states: DataFrame) -> DataFrame:
        """Keeps whole states (``snapshot``, keys, values); a snapshot's earlier state gives way.  The digests of what was put."""
        generation = uuid.uuid4().hex
        path = f"{self.folder}/states/{generation}"
        states.select("snapshot", *self.keys, *self.values).repartition("snapshot").write.partitionBy("snapshot").parquet(path)
        if not path_exists(self.spark, path) or self.spark.read.parquet(path).isEmpty():
            return self.spark.createDataFrame([], INDEX)
        written = self.spark.read.parquet(path).withColumn("snapshot", F.col("snapshot").cast("long"))
        fresh = checkpointed(snapshot_digests(written, [*self.keys, *self.values]).select("snapshot", F.lit(generation).alias("generation"), "n_rows", "digest", F.lit(True).alias("live")))
        self.table.upsert(fresh, ["snapshot"])
        return fresh

    def invalidate(self, snapshots: DataFrame, rewritten: DataFrame) -> DataFrame:
        """Drops the states of rewritten snapshots (``id``) and of all their descendants.  The index rows of what was dropped."""
        below = lineage.descendants(snapshots, rewritten).select(F.col("id").alias("snapshot"))
        gone = checkpointed(self.index().where("live").join(below, "snapshot", "left_semi"))
        if gone.isEmpty():
            return gone
        self.table.upsert(gone.withColumn("live", F.lit(False)), ["snapshot"])
        for r in gone.select("snapshot", "generation").collect():  # a folder each, nobody reads them any more
            drop_path(self.spark, f"{self.folder}/states/{r['generation']}/snapshot={r['snapshot']}")
        return gone

    def rebuild(self, deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
        """Builds dropped states again: ``snapshot, was, now``, the digests before and after."""
        dead = checkpointed(self.index().where("NOT live").select("snapshot", F.col("digest").alias("was")))
        made = self.state(deltas, snapshots, dead.select(F.col("snapshot").alias("id"))).withColumnRenamed("id", "snapshot")
        now = self.put(checkpointed(made))
        return dead.join(now.select("snapshot", F.col("digest").alias("now")), "snapshot", "left")

    def state(self, deltas: DataFrame, snapshots: DataFrame, ids: DataFrame) -> DataFrame:
        """The states of snapshots, from the nearest whole ones and the deltas behind them."""
        live = None if self.index().where("live").isEmpty() else self.states()
        return lineage.as_of_snapshots(deltas, snapshots, ids, self.keys, live)
