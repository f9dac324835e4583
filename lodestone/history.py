"""Import of a history: one frame a revision, as deltas, resumable between frames.

A job's folder holds ``deltas/seq=N``, ``facts/seq=N`` and ``edges/seq=N`` (the last frame and every checkpoint), ``contents``, the facts
of all contents met so far, each parsed once, and a versioned table of its state: queued, enumerating, importing, finalizing, then completed, cancelled or failed.  A frame counts once the
state names it, and is written over where it doesn't, so a job that broke off goes on with the first frame that
isn't there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import engine
from lodestone.factstore import FactStore
from lodestone.operators.temporal import EVERY
from lodestone.sources import files
from lodestone.sources.versioned import VersionedTable
from lodestone.storage import drop_path

STATES = ("queued", "enumerating", "importing", "finalizing", "completed", "cancelled", "failed")
STATE = "status string, done int, total int, error string"


class HistoryImport:
    def __init__(self, spark: SparkSession, folder: str, policy: dict, tree: Callable[[str], DataFrame] | None = None):
        """``tree`` gives the files of a revision, as ``files.tree`` does; ``watch`` needs none."""
        self.spark, self.folder, self.policy, self.tree = spark, folder.rstrip("/"), policy, tree
        self.table = VersionedTable(spark, f"{self.folder}/state")

    def state(self) -> dict:
        if self.table.version() is None:
            return {"status": "queued", "done": 0, "total": 0, "error": None}
        return self.table.read().first().asDict()

    def _set(self, **changes: object) -> dict:
        now = self.state() | changes
        self.table.write(self.spark.createDataFrame([tuple(now[k] for k in ("status", "done", "total", "error"))], STATE))
        self.table.prune(2)
        return now

    def deltas(self) -> DataFrame:
        """The deltas of all frames that are done."""
        return self.spark.read.parquet(f"{self.folder}/deltas").where(f"seq < {self.state()['done']}")

    def facts(self, sequence: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/facts/seq={sequence}")

    def run(self, revisions: Sequence[str], cancelled: Callable[[], bool] = lambda: False) -> dict:
        """Imports what isn't yet; ``cancelled`` is asked between frames.  The state that it ends in."""
        now = self._set(status="enumerating", total=len(revisions), error=None)
        for seq in range(now["done"], len(revisions)):
            if cancelled():
                return self._set(status="cancelled")
            self.step(seq, lambda revision=revisions[seq]: self.tree(revision))
        self._set(status="finalizing")
        return self._set(status="completed")

    def step(self, seq: int, tree: Callable[[], DataFrame]) -> None:
        """One frame from its files, which are asked for once the state says so; one that is done already is left as it is."""
        if seq < self.state()["done"]:
            return
        self._set(status="importing")
        try:
            self._frame(seq, tree())
        except Exception as e:
            self._set(status="failed", error=f"{type(e).__name__}: {e}"[:500])
            raise
        self._set(done=seq + 1)
        if seq > 0 and (seq - 1) % EVERY != EVERY - 1:  # checkpoints stay
            drop_path(self.spark, f"{self.folder}/facts/seq={seq - 1}")
            drop_path(self.spark, f"{self.folder}/edges/seq={seq - 1}")

    def watch(self, root: str, seconds: float | None = None) -> StreamingQuery:
        """A frame whenever the source tree below ``root`` has changed: looked at every so many ``seconds``, or once.  A batch that is
        run again after a crash is a frame that is done, or is written over."""

        def each(batch: DataFrame, n: int) -> None:
            self.step(n, lambda: files.analysable(batch, self.policy["include"], self.policy["ignore"]))

        writer = files.tree_stream(self.spark, root).writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/watch")
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()

    def _frame(self, seq: int, tree: DataFrame) -> None:
        """Contents that no earlier frame had are parsed; edges of sources that nothing touches are carried forward."""
        before = self.facts(seq - 1).drop("analysis_status", "node") if seq else None
        edges = self.edges(seq - 1) if seq else None
        made = engine.scan_tree(self.spark, tree, self.policy, before, seq, FactStore(self.spark, f"{self.folder}/contents"), edges)
        made["facts"].write.mode("overwrite").parquet(f"{self.folder}/facts/seq={seq}")
        made["deltas"].drop("seq").write.mode("overwrite").parquet(f"{self.folder}/deltas/seq={seq}")
        made["edges"].write.mode("overwrite").parquet(f"{self.folder}/edges/seq={seq}")
        made["plan"].groupBy("reason").agg(F.count("*").alias("files")).withColumn("n_parsed", F.lit(made["n_parsed"])).write.mode("overwrite").parquet(f"{self.folder}/work/seq={seq}")

    def edges(self, sequence: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/edges/seq={sequence}")

    def work(self) -> DataFrame:
        """``seq, reason, files, n_parsed`` of all frames: how many files were resolved again or carried, and contents parsed."""
        return self.spark.read.parquet(f"{self.folder}/work").where(f"seq < {self.state()['done']}")
