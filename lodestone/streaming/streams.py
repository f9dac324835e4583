"""Event streams: windows with watermarks, deduplicated refreshes, and the findings' life as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.storage import path_exists

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", max_files: int = 16) -> DataFrame:
    """New files of a folder as they come; ``ts`` as the timestamp that watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 days", slide: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def late_safe(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Watermarked, and without events seen before within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def matched(events: DataFrame, before: str, after: str, within: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Pairs of a user's events, ``after`` within a time of ``before``: a bounded stream-stream join."""
    a = events.where(F.col("event_type") == before).select("user_id", F.col("ts").alias("before_at"), F.col("event_id").alias("before_id")).withWatermark("before_at", delay)
    b = events.where(F.col("event_type") == after).select(F.col("user_id").alias("u"), F.col("ts").alias("after_at"), F.col("event_id").alias("after_id")).withWatermark("after_at", delay)
    near = (F.col("user_id") == F.col("u")) & (F.col("after_at") >= F.col("before_at")) & (F.col("after_at") <= F.col("before_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "before_id", "after_id")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The result of all that is there now, which the executors write to a table beside the checkpoint."""
    spark, folder = df.sparkSession, f"{checkpoint}-{name}"

    def write(batch: DataFrame, n: int) -> None:  # a batch that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{folder}/{'whole' if mode == 'complete' else f'batch-{n}'}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/*") if path_exists(spark, folder) else spark.createDataFrame([], df.schema)


def refresh(df: DataFrame, checkpoint: str, digest: Callable[[DataFrame], str], apply: Callable[[DataFrame, int], Any], seconds: float | None = None) -> StreamingQuery:
    """Micro-batches whose content digest is that of the last one are skipped.  The last digest is kept beside the stream's own
    checkpoint, so a restart doesn't apply an unchanged batch again."""
    spark, kept = df.sparkSession, f"{checkpoint}-digests"

    def last() -> str | None:
        if not path_exists(spark, kept):
            return None
        row = spark.read.schema("n long, digest string").json(kept).orderBy(F.col("n").desc()).first()
        return row["digest"] if row else None

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        d = digest(batch)
        if d != last():
            apply(batch, n)
            spark.createDataFrame([(n, d)], "n long, digest string").coalesce(1).write.mode("append").json(kept)
        batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def finding_states(observed: DataFrame) -> DataFrame:
    """``stable_key, status, frame`` whenever a key's status changes.  ``observed`` has ``stable_key, frame, detected``;
    the state of a key is its status and the frame it was last seen in."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, at = state.get if state.exists else ("", -1)
        out = []
        for frame, hit in pd.concat(list(batches))[["frame", "detected"]].sort_values("frame").itertuples(index=False):
            if frame <= at:
                continue  # late or repeated
            was, at = status, int(frame)
            if hit:
                status = "new" if not was else "regressed" if was == "resolved" else was
            elif was and was != "dismissed":
                status = "resolved"
            if status != was:
                out.append((key[0], status, int(frame)))
        state.update((status, at))
        yield pd.DataFrame(out, columns=["stable_key", "status", "frame"])

    return observed.groupBy("stable_key").applyInPandasWithState(step, "stable_key string, status string, frame long", "status string, at long", "append", GroupStateTimeout.NoTimeout)
