from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.relational import table_digest
from lodestone.streaming import streams


def test_states_follow_presence(spark, tmp_path):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 2, True), ("b", 3, True), ("c", 1, False)]
    spark.createDataFrame(rows, "stable_key string, frame long, detected boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    observed = spark.readStream.schema("stable_key string, frame long, detected boolean").parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.finding_states(observed), "states_test", str(tmp_path / "cp"), "append")
    assert sorted(map(tuple, out.collect())) == [("a", "new", 1), ("a", "regressed", 3), ("a", "resolved", 2), ("b", "new", 2)]


def test_stream_equals_batch(spark, data, tmp_path):
    live = streams.run_once(streams.sliding(streams.event_stream(spark, data)), "sliding_test", str(tmp_path / "cp"))
    batch = streams.sliding(spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert live.exceptAll(batch).count() == 0 and live.count() == batch.count()


def test_late_and_repeated_events(spark, data, tmp_path):
    events = streams.late_safe(streams.event_stream(spark, data)).groupBy("event_type").count()
    out = streams.run_once(events, "late_test", str(tmp_path / "cp"))
    assert out.agg(F.sum("count")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_matched_pairs(spark, data, tmp_path):
    out = streams.run_once(streams.matched(streams.event_stream(spark, data), "purchase", "error", "6 hours"), "matched_test", str(tmp_path / "cp"), "append")
    e = spark.read.parquet(f"{data}/events.parquet")
    a, b = e.where("event_type = 'purchase'").alias("a"), e.where("event_type = 'error'").alias("b")
    want = a.join(b, F.expr("a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS")).count()
    assert out.count() == want


def test_unchanged_batches_are_skipped(spark, tmp_path):
    seen = []
    for n in range(2):
        spark.createDataFrame([(1,), (2,)], "k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.refresh(df, str(tmp_path / "cp"), lambda b: table_digest(b, ["k"]).first()["digest"], lambda b, n: seen.append(n)).awaitTermination()
    assert len(seen) == 1
