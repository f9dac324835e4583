"""Leases with timers and the stream over a source tree."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from lodestone.history import HistoryImport
from lodestone.sources import files
from lodestone.storage import path_exists
from lodestone.streaming import leases, streams

LOG = "job long, id long, at timestamp, kind string"
HOUR = 3_600_000


def test_a_lease_by_hand():
    step = lambda *entries, until=100, state=("", 0, 0): leases.advance(state, [(at, n, kind) for n, (at, kind) in enumerate(entries)], until, 10, 2)
    assert step((1, "claim"), (2, "claim"), (9, "heartbeat"), (19, "complete"), (20, "claim")) == (("completed", 1, 19), [(1, 1, "running"), (19, 1, "completed")])
    assert step((1, "claim"), (12, "complete"), (13, "claim"))[1] == [(1, 1, "running"), (11, 1, "retry"), (13, 2, "running"), (23, 2, "failed")]
    assert step((1, "claim"), until=11) == (("running", 1, 11), [(1, 1, "running")])
    assert step((5, "heartbeat"), (6, "complete")) == (("", 0, 0), [])


def test_leases_do_not_depend_on_batches(spark, tmp_path):
    """The same log in one batch, and in several that come out of order within the delay."""
    leases.use_state_store(spark)
    draw = random.Random(3)
    rows = [(draw.randrange(6), n, n * 900_000 + draw.randrange(900_000), draw.choice(("claim", "claim", "heartbeat", "heartbeat", "complete"))) for n in range(300)]
    clock = max(at for _, _, at, _ in rows) - 2 * HOUR
    want = []
    for job in range(6):
        own = sorted((at, n, kind) for j, n, at, kind in rows if j == job and at < clock)
        want += [(job, *c) for c in leases.advance(("", 0, 0), own, clock, 2 * HOUR, 3)[1]]
    assert {s for *_, s in want} == {"running", "retry", "completed", "failed"}
    for parts in (1, 5):
        folder = str(tmp_path / f"log{parts}")
        for p in range(parts):
            some = rows[p * 300 // parts : (p + 1) * 300 // parts]
            draw.shuffle(some)
            spark.createDataFrame(some, "job long, id long, at long, kind string").withColumn("at", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.02)
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
        got = streams.run_once(leases.lease_changes(log, 2 * HOUR, 3, "2 hours"), "out", str(tmp_path / f"cp{parts}"), "append")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_timers_do_not_grow_with_jobs(spark, tmp_path):
    """Jobs share the timers and what waits in their bucket."""
    leases.use_state_store(spark)
    claims = spark.range(4000).select(F.col("id").alias("job"), "id", F.timestamp_millis(F.col("id") + HOUR).alias("at"), F.lit("claim").alias("kind"))
    claims.union(claims.limit(1).withColumn("at", F.timestamp_millis(F.lit(100 * HOUR)))).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    changes = leases.lease_changes(log, HOUR, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    changes.awaitTermination()
    assert 0 < sum(state["customMetrics"].get("numRegisteredTimers", 0) for p in changes.recentProgress for state in p["stateOperators"]) < 2000
    got = spark.read.schema(leases.CHANGES).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(c for n in range(4000) for c in ((n, n + HOUR, 1, "running"), (n, n + 2 * HOUR, 1, "failed")))


def test_entries_without_job_moment_or_id(spark, tmp_path):
    """Without a job or a moment they do nothing, but the first count for the clock; without an id they come last at their moment."""
    leases.use_state_store(spark)
    big = 2**53
    rows = [(None, 1, 100 * HOUR, "claim"), (7, 1, None, "claim"), (8, None, HOUR, "complete"), (8, big + 1, HOUR, "complete"), (8, big + 2, HOUR, "claim"), (9, big, HOUR, "complete"), (9, big + 1, HOUR, "claim")]
    spark.createDataFrame(rows, "job long, id long, at long, kind string").withColumn("at", F.timestamp_millis("at")).coalesce(1).write.parquet(str(tmp_path / "log"))
    got = streams.run_once(leases.lease_changes(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), HOUR, 1, buckets=1), "out", str(tmp_path / "cp"), "append")
    assert sorted(map(tuple, got.collect())) == [(8, HOUR, 1, "completed"), (8, HOUR, 1, "running"), (9, HOUR, 1, "running"), (9, 2 * HOUR, 1, "failed")]


def test_silence_gives_a_job_back_by_the_clock(spark, tmp_path):
    leases.use_state_store(spark)
    spark.createDataFrame([(1, 1, 0, "claim"), (2, 1, 0, "claim"), (2, 2, 1, "complete")], "job long, id long, at long, kind string").withColumn("at", F.timestamp_millis("at")).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")
    live = leases.lease_changes(log, 500, 1, event_time=False).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    got = set()
    for _ in range(120):
        time.sleep(0.5)
        if path_exists(spark, f"{out}/_spark_metadata"):
            got = {(r["job"], r["attempt"], r["status"]) for r in spark.read.schema(leases.CHANGES).parquet(out).collect()}
        if len(got) == 4:
            break
    live.stop()
    live.awaitTermination()
    assert got == {(1, 1, "running"), (1, 1, "failed"), (2, 1, "running"), (2, 1, "completed")}


def test_watching_a_tree(spark, tmp_path):
    """Three edits are three frames more; a tree as it was is none; another process goes on where the first stopped."""
    root, policy = tmp_path / "tree", files.policy("groups: []")
    edits = ({"pkg/__init__.py": "", "pkg/a.py": "x = 1\n", "pkg/deep/er/b.py": "import pkg.a\n"}, {"pkg/a.py": "x = 2\n"}, {"pkg/c.py": "import pkg.a\n"}, {"pkg/deep/er/b.py": None})
    counts = []
    for n, edit in enumerate(edits):
        for path, text in edit.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(text) if text is not None else (root / path).unlink()
        for _ in range(1 + (n == 1)):  # the second finds nothing new
            job = HistoryImport(spark, str(tmp_path / "job"), policy)
            job.watch(str(root)).awaitTermination()
            counts.append(job.state()["done"])
    assert counts == [1, 2, 2, 3, 4]
    assert sorted((r["path"], r["loc"]) for r in job.facts(3).collect()) == [("pkg/__init__.py", 0), ("pkg/a.py", 1), ("pkg/c.py", 1)]
    assert sorted(map(tuple, job.deltas().groupBy("seq", "kind").count().collect())) == [(0, "add", 3), (1, "change", 1), (2, "add", 1), (3, "delete", 1)]
    assert [r["n_parsed"] for r in job.work().select("seq", "n_parsed").distinct().orderBy("seq").collect()] == [3, 1, 0, 0]  # c.py holds what b.py does


def test_wide_and_deep_trees_are_read_in_branches(spark, tmp_path):
    from lodestone.sources.treesource import TreeReader

    for n in range(70):
        (tmp_path / f"d{n}" / "x" / "y").mkdir(parents=True)
        (tmp_path / f"d{n}" / "x" / "y" / "__init__.py").write_text(f"n = {n}\n")
    (tmp_path / "top.py").write_text("t = 1\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("no\n")
    parts = TreeReader(str(tmp_path), 1000).partitions()
    assert sum(p.below for p in parts) == 70
    assert {r["path"] for r in files.tree(spark, str(tmp_path)).collect()} == {"top.py", *(f"d{n}/x/y/__init__.py" for n in range(70))}
