"""Branches, cycles, checkpoints of snapshots, and tables that survive crashes."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.checkpoints import CheckpointStore
from lodestone.operators import lineage, temporal
from lodestone.sources.versioned import Conflict, Damaged, VersionedTable


def forest(seed, n=40):
    """``(id, base)`` and deltas ``(snapshot, k, kind, v)`` of a random forest."""
    rng = random.Random(seed)
    base = {i: None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 4), i) for i in range(n)}
    deltas = [(i, k, rng.choice(("add", "change", "delete")), f"{i}.{k}") for i in range(n) for k in range(6) if rng.random() < 0.4]
    return base, deltas


def chain(base, i):
    out = []
    while i is not None:
        out.append(i)
        i = base[i]
    return out


def brute_state(base, deltas, i):
    state = {}
    for s in reversed(chain(base, i)):
        for d in deltas:
            if d[0] == s:
                state[d[1]] = None if d[2] == "delete" else d[3]
    return {(i, k, v) for k, v in state.items() if v is not None}


def frames(spark, base, deltas):
    return spark.createDataFrame(list(base.items()), "id long, base long"), spark.createDataFrame(deltas, "snapshot long, k long, kind string, v string")


def test_states_of_branches(spark):
    base, deltas = forest(3)
    snapshots, d = frames(spark, base, deltas)
    got = lineage.ancestors(snapshots, snapshots).collect()
    assert sorted((r["id"], r["distance"], r["ancestor"]) for r in got) == sorted((i, n, s) for i in base for n, s in enumerate(chain(base, i)))
    states = {tuple(r) for r in lineage.as_of_snapshots(d, snapshots, snapshots, ["k"]).collect()}
    assert states == set().union(*(brute_state(base, deltas, i) for i in base))
    kept = spark.createDataFrame([(s, k, v) for s in (7, 20) for _, k, v in brute_state(base, deltas, s)], "snapshot long, k long, v string")
    unread = d.where(~F.col("snapshot").isin(*chain(base, 20)))  # what lies behind a whole state isn't needed
    some = snapshots.where(F.col("id").isin(20, *[i for i in base if 20 in chain(base, i)]))
    assert {tuple(r) for r in lineage.as_of_snapshots(unread, snapshots, some, ["k"], kept).collect()} == set().union(*(brute_state(base, deltas, i) for i in base if 20 in chain(base, i)))
    below = lineage.descendants(snapshots, spark.createDataFrame([(5,), (9,), (999,)], "id long"))
    assert sorted(r["id"] for r in below.collect()) == [i for i in base if {5, 9} & set(chain(base, i))]


def test_two_snapshots_on_one_base(spark):
    snapshots, d = frames(spark, {1: None, 2: 1, 3: 1}, [(1, 0, "add", "root"), (2, 0, "change", "left"), (3, 1, "add", "right")])
    assert {tuple(r) for r in lineage.as_of_snapshots(d, snapshots, snapshots.where("id > 1"), ["k"]).collect()} == {(2, 0, "left"), (3, 0, "root"), (3, 1, "right")}


@pytest.mark.parametrize("bases", [{1: 2, 2: 1}, {1: 1}, {0: None, 5: 7, 6: 5, 7: 6, 8: 0}])
def test_cycles(spark, bases):
    snapshots = spark.createDataFrame(list(bases.items()), "id long, base long")
    for whole in (None, snapshots.limit(1)):
        with pytest.raises(ValueError, match="lead back"):
            lineage.ancestors(snapshots, snapshots, whole)
    with pytest.raises(ValueError, match="lead back"):
        lineage.descendants(snapshots, snapshots)
    with pytest.raises(ValueError, match="missing"):
        lineage.ancestors(spark.createDataFrame([(1, 5)], "id long, base long"), snapshots)


def test_checkpoint_store(spark, tmp_path):
    base, deltas = forest(5)
    snapshots, d = frames(spark, base, deltas)
    store = CheckpointStore(spark, str(tmp_path / "checkpoints"), ["k"], ["v"])
    assert store.index().count() == 0
    whole = [i for i in (4, 11, 18, 25, 33) if brute_state(base, deltas, i)]
    made = store.state(d, snapshots, snapshots.where(F.col("id").isin(*whole))).withColumnRenamed("id", "snapshot")
    store.put(made)
    before = {r["snapshot"]: r["digest"] for r in store.index().collect()}
    assert set(before) == set(whole)
    state = lambda deltas: {tuple(r) for r in store.state(deltas, snapshots, snapshots).collect()}
    assert state(d) == set().union(*(brute_state(base, deltas, i) for i in base))

    # A rebuild of what didn't change has the same digests.
    root = chain(base, whole[-1])[-2]
    hit = {i for i in whole if root in chain(base, i)}
    gone = store.invalidate(snapshots, snapshots.where(F.col("id") == root))
    assert {r["snapshot"] for r in gone.collect()} == hit and whole[-1] in hit
    assert {r["snapshot"] for r in store.index().where("live").collect()} == set(whole) - hit
    assert {(r["snapshot"], r["was"], r["now"]) for r in store.rebuild(d, snapshots).collect()} == {(i, before[i], before[i]) for i in hit}

    # A rewritten delta shows in the states of its descendants, once theirs are dropped.
    rewritten = [x for x in deltas if x[0] != root] + [(root, 99, "add", "new")]
    fresh = frames(spark, base, rewritten)[1]
    store.invalidate(snapshots, snapshots.where(F.col("id") == root))
    assert state(fresh) == set().union(*(brute_state(base, rewritten, i) for i in base))
    assert all(r["was"] != r["now"] for r in store.rebuild(fresh, snapshots).collect())
    assert store.invalidate(snapshots, snapshots.where("id < 0")).count() == 0


def test_joint_parity(spark):
    files = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "c")], "id long, v string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    got = temporal.joint_parity({"files": files, "links": links, "none": files.limit(0)}, {"files": files.where("id <> 2").unionByName(files.where("id = 2").limit(1)), "links": links.select("target", "source"), "none": files.limit(0)}, {"files": ["id"], "links": ["source", "target"], "none": ["id"]})
    assert {tuple(r) for r in got.collect()} == {("files", 4, 3, 1, False, '{"id":2}'), ("links", 2, 2, 0, True, None), ("none", 0, 0, 0, True, None)}


# ---- publication


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def content(table, version=None):
    return sorted(r["v"] for r in table.read(version).collect())


def test_writers_of_one_version(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert one.write(rows(spark, 1, 2)) == 1
    seen = two.version()
    assert one.append(rows(spark, 3)) == 2
    with pytest.raises(Conflict):
        two.write(rows(spark, 9), base=seen)
    assert content(one) == [1, 2, 3] and one.versions() == [1, 2] and content(one, 1) == [1, 2]
    with pytest.raises(Conflict):
        one._publish(2, [])
    assert content(two) == [1, 2, 3]


def test_an_append_writes_its_own_rows_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark, *range(50)))
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    t.append(rows(spark, 100))
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    assert all(now[p] == at for p, at in old.items()) and [r["n_rows"] for r in t.manifest().collect()] == [50, 1]
    t.insert_absent(rows(spark, 7, 200, 200), ["v"])
    assert [r["n_rows"] for r in t.manifest().collect()] == [50, 1, 1] and len(content(t)) == 52
    t.compact()
    assert [r["n_rows"] for r in t.manifest().collect()] == [52]
    t.prune()
    assert t.versions() == [4] and len(list((tmp_path / "t/data").iterdir())) == 1 and len(content(t)) == 52


@pytest.mark.parametrize("step", ["_stored", "_sums", "rename"])
def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch, step):
    """Whatever step it dies in, readers see the version before, and the next writer goes on."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark, 1, 2))
    died = VersionedTable(spark, str(tmp_path / "t"))
    if step == "rename":  # the marker is written, but never put in its place
        monkeypatch.setattr(died, "_publish", lambda version, parts: (tmp_path / "t/pending/x").write_text(json.dumps({"parts": parts[:1]})))
        (tmp_path / "t/pending").mkdir(exist_ok=True)
        died.append(rows(spark, 3))
    else:
        def stop(*a, **k):
            raise KeyboardInterrupt

        monkeypatch.setattr(died, step, stop)
        with pytest.raises(KeyboardInterrupt):
            died.append(rows(spark, 3))
    assert t.version() == 1 and content(t) == [1, 2]
    assert t.append(rows(spark, 4)) == 2 and content(t) == [1, 2, 4]


def test_damage_is_seen(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(rows(spark, 1, 2, 3).coalesce(1))
    t.write(rows(spark, 5))
    t.verify(1)
    assert t.restore(1) == 3 and content(t) == [1, 2, 3]
    folder = tmp_path / "t" / t.manifest(1).first()["folder"]
    file = next(folder.glob("*.parquet"))
    whole = file.read_bytes()
    file.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Damaged):
        t.restore(1)
    file.unlink()
    with pytest.raises(Damaged):
        t.verify(1)
    rows(spark, 1, 2, 4).coalesce(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(Damaged):
        t.restore(1)
    assert t.versions() == [1, 2, 3] and t.restore(2) == 4 and content(t) == [5]
    with pytest.raises(ValueError):
        t.restore(77)
