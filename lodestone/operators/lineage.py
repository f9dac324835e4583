"""Snapshots that name their base: ancestors, states as of a snapshot, descendants.

Bases form a forest, not a sequence: two snapshots may go on from one.  Chains are followed by pointer doubling: after k rounds
each snapshot points 2^k steps up, so a chain of n takes log n rounds, each one join of the snapshots with themselves, and all
snapshots are followed at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import checkpointed, release


def _pointers(snapshots: DataFrame) -> DataFrame:
    """``id, up`` of ``(id, base)``; a base that isn't among the snapshots is an error."""
    up = checkpointed(snapshots.where("base IS NOT NULL").select("id", F.col("base").alias("up")))
    lost = up.join(snapshots.select(F.col("id").alias("up")), "up", "left_anti").select("id").take(1)
    if lost:
        raise ValueError(f"the base of snapshot {lost[0][0]} is missing")
    return up


def _doubled(up: DataFrame) -> DataFrame:
    return checkpointed(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")))


def ancestors(snapshots: DataFrame, ids: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``id, ancestor, distance`` of the snapshots ``ids`` (column id): itself at distance 0, its base, and so on to the root, or to the
    first of the snapshots ``whole``.  A cycle among ``snapshots (id, base)`` is an error, wherever it is."""
    n, step = snapshots.count(), 1
    up = _pointers(snapshots)
    if whole is not None:
        cut = checkpointed(up.join(whole.select("id"), "id", "left_anti"))
        _acyclic(up, n)
        up = cut
    reached = checkpointed(ids.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    while not up.isEmpty():
        if step > n:
            raise ValueError("snapshots lead back to themselves")
        more = reached.join(up.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        further, higher = checkpointed(reached.unionByName(more)), _doubled(up)
        release(reached, up)
        reached, up, step = further, higher, 2 * step
    return reached


def _acyclic(up: DataFrame, n: int) -> None:
    step = 1
    while not up.isEmpty():
        if step > n:
            raise ValueError("snapshots lead back to themselves")
        up, step = _doubled(up), 2 * step


def as_of_snapshots(deltas: DataFrame, snapshots: DataFrame, ids: DataFrame, keys: Sequence[str], checkpoints: DataFrame | None = None) -> DataFrame:
    """The states of the snapshots ``ids``: ``id``, ``keys`` and the values of ``deltas (snapshot, kind, keys, values)``.

    A key has the value of the nearest ancestor with a delta of it, unless that deletes it.  ``checkpoints (snapshot, keys, values)`` are whole
    states; a chain ends at the first snapshot that has one, whose own deltas don't count."""
    values = [c for c in deltas.columns if c not in ("snapshot", "kind", *keys)]
    whole = None if checkpoints is None else checkpoints.select(F.col("snapshot").alias("id")).distinct()
    chain = ancestors(snapshots, ids, whole).withColumnRenamed("ancestor", "snapshot")
    rows = deltas.select("snapshot", *keys, "kind", *values)
    if checkpoints is not None:
        rows = rows.join(whole.withColumnRenamed("id", "snapshot"), "snapshot", "left_anti").unionByName(checkpoints.select("snapshot", *keys, F.lit("add").alias("kind"), *values))
    nearest = rows.join(chain, "snapshot").groupBy("id", *keys).agg(F.min_by(F.struct("kind", *values), "distance").alias("s"))
    return nearest.where("s.kind <> 'delete'").select("id", *keys, *[F.col(f"s.{v}").alias(v) for v in values])


def descendants(snapshots: DataFrame, roots: DataFrame) -> DataFrame:
    """``id``: the snapshots ``roots`` and all that lead to one of them through their bases."""
    n, step = snapshots.count(), 1
    up = _pointers(snapshots)
    below = checkpointed(snapshots.select("id").join(roots.select("id").distinct(), "id", "left_semi"))
    while not up.isEmpty():
        if step > n:
            raise ValueError("snapshots lead back to themselves")
        more = up.join(below.select(F.col("id").alias("up")), "up", "left_semi").select("id")
        wider, higher = checkpointed(below.unionByName(more).distinct()), _doubled(up)
        release(below, up)
        below, up, step = wider, higher, 2 * step
    return below
