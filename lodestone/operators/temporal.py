"""Frames as sparse deltas: encoding, reconstruction, checkpoints, lineage and parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import diff_frames, table_digest
from lodestone.operators.windows import latest_state

EVERY = 16


def delta_encode(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], sequence: int) -> DataFrame:
    """The deltas that lead from one frame to the next: ``keys, seq, kind, values``."""
    d = diff_frames(before, after, keys, values)
    return d.select(*keys, F.lit(sequence).alias("seq"), F.col("change_kind").alias("kind"), *[F.col(f"after.{v}").alias(v) for v in values])


def is_checkpoint(sequence: str):
    """Every 16th frame, counted from 0."""
    return F.col(sequence) % EVERY == EVERY - 1


def checkpoint_before(sequence: int) -> int | None:
    """The last checkpoint at or before a frame."""
    at = (sequence + 1) // EVERY * EVERY - 1
    return at if at >= 0 else None


def as_of(deltas: DataFrame, keys: Sequence[str], sequence: int, checkpoint: DataFrame | None = None, checkpoint_sequence: int | None = None) -> DataFrame:
    """The frame at a sequence number: the checkpoint's rows and the deltas behind it.

    The bounds are literals, so a table partitioned by ``seq`` is read from the checkpoint on."""
    part = deltas.where(F.col("seq") <= sequence)
    if checkpoint is not None:
        part = part.where(F.col("seq") > checkpoint_sequence).unionByName(checkpoint)
    return latest_state(part, keys, "seq")


def frame_sizes(deltas: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``frame, nodes``: how many keys each frame holds, where any.

    A state adds one where it starts and takes one where the key's next delta ends it, so only sums per frame are put in
    order, not the frames' rows."""
    w = Window.partitionBy(*keys).orderBy("seq")
    held = deltas.select(*keys, "seq", "kind").withColumn("until", F.lead("seq").over(w)).where(F.col("kind") != "delete")
    steps = held.select("seq", F.lit(1).alias("d")).unionByName(held.where("until IS NOT NULL").select(F.col("until").alias("seq"), F.lit(-1).alias("d")))
    steps = steps.groupBy("seq").agg(F.sum("d").alias("d"), F.lit(False).alias("asked")).unionByName(frames.select("seq").distinct().select("seq", F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked")))
    by = steps.groupBy("seq").agg(F.sum("d").alias("d"), F.bool_or("asked").alias("asked"))
    running = F.sum("d").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))  # a row per frame
    return by.withColumn("nodes", running).where("asked AND nodes > 0").select(F.col("seq").alias("frame"), "nodes")


def lineage_faults(snapshots: DataFrame) -> DataFrame:
    """``id, fault`` of snapshots ``(id, base, seq, repository)``: missing or foreign base, or a sequence that doesn't
    follow its base.  A cycle has a snapshot whose number doesn't follow, so it is found too."""
    base = snapshots.select(F.col("id").alias("base"), F.col("seq").alias("base_seq"), F.col("repository").alias("base_repository"))
    fault = (
        F.when(F.col("base").isNull(), F.when(F.col("seq") != 0, "no_base")).when(F.col("base_seq").isNull(), "missing_base")
        .when(F.col("base_repository") != F.col("repository"), "foreign_base").when(F.col("seq") != F.col("base_seq") + 1, "not_monotone")
    )
    return snapshots.join(base, "base", "left").withColumn("fault", fault).where("fault is not null").select("id", "fault")


def parity(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether two frames hold the same rows, by digest."""
    both = table_digest(a, columns).withColumn("side", F.lit("left")).unionByName(table_digest(b, columns).withColumn("side", F.lit("right")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest"))).alias(side)
    return both.agg(of("left"), of("right")).withColumn("equal", F.col("left") == F.col("right"))


def joint_parity(left: dict[str, DataFrame], right: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """A row for each table of two projections (of files, relationships and symbols, say): ``table, left_rows, right_rows, differing, equal,
    first_key``.

    Rows are compared whole, as often as they come; ``differing`` counts the distinct ones that don't come equally often, and ``first_key`` is the least key
    (its columns as JSON, by the order of the columns' values) of those.  Each table is aggregated once, over both sides together."""

    def one(name: str) -> DataFrame:
        columns = sorted(left[name].columns)
        whole = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
        side = lambda df, l, r: df.select(F.struct(*keys[name]).alias("k"), whole.alias("h"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
        both = side(left[name], 1, 0).unionByName(side(right[name], 0, 1)).groupBy("k", "h").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        odd = F.col("l") != F.col("r")
        sums = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"), F.count_if(odd).alias("differing"), F.min(F.when(odd, F.col("k"))).alias("k"))
        return sums.select(F.lit(name).alias("table"), "left_rows", "right_rows", "differing", (F.col("differing") == 0).alias("equal"), F.to_json("k").alias("first_key"))

    out = None
    for name in left:
        out = one(name) if out is None else out.unionByName(one(name))
    return out


def timeline_merge(commits: DataFrame, sha: str, at: str) -> DataFrame:
    """Commits in order of time; a repeated one keeps its first place and its last values."""
    rest = [c for c in commits.columns if c not in (sha, at)]
    merged = commits.groupBy(sha).agg(F.min(at).alias("placed_at"), F.max(F.struct(at, *rest)).alias("s"))
    return merged.select(sha, "placed_at", F.col(f"s.{at}").alias(at), *[F.col(f"s.{c}").alias(c) for c in rest])


def reuse_status(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Per key what an incremental run has to do, from ``raw_hash, structural_hash, analyzer``."""
    was = previous.select(key, F.col("raw_hash").alias("_raw"), F.col("structural_hash").alias("_structural"), F.col("analyzer").alias("_analyzer"))
    same = F.col("raw_hash") == F.col("_raw")
    status = (
        F.when(F.col("_raw").isNull(), "new").when(same & (F.col("analyzer") == F.col("_analyzer")), "raw_unchanged").when(same, "analyzer_changed")
        .when(F.col("structural_hash") == F.col("_structural"), "metadata_only").otherwise("structural_changed")
    )
    return current.join(was, key, "left").withColumn("analysis_status", status).drop("_raw", "_structural", "_analyzer")


def carry_forward(edges: DataFrame, recomputed: DataFrame, affected: DataFrame, source: str = "source") -> DataFrame:
    """The old edges of unaffected sources and the new ones of the rest."""
    return edges.join(affected.select(source), source, "left_anti").unionByName(recomputed.join(affected.select(source), source, "left_semi"))


def _suffixes(token: str) -> Column:
    """A dotted name and all that it ends in."""
    parts = F.split(F.col(token), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def invalidated(tokens: DataFrame, changed: DataFrame, key: str, token: str) -> DataFrame:
    """Keys that refer to a token of the changed set, to a longer name that ends in it, or to what it ends in itself.

    Either side is exploded to its suffixes, so both are joins by equality."""
    named = tokens.where(F.col(token) != "")
    hit = changed.where(F.col(token) != "").select(token).distinct()
    longer = named.select(key, F.explode(_suffixes(token)).alias(token)).join(hit, token, "left_semi")
    shorter = named.join(hit.select(F.explode(_suffixes(token)).alias(token)).distinct(), token, "left_semi")
    return longer.select(key).unionByName(shorter.select(key)).distinct()


def invalidation_plan(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """``key, reason, recompute`` for each row of ``current``: why its references have to be resolved again, or that they may be
    carried forward.

    ``current`` has ``namespace`` (names the row is known by), ``interface`` (what it offers), ``refs`` (names it
    refers to; all arrays of dotted names), ``changed`` (its content was read anew) and ``cause`` (analyzer_upgraded, policy_changed or null);
    ``previous`` the three arrays.  Names of rows that came, went, or have another namespace or interface are affected; a row that
    refers to one of them, or to a name that ends in one or that one ends in, is resolved again though its content is the same."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    sets = ("namespace", "interface", "refs")
    was = previous.select(key, *[as_set(F.col(c)).alias(f"_{c}") for c in sets], F.lit(True).alias("_was"))
    now = current.select(key, *[as_set(F.col(c)).alias(c) for c in sets], "changed", "cause", F.lit(True).alias("_is"))
    both = now.join(was, key, "full_outer")
    differ = lambda c: ~as_set(F.col(c)).eqNullSafe(as_set(F.col(f"_{c}")))
    names = F.flatten(F.array(*[as_set(F.col(c)) for c in ("namespace", "interface", "_namespace", "_interface")]))
    affected = both.where(differ("namespace") | differ("interface")).select(F.explode(names).alias("token")).distinct()
    kept = both.where("_is AND NOT changed").select(key, F.explode("refs").alias("token"))
    hit = invalidated(kept, affected, key, "token").withColumn("_hit", F.lit(True))
    direct = F.coalesce("cause", F.when(differ("namespace"), "namespace_changed").when(differ("interface"), "interface_changed").when(differ("refs"), "resolver_context_changed").otherwise("content_changed"))
    reason = F.when(F.col("changed"), direct).when(F.col("cause").isNotNull(), F.col("cause")).when(F.col("_hit"), "resolver_context_changed").otherwise("carried_forward")
    out = both.where("_is").join(hit, key, "left").select(key, reason.alias("reason"))
    return out.withColumn("recompute", F.col("reason") != "carried_forward")
