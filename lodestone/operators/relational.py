"""Joins, aggregates, diffs and keyed writes as DataFrames.

One-to-many sides are aggregated before they are joined, so no join multiplies rows and
each side shuffles once on its key; small sides are left to adaptive broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.operators.pairs import PAIRS, count_pairs
from lodestone.storage import checkpointed, tasks

# ---- integrity


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand in more than one row, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, keys: Sequence[str], parents: DataFrame) -> DataFrame:
    """Rows whose key has no parent; null keys have none to miss."""
    return df.dropna(subset=list(keys)).join(parents.select(*keys).distinct(), list(keys), "left_anti")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = duplicates(df, keys).take(1)
    if found:
        raise ValueError(f"{', '.join(keys)} not unique: {found[0].asDict()}")
    return df


def lookup_all(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must have a fact; a missing one is an error."""
    lost = df.join(facts.select(key), key, "left_anti").take(1)
    if lost:
        raise ValueError(f"no fact for {key} {lost[0][key]}")
    return df.join(facts, key)


# ---- ledgers


def with_counts(df: DataFrame, key: str, many: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of a one-to-many side; absent keys keep nulls."""
    return df.join(many.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()]), key, "left")


def change_summary(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Per key: number of changes, first and last commit (ties by name) and their times."""
    return changes.groupBy(key).agg(
        F.count("*").alias("change_count"), F.min(F.struct(at, tie)).alias("first"), F.max(F.struct(at, tie)).alias("last")
    ).select(key, "change_count", F.col(f"first.{at}").alias("first_at"), F.col(f"first.{tie}").alias("first_commit"), F.col(f"last.{at}").alias("last_at"), F.col(f"last.{tie}").alias("last_commit"))


# ---- edges


def merge_edges(references: DataFrame, keys: Sequence[str] = ("source", "target", "external", "type", "status"), samples: int = 5) -> DataFrame:
    """One edge per key: weight, largest confidence, smallest line from 0 on, the first distinct
    pieces of evidence by line, and the distinct original targets.

    References are merged per piece of evidence, then the first pieces of each key are numbered; the rows of both
    kinds meet in one aggregate, so null keys stay and no array is longer than its result."""
    line = F.when(F.col("line") >= 0, F.col("line"))
    pieces = references.where("evidence != ''").groupBy(*keys, "evidence").agg(F.min(F.coalesce(line, F.lit(2_000_000_000))).alias("_line"))
    first = pieces.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_line", "evidence"))).where(F.col("_n") <= samples)
    merged = references.groupBy(*keys).agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"), F.min(line).alias("line"))
    originals = references.where("original is not null").select(*keys, "original").distinct()
    parts = merged.unionByName(first.select(*keys, F.struct("_n", "evidence").alias("_e")), allowMissingColumns=True).unionByName(originals, allowMissingColumns=True)
    return parts.groupBy(*keys).agg(
        F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max("line").alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["evidence"]), " | ").alias("evidence"),
        F.array_sort(F.collect_list("original")).alias("originals"),
    )


def edge_quality(edges: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many references were resolved, and the rate among internal ones."""
    n = lambda s: F.count_if(F.col(status) == s)
    counted = edges.agg(F.count("*").alias("total"), n("resolved_internal").alias("resolved"), n("ambiguous_internal").alias("ambiguous"), n("unresolved_internal").alias("unresolved"), n("external").alias("external"))
    internal = F.col("resolved") + F.col("ambiguous") + F.col("unresolved")
    verdict = F.when(internal == 0, "unavailable").when(F.col("ambiguous") + F.col("unresolved") == 0, "complete").otherwise("partial")
    return counted.select("*", internal.alias("internal"), (F.col("resolved") / F.nullif(internal, F.lit(0))).alias("resolution_rate"), verdict.alias("status"))


def resolution_status(direct: Column, target: Column, external: Column) -> Column:
    """The stored status, else what the target says."""
    return F.coalesce(F.nullif(direct, F.lit("")), F.when(target.isNotNull(), "resolved_internal").when(external.rlike(r"^[./]"), "unresolved_internal").otherwise("external"))


def capped_confidence(confidence: Column, status: Column) -> Column:
    return F.least(confidence, F.when(status == "ambiguous_internal", 0.5).when(status == "unresolved_internal", 0.35).otherwise(1.0))


# ---- resolution of references


def resolve_unique_suffix(references: DataFrame, paths: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """``name, path`` where exactly one path equals the name or ends with ``/name``.

    Paths are exploded into their suffixes, which makes it an equi-join."""
    parts = F.split(path, "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    found = references.select(name).distinct().join(paths.select(F.col(path), suffix.alias(name)), name)
    return found.groupBy(name).agg(F.count("*").alias("n"), F.min(path).alias(path)).where("n = 1").drop("n")


def first_candidate(references: DataFrame, candidates: Column, known: DataFrame, key: str, path: str = "path") -> DataFrame:
    """For each row the first of its candidate paths that is known, else null."""
    tried = references.select(key, F.posexplode(candidates).alias("at", path))
    hit = tried.join(known.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "at").alias("resolved"), F.min("at").alias("attempt"))
    return references.join(hit, key, "left")


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, separator: str = ".") -> DataFrame:
    """For each name its longest known prefix that ends at a separator (or is the name), else null."""
    parts = F.split(name, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    tried = names.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))).alias(prefix)).distinct()
    hit = tried.join(prefixes.select(prefix).distinct(), prefix).groupBy(name).agg(F.max_by(prefix, F.char_length(prefix)).alias(prefix))
    return names.join(hit, name, "left")


def resolve_by_priority(references: DataFrame, *ways: DataFrame, name: str = "name") -> DataFrame:
    """``name, target, way``: the first way (``name, target`` rows) that gives exactly one target."""
    out = None
    for n, way in enumerate(ways):
        one = way.groupBy(name).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").select(name, "target", F.lit(n).alias("way"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(name).agg(F.min(F.struct("way", "target")).alias("b")).select(name, "b.target", "b.way")
    return references.select(name).distinct().join(best, name, "left")


def candidate_counts(references: DataFrame, candidates: DataFrame, name: str = "name", target: str = "target") -> DataFrame:
    """``n`` distinct candidates of each reference, and what follows: resolved with one, ambiguous with more, else
    unresolved where the name is relative, else external.  Pairs are made distinct before names are counted."""
    many = candidates.select(name, target).where(F.col(target).isNotNull()).distinct().groupBy(name).agg(F.count("*").alias("n"))
    n = F.col("n")
    status = F.when(n == 1, "resolved_internal").when(n > 1, "ambiguous_internal").when(F.col(name).rlike(r"^[./]"), "unresolved_internal").otherwise("external")
    return references.join(many, name, "left").fillna({"n": 0}).withColumn("status", status)


def candidate_status(references: DataFrame, candidates: DataFrame, name: str = "name", target: str = "target", limit: int = 10) -> DataFrame:
    """``candidate_counts`` with the first ``limit`` candidates in order (null where there are none)."""
    w = Window.partitionBy(name).orderBy(target)
    first = candidates.select(name, target).where(F.col(target).isNotNull()).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return candidate_counts(references, candidates, name, target).join(first.groupBy(name).agg(F.array_sort(F.collect_list(target)).alias("candidates")), name, "left")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """``name, target``: the paths in which a symbol is found under its name or its qualified name, of ``(path, name, qualified)``."""
    named = symbols.select(F.col("path").alias("target"), F.explode(F.array("name", "qualified")).alias("name"))
    return named.where("name IS NOT NULL AND name <> ''").select("name", "target").distinct()


def resolve_symbols(references: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """``references`` (with a column ``symbol``) and ``target, status, n, candidates``: the one path that has a symbol of that name; with several
    the reference is ambiguous, and the first ``limit`` of them are candidates; with none it is unresolved.

    A name is as a rule referred to often and found in few paths, so names are counted and their candidates numbered once, and the references
    join a row a name."""
    asked = references.select(F.col("symbol").alias("name")).distinct()
    index = symbol_index(symbols).join(asked, "name", "left_semi")
    ranked = index.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("target")))
    by = ranked.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("_only"), F.array_sort(F.collect_list(F.when(F.col("_n") <= limit, F.col("target")))).alias("_all"))
    found = references.join(by.withColumnRenamed("name", "symbol"), "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    n = F.col("n")
    status = F.when(n == 1, "resolved_internal").when(n > 1, "ambiguous_internal").otherwise("unresolved_internal")
    return found.select(*references.columns, F.when(n == 1, F.col("_only")).alias("target"), status.alias("status"), "n", F.when(n > 1, F.col("_all")).alias("candidates"))


def with_symbol_details(symbols: DataFrame, details: DataFrame) -> DataFrame:
    """``symbols`` with the details of the symbol of the same path, qualified name and first line, null where there are none; of several
    the first by their values."""
    keys = ["path", "qualified", "start_line"]
    rest = [c for c in details.columns if c not in keys]
    one = details.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_d")).select(*keys, *[F.col(f"_d.{c}").alias(c) for c in rest])
    return symbols.join(one, keys, "left")


# ---- sets


def contained_pairs(members: DataFrame, pairs: DataFrame, group: str, member: str) -> DataFrame:
    """``pairs (a, b)`` of which some group holds both, with the number of such groups."""
    own = members.select(group, member).distinct()
    a, b = own.select(F.col(group), F.col(member).alias("a")), own.select(F.col(group), F.col(member).alias("b"))
    return pairs.select("a", "b").distinct().join(a, "a").join(b, [group, "b"]).groupBy("a", "b").agg(F.count("*").alias("proofs"))


def collisions(members: DataFrame, group: str, member: str, sample: int = 10, block: int = 512) -> DataFrame:
    """Pairs of groups that share members: how many, and the first few by name.

    The groups of a very common member are dealt to blocks of about ``block``, and each pair of blocks is joined by
    itself, so no task pairs all groups of one member.  Members, and then the pairs that they make, are counted, and go to as many
    tasks as that needs."""
    spark, rows = members.sparkSession, members.select(F.col(group).alias("left"), member).where(F.col("left").isNotNull())
    own = checkpointed(rows.repartition(tasks(spark, rows.count()), "left", member).distinct())
    sizes = own.where(F.col(member).isNotNull()).groupBy(member).agg(F.count("*").alias("n"))
    made = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    groups = own.agg(F.count_distinct("left")).first()[0]
    common = sizes.select(member, F.ceil(F.col("n") / block).alias("_blocks")).where("_blocks > 1")
    dealt = own.join(common, member, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("left"), "_blocks"))
    a = dealt.select("left", member, F.col("_block").alias("_i"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_j"))
    b = dealt.select(F.col("left").alias("right"), member, F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_i"), F.col("_block").alias("_j"))
    a, b = (x.repartition(tasks(spark, made), member, "_i", "_j") for x in (a, b))
    both = a.join(b, [member, "_i", "_j"]).where("_i < _j OR left < right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), member)
    n = tasks(spark, min(made, groups * (groups - 1) / 2))
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):  # else fewer pairs than that: better summed before they are dealt
        both = both.repartition(n, "left", "right")
    return both.groupBy("left", "right").agg(F.count("*").alias("shared"), F.slice(F.array_sort(F.collect_set(member)), 1, sample).alias("first"))


def collision_counts(members: DataFrame, group: str, member: str, block: int = 512, pairs: int = PAIRS) -> DataFrame:
    """``left, right, shared`` of ``collisions``, where nobody needs the members' names: pairs are shuffled as packed lists.

    That takes integer groups no further than 2^31 apart; others are counted by ``collisions``.  A member's groups become arrays of about
    ``block`` at most, so those of a very common one lie in many."""
    spark, kind = members.sparkSession, members.schema[group].dataType
    rows = members.select(F.col(group).alias("left"), F.col(member).alias("_member")).where("left IS NOT NULL AND _member IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("left"), F.max("left")).first()
    if not isinstance(kind, IntegralType) or (n and high - low >= 2**31 - 1):
        return collisions(members, group, member, block=block).select("left", "right", "shared")
    low, high = low or 0, high or 0
    own = checkpointed(rows.select((F.col("left") - low).cast("int").alias("_id"), "_member").repartition(tasks(spark, n), "_id", "_member").distinct())
    sizes = own.groupBy("_member").agg(F.count("*").alias("n"))
    made, most = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = max(tasks(spark, n), -(-int(made) // pairs))
    if most <= block:
        lists = own.repartition(parts, "_member").groupBy("_member").agg(F.collect_list("_id").alias("a")).select("a", F.expr("CAST(array() AS array<int>)").alias("b"), F.lit(True).alias("within"))
    else:
        common = sizes.where(F.col("n") > block).select("_member", F.ceil(F.col("n") / block).alias("_blocks"))
        dealt = own.join(common, "_member", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks"))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        cells = dealt.select("_member", "_id", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), (F.col("_block") <= F.col("_other")).alias("_first"))
        held = [F.collect_list(F.when(side, F.col("_id"))).alias(name) for name, side in (("a", F.col("_first")), ("b", ~F.col("_first")))]
        lists = cells.repartition(parts, "_member", "_i", "_j").groupBy("_member", "_i", "_j").agg(*held).withColumn("within", F.expr("_i = _j"))
    counted = count_pairs(lists, high - low, int(made), pairs)
    return counted.select((F.col("x") + low).cast(kind).alias("left"), (F.col("y") + low).cast(kind).alias("right"), F.col("n").alias("shared"))


def symmetric_neighbours(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Each edge seen from both ends: ``node, neighbour, direction``."""
    uses = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), F.lit("uses").alias("direction"))
    return uses.unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("neighbour"), F.lit("used_by").alias("direction")))


# ---- diffs and keyed writes


def diff_frames(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys, change_kind, before, after``: added, changed and deleted keys (null-safe)."""
    b = before.select(*keys, F.struct(*values).alias("before"))
    a = after.select(*keys, F.struct(*values).alias("after"))
    kind = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "change")
    return b.join(a, list(keys), "full_outer").withColumn("change_kind", kind).where("change_kind is not null").select(*keys, "change_kind", "before", "after")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the values of ``rows`` where keys meet, and with its new keys."""
    kept = table.join(rows.select(*keys), list(keys), "left_anti")
    return kept.unionByName(rows)


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def latest_wins(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# ---- rollups


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """``facet, value, n`` of several columns in one pass over exploded pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def diagnostic_groups(df: DataFrame, key: str | Sequence[str], item: str, severity: Column, sample: int = 3, histogram: str | None = None) -> DataFrame:
    """Groups of two and more, by one key or several: size, largest severity rank, first few items by name, and where a column is
    named for it ``histogram``: how many rows have each of its values, as an array of ``value, n`` by value."""
    keys = [key] if isinstance(key, str) else list(key)
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(severity).alias("top"))
    items = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(item))).where(F.col("_n") <= sample)
    parts = counted.unionByName(first.select(*keys, F.col(item).alias("_item")), allowMissingColumns=True)
    out = [F.max("n").alias("n"), F.max("top").alias("top"), F.array_join(F.array_sort(F.collect_list("_item")), ",").alias("sample")]
    if histogram is not None:
        by = df.groupBy(*keys, F.col(histogram).alias("_value")).agg(F.count("*").alias("_k"))
        parts = parts.unionByName(by.select(*keys, F.struct(F.col("_value").alias("value"), F.col("_k").alias("n")).alias("_h")), allowMissingColumns=True)
        out.append(F.array_sort(F.collect_list("_h")).alias("histogram"))
    return parts.groupBy(*keys).agg(*out).where("n >= 2")


def pivot_metrics(metrics: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows as one row per key; the names are given, which saves a pass."""
    return metrics.groupBy(key).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counted = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def table_digest(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One SHA-256 of all rows, whatever their order: of their number and of the sums of the four parts of the rows' own SHA-256.

    Sums combine before the shuffle, so no array of rows is made, however many there are."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *parts)
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", *[F.coalesce(f"s{i}", F.lit(0)).cast("string") for i in range(4)]), 256).alias("digest"))


def ordered_digest(df: DataFrame, key: str, item: str) -> DataFrame:
    """``key, digest, n``: per key one SHA-256 over its items, put together in order.

    Rows come sorted by key; a task walks its partition and keeps one running hash, so no key has to fit in memory.
    A null item counts in ``n`` only."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running, n, kind = None, hashlib.sha256(), 0, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for k, group in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lambda x: x[0]):
                if n and k != current:
                    done.append((current, running.hexdigest(), n))
                    running, n = hashlib.sha256(), 0
                current, texts = k, [x for _, x in group]
                running.update("".join(x for x in texts if x is not None).encode())
                n += len(texts)
            yield made(done, kind)
        if n:
            yield made([(current, running.hexdigest(), n)], kind)

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.string(), pa.int64()))], ["key", "digest", "n"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(item).alias("item")).repartition("key").sortWithinPartitions("key", "item")
    return rows.mapInArrow(walk, f"key {kind}, digest string, n long").withColumnRenamed("key", key)


def ratchet(current: DataFrame, baseline: DataFrame, key: str, value: str, hard: int) -> DataFrame:
    """Verdict of each key against a baseline: new ones must stay within ``hard``, known ones must not grow, and a
    baseline that is too high is stale."""
    now, was = F.col(value), F.col("_was")
    verdict = F.when(was.isNull() & (now > hard), "new_violation").when(now.isNull(), "stale_baseline").when(was.isNull(), "ok").when(now > was, "growth").when(now < was, "stale_baseline").otherwise("ok")
    return current.join(baseline.select(key, F.col(value).alias("_was")), key, "full_outer").select(key, was.alias("baseline"), now.alias("current"), verdict.alias("verdict"))
