"""Graph operators over edge DataFrames ``(source, target)``.

Traversals are loops of joins between the frontier and the edges, which stop on an empty
frontier, so cycles end them.  Each step's result is checkpointed to the shared folder, which cuts the
lineage and survives lost executors; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.exprs import glob_any
from lodestone.functions.scores import proximity
from lodestone.storage import checkpointed, release

HOPS = 4  # a round's
PEELS = 2  # layers that one job trims
COMPACT = 8  # rounds whose rings stand apart before they are put together


# ---- degrees: three definitions, three functions


def degree_all(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out``: fan-out counts every row, external targets too."""
    return _degrees(edges.select("source"), edges.where("target is not null").select("target"))


def degree_internal(edges: DataFrame) -> DataFrame:
    """As ``degree_all`` over rows with a target only."""
    own = edges.where("target is not null")
    return _degrees(own.select("source"), own.select("target"))


def degree_distinct(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out`` of distinct neighbours."""
    own = edges.where("target is not null").select("source", "target").distinct()
    return _degrees(own.select("source"), own.select("target"))


def _degrees(sources: DataFrame, targets: DataFrame) -> DataFrame:
    ends = sources.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(targets.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


# ---- reachability


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, enough: int | None = None) -> DataFrame:
    """``node, distance`` of all nodes that a path leads to from ``start`` (a ``node`` column),
    which are at distance 0.  With ``enough``, no further rings once those that are whole hold so many nodes besides the start."""
    hops = checkpointed(edges.where("target is not null").select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    seen = _Rings(start.select("node").distinct())
    while (depth is None or seen.at < depth) and seen.grow(hops, HOPS if depth is None else min(HOPS, depth - seen.at)):
        if enough is not None and seen.all().where("distance > 0").count() >= enough:
            break
    release(hops)
    return seen.all()


class _Rings:
    """Nodes by distance.  A round takes a few hops from the last ring and writes only the nodes that are new; every COMPACT
    rounds the parts are put together in one table, so neither the rows written nor the number of partitions grows with
    rounds times nodes."""

    def __init__(self, start: DataFrame):
        self.at, self.parts = 0, [checkpointed(start.withColumn("distance", F.lit(0)))]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def grow(self, hops: DataFrame, n: int = 1) -> bool:
        """Adds the next n rings; false where the last of them is empty."""
        ring, rings = self.parts[-1].where(F.col("distance") == self.at).select("node"), []
        for at in range(self.at + 1, self.at + n + 1):
            ring = ring.join(hops, "node").select(F.col("next").alias("node")).distinct()
            rings.append(ring.withColumn("distance", F.lit(at)))
        found = rings[0]
        for r in rings[1:]:
            found = found.unionByName(r)
        found = found.groupBy("node").agg(F.min("distance").alias("distance")) if n > 1 else found
        fresh = checkpointed(found.join(self.all().select("node"), "node", "left_anti"))
        if len(self.parts) >= COMPACT:
            whole = checkpointed(self.all())
            release(*self.parts)
            self.parts = [whole]
        self.parts.append(fresh)
        self.at += n
        return not fresh.where(F.col("distance") == self.at).isEmpty()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def undirected(edges: DataFrame) -> DataFrame:
    own = edges.where("target is not null").select("source", "target")
    return own.unionByName(reversed_edges(own)).distinct()


def dependants(edges: DataFrame, target: DataFrame, limit: int = 500) -> DataFrame:
    """What depends on the target, nearest first, at most ``limit`` (by distance, then node)."""
    found = reach(reversed_edges(edges.where("target is not null")), target, enough=limit).where("distance > 0")
    return found.orderBy("distance", "node").limit(limit)


def second_order(edges: DataFrame, target: DataFrame) -> DataFrame:
    """``node, ring``: direct dependants (1), and theirs that are neither direct nor the target (2)."""
    return reach(reversed_edges(edges.where("target is not null")), target, depth=2).where("distance > 0").withColumnRenamed("distance", "ring")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, hub: int = 80) -> DataFrame:
    """``node, distance`` within ``depth`` hops either way; beyond the first hop nodes with more than
    ``hub`` distinct neighbours (in and out) aren't passed through."""
    both = undirected(edges)
    passable = degree_distinct(edges).where(F.col("fan_in") + F.col("fan_out") <= hub).select(F.col("node").alias("source"))
    seen = _Rings(seeds.select("node").distinct())
    if depth > 0 and seen.grow(both.select(F.col("source").alias("node"), F.col("target").alias("next"))) and depth > 1:
        calm = checkpointed(both.join(passable, "source", "left_semi").select(F.col("source").alias("node"), F.col("target").alias("next")))
        while seen.at < depth and seen.grow(calm):
            pass
    return seen.all()


def related(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """Neighbours of the seeds by proximity score; ``nodes`` has ``node, folder, grp, path, lexical``."""
    found = expand(edges, seeds, depth).where("distance > 0")
    direct = undirected(edges).join(seeds.select(F.col("node").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("direct"))
    own = nodes.join(seeds.select("node"), "node", "left_semi")
    degree = degree_distinct(edges).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    f = (
        found.join(nodes, "node").join(direct, "node", "left").join(degree, "node", "left")
        .join(own.select("folder").distinct().withColumn("_f", F.lit(True)), "folder", "left").join(own.select("grp").distinct().withColumn("_g", F.lit(True)), "grp", "left")
    )
    score = proximity(F.col("distance"), F.coalesce("direct", F.lit(0)), F.coalesce("lexical", F.lit(0.0)), F.coalesce("_f", F.lit(False)), F.coalesce("_g", F.lit(False)), F.coalesce("degree", F.lit(0)))
    return f.withColumn("score", score).orderBy(F.col("score").desc(), "path").limit(limit).select("node", "path", "distance", "score")


# ---- cycles


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of nodes on cycles of more than one node; components carry their least node.

    Nodes without an edge in or out are trimmed again and again.  Each round colours every node with the
    least node that reaches it (label propagation); what a colour's own node is reached from within the colour is its
    component.  All components of a round are found together, however many there are."""
    left = checkpointed(edges.where("target is not null and source <> target").select("source", "target").distinct())
    found: DataFrame | None = None
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        color = _least_ancestor(left)
        same = left.join(color.select(F.col("node").alias("source"), "color"), "source").join(color.select(F.col("node").alias("target"), F.col("color").alias("c2")), "target").where("color = c2")
        inside = checkpointed(same.select("source", "target"))
        back = reach(reversed_edges(inside), color.where("node = color").select("node"))
        own = checkpointed(color.join(back.select("node"), "node", "left_semi").select("node", F.col("color").alias("component")))
        found = own if found is None else found.unionByName(own)
        left = checkpointed(left.join(own.select(F.col("node").alias("source")), "source", "left_anti").join(own.select(F.col("node").alias("target")), "target", "left_anti"))
    if found is None:
        kind = edges.schema["source"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that none leads to or from, again and again; ``edges`` itself goes."""
    n = edges.count()
    while True:
        fresh = edges
        for _ in range(PEELS):
            ends = fresh.select(F.col("source").alias("node")).intersect(fresh.select(F.col("target").alias("node")))
            fresh = fresh.join(ends.select(F.col("node").alias("source")), "source", "left_semi").join(ends.select(F.col("node").alias("target")), "target", "left_semi")
        fresh = checkpointed(fresh)
        release(edges)
        edges, m = fresh, fresh.count()
        if m == n:
            return edges
        n = m


def _least_ancestor(edges: DataFrame) -> DataFrame:
    """``node, color``: the least node among a node and all that reach it.

    What reaches a node's color reaches the node, so each round takes the color's own color, too, and the rounds
    are as the logarithm of the longest path, not as its length."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    color = held = checkpointed(nodes.withColumn("color", F.col("node")))
    while True:
        sent = edges.join(color.select(F.col("node").alias("source"), F.col("color").alias("c")), "source").groupBy(F.col("target").alias("node")).agg(F.min("c").alias("c"))
        near = color.join(sent, "node", "left").select("node", F.col("color").alias("was"), F.least("color", "c").alias("color"))
        far = near.select(F.col("node").alias("color"), F.col("color").alias("beyond"))
        fresh = checkpointed(near.join(far, "color", "left").select("node", F.least("color", "beyond").alias("color"), (F.least("color", "beyond") < F.col("was")).alias("changed")))
        release(held)
        color, held = fresh.select("node", "color"), fresh
        if not fresh.agg(F.bool_or("changed")).first()[0]:
            return color


# ---- hierarchy


def ancestors(parents: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """``name, ancestor, depth``: each name with itself (0) and everything above it; a cycle ends
    where it would repeat."""
    up = parents.where(F.col(parent).isNotNull()).select(F.col(name).alias("ancestor"), F.col(parent).alias("_up"))
    level = checkpointed(parents.select(name, F.col(name).alias("ancestor"), F.lit(0).alias("depth")))
    out = level
    while True:
        step = level.join(up, "ancestor").select(name, F.col("_up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
        level = checkpointed(step.join(out.select(name, "ancestor"), [name, "ancestor"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def with_virtual_parents(groups: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """Adds parents that are named but not declared, as roots."""
    missing = groups.where(F.col(parent).isNotNull()).select(F.col(parent).alias(name)).distinct().join(groups.select(name), name, "left_anti")
    return groups.select(name, parent).unionByName(missing.withColumn(parent, F.lit(None).cast(groups.schema[parent].dataType)))


def rollup_tree(groups: DataFrame, direct: DataFrame, values: Sequence[str], name: str = "name", parent: str = "parent") -> DataFrame:
    """Direct and total values of every group: its own and all descendants'."""
    tree = with_virtual_parents(groups, name, parent)
    own = direct.groupBy(name).agg(*[F.sum(v).alias(v) for v in values])
    total = ancestors(tree, name, parent).join(own, name).groupBy(F.col("ancestor").alias(name)).agg(*[F.sum(v).alias(f"total_{v}") for v in values])
    out = tree.join(own, name, "left").join(total, name, "left")
    return out.select(name, parent, *[F.coalesce(v, F.lit(0)).alias(f"direct_{v}") for v in values], *[F.coalesce(f"total_{v}", F.lit(0)).alias(f"total_{v}") for v in values])


def root_of(parents: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    return ancestors(parents, name, parent).groupBy(name).agg(F.max_by("ancestor", "depth").alias("root"))


# ---- external nodes, rules on edges, tests


def external_nodes(edges: DataFrame) -> DataFrame:
    """One node for each status and label that edges without a target name, with its references."""
    out = edges.where("target is null")
    return out.groupBy(F.concat_ws(":", "status", "external").alias("node"), "status", "external").agg(F.count("*").alias("references"))


def forbidden_edges(edges: DataFrame, nodes: DataFrame, from_, to) -> DataFrame:
    """Edges whose source and target satisfy predicates over ``source_*`` and ``target_*`` columns of ``nodes``."""
    end = lambda side: nodes.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in nodes.columns])
    return edges.join(end("source"), "source").join(end("target"), "target").where(from_ & to)


def layers_of(nodes: DataFrame, layers: Sequence[tuple[str, Sequence[str]]], name: str = "path") -> DataFrame:
    """``node, layer``: every layer one of whose globs a node's name matches."""
    own = [F.when(glob_any(name, globs), F.lit(layer)) for layer, globs in layers]
    return nodes.select("node", F.explode(F.array_compact(F.array(*own))).alias("layer"))


def layer_faults(edges: DataFrame, layers: DataFrame, allowed: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """``fault, source, target`` against ``layers (node, layer)`` and ``allowed (from_layer, to_layer)``: nodes in no layer or
    in several, and edges between layers that aren't allowed.  Edges that ``legacy (source, target)`` excepts are no faults; an
    exception that excepts nothing is ``stale``."""
    n = layers.groupBy("node").agg(F.count_distinct("layer").alias("n"), F.min("layer").alias("layer"))
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.where("target is not null").select(F.col("target").alias("node"))).distinct().join(n, "node", "left")
    none = nodes.where("n is null").select(F.lit("unclassified").alias("fault"), F.col("node").alias("source"), F.lit(None).cast("string").alias("target"))
    many = nodes.where("n > 1").select(F.lit("ambiguous").alias("fault"), F.col("node").alias("source"), F.lit(None).cast("string").alias("target"))
    one = n.where("n = 1")
    across = edges.join(one.select(F.col("node").alias("source"), F.col("layer").alias("from_layer")), "source").join(one.select(F.col("node").alias("target"), F.col("layer").alias("to_layer")), "target").where("from_layer <> to_layer")
    bad = across.join(allowed, ["from_layer", "to_layer"], "left_anti").select(F.lit("not_allowed").alias("fault"), "source", F.col("target").cast("string").alias("target"))
    if legacy is not None:
        known = legacy.select("source", F.col("target").cast("string").alias("target")).distinct()
        stale = known.join(bad, ["source", "target"], "left_anti").select(F.lit("stale").alias("fault"), "source", "target")
        bad = bad.join(known, ["source", "target"], "left_anti").unionByName(stale)
    return none.unionByName(many).unionByName(bad)


def edge_coverage(edges: DataFrame, tests: DataFrame, evidence: int = 10) -> DataFrame:
    """Internal edges of non-test sources that some test proves by having edges to both ends."""
    own = edges.where("target is not null").select("source", "target").distinct()
    by_test = own.join(tests.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("source").alias("test"), F.col("target").alias("node"))
    plain = own.join(tests.select(F.col("node").alias("source")), "source", "left_anti")
    proof = plain.join(by_test.select("test", F.col("node").alias("source")), "source").join(by_test.select("test", F.col("node").alias("target")), ["test", "target"])
    w = Window.partitionBy("source", "target").orderBy("test")
    return proof.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= evidence).groupBy("source", "target").agg(F.lit(1.0).alias("coverage"), F.array_sort(F.collect_list("test")).alias("evidence"))


def session_graph(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A small edge table from ``(source, target)`` pairs, for policies and tests."""
    return spark.createDataFrame(list(rows), "source long, target long")
