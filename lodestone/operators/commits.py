"""Commit graphs ``(sha, parent)``: best common ancestors of any number of pairs at once.

Runs of commits with one parent and one child are contracted to chains, by pointer doubling, so that rounds grow with the merges
and branches on a path, not with its commits.  Of a chain a traversal reaches all from some place down, and it enters every chain
but its first one at the top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import checkpointed, release, tasks

HOPS = 2  # chains that a round goes down


def chains(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sha, chain, place)`` of all commits, where a chain is named by its oldest commit and places count up from 0 there, and
    ``(chain, next, top)``: the chains that a chain's oldest commit has its parents in, and their last places."""
    own = checkpointed(parents.select("sha", "parent").distinct())
    known = own.select("sha").unionByName(own.where("parent IS NOT NULL").select(F.col("parent").alias("sha"))).distinct()
    links = own.where("parent IS NOT NULL")
    single = links.groupBy("sha").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    only = links.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    up = single.join(only, "parent").select("sha", F.col("parent").alias("to"))
    # Each commit points at the oldest that it has found, and how far that is; what that one has found is added.
    at = checkpointed(known.join(up, "sha", "left").select("sha", F.coalesce("to", "sha").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("far")))
    for _ in range(known.count().bit_length() + 1):
        ahead = at.select(F.col("sha").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        further = checkpointed(at.join(ahead, "to").select("sha", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), (F.col("_far") > 0).alias("moved")))
        release(at)
        at = further
        if at.where("moved").isEmpty():
            break
    else:
        raise ValueError("commits lead back to themselves")
    places = at.select("sha", F.col("to").alias("chain"), F.col("far").alias("place"))
    target = places.select(F.col("sha").alias("parent"), F.col("chain").alias("next"), F.col("place").alias("top"))
    down = links.join(places.where("place = 0").select("sha", "chain"), "sha").join(target, "parent").select("chain", "next", "top").distinct()
    return checkpointed(places), checkpointed(down)


def _reached(chains: DataFrame, down: DataFrame) -> DataFrame:
    """``start, chain, top, nexts``: for each of ``chains`` itself (``top`` is null) and all chains below, with the last place of
    each and the chains right below it (those of one commit's parents)."""
    nexts = down.groupBy("chain").agg(F.array_sort(F.collect_list("next")).alias("nexts"))
    steps = checkpointed(down.join(nexts.select(F.col("chain").alias("next"), "nexts"), "next", "left").select("chain", "next", "top", "nexts"))
    own = chains.distinct().join(nexts, "chain", "left").select(F.col("chain").alias("start"), "chain", F.lit(None).cast("long").alias("top"), "nexts")
    seen = [checkpointed(own)]
    ring, new = seen[0], seen[0].count()
    rows = new
    while new:
        rings, n = [], tasks(chains.sparkSession, rows)
        for _ in range(HOPS):
            ring = ring.select("start", "chain").join(steps, "chain").select("start", F.col("next").alias("chain"), "top", "nexts").repartition(n, "start", "chain").distinct()
            rings.append(ring)
        found, all_ = rings[0], seen[0]
        for r in rings[1:]:
            found = found.unionByName(r)
        for s in seen[1:]:
            all_ = all_.unionByName(s)
        found = found.repartition(n, "start", "chain").distinct()
        ring = checkpointed(found.join(all_.select("start", "chain").repartition(n, "start", "chain"), ["start", "chain"], "left_anti"))
        new = ring.count()
        rows += new
        seen.append(ring)
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


def merge_bases(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """``a, b, base``: the best common ancestors of each pair ``(a, b)``, those that no other common ancestor leads to; none, one, or
    several after criss-cross merges.  A commit is an ancestor of itself.

    ``parents (sha, parent)`` has a row for each parent; roots have one with null or none.  Pairs of unknown commits have no base.  All ancestors of a
    common ancestor are common, so a common chain is beaten exactly if another common one leads to it.

    What is below a chain is found once, however many pairs begin there.  Both sides of a pair are then dealt by pair, to as many
    tasks as their rows need."""
    places, down = chains(parents)
    numbered = checkpointed(pairs.select("a", "b").distinct().select("a", "b", F.monotonically_increasing_id().alias("pair")))
    side = lambda c: numbered.select("pair", F.col(c).alias("sha"), F.lit(c).alias("side")).join(places, "sha").select("pair", "side", F.col("chain").alias("start"), "place")
    ends = checkpointed(side("a").unionByName(side("b")))
    below = _reached(ends.select(F.col("start").alias("chain")), down)
    rows = ends.join(below.groupBy("start").agg(F.count("*").alias("n")), "start").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reached = ends.join(below, "start").select("pair", "chain", F.coalesce("top", "place").alias("place"), F.when(F.col("side") == "a", F.col("nexts")).alias("nexts"))
    common = reached.repartition(tasks(pairs.sparkSession, rows), "pair").groupBy("pair", "chain").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.max("nexts").alias("nexts")).where("n = 2")
    mark = lambda chain, place, beaten: F.struct(chain.alias("chain"), place.cast("long").alias("place"), F.lit(beaten).alias("beaten"))
    marks = F.concat(F.array(mark(F.col("chain"), F.col("place"), False)), F.transform(F.coalesce("nexts", F.array().cast(below.schema["nexts"].dataType)), lambda c: mark(c, F.lit(None), True)))
    marked = common.select("pair", F.explode(marks).alias("m")).select("pair", "m.chain", "m.place", "m.beaten")
    best = marked.groupBy("pair", "chain").agg(F.min("place").alias("place"), F.bool_or("beaten").alias("beaten")).where("NOT beaten").join(places, ["chain", "place"])
    return numbered.join(best, "pair").select("a", "b", F.col("sha").alias("base"))
