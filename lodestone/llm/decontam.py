"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED`` words shared by a document and a benchmark item.  Documents'
runs pass a bitmap of the benchmark's runs (of fixed size, so that it can be broadcast
however large the benchmark is), and the rest are joined exactly.  An item can only leak where more of its places
match than some number; so many places, those of the runs that most items share, propose no pairs
and are looked up for the proposed ones, so that a stem of thousands of items doesn't pair each of them
with each text that has it.  Places where a text repeats itself with a short period are one row on either side, so a text of one word, again and again,
makes as many rows as it has words.  For each pair of document
and item with enough shared words, tiles are marked: the longest
matches that overlap nothing marked so far, again and again, down to ``SEED`` words.

Of running Karp-Rabin the hashes of the least length are what is needed here: as all runs of ``SEED`` words are hashed and joined, a longer
match is a row of neighbouring places on a diagonal, so no hash is rolled at a falling length; equal words are told by 64-bit
hashes under a seed of the job.
An item is leaked where tiles cover at least a share of its words, in whatever order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bitmaps import Bitmap, bitmap_of
from lodestone.llm.shared import materialise
from lodestone.llm.textcore import job_seed, shingle_hashes, word_hashes

SEED = 5


def progressions(run: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of runs as ``run, first, n, step``.  Places of one run that follow one another by the same step of at most ``length`` (the run
    overlaps or touches itself, so the words there repeat with that period) are one row; else each is a row of its own, of step 0."""
    order = np.lexsort((at, run))
    r, p = run[order], at[order]
    gap = np.diff(p)
    near = (np.diff(r) == 0) & (gap <= length)
    # A row goes on with a gap that is near and as wide as its first one; a place belongs to the first row that takes it.
    step = np.where(near, gap, 0)
    goes_on = np.concatenate(([False], near))[: len(r)]
    goes_on[2:] &= (step[1:] == step[:-1]) | ~near[:-1]
    starts = np.flatnonzero(~goes_on)
    n = np.diff(np.append(starts, len(r)))
    of = np.append(step, 0)[starts]
    return r[starts], p[starts], n, np.where(n > 1, of, 0)


def runs(table: DataFrame, names: list[str], text_col: str, length: int, salt: int, bitmap: Bitmap | None = None) -> DataFrame:
    """``names``, ``_words`` (how many the text has), and rows ``_run, _at, _n, _step`` for the runs of
    words (by hash under ``salt``) that the bitmap has, as ``progressions``; texts with fewer words have no runs."""
    sent = None if bitmap is None else table.sparkSession.sparkContext.broadcast(bitmap)
    kinds = ", ".join(f"{n} {table.schema[n].dataType.simpleString()}" for n in names)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = None if sent is None else sent.value
        for b in batches:
            for first, last, hashes, offsets in word_hashes(b["_text"], salt):
                rows, found = [], []
                for i in range(last - first):
                    words = hashes[offsets[i] : offsets[i + 1]]
                    if len(words) < length:
                        continue
                    h = shingle_hashes(words, length)
                    own = np.arange(len(h)) if seen is None else np.flatnonzero(seen.has(h))
                    found.append(progressions(h[own], own, length))
                    rows.append(np.full(len(found[-1][0]), first + i))
                if rows:
                    row = np.concatenate(rows)
                    run, at, n, step = (np.concatenate(x) for x in zip(*found, strict=True))
                    out = b.iloc[row].drop(columns="_text")
                    yield out.assign(_words=(offsets[1:] - offsets[:-1])[row - first], _run=run.view(np.int64), _at=at, _n=n, _step=step)

    return table.select(*names, F.col(text_col).alias("_text")).mapInPandas(explode, f"{kinds}, _words int, _run long, _at int, _n int, _step int")


def tile(doc_at: np.ndarray, item_at: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(document word, item word, words)`` from the places of shared seeds."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    new = np.concatenate(([True], (np.diff(d) != 1) | (np.diff(d - i) != 0)))
    starts = np.flatnonzero(new)
    return tile_matches(d[starts], i[starts], np.diff(np.append(starts, len(d))) + seed - 1, seed)


def tile_matches(doc_at: np.ndarray, item_at: np.ndarray, words: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """The tiles of whole matches, each the longest on its place of a diagonal.

    Longest first: a match that still has
    ``seed`` unmarked words in a row is cut to them and marked when it is the longest left;
    ties go to the first place in the item, then in the document."""
    waiting: dict[int, list[tuple[int, int]]] = {}
    for a, b, n in zip(item_at.tolist(), doc_at.tolist(), words.tolist(), strict=True):
        waiting.setdefault(n, []).append((a, b))
    tiles = []
    used_i, used_d = (np.zeros(int((at + words).max()) + 1, dtype=bool) for at in (item_at, doc_at))
    while waiting:
        size = max(waiting)
        for a, b in sorted(waiting.pop(size)):
            used = used_i[a : a + size] | used_d[b : b + size]
            if not used.any():
                tiles.append((b, a, size))
                used_i[a : a + size] = used_d[b : b + size] = True
                continue
            edge = np.diff(np.concatenate(([True], used, [True])).view(np.int8))
            for k, end in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
                if end - k >= seed:  # what is free of it waits for its own length
                    waiting.setdefault(end - k, []).append((a + k, b + k))
    return tiles


def ranked_places(grams: DataFrame, min_coverage: float, seed: int) -> DataFrame:
    """``grams`` and ``_common``: true for an item's places of the runs that most items share, one
    fewer than a leak needs; runs of a single place stay out."""
    often = grams.groupBy("_run").agg(F.sum("_n").alias("_often"))
    upto = F.sum("_n").over(Window.partitionBy("_item", "_item_text").orderBy(F.col("_often").desc(), "_item_at", "_run").rowsBetween(Window.unboundedPreceding, 0))
    needed = F.ceil(F.col("_item_words") * F.lit(min_coverage) / seed - 1e-9)  # a place covers ``seed`` words at most
    return grams.join(often, "_run").withColumn("_common", (F.col("_often") > 1) & (upto < needed)).drop("_often")


def _segments(seed: int) -> Column:
    """The matches that a run's places in a document (_at, _n, _step) and in an item (_item_at, _item_n, _item_step) make: an array of
    ``at, item_at, words``, one for each diagonal.

    Where both repeat by one step, or either is one place, the places on a diagonal follow one another by that step, which isn't more
    than ``seed``, so they are one match; there are as many diagonals as places on both sides, not as many as pairs."""
    d, i = F.col("_n"), F.col("_item_n")
    step = F.greatest("_step", "_item_step")

    def along(delta: Column) -> Column:
        k, j = F.greatest(delta, F.lit(0)), F.greatest(-delta, F.lit(0))
        return F.struct((F.col("_at") + k * step).alias("at"), (F.col("_item_at") + j * step).alias("item_at"), ((F.least(d - k, i - j) - 1) * step + seed).alias("words"))

    each = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda k: F.transform(each(i), lambda j: F.struct((F.col("_at") + k * F.col("_step")).alias("at"), (F.col("_item_at") + j * F.col("_item_step")).alias("item_at"), F.lit(seed).alias("words")))
    return F.when((F.col("_step") == F.col("_item_step")) | (d == 1) | (i == 1), F.transform(F.sequence(1 - i, d - 1), along)).otherwise(F.flatten(F.transform(each(d), pair)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = 0.5, seed: int = SEED) -> DataFrame:
    """One row per leaked pair: ``doc_id, item_id, item_words, covered_words, coverage, tiles`` (an
    array of ``doc_word, item_word, words``).

    Words are lower-cased runs of letters and digits.  Items of fewer than ``seed`` words leak nowhere, as
    do null texts and ids.  Rows that share an id and a text count once; of rows that share an id, each text is
    tiled alone and the best coverage stays.  Columns other than id and text are not read.  An empty table on either side gives no rows.
    """
    salt = job_seed()
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_it")).where("_item is not null").dropDuplicates()
    grams = runs(items.withColumn("_item_text", F.xxhash64("_it")), ["_item", "_item_text"], "_it", seed, salt).select("_item", "_item_text", F.col("_words").alias("_item_words"), "_run", F.col("_at").alias("_item_at"), "_n", F.col("_step").alias("_item_step"))
    grams = materialise(ranked_places(grams, min_coverage, seed))
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_dt")).where("_doc is not null").withColumn("_doc_text", F.xxhash64("_dt"))
    hits = runs(own, ["_doc", "_doc_text"], "_dt", seed, salt, bitmap_of(grams.select("_run"))).drop("_words")
    hits = materialise(hits.join(grams.select("_run").distinct(), "_run", "left_semi"))

    pair = ["_doc", "_doc_text", "_item", "_item_text", "_item_words"]
    places = ["_at", "_n", "_step", "_item_at", "_item_n", "_item_step"]
    grams = grams.withColumnRenamed("_n", "_item_n")
    proposed = hits.join(grams.where("not _common"), "_run").select(*pair, *places)
    common = grams.where("_common").select("_item", "_item_text", "_run", "_item_at", "_item_n", "_item_step")
    looked_up = proposed.select(*pair).distinct().join(common, ["_item", "_item_text"]).join(hits, ["_doc", "_doc_text", "_run"]).select(*pair, *places)
    # Places are joined to whole matches along their diagonals first, of which a pair has no more than the words of both.
    cut = proposed.unionByName(looked_up).select(*pair, F.explode(_segments(seed)).alias("s")).select(*pair, "s.*", (F.col("s.at") - F.col("s.item_at")).alias("_diagonal"))
    along = Window.partitionBy(*pair, "_diagonal").orderBy("at", "words")
    reached = F.max(F.col("at") + F.col("words")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("at") > reached).cast("int"), F.lit(0))
    matches = cut.withColumn("_fresh", fresh).withColumn("_match", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*pair, "_diagonal", "_match")
    matches = matches.agg(F.min("at").alias("_at"), F.min("item_at").alias("_item_at"), (F.max(F.col("at") + F.col("words")) - F.min("at")).alias("_n"))
    matches = matches.groupBy(*pair).agg(F.collect_list(F.struct("_item_at", "_at", "_n")).alias("_matches"))
    # The most that tiles can cover is what matches cover together: few pairs pass.
    reach = F.aggregate(
        F.array_sort("_matches"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, m: F.struct((s["n"] + F.greatest(m["_item_at"] + m["_n"] - F.greatest(m["_item_at"], s["to"]), F.lit(0))).alias("n"), F.greatest(m["_item_at"] + m["_n"], s["to"]).alias("to")), lambda s: s["n"],
    )
    likely = matches.where(reach >= F.col("_item_words") * F.lit(min_coverage))

    @F.pandas_udf("array<struct<doc_word: int, item_word: int, words: int>>")
    def tiled(column: pd.Series) -> pd.Series:
        out = []
        for found in column:
            m = np.array([(x["_at"], x["_item_at"], x["_n"]) for x in found], dtype=np.int64)
            out.append([{"doc_word": d, "item_word": i, "words": n} for d, i, n in sorted(tile_matches(m[:, 0], m[:, 1], m[:, 2], seed))])
        return pd.Series(out)

    found = likely.withColumn("tiles", tiled("_matches")).withColumn("covered_words", F.aggregate("tiles", F.lit(0), lambda s, t: s + t["words"]))
    found = found.withColumn("coverage", F.col("covered_words") / F.col("_item_words")).where(F.col("coverage") >= min_coverage)
    best = found.groupBy("_doc", "_item").agg(F.max(F.struct("coverage", "covered_words", F.col("_item_words").alias("item_words"), "tiles")).alias("b"))
    return best.select(F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), "b.item_words", "b.covered_words", "b.coverage", "b.tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose id has no leaked item, with all their columns; null ids stay."""
    leaked = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, min_coverage).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, F.col(id_col) == F.col("_leaked"), "left_anti")
