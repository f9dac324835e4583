"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label.  The negatives of a positive
are the best rows of other labels whose scores lie in a window that ends at the positive's
score.  The windows of an anchor overlap, so they aren't searched one by one: the
positives' scores, the upper limits, split the scores into disjoint slots.  Each task
keeps the best k of each slot it sees (a combiner), tasks' slots are merged to the best k
of each slot, and a merge of slots from the lowest upwards gives the best k under each
limit.  As a window is what is best under its limit as far as its lower end, cutting
those k at the lower end answers it.

Anchors are held against all rows in blocks of bounded size, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise
from lodestone.llm.topk import EXACT, _products, padded

ROWS = 2048
PAIRS = 1 << 19  # pairs that a combiner gathers before it keeps the best


def labelled(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """``_id, _label, _v``: floor(scale * component) as doubles (held to 64 bits).  Rows with a null id, label or vector,
    or with null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), label.cast("string").alias("_label"), x.alias("_x"), F.when(~bad, whole).alias("_v"))
    return own.where("_id IS NOT NULL AND _label IS NOT NULL AND _v IS NOT NULL").drop("_x")


class Slots:
    """The best k pairs of each (anchor, slot) so far, by descending score, ties by ascending id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.floor = np.full(anchors * slots, np.iinfo(np.int64).min)  # the k-th best score, where there are k
        self.kept = np.empty((0, 3), np.int64)  # cell, score, id
        self.fresh: list[np.ndarray] = []
        self.waiting = 0

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        cell = anchor * self.slots + slot
        ok = score >= self.floor[cell]
        self.fresh.append(np.stack((cell[ok], score[ok], ids[ok]), 1))
        self.waiting += int(ok.sum())
        if self.waiting > PAIRS:
            self.best()

    def best(self) -> np.ndarray:
        rows = np.concatenate((self.kept, *self.fresh))
        rows = rows[np.lexsort((rows[:, 2], -1 - rows[:, 1], rows[:, 0]))]  # -1 - score can't overflow
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]
        self.kept, self.fresh, self.waiting = rows[place < self.k], [], 0
        return self.kept


class Anchors:
    """A block of anchors, which scores batches of rows."""

    def __init__(self, own: pd.DataFrame):
        self.width = max([1, *map(len, own["_v"])])
        self.ids = own["_id"].to_numpy(np.int64)
        self.v = padded(own["_v"].tolist(), self.width)
        self.codes, names = pd.factorize(own["_label"].to_numpy(object))
        self.names = pd.Index(names, dtype=object)

    def scores(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, codes of labels, and integer inner products with each anchor (anchors by rows)."""
        x = padded(rows["_v"].tolist(), self.width)
        code = self.names.get_indexer(rows["_label"].to_numpy(object))
        if len(x) and len(self.v) and np.abs(x).max() * np.abs(self.v).max() * self.width >= EXACT:
            score = np.stack([_products(x, v) for v in self.v])
        else:
            score = np.rint(self.v @ x.T).astype(np.int64)
        return rows["_id"].to_numpy(np.int64), code, score


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.iloc[at : at + ROWS]


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, least: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, block: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are the ``positives`` best other
    rows of its label (column ``label`` unless given), by integer inner product of quantised vectors, ties to smaller ids.  Its
    negatives for a positive of score p are the ``k`` best rows of other labels whose score n has
    ``least[0] * p <= least[1] * n <= least[1] * p``.

    Rows without an id, a label or a vector of finite components take no part.  Of rows that share an anchor's id the smallest
    (label, vector) is the anchor; the others answer as all rows do, each by itself, so repeated rows are several positives or
    negatives.  A shorter vector goes on with zeros.  Scores beyond 64 bits are cut to the largest there is.  At most about ``block`` anchors with
    their positives are broadcast at a time.  Other columns are not read.  An empty table gives no rows.
    """
    rows = labelled(vectors, id_col, vector_col, F.col("label") if label is None else label, scale)
    asks = rows.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("a")).select("_id", "a.*")
    n = asks.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:  # rows are quantised once for all blocks
        rows, asks = materialise(rows), materialise(asks)
    parts = []
    for at in range(blocks):
        anchors = Anchors(asks.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == at).toPandas())
        found = _negatives(rows, anchors, _positives(rows, anchors, positives), k, least)
        parts.append(found if blocks == 1 else materialise(found))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _positives(rows: DataFrame, anchors: Anchors, k: int) -> pd.DataFrame:
    """``anchor`` (its number in the block), ``place, id, score`` of the k best other rows of its label."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        found = Slots(len(own.ids), 1, k + 1)  # the anchor itself may be among them
        for b in _batches(batches) if len(own.ids) else ():
            ids, code, score = own.scores(b)
            a, r = np.nonzero(own.codes[:, None] == code)
            found.add(a, np.zeros(len(a), np.int64), score[a, r], ids[r])
        best = found.best()
        yield pd.DataFrame({"anchor": best[:, 0], "score": best[:, 1], "id": best[:, 2]})

    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    best = rows.mapInPandas(search, "anchor int, score long, id long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).toPandas()
    # The anchor's own row, where it is among them, is one of those with its id and its own score.
    own = np.array([int(_products(v[None], v)[0]) for v in anchors.v], np.int64)
    best = best.sort_values(["anchor", "place"], ignore_index=True)
    at = best["anchor"].to_numpy(np.int64)
    itself = (best["id"].to_numpy() == anchors.ids[at]) & (best["score"].to_numpy() == own[at])
    best = best.drop(index=best[itself].drop_duplicates("anchor").index)
    best["place"] = best.groupby("anchor").cumcount()
    return best[best["place"] < k]


def _negatives(rows: DataFrame, anchors: Anchors, positives: pd.DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """The negatives of all positives of a block."""
    spark = rows.sparkSession
    n = len(anchors.ids)
    slots = max(1, int(positives.groupby("anchor")["score"].nunique().max()) if len(positives) else 1)
    # Slot s of an anchor holds the scores up to limits[s] and over limits[s + 1]; limits descend, and the last one's slot has no end.
    limits = np.full((n, slots), np.iinfo(np.int64).min)
    low = np.full(n, np.iinfo(np.int64).max)  # under this no window goes; anchors without positives take nothing
    for a, group in positives.groupby("anchor"):
        own = sorted(set(group["score"].tolist()), reverse=True)
        limits[a, : len(own)] = own
        low[a] = min(_lower(p, least) for p in own)
    sent = spark.sparkContext.broadcast((anchors, limits, low))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, upper, lower = sent.value
        found = Slots(len(own.ids), slots, k)
        for b in _batches(batches) if len(own.ids) else ():
            ids, code, score = own.scores(b)
            a, r = np.nonzero((score <= upper[:, :1]) & (score >= lower[:, None]) & (own.codes[:, None] != code))
            s = score[a, r]
            found.add(a, (upper[a] >= s[:, None]).sum(1) - 1, s, ids[r])
        best = found.best()
        yield pd.DataFrame({"anchor": best[:, 0] // slots, "slot": best[:, 0] % slots, "score": best[:, 1], "id": best[:, 2]})

    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    best = rows.mapInPandas(search, "anchor int, slot int, score long, id long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    item = F.struct("place", "score", "id")
    held = best.groupBy("anchor").agg(*[F.array_sort(F.collect_list(F.when(F.col("slot") == s, item))).alias(f"_slot{s}") for s in range(slots)])  # k a slot at most
    # From the lowest slot upwards: the best under a limit are its slot's, then those under the next lower limit.
    under: list[Column] = []
    for s in reversed(range(slots)):
        under.insert(0, F.slice(F.concat(f"_slot{s}", under[0]), 1, k) if under else F.col(f"_slot{s}"))
    held = held.select("anchor", F.array(*under).alias("under"))

    asked = [(a, int(anchors.ids[a]), i, p, int((limits[a] > p).sum()), _lower(p, least)) for a, i, p in zip(*(positives[c].tolist() for c in ("anchor", "id", "score")), strict=True)]
    windows = spark.createDataFrame(asked, "anchor int, anchor_id long, positive_id long, positive_score long, _at int, _lower long")
    answered = held.join(F.broadcast(windows), "anchor")  # ``block`` times ``positives`` rows at most
    inside = F.filter(F.get("under", F.col("_at")), lambda x: (x["score"] >= F.col("_lower")) & (x["score"] <= F.col("positive_score")))
    answered = answered.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("_n", "_x"))
    return answered.select("anchor_id", "positive_id", (F.col("_n") + 1).cast("int").alias("rank"), F.col("_x.id").alias("negative_id"), "positive_score", F.col("_x.score").alias("negative_score"))


def _lower(score: int, least: tuple[int, int]) -> int:
    """The least whole n with least[0] * score <= least[1] * n, in 64 bits."""
    most = np.iinfo(np.int64)
    return min(max(-((-least[0] * score) // least[1]), most.min), most.max)
