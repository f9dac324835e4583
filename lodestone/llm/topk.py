"""Exact top-k inner-product search over quantised vectors.

For vectors q, x cut into segments of m components with means and deviations,
``|q - x|^2 >= sum m ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)``: a lower bound of the
distance, hence an upper bound of the inner product ``(|q|^2 + |x|^2 - |q - x|^2) / 2``,
which simplifies to ``sum m (mean_q mean_x + dev_q dev_x)``.  Bounds are taken coarse to
fine, each only for what the coarser ones left, and inner products only for survivors.

Queries are held against all rows in blocks of bounded size: a block is broadcast, each
partition keeps its own best k, and the best of those are taken per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise

LEVELS = (1, 4, 16)
ROWS = 2048
EXACT = 2**53  # doubles hold all whole numbers up to here


def _features(x: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose inner product bounds that of the vectors from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1)


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; larger ones are cut to the largest there is."""
    if len(x) and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT:
        own = [int(c) for c in q.tolist()]
        most = np.iinfo(np.int64)
        return np.array([min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), most.min), most.max) for row in x.tolist()], dtype=np.int64)
    return np.rint(x @ q).astype(np.int64)


def padded(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of ``width``; what a vector lacks is 0, and what a query lacks adds nothing."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors).astype(np.float64) if len(vectors) else np.empty((0, width))
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: min(len(v), width)] = v[:width]
    return out


class BlockSearch:
    """The best k candidates so far for each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors.astype(np.float64), k
        self.levels = [_features(self.q, s) for s in LEVELS]
        self.best = [np.empty((0, 2), np.int64) for _ in ids]  # score, id
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        x = vectors.astype(np.float64)
        slack = 1e-9 * (1 + np.abs(x).max() * np.abs(self.q).max() * x.shape[1])
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))
        alive = np.ones((len(self.ids), len(ids)), dtype=bool)
        for fq, segments in zip(self.levels, LEVELS, strict=True):
            # A level works on the queries and candidates of which any pair is left.
            rows, cols = rows[alive[rows].any(1)], cols[alive[:, cols].any(0)]
            if not len(rows) or not len(cols):
                return
            bound = fq[rows] @ _features(x[cols], segments).T
            alive[np.ix_(rows, cols)] &= bound + slack >= self.floor[rows, None]
        for r in rows[alive[rows].any(1)].tolist():
            c = np.flatnonzero(alive[r])
            score = _products(x[c], self.q[r])
            all_ = np.concatenate((self.best[r], np.stack((score, ids[c]), 1)))
            all_ = all_[np.lexsort((all_[:, 1], -all_[:, 0]))[: self.k]]
            self.best[r] = all_
            if len(all_) == self.k:
                self.floor[r] = all_[-1, 0]

    def result(self) -> pd.DataFrame:
        n = [len(b) for b in self.best]
        flat = np.concatenate(self.best) if n else np.empty((0, 2), np.int64)
        own = np.array([int(_products(q[None], q)[0]) for q in self.q], np.int64)
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "vec_id": flat[:, 1], "score": flat[:, 0], "own": np.repeat(own, n)})


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(_id, _v array<double>)``: floor(scale * component), as doubles (held to 64 bits).  Rows with a
    null id, a null vector, or null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("_v"))


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the
    k other rows of the largest inner product of quantised vectors, ties to smaller ids.

    Rows that ``quantised`` leaves out take no part.  Of rows that share a query's id the
    smallest vector asks; the others answer as all other rows do, each by itself.  A shorter vector goes on with
    zeros, so an empty one scores 0.  Scores beyond 64 bits are cut to the largest there is.  At most ``block`` queries are broadcast at a time.
    Columns other than id and vector are not read.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    spark = vectors.sparkSession
    asks = rows.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    n = asks.count()
    parts = []
    blocks = max(1, -(-n // block))
    asks = asks if blocks == 1 else materialise(asks)
    for at in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == at).toPandas()
        width = max([1, *map(len, own["_v"])])
        sent = spark.sparkContext.broadcast((own["_id"].to_numpy(np.int64), padded(own["_v"].tolist(), width)))

        def search(batches: Iterator[pd.DataFrame], sent=sent, width=width) -> Iterator[pd.DataFrame]:
            ids, queries = sent.value
            found = BlockSearch(ids, queries, k + 1)  # a query may find itself
            for b in batches:
                for a in range(0, len(b) if len(ids) else 0, ROWS):
                    part = b.iloc[a : a + ROWS]
                    found.add(part["_id"].to_numpy(np.int64), padded(part["_v"].tolist(), width))
            yield found.result()

        best = rows.mapInPandas(search, "query_id long, vec_id long, score long, own long")
        parts.append(best if blocks == 1 else materialise(_ranked(best, k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _ranked(out, k) if blocks == 1 else out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # The query's own row, where it is among them, is one of those with its id and its own score.
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    gone = F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("query_id"))
    found = found.withColumn("gone", gone).where("gone IS NULL OR place <> gone")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
