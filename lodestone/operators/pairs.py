"""Pairs counted through packed lists: a shuffle that holds about two bytes a pair instead of a row."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = 4_000_000  # that a task holds at once
OUT_ROWS = 65_536


class Grid(NamedTuple):
    """Buckets of pairs of ids from 0 to ``span``: lefts modulo ``p`` by rights modulo ``q``, so neither a frequent left nor a frequent
    right lies in one bucket.  A pair's key is its bucket and, densely, its place there."""

    span: int
    p: int
    q: int

    @property
    def width(self) -> int:
        return self.span // self.q + 1

    @property
    def room(self) -> int:
        return (self.span // self.p + 1) * self.width

    def keys(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left, right = x // self.p, y // self.q
        return ((x - left * self.p) * self.q + y - right * self.q) * self.room + left * self.width + right

    def ids(self, bucket: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = places // self.width, places % self.width
        return left * self.p + bucket // self.q, right * self.q + bucket % self.q


def grid(span: int, buckets: int) -> Grid:
    """Primes, so ids at even steps still go to all buckets."""
    p = _prime(isqrt(max(buckets, 1) - 1) + 1)
    return Grid(span, p, _prime(-(-buckets // p)))


def _prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, isqrt(n) + 1)):
        n += 1
    return n


def count_pairs(cells: DataFrame, span: int, made: int, pairs: int = PAIRS) -> DataFrame:
    """``x, y, n`` (x below y) of ``cells (a, b, within)``: arrays of ids from 0 to ``span``, of which all pairs within ``a`` count, or
    all of one in ``a`` and one in ``b``; ``made`` pairs in all."""
    g = grid(span, max(cells.sparkSession.sparkContext.defaultParallelism, -(-made // pairs)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x, y in _pairs(batch, max(pairs // 8, 1)):
                held.append(g.keys(x, y))
                n += len(x)
                if n >= pairs:
                    yield _packed(held, g)
                    held, n = [], 0
        if n:
            yield _packed(held, g)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, _Counts] = {}
        for batch in batches:
            for bucket, n, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault(bucket, _Counts(pairs)).add(_unpacked(packed, n, width))
        for bucket, c in counts.items():
            places, n = c.result()
            for at in range(0, len(places), OUT_ROWS):
                x, y = g.ids(bucket, places[at : at + OUT_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n[at : at + OUT_ROWS])], ["x", "y", "n"])

    packed = cells.select("a", "b", "within").mapInArrow(pack, "bucket int, n long, width int, packed binary")
    return packed.repartitionById(g.p * g.q, F.col("bucket")).mapInArrow(count, "x long, y long, n long")


def _pairs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the cells, about ``most`` at a time, the smaller id first."""
    (a, a_sizes), (b, b_sizes) = (_lists(batch.column(i)) for i in (0, 1))
    within, cell, at = batch.column(2).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(a_sizes)), a_sizes), np.arange(len(a))
    # each id of a goes with those that follow it in its cell, or with all of b's
    partners = np.concatenate([a, b])
    sizes = np.where(within[cell], np.cumsum(a_sizes)[cell] - at - 1, b_sizes[cell])
    starts = np.where(within[cell], at + 1, len(a) + (np.cumsum(b_sizes) - b_sizes)[cell])
    ends, i = np.cumsum(sizes), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        n, till = sizes[i:j], np.cumsum(sizes[i:j])
        x, y = np.repeat(a[i:j], n), partners[np.arange(till[-1]) + np.repeat(starts[i:j] - till + n, n)]
        yield np.minimum(x, y), np.maximum(x, y)
        i = j


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _packed(held: list[np.ndarray], g: Grid) -> pa.RecordBatch:
    """Sorted keys of each bucket as their steps: first all lowest bytes, then all second ones, as far as there are any."""
    keys = np.concatenate(held)
    keys.sort()
    cuts = np.searchsorted(keys, np.arange(g.p * g.q + 1) * g.room)
    rows = []
    for bucket in np.flatnonzero(np.diff(cuts)):
        steps = np.diff(keys[cuts[bucket] : cuts[bucket + 1]], prepend=bucket * g.room)
        width = max(1, -(-int(steps.max()).bit_length() // 8))
        planes = steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        rows.append((int(bucket), len(steps), width, pa.compress(planes, "zstd", asbytes=True)))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "n", "width", "packed"])


def _unpacked(packed: bytes, n: int, width: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(pa.decompress(packed, n * width, "zstd"), np.uint8).reshape(width, n).T
    return np.cumsum(steps.view("<i8").ravel())


class _Counts:
    """How often each place occurs; at most ``most`` places wait uncounted."""

    def __init__(self, most: int):
        self.most, self.waiting, self.n = most, [], 0
        self.places = self.counts = np.zeros(0, np.int64)

    def add(self, places: np.ndarray) -> None:
        self.waiting.append(places)
        self.n += len(places)
        if self.n >= self.most:
            self._fold()

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        return self.places, self.counts

    def _fold(self) -> None:
        if self.n:
            new = np.concatenate(self.waiting)
            new.sort()
            first = np.flatnonzero(np.diff(new, prepend=-1))
            places, counts = new[first], np.diff(first, append=len(new))
            if len(self.places):
                places, counts = np.concatenate([self.places, places]), np.concatenate([self.counts, counts])
                order = np.argsort(places, kind="stable")
                first = np.flatnonzero(np.diff(places[order], prepend=-1))
                places, counts = places[order][first], np.add.reduceat(counts[order], first)
            self.places, self.counts, self.waiting, self.n = places, counts, [], 0
