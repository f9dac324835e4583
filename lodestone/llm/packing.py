"""Packing documents into sequences of a fixed number of tokens.

Pieces are dealt at random to groups of a bounded number of sequences, so that each
group can be packed by one task; the loss is below one sequence a group.  A group starts with its pieces
put into sequences one after the other, longest first, and is packed by local search between
sequences that aren't full: moving a piece, exchanging one for one, or two for one, always so that the sum of
squared fills grows, until sequences empty.  The search ends when the free space proves that no
sequence can be saved, or no exchange helps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.huffman import ids_crc32
from lodestone.llm.shared import materialise
from lodestone.llm.tokens import byte_bpe

GROUP_SEQUENCES = 16384
GROUP_PIECES = 1 << 18  # very short pieces make more groups
TEXTS = 256


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each to the last bin or else a new one."""
    bins: list[list[int]] = []
    room = -1
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        if lengths[i] > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= lengths[i]
    return bins


class LocalSearch:
    """Bins that exchange pieces.  Bins that aren't full offer their room to single pieces, and each of their
    pieces as one that a larger piece (or two) may replace; both are looked up by size in a bit set."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, lengths, capacity
        self.room = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)  # offers of an older version don't count
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.by_reach: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]  # the most that fits in a piece's place
        self.rooms = self.reaches = 0  # bit n is set where there may be offers
        self.done = {"move": 0, "one for one": 0, "two for one": 0}
        for b in range(len(bins)):
            self._offer(b)

    def _offer(self, b: int) -> None:
        self.version[b] += 1
        room = self.room[b]
        if 0 < room < self.capacity:
            self.by_room[room].append((b, self.version[b]))
            self.rooms |= 1 << room
            for i in self.bins[b]:
                heapq.heappush(self.by_reach[self.size[i] + room], (self.size[i], b, i, self.version[b]))
                self.reaches |= 1 << self.size[i] + room

    def _bin_for(self, size: int, exactly: bool) -> int | None:
        """The bin of the least room that takes ``size``, or fills up with it."""
        while True:
            fits = self.rooms >> size
            if not fits or (exactly and not fits & 1):
                return None
            room = size + (fits & -fits).bit_length() - 1
            offers = self.by_room[room]
            while offers and self.version[offers[-1][0]] != offers[-1][1]:
                offers.pop()
            if offers:
                return offers[-1][0]
            self.rooms ^= 1 << room

    def _place_for(self, size: int, exactly: bool) -> tuple[int, int] | None:
        """A bin and a smaller piece of it in whose place ``size`` fits closest, or fills it up."""
        fits, reach = self.reaches >> size, size
        while fits:
            skip = (fits & -fits).bit_length() - 1
            fits, reach = fits >> skip, reach + skip
            if exactly and reach != size:
                return None
            offers = self.by_reach[reach]
            while offers and self.version[offers[0][1]] != offers[0][3]:
                heapq.heappop(offers)
            if not offers:
                self.reaches ^= 1 << reach
            elif offers[0][0] < size:
                return offers[0][1], offers[0][2]
            fits, reach = fits >> 1, reach + 1
        return None

    def _give(self, d: int, given: list[int], b: int, back: int | None = None) -> bool:
        """Moves pieces from bin d to b, and one back, where the sum of squared fills grows by it."""
        gain = sum(self.size[i] for i in given) - (0 if back is None else self.size[back])
        if self.room[d] + gain <= self.room[b]:
            return False
        for i in given:
            self.bins[d].remove(i)
        if back is not None:
            self.bins[b].remove(back)
            self.bins[d].append(back)
        self.bins[b] += given
        self.room[b] -= gain
        self.room[d] += gain
        self._offer(b)
        self.done["move" if back is None else "one for one" if len(given) == 1 else "two for one"] += 1
        return True

    def _step(self, d: int) -> bool:
        """One change that takes fill from bin d: better one that fills another bin up, then a move, then an exchange."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[d]:
            by_size.setdefault(self.size[i], []).append(i)
        sizes = sorted(by_size, reverse=True)
        pairs: dict[int, list[int]] = {}
        for n, x in enumerate(sizes):
            for y in sizes[n:]:
                if x != y or len(by_size[x]) > 1:
                    pairs.setdefault(x + y, [by_size[x][0], by_size[y][-1]])
        for exactly in (True, False):
            for x in sizes:
                b = self._bin_for(x, exactly)
                if b is not None and self._give(d, by_size[x][:1], b):
                    return True
            for x in sizes:
                place = self._place_for(x, exactly)
                if place and self._give(d, by_size[x][:1], *place):
                    return True
            for x in sorted(pairs, reverse=True):
                place = self._place_for(x, exactly)
                if place and self._give(d, pairs[x], *place):
                    return True
        return False

    def run(self) -> list[list[int]]:
        """The bins that are left."""
        for d in range(len(self.bins)):  # moves alone, from bins of long pieces to bins of short ones
            if 0 < self.room[d] < self.capacity:
                self.version[d] += 1
                for i in sorted(self.bins[d], key=self.size.__getitem__, reverse=True):
                    b = self._bin_for(self.size[i], False)
                    if b is not None:
                        self._give(d, [i], b)
                self._offer(d)
        least, better = -(-sum(self.size) // self.capacity), True
        used = sum(r < self.capacity for r in self.room)
        while better and used > least:
            better = False
            waiting = [(self.capacity - r, b) for b, r in enumerate(self.room) if 0 < r < self.capacity]
            heapq.heapify(waiting)
            while waiting and used > least:
                fill, d = heapq.heappop(waiting)
                if not 0 < self.room[d] < self.capacity:
                    continue
                if fill != self.capacity - self.room[d]:  # it has changed since
                    heapq.heappush(waiting, (self.capacity - self.room[d], d))
                    continue
                self.version[d] += 1  # a bin offers nothing to itself
                while self.room[d] < self.capacity and self._step(d):
                    better = True
                used -= self.room[d] == self.capacity
                self._offer(d)
        return [b for b in self.bins if b]


def local_search(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, as few as exchanges lead to."""
    return LocalSearch(next_fit(lengths, capacity), lengths, capacity).run()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all documents."""
    end = np.empty(0, np.int32) if end_id is None else np.array([end_id], np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for b in batches:
            for a in range(0, len(b), TEXTS):
                part = b.iloc[a : a + TEXTS]
                rows = []
                for name, ids in zip(part["_id"].tolist(), bpe.encode(part["_text"]), strict=True):
                    ids = np.concatenate((ids, end))
                    name = None if pd.isna(name) else int(name)
                    rows += [(name, n, s, size, ids_crc32(ids[s : s + size])) for n, (s, size) in enumerate(cut(len(ids), capacity))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=pd.array(out["doc_id"], dtype="Int64"))

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: a row per piece with
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents longer than a sequence are cut.  Null and empty texts hold the end id alone (with
    ``end_id=None`` they are pieces of length 0).  Repeated rows are packed as often as they come; a null id
    stays null.  Columns other than id and text are not read.  An empty table gives no rows.
    """
    parts = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    n = parts.agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    groups = max(1, -(-(n["tokens"] or 0) // (capacity * group_sequences)), -(-n["pieces"] // GROUP_PIECES))

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].tolist()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for n, members in enumerate(local_search(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 32) + n, at
                at += lengths[i]
        return group.assign(doc_id=group["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset).drop(columns="_group")

    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
