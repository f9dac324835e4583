"""Byte-level BPE ids for batches of texts, through the ``tokenizers`` library.

The library is asked for each distinct pre-token once: byte-level BPE encodes
pre-tokens independently, so a text's ids are those of its pre-tokens in a row.
Pre-token bounds come from numpy over code points, with character classes taken
from the library's own pre-tokenizer.  The memo is bounded and lives as long as
the Python worker; it is looked up by hash, and what it finds is compared character by
character.  Long texts are cut where a pre-token surely starts.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd

from lodestone.llm.textcore import hash_runs, job_seed

CHUNK_CHARS = 1 << 20
MEMO_ENTRIES = 3 << 19
JOINED = 500
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255
_BLANK = "\u0120"  # how the vocabulary writes a blank
# Endings that the pre-tokenizer joins to an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_tokenizer() -> str:
    """The installed path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memo:
    """Numbers of 64-bit hashes: a table with open addressing, filled and read by whole arrays."""

    def __init__(self, entries: int):
        self.mask = (1 << (entries + entries // 2).bit_length()) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.held = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        h = np.maximum(hashes, np.uint64(1))  # 0 marks free places
        out, at, left = np.full(len(h), -1, np.int64), (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            there = self.keys[at[left]]
            hit = there == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + 1) & self.mask
        return out

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct hashes that it lacks."""
        h = np.maximum(hashes, np.uint64(1))
        at, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        self.held += len(h)
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            own = free[self.keys[at[free]] == h[free]]  # of several that want a place the last gets it
            self.values[at[own]] = numbers[own]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + 1) & self.mask


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _same(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> bool:
    """Whether all runs of ``a`` are those of ``b``."""
    return np.array_equal(a_sizes, b_sizes) and np.array_equal(a[_ranges(a_starts, a_sizes)], b[_ranges(b_starts, b_sizes)])


def _text(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> str:
    """The words at ``starts`` in a row."""
    if len(starts) == 1:
        return points[starts[0] : starts[0] + sizes[0]].tobytes().decode("utf-32-le", "surrogatepass")
    return points[_ranges(starts, sizes)].tobytes().decode("utf-32-le", "surrogatepass")


class ByteBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens in a text are text
        self.kind = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that start with a blank
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == _BLANK]] = True
        self.seed = job_seed()
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo(MEMO_ENTRIES)
        self.flat = np.empty(0, np.int32)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.chars, self.char_at = np.empty(0, np.uint32), np.zeros(1, np.int64)  # what the entries stand for

    def _classify(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == _UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                c = chr(p)
                alone = [k for k, near in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(near + c + near)) == 1]
                self.kind[p] = alone[0] if alone else _SPACE
            kinds = self.kind[points]
        return kinds

    def _starts(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``breaks`` are the starts of texts."""
        n = len(points)
        kinds = self._classify(points)
        new = np.ones(n, dtype=bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[breaks] = True
        last = np.ones(n, dtype=bool)  # last of its run
        last[:-1] = new[1:]
        start = new.copy()
        ends_text = np.zeros(n, dtype=bool)
        ends_text[np.append(breaks[1:], n) - 1] = True
        # The last character of white space before other text stands apart; a blank goes to what follows.
        apart = np.flatnonzero((kinds == _SPACE) & last & ~ends_text)
        start[apart] = True
        blank = apart[points[apart] == 32]
        start[blank + 1] = False
        # An apostrophe that starts a pre-token takes one of the endings with it.
        for p in np.flatnonzero((points == 39) & start & last & ~ends_text).tolist():
            if kinds[p + 1] != _LETTER:
                continue
            tail = "".join(map(chr, points[p + 1 : p + 3].tolist()))
            for e in _ENDINGS:
                stop = p + 1 + len(e)
                if tail.startswith(e) and not (len(e) == 2 and new[p + 2]):
                    start[p + 1] = False
                    if stop < n:
                        start[stop] = start[stop] or kinds[stop] == _LETTER
                    break
        return np.flatnonzero(start)

    def _encode_words(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words at ``starts`` in the order returned last, and how many each word has.  Words that start with
        a blank stay apart in a joined text, where the library is faster; only their first ids start with it."""
        joins = (points[starts] == 32) & (sizes > 1)
        joins[joins] = self.kind[points[starts[joins] + 1]] != _SPACE
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        n = int(joins.sum())
        flat, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        text = _text(points, starts[order[:n]], sizes[order[:n]])
        cuts = np.concatenate(([0], np.cumsum(sizes[order[:n]])))[[*range(0, n, JOINED), n]].tolist()
        for e in self.tokenizer.encode_batch_fast([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            flat.append(ids)
            counts.append(np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))
        alone = [_text(points, starts[i : i + 1], sizes[i : i + 1]) for i in order[n:]]
        for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            flat.append(np.array(e.ids, np.int32))
            counts.append(np.array([len(e.ids)]))
        return np.concatenate(flat), np.concatenate(counts), order

    def _learn(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        flat, counts, order = self._encode_words(points, starts, sizes)
        first, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], size[order] = len(self.flat) + np.cumsum(counts) - counts, counts
        self.memo.put(hashes, len(self.first) + np.arange(len(hashes)))
        self.first, self.size = np.concatenate((self.first, first)), np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))
        self.char_at = np.concatenate((self.char_at, len(self.chars) + np.cumsum(sizes)))
        self.chars = np.concatenate((self.chars, points[_ranges(starts, sizes)]))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """By the library alone: for texts in which different words have one hash."""
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, np.int32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        from_ = np.cumsum(lens) - lens
        starts = self._starts(points, from_[lens > 0])
        sizes = np.diff(np.append(starts, len(points)))
        # The fewer bytes a character takes, the fewer are hashed; a word that comes in two widths has two entries.
        narrow = points.astype(next(kind for kind, most in ((np.uint8, 0xFF), (np.uint16, 0xFFFF), (np.uint32, 0x10FFFF)) if points.max() <= most))
        width = narrow.itemsize
        hashes = hash_runs(narrow.view(np.uint8), starts * width, sizes * width, self.seed + width)
        codes, distinct = pd.factorize(hashes)
        at = np.empty(len(distinct), np.int64)
        at[codes] = np.arange(len(codes))  # a place where each stands
        own, many = starts[at], sizes[at]
        if not np.array_equal(sizes, many[codes]) or not np.array_equal(narrow, narrow[_ranges(own[codes], sizes)]):
            return self._plain(texts)
        slots = self.memo.find(distinct)
        missing = np.flatnonzero(slots < 0)
        if self.memo.held + len(missing) > MEMO_ENTRIES:  # it begins anew with what this chunk holds
            self._forget()
            missing, slots = np.arange(len(distinct)), np.full(len(distinct), -1, np.int64)
        known = np.flatnonzero(slots >= 0)
        if not _same(points, own[known], many[known], self.chars, self.char_at[slots[known]], self.char_at[slots[known] + 1] - self.char_at[slots[known]]):
            return self._plain(texts)
        if len(missing):
            slots[missing] = len(self.first) + np.arange(len(missing))
            self._learn(distinct[missing], points, own[missing], many[missing])
        slot = slots[codes]
        size, first = self.size[slot], self.first[slot]
        ends = np.cumsum(size)
        ids = self.flat[_ranges(first, size)]
        cut = np.concatenate(([0], ends))[np.searchsorted(starts, np.append(from_, len(points)))]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text as int32 arrays; null texts count as empty."""
        out: list[np.ndarray] = []
        texts = [t or "" for t in texts]
        at = 0
        while at < len(texts):
            if len(texts[at]) > CHUNK_CHARS:
                out.append(np.concatenate([ids for piece in self._pieces(texts[at]) for ids in self._chunk([piece])]))
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= CHUNK_CHARS:
                size += len(texts[end])
                end += 1
            out += self._chunk(texts[at:end])
            at = end
        return out

    def _pieces(self, text: str) -> Iterator[str]:
        """``text`` cut into pieces of about CHUNK_CHARS where a pre-token surely starts: behind a character that isn't white
        space, and far enough from the end of what is looked at that the rest can't matter."""
        at = 0
        while len(text) - at > CHUNK_CHARS:
            size, cut = CHUNK_CHARS, 0
            while not cut and at + size < len(text):
                points = np.frombuffer(text[at : at + size].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                starts = self._starts(points, np.zeros(1, np.int64))
                starts = starts[(starts > 0) & (starts < size - 4)]
                starts = starts[self.kind[points[starts - 1]] != _SPACE]
                cut, size = int(starts[-1]) if len(starts) else 0, 2 * size  # a longer window where one pre-token fills it
            if not cut:
                break
            yield text[at : at + cut]
            at += cut
        yield text[at:]


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
