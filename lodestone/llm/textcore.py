"""Word hashing over batches of texts with numpy, used inside Arrow batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text.  Words never cross texts, so a batch is hashed as one byte array.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Iterator

import numpy as np
import xxhash

CHUNK_CHARS = 1 << 20
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[ord("0") : ord("9") + 1] = True
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[0x80:] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # the first bytes of a lane
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LONGEST = 256  # bytes of a word that is hashed by lanes
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply rounds)."""
    return _mixed(x.astype(np.uint64, copy=True))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut at separators into parts of about CHUNK_CHARS."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        m = _SEPARATOR.search(text, at + CHUNK_CHARS)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def job_seed() -> int:
    """A seed for the hashes of one job, drawn in the driver, so that no text can be written against it."""
    return secrets.randbits(63)


def hash_runs(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of bytes.  Eight bytes at a time go through a mixer that isn't linear in
    them; runs of over _LONGEST bytes are hashed by xxh3, each by itself."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))  # from each byte on
    lens = lens.astype(np.int64)
    out = mix64(lens.astype(np.uint64) * _STEP + np.uint64(seed))
    own = np.flatnonzero(lens <= _LONGEST)
    at = 0
    while len(own):
        left = lens[own] - at
        own, left = own[left > 0], left[left > 0]
        lane = lanes[starts[own] + at] & _MASK[np.minimum(left, 8)]
        out[own] = _mixed(lane ^ out[own])
        at += 8
    for i in np.flatnonzero(lens > _LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lens[i]], seed)
    return out


def _hash_words(joined: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.diff(np.concatenate(([0], _WORD_BYTE[raw].view(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return hash_runs(raw, starts, np.flatnonzero(edge == -1) - starts, seed), starts


def word_hashes(texts, seed: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields ``(first, last, hashes, offsets)``: the words of texts[first:last] in
    order; those of text ``first + i`` are ``hashes[offsets[i]:offsets[i + 1]]``.
    Null texts have no words."""
    texts = [t.lower() if t else "" for t in texts]
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK_CHARS:
            h = np.concatenate([_hash_words(p, seed)[0] for p in _pieces(texts[at])])
            yield at, at + 1, h, np.array([0, len(h)])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= CHUNK_CHARS:
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        h, starts = _hash_words("\n".join(part), seed)
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in part])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        yield at, end, h, np.searchsorted(starts, bounds)
        at = end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, by start; one run of all words if there are fewer.  Each word is mixed in
    before the next one comes."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for w in range(k):
        out *= _STEP
        out ^= words[w : w + n]
        _mixed(out)
    return out
