from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import huffman, packing, textcore
from lodestone.llm.tokens import byte_bpe, default_tokenizer

from .conftest import ODD, thue_morse, words

PIECES = ["a", "B", "é", "1", "٣", "½", "'", "'s", "'re", "'ll", " ", "  ", "\n", "　", "!", "_", "😀", "中", "́", "​", "\x00", "<|endoftext|>", "I'm", "\u0085"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=14).map("".join), max_size=5))
def test_ids_are_the_library_s(texts):
    bpe = byte_bpe(default_tokenizer())
    want = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(texts)] == want


def test_memo_is_bounded(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 50)
    bpe = tokens.ByteBpe(default_tokenizer())
    for n in range(5):
        text = " ".join(f"word{n}{k}" for k in range(30))
        assert bpe.encode([text])[0].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_one_hash(monkeypatch):
    """Where different words get one hash, in a chunk or in the memo, the ids are still the library's."""
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "hash_runs", lambda raw, starts, lens, seed: lens.astype(np.uint64))
    bpe = tokens.ByteBpe(default_tokenizer())
    for texts in (["abcd"], ["wxyz"], ["ab cd ef", "cd ab", ""], ["abcd", "efgh"]):
        assert [x.tolist() for x in bpe.encode(texts)] == [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_thue_morse_words():
    bpe = byte_bpe(default_tokenizer())
    texts = [t for size in (1 << 10, 1 << 13) for t in thue_morse(size)]
    assert [x.tolist() for x in bpe.encode(texts)] == [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size in range(10, 14):
        (_, _, h, _), = textcore.word_hashes([" ".join(thue_morse(1 << size))])
        assert h[0] != h[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "word ", " word", "aaaa", "    ", "it's ", "12 "]), min_size=20, max_size=120).map("".join))
def test_long_texts_are_cut_between_pre_tokens(text):
    from lodestone.llm import tokens

    bpe, before = byte_bpe(default_tokenizer()), tokens.CHUNK_CHARS
    tokens.CHUNK_CHARS = 16
    try:
        assert "".join(bpe._pieces(text)) == text
        assert bpe.encode([text])[0].tolist() == bpe.tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        tokens.CHUNK_CHARS = before


def test_word_hashes(monkeypatch):
    texts = [t for _, t in ODD]
    monkeypatch.setattr(textcore, "CHUNK_CHARS", 1000)
    seen, got = {}, []
    for first, last, h, o in textcore.word_hashes(texts):
        got += [h[o[i] : o[i + 1]].tolist() for i in range(last - first)]
    for text, own in zip(texts, got, strict=True):
        assert len(own) == len(words(text))
        for w, x in zip(words(text), own, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=600))
def test_codes_round_trip(ids):
    ids = np.array(ids, dtype=np.int64)
    n = np.bincount(ids, minlength=1)
    seen = np.flatnonzero(n)
    bits = huffman.code_lengths(n[seen], 10)
    assert bits.max(initial=0) <= 10 and (len(seen) < 2 or sum(2.0**-bits) == 1)
    book = huffman.Codebook(seen, bits)
    payload, at = book.encode(ids)
    assert book.decode(payload, at, len(ids)).tolist() == ids.tolist()


def test_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    n = np.sort((rng.pareto(0.5, 200) * 10 + 1).astype(np.int64))
    heap, free = [(int(x), i, (i,)) for i, x in enumerate(n)], np.zeros(200, int)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, k, y) = heapq.heappop(heap), heapq.heappop(heap)
        free[list(x + y)] += 1
        heapq.heappush(heap, (a + b, k, x + y))
    assert (huffman.code_lengths(n, 60) * n).sum() == (free * n).sum()
    assert huffman.code_lengths(n, 9).max() <= 9


def test_token_file(spark, odd, nothing, tmp_path):
    bpe = byte_bpe(default_tokenizer())
    path = str(tmp_path / "tokens")
    huffman.write_token_file(odd, path, default_tokenizer())
    got = huffman.read_token_file(spark, path).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for name, text in order:
        ids = bpe.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got), key=lambda r: r[1]) == want
    huffman.write_token_file(nothing, str(tmp_path / "none"), default_tokenizer())
    assert huffman.read_token_file(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("group", [1, 16384])
def test_packing(spark, odd, nothing, group):
    bpe = byte_bpe(default_tokenizer())
    got = packing.pack(odd, default_tokenizer(), capacity=64, group_sequences=group).collect()
    ids = [(n, bpe.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for n, t in ODD]
    want = sorted(((n, k, s, size, zlib.crc32(np.array(i[s : s + size], "<u4").tobytes())) for n, i in ids for k, (s, size) in enumerate(packing.cut(len(i), 64))), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    if group > 1:
        assert len(by) == -(-sum(len(i) for _, i in ids) // 64)
    assert packing.pack(nothing, default_tokenizer()).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for r in {b for b in bins if b + lengths[k] <= capacity}:
            rest = list(bins)
            rest[rest.index(r)] += lengths[k]
            place(k + 1, rest)
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def best_fit(lengths, capacity):
    """Best-fit decreasing, the yardstick."""
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - size)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=9))
def test_local_search(lengths):
    bins = packing.local_search(lengths, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 20 for b in bins)
    assert len(bins) <= fewest(lengths, 20) + 1


def test_exchanges_empty_bins():
    lengths = [10, 10, 9, 9, 8, 8, 8, 6, 6, 3, 3]
    search = packing.LocalSearch([[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [10]], lengths, 20)
    assert len(search.run()) == 5  # of 90 in all


def test_each_exchange_grows_squared_fill(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 900, 400).tolist()
    give, grown = packing.LocalSearch._give, []

    def watched(self, *args):
        before = sum((self.capacity - r) ** 2 for r in self.room)
        done = give(self, *args)
        grown.append(sum((self.capacity - r) ** 2 for r in self.room) > before or not done)
        return done

    monkeypatch.setattr(packing.LocalSearch, "_give", watched)
    search = packing.LocalSearch(packing.next_fit(lengths, 2048), lengths, 2048)
    assert len(search.run()) < best_fit(lengths, 2048)
    assert all(grown) and all(search.done.values())


def test_documents_are_packed_by_exchanges(spark):
    """On the given documents the search does the packing, and is no worse than best-fit decreasing."""
    bpe = byte_bpe(default_tokenizer())
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lengths = [n for ids in bpe.encode(texts) for _, n in packing.cut(len(ids) + 1, 2048)]
    search = packing.LocalSearch(packing.next_fit(lengths, 2048), lengths, 2048)
    start = len(search.bins)
    bins = search.run()
    assert sum(search.done.values()) > 100 and len(bins) < start
    assert len(bins) <= best_fit(lengths, 2048)
