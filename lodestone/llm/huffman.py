"""Token files: ids of tokenised documents under canonical length-limited Huffman codes.

A token file is a folder of two Parquet tables.  ``codebook`` holds ``(id, bits)``; the
codes follow from the lengths, in order of ``(bits, id)``.  ``blocks`` holds independent
blocks of whole documents in ascending order of document id: the number of ids before
the block, the documents and their lengths, the bit string, and the bit offset of every
``STRIDE``-th id.  A block is decoded by table, ``STRIDE`` ids deep and all checkpoints
side by side.

Code lengths come from the counts of all ids (at most one per vocabulary entry reach the
driver) by package-merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import drop_path, shared_path
from lodestone.llm.tokens import byte_bpe

STRIDE = 128
BLOCK_IDS = 1 << 18
MAX_BITS = 18
TEXTS = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with positive counts."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, dtype=np.int64)[order]
    packages, taken = np.empty(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        taken.append(by < n)
        both = both[by][: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(taken):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codebook:
    """Canonical codes for ``ids`` with ``bits`` each."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        by = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids, np.int64)[by], np.asarray(bits, np.int64)[by]
        self.top = int(self.bits.max()) if len(by) else 1
        width = np.int64(1) << (self.top - self.bits)
        at = np.cumsum(width) - width
        self.code = np.zeros(int(self.ids.max()) + 1 if len(by) else 1, np.uint64)
        self.code_bits = np.zeros(len(self.code), np.int64)
        self.code[self.ids] = (at >> (self.top - self.bits)).astype(np.uint64)
        self.code_bits[self.ids] = self.bits
        spare = (1 << self.top) - int(width.sum())
        self.table_id = np.concatenate((np.repeat(self.ids, width), np.zeros(spare, np.int64))).astype(np.int32)
        self.table_bits = np.concatenate((np.repeat(self.bits, width), np.ones(spare, np.int64)))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bit string and the bit offsets of every STRIDE-th id (little-endian uint64)."""
        bits = self.code_bits[ids]
        ends = np.cumsum(bits)
        from_ = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 32 + 2, dtype=np.uint64)
        if len(ids):
            # Each code lies in one or two words of 32 bits; codes of one word stand next to each other.
            at, shift = from_ >> 5, (64 - (from_ & 31) - bits).astype(np.uint64)
            wide = self.code[ids] << shift
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            words[at[first]] = np.bitwise_or.reduceat(wide >> np.uint64(32), first)
            low = wide & np.uint64(0xFFFFFFFF)
            over = np.flatnonzero(low)
            words[at[over] + 1] |= low[over]  # at most one code crosses into a word
        return words.astype(">u4").tobytes()[: (total + 7) // 8], from_[::STRIDE].astype("<u8").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(checkpoints, dtype="<u8").astype(np.int64)
        words = np.frombuffer(payload + b"\0" * (12 + -len(payload) % 4), dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        last, mask = len(pairs) - 1, (1 << self.top) - 1
        out = np.empty((STRIDE, len(at)), dtype=np.int32)
        for k in range(STRIDE):
            seen = (pairs[np.minimum(at >> 5, last)] >> (64 - self.top - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
            out[k] = self.table_id[seen]
            at = at + self.table_bits[seen]
        return out.T.reshape(-1)[:n]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Runs of whole documents in ascending order of id, of about BLOCK_IDS ids each; the last row of a
    partition has no run but ``seen``, how often each id came in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, part, before = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        names, held, size, any_ = [], [], 0, False
        end = [] if end_id is None else [np.array([end_id], np.int32)]
        seen = np.zeros(bpe.tokenizer.get_vocab_size(), np.int64)

        def flush() -> pd.DataFrame:
            nonlocal before, seen
            ids = np.concatenate([x for h in held for x in (h, *end)])
            seen = _added(seen, np.bincount(ids))
            lens = np.fromiter(map(len, held), np.int64, len(held)) + len(end)
            out = pd.DataFrame({"part": [part], "before": [before], "n": [len(ids)], "docs": [pd.array(names, dtype="Int64")], "lens": [lens], "ids": [ids.astype("<u4").tobytes()], "seen": [None]})
            before += len(ids)
            names.clear()
            held.clear()
            return out

        for b in batches:
            any_ = any_ or len(b) > 0
            for a in range(0, len(b), TEXTS):
                piece = b.iloc[a : a + TEXTS]
                for name, ids in zip(piece["_id"].tolist(), bpe.encode(piece["_text"]), strict=True):
                    names.append(None if pd.isna(name) else int(name))
                    held.append(ids)
                    size += len(ids) + 1
                    if size >= BLOCK_IDS:
                        yield flush()
                        size = 0
        if held:
            yield flush()
        if any_:
            yield pd.DataFrame({"part": [part], "before": [before], "n": [0], "docs": [None], "lens": [None], "ids": [None], "seen": [seen.astype("<i8").tobytes()]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_by"))
    # The second key splits an id that very many rows share.
    return rows.repartitionByRange("_id", "_by").sortWithinPartitions("_id", "_by").mapInPandas(run, "part int, before long, n long, docs array<long>, lens array<long>, ids binary, seen binary")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = max(len(a), len(b))
    return np.pad(a, (0, n - len(a))) + np.pad(b, (0, n - len(b)))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token file of ``docs`` to ``path`` (a folder every executor reaches).

    Null texts are empty: they have the end id alone (no ids where ``end_id`` is None).  Repeated ids are
    written one after the other, by a hash of the text; a null id comes first.  Columns other than id and text are not read.
    An empty table makes an empty file.
    """
    spark = docs.sparkSession
    held = shared_path(spark, "ids")
    _tokenised(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(held)
    runs, ends = spark.read.parquet(held).where("seen is null").drop("seen"), spark.read.parquet(held).where("seen is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for seen in b["seen"]:
                total = _added(total, np.frombuffer(seen, dtype="<i8"))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counts = ends.select("seen").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    bits = code_lengths(counts["n"].to_numpy())
    codebook = pd.DataFrame({"id": counts["id"].astype("int64"), "bits": bits.astype("int64")})
    spark.createDataFrame(codebook, "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")

    # One number for each partition, by order of range.
    sizes = sorted((r["part"], r["before"]) for r in ends.select("part", "before").collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist(), strict=False))
    sent = spark.sparkContext.broadcast((codebook["id"].to_numpy(), bits, before))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bits, before = sent.value
        book = Codebook(ids, bits)
        for b in batches:
            coded = [book.encode(np.frombuffer(x, dtype="<u4")) for x in b["ids"]]
            yield pd.DataFrame({"start": b["part"].map(before) + b["before"], "n": b["n"], "docs": b["docs"], "lens": b["lens"], "payload": [c[0] for c in coded], "checkpoints": [c[1] for c in coded]})

    runs.mapInPandas(encode, "start long, n long, docs array<long>, lens array<long>, payload binary, checkpoints binary").write.parquet(f"{path}/blocks")
    drop_path(spark, held)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, and its ``ids`` if asked for."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    sent = spark.sparkContext.broadcast((book["id"].to_numpy(), book["bits"].to_numpy()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Codebook(*sent.value)
        for b in batches:
            for start, n, docs, lens, payload, checkpoints in b[["start", "n", "docs", "lens", "payload", "checkpoints"]].itertuples(index=False):
                ids = book.decode(payload, checkpoints, n)
                ends = np.cumsum(lens)
                parts = [ids[e - s : e] for e, s in zip(ends.tolist(), list(lens), strict=True)]
                out = {"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], dtype="Int64"), "start": start + ends - np.asarray(lens), "n_tokens": lens, "ids_crc32": [ids_crc32(p) for p in parts]}
                yield pd.DataFrame(out | ({"ids": parts} if with_ids else {}))

    return spark.read.parquet(f"{path}/blocks").mapInPandas(decode, schema)
