"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

Documents with equal n-gram sets form one class of copies and are joined once.  Sets get
MinHash signatures; sets that agree in a band of signature values are candidates.  A pair's signatures are
compared step by step, and the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold, given the agreements so far, falls below a
tolerance.  What is left is verified exactly on the sets.

Every pair is taken up once, in the first of its common buckets (large ones before
small ones).  Pairs of small buckets are rows.  A large bucket is cut into blocks; each pair of blocks is one
bounded group that compares and verifies in place and returns sums and a spanning
forest of its links instead of pairs, so no bucket is capped or collected.

Linked sets are joined to classes by alternating large and small stars.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bitmaps import Bitmap, bitmap_of
from lodestone.llm.shared import materialise, release
from lodestone.llm.textcore import job_seed, mix64, shingle_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
SMALL_BUCKET = 32
BLOCK = 512
PAIRS_AT_ONCE = 1 << 15
_seeds = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32)
_A, _B = _seeds[:HASHES] | np.uint32(1), _seeds[HASHES:]


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The sorted distinct n-grams of a text's word hashes."""
    return np.unique(shingle_hashes(words, k))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, cut to 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 1024):
        low = np.minimum(low, (x[a : a + 1024, None] * _A + _B).min(0))
    return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


@functools.lru_cache
def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> tuple[int, ...]:
    """After 1, 2, ... steps, the fewest agreements with which a pair stays.

    With a uniform prior, m agreements of n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, HASHES + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, large: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray | int, least: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (a, b) of rows of ``sig`` belong to this bucket and pass all steps.

    ``large`` has a bit for each band whose bucket is large; ``band`` is the bucket's."""
    out = []
    for at in range(0, len(a), PAIRS_AT_ONCE):
        p, q = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
        keep, agree = np.arange(len(p)), np.zeros(len(p), dtype=np.int64)
        for n, m in enumerate(least):
            cols = slice(n * STEP, (n + 1) * STEP)
            agree = agree[: len(keep)] + (sig[p[keep], cols] == sig[q[keep], cols]).sum(1)
            ok = agree >= m
            keep, agree = keep[ok], agree[ok]
        together = (sig[p[keep]] == sig[q[keep]]).reshape(-1, BANDS, ROWS).all(2)
        in_large = together & ((large[p[keep]] & large[q[keep]])[:, None] >> np.arange(BANDS) & 1).astype(bool)
        first = np.where(in_large.any(1), in_large.argmax(1), together.argmax(1))
        own = band if np.isscalar(band) else band[at : at + PAIRS_AT_ONCE][keep]
        out.append(at + keep[together.any(1) & (first == own)])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups of rows sorted by ``keys``, with the groups' starts."""
    rest: list[pd.DataFrame] = []

    def starts(b: pd.DataFrame) -> np.ndarray:
        k = b[keys].to_numpy()
        return np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))

    for b in batches:
        if not len(b):
            continue
        last = len(b) - 1
        tail = b[keys].iloc[last]
        if rest and (rest[-1][keys].iloc[-1] == tail).all() and (b[keys].iloc[0] == tail).all():
            rest.append(b)  # still the same group
            continue
        whole = pd.concat([*rest, b], ignore_index=True)
        s = starts(whole)
        rest = [whole.iloc[s[-1] :]]
        if s[-1]:
            yield whole.iloc[: s[-1]], s[:-1]
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        yield whole, starts(whole)


@functools.lru_cache(maxsize=64)
def _triangle(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, HASHES)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int, shingles: bool = False, bitmap: Bitmap | None = None) -> DataFrame:
    """``id, fp, data`` of each row, or of those whose id a bitmap has: data is the signature, or the shingles; fp is null
    where the text has no words."""
    sent = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if sent is not None:
                b = b[sent.value.has(b["_hash"].to_numpy(np.int64))]
            ids = b["_id"].to_numpy(np.int64)
            for first, last, hashes, offsets in word_hashes(b["_text"], seed):
                rows = []
                for i in range(last - first):
                    s = shingle_set(hashes[offsets[i] : offsets[i + 1]], k)
                    fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    rows.append((fp, (s if shingles else signature(s)).tobytes() if len(s) else None))
                yield pd.DataFrame({"id": ids[first:last], "fp": [r[0] for r in rows], "data": [r[1] for r in rows]})

    own = F.col(id_col).cast("long")
    return docs.where(F.col(id_col).isNotNull()).select(own.alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(own).alias("_hash")).mapInPandas(run, "id long, fp binary, data binary")


def _candidates(small: DataFrame, threshold: float) -> DataFrame:
    """``a, b, a_copies, b_copies`` of pairs in small buckets that pass all steps."""
    least = least_agreements(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in groups(batches, ["key"]):
            sizes = np.diff(np.append(starts, len(b)))
            left = np.concatenate([s + _triangle(m)[0] for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)])
            right = np.concatenate([s + _triangle(m)[1] for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)])
            band = b["key"].to_numpy(np.int64) & (BANDS - 1)
            ok = surviving(_matrix(b["sig"]), b["large"].to_numpy(np.int64), left, right, band[left], least)
            rep, copies = b["rep"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)
            left, right = left[ok], right[ok]
            yield pd.DataFrame({"a": rep[left], "b": rep[right], "a_copies": copies[left], "b_copies": copies[right]})

    return small.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, a_copies long, b_copies long")


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``u, v, w``: each similar pair both ways, w being the copies of v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b["x"], b["y"], strict=True)]
            b = b[np.array(ok, dtype=bool)]
            yield pd.DataFrame({"u": np.concatenate((b["a"], b["b"])), "v": np.concatenate((b["b"], b["a"])), "w": np.concatenate((b["b_copies"], b["a_copies"]))})

    x, y = shingles.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), shingles.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(run, "u long, v long, w long")


def _blocks(large: DataFrame, threshold: float) -> DataFrame:
    """``u, v, w`` for sets with links inside pairs of blocks of large buckets: w is the copies of
    all partners, v the least set that u is connected to there."""
    least = least_agreements(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, starts in groups(batches, ["key", "i", "j"]):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
                g = b.iloc[s:e]
                yield links(g)

    def links(g: pd.DataFrame) -> pd.DataFrame:
        n, i, j, block = len(g), int(g["i"].iloc[0]), int(g["j"].iloc[0]), g["block"].to_numpy()
        if i == j:
            left, right = np.triu_indices(n, 1)
        else:
            p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
            left, right = np.repeat(p, len(q)), np.tile(q, len(p))
        ok = surviving(_matrix(g["sig"]), g["large"].to_numpy(np.int64), left, right, int(g["key"].iloc[0]) & (BANDS - 1), least)
        left, right = left[ok], right[ok]
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        size = np.array([len(x) for x in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(local, np.cumsum(size)[:-1])
        rep, copies = g["rep"].to_numpy(np.int64), g["copies"].to_numpy(np.int64)
        weight, root = np.zeros(n, np.int64), list(range(n))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        seen = np.zeros(int(local.max()) + 1, dtype=bool)
        by = np.argsort(left, kind="stable")
        left, right = left[by], right[by]
        cuts = np.flatnonzero(np.diff(left, prepend=-1)).tolist()
        for c, d in zip(cuts, [*cuts[1:], len(left)], strict=False):
            k = int(left[c])
            seen[own[k]] = True
            for m in right[c:d].tolist():
                both = int(seen[own[m]].sum())
                if both >= threshold * (size[k] + size[m] - both) - 1e-9:
                    weight[k] += copies[m]
                    weight[m] += copies[k]
                    x, y = find(k), find(m)
                    x, y = (x, y) if rep[x] <= rep[y] else (y, x)
                    root[y] = x
            seen[own[k]] = False
        linked = np.flatnonzero(weight)
        return pd.DataFrame({"u": rep[linked], "v": [int(rep[find(k)]) for k in linked.tolist()], "w": weight[linked]})

    return large.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "u long, v long, w long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each node of an edge ``(u, v)`` is connected to."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct())
        release(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per id: ``doc_id, class_id, n_links``.

    ``class_id`` is the least id that a chain of links leads to; ``n_links`` counts the other
    documents whose set of ``words``-word n-grams is at least ``threshold`` similar, copies
    among them.  A text of fewer words is one n-gram.  The bands find pairs from THRESHOLD on, so a lower
    threshold is refused.

    Null and empty texts and texts without words are linked to nothing.  Null ids are left out.  Rows that
    share an id and a set of n-grams count once; of rows that share an id with different sets each is joined, all are in one
    class, and ``n_links`` is the sum over them.  Columns other than id and text are not read.  An empty table gives no rows.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"threshold below {THRESHOLD}")
    seed = job_seed()
    rows = _sets(docs, id_col, text_col, words, seed).groupBy("id", "fp").agg(F.first("data").alias("sig"))
    own = materialise(rows)
    # A set is named by a number: an id may stand for several sets.
    sets = own.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = materialise(sets.withColumn("rep", F.monotonically_increasing_id()))
    several = materialise(own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    repeated = not several.isEmpty()

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # The four values of a band fill 64 bits; the band's number takes the place of the last ones.
            keys = mix64(_matrix(b["sig"]).reshape(-1, ROWS).copy().view("<u8").ravel().reshape(-1, BANDS) + np.arange(BANDS, dtype=np.uint64))
            keys = (keys & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "rep": np.repeat(b["rep"].to_numpy(np.int64), BANDS)})

    bands = sets.select("rep", "sig").mapInPandas(banded, "key long, rep long")
    shared = materialise(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialise(bands.join(shared, "key"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(BANDS - 1).cast("int"))
    masks = members.where(F.col("n") > SMALL_BUCKET).groupBy("rep").agg(F.bit_or(bit).alias("large"))
    about = sets.select("rep", "copies", "sig").join(masks, "rep", "left").withColumn("large", F.coalesce("large", F.lit(0).cast("long")))
    known = members.join(about, "rep")
    pairs = materialise(_candidates(known.where(F.col("n") <= SMALL_BUCKET), threshold))

    needed = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(members.where(F.col("n") > SMALL_BUCKET).select("rep")).distinct()
    needed = materialise(sets.select("rep", "fp", F.col("first_id").alias("id")).join(needed, "rep", "left_semi"))
    picked = _sets(docs, id_col, text_col, words, seed, True, bitmap_of(needed.select(F.xxhash64("id"))))
    shingles = materialise(picked.join(needed, ["id", "fp"]).groupBy("rep").agg(F.first("data").alias("shingles")))

    number = F.ceil(F.col("n") / BLOCK).cast("int")
    block = known.where(F.col("n") > SMALL_BUCKET).withColumn("block", F.pmod(F.xxhash64("rep"), number).cast("int"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0), number - 1))).select("key", "rep", "copies", "sig", "large", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = materialise(_verified(pairs, shingles, threshold).unionByName(_blocks(block.join(shingles, "rep"), threshold)))

    edges = links.select("u", "v")
    if repeated:  # the sets of one id belong together
        same = own.join(several, "id", "left_semi").join(sets.select("fp", "rep"), "fp").select("id", "rep")
        edges = edges.unionByName(same.join(same.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v"))
    root = materialise(components(edges).withColumnRenamed("node", "rep"))
    least = root.join(sets.select("rep", "first_id"), "rep").groupBy("root").agg(F.min("first_id").alias("class_id"))
    count = links.groupBy(F.col("u").alias("rep")).agg(F.sum("w").alias("partners"))
    result = sets.select("fp", "rep", "first_id", "copies").join(root.join(least, "root"), "rep", "left").join(count, "rep", "left")
    result = materialise(result.select("fp", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    release(shared, members, pairs, needed, shingles, links, root, sets)
    out = own.select("id", "fp").join(result, "fp", "left")
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out if not repeated else out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class, with all their columns; null ids stay."""
    gone = jaccard_join(docs, id_col, text_col).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
