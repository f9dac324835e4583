"""Text quality by a factorisation machine.

Features of a text: its words, hashed to ``WORD_SLOTS`` slots (log counts, scaled to unit
length), structure statistics (length, line and word shapes, shares of character classes,
repetition), each cut into ``LEVELS`` levels, and metadata columns of numbers, by levels of their logarithm
with one more for nulls.  Score: a logistic of bias, weights, and pairwise
interactions with factors of rank ``RANK``, by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

Spark computes the features of all rows; the machine is fitted on at most ``FIT_ROWS`` labelled
rows (taken by hash of the id, a documented bound) and scores every row in its partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textcore import word_hashes

WORD_SLOTS = 1 << 12
LEVELS = 16
RANK = 8
FIT_ROWS = 12_000
STATISTICS = ("chars", "words", "word_length", "line_length", "letters", "upper", "digits", "blanks", "marks", "rare_marks", "same_words", "same_lines", "words_twice")
SLOTS = WORD_SLOTS + len(STATISTICS) * LEVELS
_MARKS = np.zeros(256, dtype=np.uint8)
for _c in b".,;:!?'\"-()":
    _MARKS[_c] = 1
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _MARKS[_c] = 2


def statistics(text: str, words: np.ndarray) -> np.ndarray:
    """The statistics of one text, each between 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n, w = max(len(raw), 1), max(len(words), 1)
    count = np.bincount(raw, minlength=256)
    upper, lower, wide = count[65:91].sum(), count[97:123].sum(), count[128:].sum()
    lines = text.split("\n")
    kinds = np.bincount(_MARKS, weights=count, minlength=3)
    return np.array([
        min(np.log1p(len(raw)) / 14, 1), min(np.log1p(len(words)) / 12, 1), min(n / w / 32, 1), min(np.log1p(n / len(lines)) / 10, 1),
        (upper + lower + wide) / n, upper / max(upper + lower, 1), count[48:58].sum() / n, (count[32] + count[10] + count[9]) / n,
        min(kinds[1] / w, 1), min(kinds[2] / w, 1), 1 - len(np.unique(words)) / w, 1 - len(set(lines)) / len(lines), (words[1:] == words[:-1]).sum() / w,
    ])


def slots(metadata: int) -> int:
    return SLOTS + metadata * (LEVELS + 1)


def features(texts, metadata=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(slots, values)`` of each text and its metadata (a row of numbers each)."""
    texts = ["" if t is None else t for t in texts]
    numbers = np.array([list(m) for m in metadata], dtype=float).reshape(len(texts), -1) if metadata is not None else np.empty((len(texts), 0))
    known = np.log1p(np.maximum(np.nan_to_num(numbers), 0)) * LEVELS / 14
    steps = np.where(np.isnan(numbers), LEVELS, np.minimum(known, LEVELS - 1).astype(np.int64)) + SLOTS + np.arange(numbers.shape[1]) * (LEVELS + 1)
    for first, last, hashes, offsets in word_hashes(texts):
        slots = (hashes >> np.uint64(20)).astype(np.int64) % WORD_SLOTS
        for i in range(first, last):
            a, b = offsets[i - first], offsets[i - first + 1]
            n = np.bincount(slots[a:b], minlength=1)
            own = np.flatnonzero(n)
            value = np.log1p(n[own])
            value /= max(np.sqrt((value**2).sum()), 1e-12)
            level = np.minimum((statistics(texts[i], hashes[a:b]) * LEVELS).astype(np.int64), LEVELS - 1)
            rest = np.concatenate((WORD_SLOTS + np.arange(len(level)) * LEVELS + level, steps[i]))
            yield np.concatenate((own, rest)), np.concatenate((value, np.full(len(rest), 0.3)))


class FactorisationMachine:
    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray, metadata: Sequence[str] = ()):
        self.bias, self.weight, self.factor, self.metadata = bias, weight, factor, tuple(metadata)

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """In linear time: sums over each row's own slots."""
        size = np.array([len(s) for s, _ in rows])
        slot, x = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
        start = np.cumsum(size) - size
        vx = self.factor[slot] * x[:, None]
        total, squares = np.add.reduceat(vx, start), np.add.reduceat(vx**2, start)
        return self.bias + np.add.reduceat(self.weight[slot] * x, start) + 0.5 * (total**2 - squares).sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, metadata: Sequence[str] = (), epochs: int = 12, step: float = 0.05, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Adagrad on logistic loss in batches of 64.  Without rows, or with one class only, every
    score is that class's share (a half without rows)."""
    size = slots(len(metadata))
    if not len(rows) or labels.min() == labels.max():
        p = float(labels.mean()) if len(rows) else 0.5
        return FactorisationMachine(float(np.log((p + 1e-3) / (1 - p + 1e-3))), np.zeros(size), np.zeros((size, RANK)), metadata)
    rng = np.random.default_rng(seed)
    p = labels.mean()
    m = FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.01, (size, RANK)), metadata)
    g_bias, g_weight, g_factor = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            part = [rows[i] for i in order[a : a + 64]]
            err = m.score(part) - labels[order[a : a + 64]]
            size = np.array([len(s) for s, _ in part])
            slot, x = np.concatenate([s for s, _ in part]), np.concatenate([v for _, v in part])
            e = np.repeat(err, size) / len(part)
            own, at = np.unique(slot, return_inverse=True)
            total = np.repeat(np.add.reduceat(m.factor[slot] * x[:, None], np.cumsum(size) - size), size, axis=0)
            d_weight = np.bincount(at, weights=e * x, minlength=len(own)) + decay * m.weight[own]
            each = (e * x)[:, None] * (total - m.factor[slot] * x[:, None])
            d_factor = np.stack([np.bincount(at, weights=each[:, f], minlength=len(own)) for f in range(RANK)], 1) + decay * m.factor[own]
            g_weight[own] += d_weight**2
            g_factor[own] += d_factor**2
            g_bias += err.mean() ** 2
            m.weight[own] -= step * d_weight / np.sqrt(g_weight[own])
            m.factor[own] -= step * d_factor / np.sqrt(g_factor[own])
            m.bias -= step * err.mean() / np.sqrt(g_bias)
    return m


def _numbers(metadata: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in metadata]).cast("array<double>")


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Sequence[str] = (), max_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fits on at most ``max_rows`` rows with a label: those first by the hash of the id (then id and label), and in that order,
    so the machine doesn't depend on how the rows are dealt.  Of rows that share id and label the one of the least metadata
    and text counts."""
    by = F.xxhash64(F.col(id_col))
    key = ["_by", "_id", "_label"]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(features(b["_text"], b["_numbers"]))
            yield pd.DataFrame({"by": b["_by"], "id": b["_id"], "label": b["_label"], "slots": [s.astype("<i4").tobytes() for s, _ in rows], "values": [v.astype("<f4").tobytes() for _, v in rows]})

    known = labelled.where(F.col(label_col).isNotNull())
    keys = [by.alias("_by"), F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("double").alias("_label")]
    # The keys alone tell the last row that is taken; texts are read for the rows up to it only.
    last = known.select(*keys).distinct().orderBy(*key).limit(max_rows).agg(F.max("_by")).first()[0]
    picked = known.where(by <= F.lit(last)).select(*keys, F.struct(_numbers(metadata).alias("_numbers"), F.col(text_col).alias("_text")).alias("_row"))
    picked = picked.groupBy(*key).agg(F.min("_row").alias("_row")).select(*key, "_row.*")
    table = picked.mapInPandas(featured, "by long, id string, label double, slots binary, values binary").toPandas()
    table = table.sort_values(["by", "id", "label"], na_position="first", ignore_index=True).head(max_rows)
    rows = [(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for s, v in zip(table["slots"], table["values"], strict=True)]
    return fit(rows, table["label"].to_numpy(float), metadata)


def score_quality(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and a double ``quality_score`` from 0 to 1 (an input column
    of that name is replaced).  Null and empty texts are scored alike, from their statistics and metadata; null
    metadata are a level of their own.  Rows are treated one by one; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight, machine.factor))

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = FactorisationMachine(*sent.value)
        for texts, numbers in batches:
            out, held = [], []
            for row in features(texts, numbers):
                held.append(row)
                if len(held) == 256:
                    out.append(m.score(held))
                    held = []
            if held:
                out.append(m.score(held))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.drop("quality_score").withColumn("quality_score", scored(F.col(text_col), _numbers(machine.metadata)))
