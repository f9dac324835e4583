"""Sets of 64-bit hashes as bitmaps of bounded size, which let through all members and few others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # 16 MB at most, the bound of what is broadcast
BITS_A_KEY = 16


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes.astype(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(keys: DataFrame) -> Bitmap | None:
    """The last bits of a long column, by BITS_A_KEY bits a key; None where more than a quarter of the largest bitmap would be set,
    which would let most of anything through: then the exact join behind it does the work alone."""
    n = keys.count()
    if n > MOST_BITS // 4:
        return None
    bits = min(max(LEAST_BITS, 1 << max(n * BITS_A_KEY - 1, 1).bit_length()), MOST_BITS)
    bit = F.col(keys.columns[0]).bitwiseAND(bits - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = keys.select(F.floor(bit / 64).alias("word"), one.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return Bitmap(out.view(np.uint64))
