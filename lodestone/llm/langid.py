"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three characters,
within words padded by a blank), by rank.  A document's own most frequent n-grams are
compared to each profile by the out-of-place distance: the sum of rank differences, with the largest
for n-grams the profile lacks.  The nearest profile gives the language.

Profiles come from the n-gram counts of all learning documents, summed by Spark; only
``languages x TOP`` rows reach the driver.  An n-gram is its code points packed into a
64-bit integer, so counting is sorting integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
CHUNK_CHARS = 1 << 19
UNDETERMINED = "und"
_NO_LETTER = re.compile(r"\W")
_letter = np.full(0x110000, 2, dtype=np.uint8)  # 2: not looked up yet


def _is_letter(points: np.ndarray) -> np.ndarray:
    known = _letter[points]
    if (known == 2).any():
        for p in np.unique(points[known == 2]).tolist():
            _letter[p] = chr(p).isalpha()
        known = _letter[points]
    return known == 1


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text as integers; empty where the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _is_letter(points)
    if not letters.any():
        return np.empty(0, np.int64)
    p = np.where(letters, points, 32).astype(np.int64)
    p = np.concatenate(([32], p, [32]))
    p = p[np.concatenate(([True], (p[1:] != 32) | (p[:-1] != 32)))]  # one blank between words
    two = p[:-1] << 21 | p[1:]
    three = two[:-1] << 21 | p[2:]
    # No n-gram has a blank in its middle: it would span two words.
    return np.concatenate((p[p != 32], two, three[p[1:-1] != 32]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.diff(np.append(first, len(codes)))


def _parts(text: str) -> Iterator[str]:
    """A text, lower-cased, in parts of about CHUNK_CHARS that end where a word does, so that their n-grams together are the
    whole text's."""
    text, at = text.lower(), 0
    while len(text) - at > CHUNK_CHARS:
        m = _NO_LETTER.search(text, at + CHUNK_CHARS)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by code."""
    seen, n = counted(ngrams(text)) if len(text) <= CHUNK_CHARS else _summed([counted(ngrams(t)) for t in _parts(text)])
    if len(seen) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        keep = n >= least
        seen, n = seen[keep], n[keep]
    return seen[np.lexsort((seen, -n))[:top]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    seen, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return seen, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(seen)).astype(np.int64)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """``lang, rank, gram``: the ``top`` most frequent n-grams of each language, over all rows
    with a text and a language; other columns are not read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("_lang")["_text"]:
                held: list[np.ndarray] = []
                size = 0
                for t in (p for t in texts for p in _parts(t)):
                    held.append(ngrams(t))
                    size += len(held[-1])
                    if size > 4 * CHUNK_CHARS:
                        yield _rows(lang, held)
                        held, size = [], 0
                if size:
                    yield _rows(lang, held)

    def _rows(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
        gram, n = counted(np.concatenate(held))
        return pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # A plain bound on the row number lets every task keep its own ``top`` before the shuffle.
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("lang", (F.col("place") - 1).alias("rank"), "gram")


class Profiles:
    """Ranks of the profiles' n-grams; the distance of a text to each language."""

    def __init__(self, lang: np.ndarray, rank: np.ndarray, gram: np.ndarray, top: int = TOP):
        self.langs, at = np.unique(lang.astype(str), return_inverse=True)
        self.grams, column = np.unique(gram, return_inverse=True)
        self.top = top
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        self.ranks[at, column] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text or "", self.top)
        if not len(own) or not len(self.langs):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))))
        distance = away.sum(1)
        best = int(np.argmin(distance))
        return str(self.langs[best]), float(1 - distance[best] / (self.top * len(own)))


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``language`` (``lang``, ``score``); an input column
    of that name is replaced.

    The score is 1 minus the distance over the largest possible one.  Null texts and texts without a letter are
    ``und`` with score 0, and so is everything where no profile was learned.  Equal distances go to the
    language first in order.  Rows are treated one by one, so repeated rows get equal answers.
    """
    table = profiles.toPandas()  # languages x top rows
    sent = docs.sparkSession.sparkContext.broadcast((table["lang"].to_numpy(), table["rank"].to_numpy(np.int64), table["gram"].to_numpy(np.int64)))

    @F.pandas_udf("lang string, score double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(*sent.value, top=top)
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang", "score"])

    return docs.drop("language").withColumn("language", answer(F.col(text_col)))


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls in the fold that isn't learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
