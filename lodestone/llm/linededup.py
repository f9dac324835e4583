"""Line dedup across documents.

Lines are normalised (white space ``[\\x20\\x09-\\x0D]`` stripped at both ends, A-Z
lower-cased), exploded as 128-bit hashes, and counted by distinct documents.  A long
line found in many documents stays only in the largest document id that holds it;
each text is put together again from its other lines, by position.

The counts are two-level (line and document, then line), so a line that a third of
all documents share is spread over tasks and summed from partial counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise

_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash, or None where the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n"):
        key = line.strip(_BLANKS)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """One row ``(_line_doc, _line_hash)`` for each document and distinct long line of it."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [set(_line_hashes(t, min_chars)) - {None} for t in b["_line_text"]]
            reps = [len(s) for s in sets]
            yield pd.DataFrame({"_line_doc": b["_line_doc"].repeat(reps), "_line_hash": [h for s in sets for h in s]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_line_doc"), F.col(text_col).alias("_line_text")).where("_line_doc is not null").mapInPandas(explode, f"_line_doc {kind}, _line_hash binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` replaced by the kept text, and
    a struct column ``line_dedup`` with ``n_lines`` and ``n_dropped`` (an input column
    of that name is replaced).

    Keys of at least ``min_chars`` code points that at least ``min_docs`` distinct ids
    hold lose their lines everywhere but in the largest such id.  Rows that share an id
    count as one document and are each rewritten.  Rows with a null id don't count and keep
    their lines.  Null and empty texts are one empty line, kept.  An empty table stays empty.
    """
    lines = materialise(line_table(docs, id_col, text_col, min_chars))  # read twice below; else all lines would be hashed twice
    hot = lines.groupBy("_line_hash").agg(F.count_distinct("_line_doc").alias("_line_n"), F.max("_line_doc").alias("_line_keep")).where(F.col("_line_n") >= min_docs).drop("_line_n")
    hot = materialise(hot)  # its own exchange then: a join of a very common line can be split, a small table broadcast
    drops = lines.join(hot, "_line_hash").where("_line_doc <> _line_keep").groupBy("_line_doc").agg(F.collect_set("_line_hash").alias("_line_drops"))

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def rebuild(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, drop in zip(texts, gone, strict=True):
            text = text or ""
            if drop is None or not len(drop):
                rows.append((text.count("\n") + 1, 0, text))
                continue
            drop = {bytes(h) for h in drop}
            parts = text.split("\n")
            kept = [p for p, h in zip(parts, _line_hashes(text, min_chars), strict=True) if h not in drop]
            rows.append((len(parts), len(parts) - len(kept), "\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    joined = docs.drop("line_dedup").join(drops, F.col(id_col) == F.col("_line_doc"), "left")
    done = joined.withColumn("_line_done", rebuild(F.col(text_col), F.col("_line_drops")))
    keep = [c for c in docs.columns if c != "line_dedup"]
    return done.select(*[F.col("_line_done.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.struct("_line_done.n_lines", "_line_done.n_dropped").alias("line_dedup"))
