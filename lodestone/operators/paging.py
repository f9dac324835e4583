"""Keyset pages with exact totals.

A cursor is base64url JSON of a version, a signature of the query, and the sort key of the last row seen.  The next page
is a filter and a top-n: no offset, whatever the depth."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
ACTIVE = ("new", "acknowledged", "accepted", "planned", "regressed")
SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2, "critical": 3}


def signature(**query: object) -> str:
    return hashlib.sha256(json.dumps(query, sort_keys=True, default=str).encode()).hexdigest()[:20]


def encode_cursor(sign: str, after: Sequence[object]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "q": sign, "after": list(after)}, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, sign: str) -> list:
    try:
        data = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        known, after = data["v"] == VERSION and data["q"] == sign, list(data["after"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if not known:
        raise ValueError("the cursor is of another query")
    return after


def page_size(n: int, most: int = 200) -> int:
    if not 1 <= int(n) <= most:
        raise ValueError(f"page size must be between 1 and {most}")
    return int(n)


def statuses(names: Sequence[str]) -> list[str]:
    """Expands ``active`` and ``all``, in lower case, without repeats; an empty list means all."""
    out: list[str] = []
    for n in (x.strip().lower() for x in names):
        if n == "all":
            return []
        out += [s for s in (ACTIVE if n == "active" else (n,)) if s not in out]
    return out


def attention(policy_severity: str = "warning", policy_priority: int = 35, info_long_functions: bool = False) -> Column:
    """Whether a finding is worth attention: planned and regressed ones always are."""
    status, severity = F.coalesce("status", F.lit("new")), F.coalesce("severity", F.lit("info"))
    rank = F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in SEVERITY_RANK.items()], F.lit(0))
    small = F.lit(False) if info_long_functions else (F.col("finding_type") == "long_function") & (severity == "info")
    worth = (rank >= SEVERITY_RANK[policy_severity]) | (F.coalesce("priority_score", F.lit(0)) >= policy_priority)
    return status.isin("new", "acknowledged", "planned", "regressed") & (status.isin("planned", "regressed") | (~small & worth))


def after_key(keys: Sequence[tuple[str, bool]], after: Sequence[object]) -> Column:
    """Rows behind a sort key; ``keys`` are ``(column, descending)`` and not null."""
    out, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, after, strict=True):
        c = F.col(name)
        out = out | (equal & ((c < F.lit(value)) if down else (c > F.lit(value))))
        equal = equal & (c == F.lit(value))
    return out


def order_by(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(n).desc() if down else F.col(n).asc() for n, down in keys]


def keyset_page(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int, after: Sequence[object] | None = None) -> DataFrame:
    """The ``size`` rows behind ``after``: a pushed filter and TakeOrderedAndProject."""
    rest = df if after is None else df.where(after_key(keys, after))
    return rest.orderBy(*order_by(keys)).limit(page_size(size))


def offset_page(df: DataFrame, keys: Sequence[tuple[str, bool]], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) by offset, for callers that number pages; its cost grows with the offset, unlike keyset_page's."""
    return df.orderBy(*order_by(keys)).offset((max(1, page) - 1) * page_size(size)).limit(page_size(size))


@dataclass
class Page:
    rows: list[dict]
    total: int
    omitted: int
    cursor: str | None
    previous: bool


def read_page(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int, cursor: str | None = None, budget: int | None = None, **query: object) -> Page:
    """One page with exact totals.  Over a byte budget the tail goes; the cursor follows the last row shown."""
    if budget is not None and budget < 2000:
        raise ValueError("payload budget must be at least 2000 bytes")
    sign = signature(keys=keys, **query)
    after = decode_cursor(cursor, sign) if cursor else None
    rows = [r.asDict(recursive=True) for r in keyset_page(df, keys, size, after).collect()]  # at most a page
    shown = rows
    while budget is not None and len(shown) > 1 and len(json.dumps(shown, default=str).encode()) > budget:
        shown = shown[:-1]
    behind = F.count_if(after_key(keys, [shown[-1][k] for k, _ in keys])) if shown else F.lit(0)
    total, rest = df.agg(F.count("*"), behind).first()  # both in one pass
    return Page(shown, total, len(rows) - len(shown), encode_cursor(sign, [shown[-1][k] for k, _ in keys]) if rest else None, after is not None)


def sorted_nulls_last(df: DataFrame, column: str, descending: bool, allowed: Sequence[str], *tie: str) -> DataFrame:
    """Sorted by an allowed column; nulls are last upwards and, reversed, first downwards."""
    if column not in allowed:
        raise ValueError(f"can't sort by {column}")
    c = F.col(column)
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *tie)


def clamped(n: int, most: int) -> int:
    return max(1, min(int(n), most))
