"""Repair of conversations by weighted interval parsing.

The turns of a conversation are edited at least cost so that their roles read
``(s?(ua)+)?``.  The repair grammar is in Chomsky normal form: a nonterminal (p, q) stands
for the edits of a span that take the roles from state p to state q, its binary rules are
(p, q) -> (p, r) (r, q), and its terminals are the edits of one turn (keep, change the
role, delete).  Edits that insert a turn take up no span, so each cell is closed under
them on both sides.  A cell holds the minimum (cost, audit) of its span, an audit being
the edits' initials in order.

Cells are combined bottom-up by span length.  As every (p, q) of a span splits into a
(p, r) and an (r, q) wherever the span is cut, one cut serves all rules, so spans of
doubling length are enough: a conversation of n turns takes n combinations, not n^3.
Cutting anywhere also lets partitions parse the spans that they hold: the turns of all
conversations are sorted over all partitions, spans that end with a partition (or have grown
to a bound) go on as cells, and only those are put together by conversation.

Of equal cost and span, no audit is the beginning of another one (both use up the same turns,
and each insertion costs more), so the least of two stays the least in whatever
they are part of.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import materialise

MAX_TURNS, MAX_CHARS = 4096, 1 << 22  # of a span that is held at once
SHORT = 8
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
_RULES = tuple((p, r, q) for p, r in _PAIRS for r2, q in _PAIRS if r == r2)
Cells = dict[tuple[int, int], tuple[int, str]]

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5


def joined(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans as one."""
    out: Cells = {}
    for p, r, q in _RULES:
        a, b = left.get((p, r)), right.get((r, q))
        if a and b:
            cell = (a[0] + b[0], a[1] + b[1])
            if (p, q) not in out or cell < out[p, q]:
                out[p, q] = cell
    return out


def _closure() -> Cells:
    """The empty span: insertions alone."""
    out = {(p, p): (0, "") for p in range(4)}
    step = {(p, q): (INSERT, "I") for (p, role), q in _NEXT.items() if role in "ua"}
    for _ in range(3):
        for (p, q), cell in joined(out, step).items():
            out[p, q] = min(cell, out.get((p, q), cell))
    return out


EMPTY = _closure()


@functools.cache
def _turn(kind: str) -> Cells:
    """The cells of one turn, closed under insertions.  ``kind``: the role's initial if it is one of s, u, a, else "-", in upper case where
    the text is truncated; "x" where the turn must go."""
    own = {(p, p): (DELETE, "D") for p in range(4)}
    cut = CUT if kind.isupper() or kind == "_" else 0
    if kind != "x":
        for (p, role), q in _NEXT.items():
            if role == kind.lower():
                own[p, q] = (KEEP + cut, "K")
            elif role in "ua":
                own[p, q] = (REROLE + cut, "R")
    return joined(joined(EMPTY, own), EMPTY)


def cells_of(kinds: str) -> Cells:
    """The cells of a span of turns, from those of its parts; the left one is the longest power of two that is shorter."""
    if len(kinds) < 2:
        return _turn(kinds) if kinds else EMPTY
    half = 1 << (len(kinds) - 1).bit_length() - 1
    of = _short if half <= SHORT else cells_of
    return joined(of(kinds[:half]), of(kinds[half:]))


_short = functools.lru_cache(maxsize=1 << 14)(cells_of)  # short spans come again and again


def best(cells: Cells) -> tuple[int, str]:
    """The cheapest edits from nothing to nothing or to whole pairs."""
    return min(cells[0, 0], cells[0, 3])


def kind_of(initial: str, fault: str) -> str:
    if fault in (BLANK, DUPLICATE):
        return "x"
    kind = initial if initial in ("s", "u", "a") else "-"
    return kind if fault == SOUND else "_" if kind == "-" else kind.upper()


def edited(turns: list[tuple[str, str]], audit: str, before: int, total: int) -> list[tuple[str, str]]:
    """The repaired turns, of which ``before`` came in earlier spans.  Which role an edit gives follows from its place among all ``total`` lines of the conversation: s comes
    first where their number is odd, and users and assistants take turns."""
    out, at, n = [], 0, before
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = "user" if (n - total % 2) % 2 == 0 else "assistant"
        if edit == "I":
            out.append((role, ""))
        else:
            own, text = turns[at]
            out.append((own if edit == "K" else role, text))
            at += 1
        n += 1
    return out


def fault_of(text: str, seen: bool) -> str:
    said = text.rstrip(_SPACE)
    return BLANK if not said else DUPLICATE if seen else SOUND if said[-1] in ".!?" else TRUNCATED


class Span:
    """Neighbouring turns of one conversation in one partition."""

    def __init__(self, conv: int | None, number: int, open_: bool):
        self.conv, self.number, self.open = conv, number, open_
        self.turns: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.chars = 0
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}
        self.illegal = self.distinct = 0
        self.first = self.last = None  # turn numbers

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        fault = fault_of(text, seen)
        self.faults[fault] += 1
        if self.turns:
            self.illegal += self.turns[-1][0][:1] + role[:1] not in _LEGAL
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.turns.append((role, text))
        self.kinds.append(kind_of(role[:1], fault))
        self.chars += len(role) + len(text)

    def row(self) -> dict:
        """A whole conversation repaired, or a span with its cells."""
        cells = cells_of("".join(self.kinds))
        cost, audit = best(cells)
        turns = self.turns if self.open else edited(self.turns, audit, 0, len(audit) - audit.count("D"))
        return {
            "conv": self.conv, "part": self.number, "open": self.open, "n": len(self.turns), "first": self.first, "last": self.last, "distinct": self.distinct,
            "head": self.turns[0][0][:1], "tail": self.turns[-1][0][:1], "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal,
            "cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cells.items()] if self.open else None,
            "cost": None if self.open else cost, "audit": None if self.open else audit, "turns": [{"role": r, "text": t} for r, t in turns],
        }


SPANS = (
    "conv long, part long, open boolean, n long, first long, last long, distinct long, head string, tail string, blank long, duplicate long, truncated long, illegal long, "
    "cells array<struct<p: int, q: int, cost: long, audit: string>>, cost long, audit string, turns array<struct<role: string, text: string>>"
)
SPAN = ["conv", "part", "open", "n", "first", "last", "distinct", "head", "tail", BLANK, DUPLICATE, TRUNCATED, "illegal", "cells", "cost", "audit", "turns"]
PIECES = "conv long, part long, piece string, before long, total long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECE = [c.split()[0] for c in PIECES.split(", ")]
_WHOLE = {"conv", "part", "n", "first", "last", "distinct", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "before", "total", "gaps"}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(**{c: pd.array(out[c].tolist(), dtype="Int64") for c in columns if c in _WHOLE})


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns to whole conversations and, where a conversation touches the partition's ends or is long, to spans."""
    number = TaskContext.get().partitionId() << 32
    span, mark, key = None, None, None
    for b in batches:
        out = []
        for has_conv, conv, has_turn, turn, role, text, digest, marks in b.itertuples(index=False, name=None):
            own = (has_conv, conv, has_turn, turn, digest)
            if marks:
                mark = own
                continue
            name = conv if has_conv else None
            if span is None:
                span = Span(name, number, True)
            elif name != span.conv or len(span.turns) >= MAX_TURNS or span.chars >= MAX_CHARS:
                span.open |= name == span.conv
                out.append(span.row())
                number += 1
                span = Span(name, number, name == span.conv)
            span.add(turn if has_turn else None, role, text, own in (mark, key))
            key = own
        yield _frame(out, SPAN)
    if span is not None:
        span.open = True
        yield _frame([span.row()], SPAN)


def _put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans with cells, sorted by conversation and part, to the edits of each span; a conversation's first one also has its sums."""

    def finish(spans: list[tuple], stack: list[tuple[int, Cells]]) -> list[dict]:
        cells = stack.pop()[1]
        while stack:
            cells = joined(stack.pop()[1], cells)
        cost, audit = best(cells)
        total = len(audit) - audit.count("D")
        first = min((s.first for s in spans if s.distinct), default=0)
        last = max((s.last for s in spans if s.distinct), default=0)
        with_turns = [s for s in spans if s.distinct]
        distinct = sum(s.distinct for s in spans) - sum(a.last == b.first for a, b in zip(with_turns, with_turns[1:], strict=False))
        illegal = sum(s.illegal for s in spans) + sum(a.tail + b.head not in _LEGAL for a, b in zip(spans, spans[1:], strict=False))
        rows, at, before = [], 0, 0
        for i, s in enumerate(spans):
            end, left = at, s.n
            while left:
                left -= audit[end] != "I"
                end += 1
            piece = audit[at:] if i == len(spans) - 1 else audit[at:end]
            rows.append({"conv": s.conv, "part": s.part, "piece": piece, "before": before, "total": total, "whole": i == 0})
            if i == 0:
                sums = {c: sum(getattr(x, c) for x in spans) for c in (BLANK, DUPLICATE, TRUNCATED)}
                rows[0] |= {**sums, "gaps": last - first + 1 - distinct if distinct else 0, "illegal": illegal, "cost": cost, "audit": audit}
            at, before = end, before + len(piece) - piece.count("D")
        return rows

    spans: list[tuple] = []
    stack: list[tuple[int, Cells]] = []  # cells of runs of spans, longest first
    for b in batches:
        out = []
        for has_conv, s in zip(b.pop("has_conv").tolist(), b.itertuples(index=False), strict=True):
            s = s._replace(conv=s.conv if has_conv else None)
            if spans and s.conv != spans[-1].conv:
                out += finish(spans, stack)
                spans, stack = [], []
            own = (1, {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s.cells})
            while stack and stack[-1][0] == own[0]:
                n, left = stack.pop()
                own = (2 * n, joined(left, own[1]))
            stack.append(own)
            spans.append(s._replace(cells=None))
        yield _frame(out, PIECE)
    if spans:
        yield _frame(finish(spans, stack), PIECE)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)``.

    One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.  ``gaps`` are the turn numbers
    missing between the least and the largest; of a turn's faults the first counts: blank (nothing but white space), duplicate (role and
    text came earlier), truncated (doesn't end in ``.!?``); ``illegal`` counts neighbours whose roles' initials aren't su, ua or au.  ``audit`` has the edits'
    initials (keep, rerole, delete, insert), the cheapest that give roles ``(s?(ua)+)?``, of equal ones the ASCII-least.
    Repaired turns: ``conv_id, part, turns`` (array of role and text): one row a conversation, or several in order of ``part`` where it
    is long or lies across partitions.

    Turns are taken by number, those without one first, those with the same by role and a hash of role and text; so repeated rows are neighbours and
    all but the first are duplicates.  Null roles and texts are one space.  A null conversation id is one conversation.  A role without an
    initial (empty) can't be kept.  Columns other than those named are not read.  An empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    key = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]
    rows = turns.select(conv.isNotNull().alias("has_conv"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # Rows whose role and text came at an earlier turn are announced by a row without text, sorted before them.
    seen = rows.select(*key).distinct()
    first = seen.groupBy("has_conv", "conv", "digest").agg(F.count("*").alias("n"), F.min(F.struct("has_turn", "turn")).alias("least")).where("n > 1")
    again = seen.join(first, ["has_conv", "conv", "digest"]).where(F.struct("has_turn", "turn") > F.col("least"))
    marks = again.select(*key, F.lit("").alias("text"), F.lit(True).alias("marks"))
    dealt = rows.withColumn("marks", F.lit(False)).unionByName(marks).repartitionByRange(*key).sortWithinPartitions(*key, F.col("marks").desc())
    spans = materialise(dealt.select("has_conv", "conv", "has_turn", "turn", "role", "text", "digest", "marks").mapInPandas(_spans, SPANS))

    parts = spans.where("open").drop("turns", "open", "cost", "audit").select(F.col("conv").isNotNull().alias("has_conv"), F.coalesce("conv", F.lit(0)).alias("conv"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first", "last")], "part", "n", "distinct", "head", "tail", BLANK, DUPLICATE, TRUNCATED, "illegal", "cells")
    pieces = materialise(parts.repartition("has_conv", "conv").sortWithinPartitions("has_conv", "conv", "part").mapInPandas(_put_together, PIECES))
    gaps = F.when(F.col("distinct") > 0, F.col("last") - F.col("first") + 1 - F.col("distinct")).otherwise(0)
    about = [BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit"]
    done = spans.where("not open").select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), *about)
    done = done.unionByName(pieces.where("whole").select(F.col("conv").alias("conv_id"), "gaps", *about))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [edited([(t["role"], t["text"]) for t in own], piece, before, total) for own, piece, before, total in zip(b["turns"], b["piece"], b["before"], b["total"], strict=True)]
            yield b[["part"]].assign(turns=[[{"role": r, "text": t} for r, t in x] for x in lines])

    long_ = spans.where("open").select("part", "turns").join(pieces.select("part", "piece", "before", "total"), "part")
    long_ = long_.mapInPandas(edit, "part long, turns array<struct<role: string, text: string>>").join(pieces.select("part", "conv"), "part")
    columns = [F.col("conv").alias("conv_id"), "part", "turns"]
    return done, spans.where("not open").select(*columns).unionByName(long_.select(*columns))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns: of the lines ``role:text``, joined by line feeds.  Parts are taken in order by one
    running hash, never put together."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = turns.select(F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "part", F.size("turns").alias("n"), F.array_join(lines, "\n").alias("said"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, sums, begun, done = None, None, False, []
        for b in batches:
            for has_conv, conv, n, said in zip(b["has_conv"].tolist(), b["conv"].tolist(), b["n"].tolist(), b["said"], strict=True):
                if sums is None or (has_conv, conv) != name:
                    done += [(name[1] if name[0] else None, sums.hexdigest())] if sums else []
                    name, sums, begun = (has_conv, conv), hashlib.sha256(), False
                sums.update((("\n" if begun and n else "") + said).encode("utf-8", "surrogatepass"))
                begun |= n > 0
            yield _summed(done)
            done = []
        if sums:
            yield _summed([(name[1] if name[0] else None, sums.hexdigest())])

    def _summed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "repaired_sha256"])
        return out.assign(conv_id=pd.array(out["conv_id"].tolist(), dtype="Int64"))

    return rows.repartition("has_conv", "conv").sortWithinPartitions("has_conv", "conv", "part").mapInPandas(walk, "conv_id long, repaired_sha256 string")
