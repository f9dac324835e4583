from __future__ import annotations

import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}


def brute_audit(kinds):
    """The least (cost, audit) over all edits, by trying each edit of each turn with up to two insertions between."""
    grow = [(0, "", "")]  # cost, audit, roles
    fits = lambda r: all(x + y in ("su", "ua", "au") for x, y in zip(r, r[1:], strict=False)) and r[:1] != "a"

    def inserted(rows):
        for cost, audit, roles in rows:
            for n in range(3):
                for more in itertools.product("ua", repeat=n):
                    yield cost + 5 * n, audit + "I" * n, roles + "".join(more)

    for kind in kinds:
        after = []
        for cost, audit, roles in inserted(grow):
            after.append((cost + 2, audit + "D", roles))
            if kind != "x":
                own, cut = kind.lower(), 5 * (kind.isupper() or kind == "_")
                after += [(cost + cut, audit + "K", roles + own)] if own in "sua" else []
                after += [(cost + cut + 1, audit + "R", roles + r) for r in "ua"]
        least = {}
        for cost, audit, roles in after:
            if fits(roles):
                state = (roles[-1:], roles == "s")
                least[state] = min(least.get(state, (cost, audit, roles)), (cost, audit, roles))
        grow = list(least.values())
    return min((c, a) for c, a, r in inserted(grow) if fits(r) and (not r or r[-1] == "a"))


@settings(max_examples=150, deadline=None)
@given(st.text("sua-SUA_x", max_size=9))
def test_cells_against_all_edits(kinds):
    assert repair.best(repair.cells_of(kinds)) == brute_audit(kinds)


@settings(max_examples=60, deadline=None)
@given(st.text("sua-SUA_x", min_size=2, max_size=40), st.integers(1, 39))
def test_a_span_may_be_cut_anywhere(kinds, at):
    at = min(at, len(kinds) - 1)
    assert repair.joined(repair.cells_of(kinds[:at]), repair.cells_of(kinds[at:])) == repair.cells_of(kinds)


def brute(rows):
    """One conversation from the definitions; rows are (turn, role, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "sound" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    kinds = "".join(repair.kind_of(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True))
    cost, audit = brute_audit(kinds)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    lines, left = [], list(rows)
    total = len(audit) - audit.count("D")
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else left.pop(0)
        if edit != "D":
            place = len(lines) - total % 2
            lines.append((role if edit == "K" else ("user", "assistant")[place % 2]) + ":" + text)
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def table():
    talks = {
        1: [(n, "ua"[n % 2] + "x", f"Turn {n}.") for n in range(30)],
        2: [(1, "system", "Be brief."), (2, "user", "Hi?"), (2, "user", "Hi?"), (4, "assistant", "no end"), (9, "assistant", " \n"), (10, "user", "Hi?")],
        3: [(None, None, None), (None, "user", "Null turn."), (None, "user", "Null turn."), (0, "assistant", "A.")],
        4: [(n, "user", "The same.") for n in range(25)],
        5: [(7, "assistant", "All alone!")],
        6: [(1, "", "No role."), (2, "tool", "A tool."), (3, "User", "Upper case."), (4, "assistant", "日本語.")],
        7: [(1, "user", "Again."), (1, "user", "Again."), (1, "user", "Again."), (1, "assistant", "Yes.")] * 6,
        8: [(n, ("system", "user", "assistant", "tool")[n * n % 4], f"Row {n}" + "." * (n % 3)) for n in range(40)],
        None: [(n, "user", "No id" + "!" * (n % 2)) for n in range(12)],
        9: [(1, "user", "word " * 5000 + "."), (2, "assistant", "end?")],
        10: [(2**62, "user", "Far."), (2**62 + 2, "assistant", "Away.")],
    }
    return talks


@pytest.mark.parametrize("turns, chars, parts", [(4096, 1 << 22, 2), (3, 1 << 22, 5), (4096, 60, 1)])
def test_repair_against_the_definitions(spark, monkeypatch, turns, chars, parts):
    monkeypatch.setattr(repair, "MAX_TURNS", turns)
    monkeypatch.setattr(repair, "MAX_CHARS", chars)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(c, *r, "x", 1) for c, own in table().items() for r in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, n int").repartition(3)
    try:
        about, repaired = repair.repair(df)
        got = {r["conv_id"]: tuple(r)[1:] for r in about.collect()}
        sums = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert {c: (*v, sums[c]) for c, v in got.items()} == {c: brute(own) for c, own in table().items()}


def test_empty_tables(spark):
    about, repaired = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert about.count() == 0 and repaired.count() == 0 and repair.digests(repaired).count() == 0
