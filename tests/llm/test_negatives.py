from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import negatives

near = lambda n: min(max(n, -(2**63)), 2**63 - 1)


def brute(rows, every, positives=5, k=5, scale=256):
    """All pairs, from the definition."""
    good = [(i, str(c), [near(int(np.floor(scale * float(x)))) for x in v]) for i, v, c in rows if None not in (i, v, c) and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: near(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for anchor in sorted({i for i, *_ in good if i % every == 0}):
        own = min((c, v) for i, c, v in good if i == anchor)
        rest = list(good)
        rest.remove((anchor, *own))
        scored = sorted((-score(own[1], v), i, c == own[0]) for i, c, v in rest)
        for p, i in [(-s, i) for s, i, same in scored if same][:positives]:
            inside = [(-s, n) for s, n, same in scored if not same and 80 * p <= 100 * -s <= 100 * p][:k]
            out += [(anchor, i, rank + 1, n, p, s) for rank, (s, n) in enumerate(inside)]
    return sorted(out)


def table():
    rng = np.random.default_rng(8)
    v = rng.normal(0.1, 0.3, (500, 16)).astype(np.float32)
    v[100:180] = v[0]  # ties and repeated rows
    v[200:260] = v[20] * 0.9
    rows = [(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, rng.integers(0, 4, 500), strict=True))]
    rows += [(600, None, 1), (601, [0.5] * 16, None), (None, [0.5] * 16, 1), (620, [float("nan")] * 16, 1), (640, [float("inf")] * 16, 1), (660, [None] * 16, 1)]
    rows += [(680, [], 1), (700, [1.0, 2.0], 2), (701, [3.0, 1.0] * 10, 2), (20, v[21].tolist(), 3), (41, v[40].tolist(), 1), (41, v[40].tolist(), 1), (720, v[5].tolist(), 99), (740, (-v[5]).tolist(), 0)]
    return rows


@pytest.mark.parametrize("block, pairs", [(4096, 1 << 19), (9, 50)])
def test_negatives_against_all_pairs(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(negatives, "PAIRS", pairs)
    monkeypatch.setattr(negatives, "ROWS", 64 if pairs == 50 else 2048)
    rows = table()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, _id string, score int").repartition(5)
    got = negatives.hard_negatives(df, every=20, block=block).collect()
    want = brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v], c) for i, v, c in rows], 20)
    assert len(want) > 300 and sorted(map(tuple, got)) == want
    assert negatives.hard_negatives(df.where("false"), every=20).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 720"), every=20).count() == 0  # an anchor without positives


def test_wide_numbers(spark):
    rows = [(20, [1e30, -1e30], 1), (21, [1e12, 1.0], 1), (22, [1e12, 2.0], 2), (23, [1e30, 5.0], 2), (24, [-1e30, 3.0], 1), (40, [123456.5, -98765.25], 2), (41, [123456.5, 0.0], 2), (42, [123000.5, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    held = [(i, [float(near(int(np.floor(256 * x)))) for x in v], c) for i, v, c in rows]  # components are doubles once they are cut to 64 bits
    got = sorted(map(tuple, negatives.hard_negatives(df, every=20).collect()))
    assert got and got == brute(held, 20, scale=1)


def test_slots_keep_the_best(monkeypatch):
    monkeypatch.setattr(negatives, "PAIRS", 30)
    rng = np.random.default_rng(1)
    found, all_ = negatives.Slots(3, 2, 4), []
    for _ in range(40):
        a, s, score, ids = rng.integers(0, 3, 20), rng.integers(0, 2, 20), rng.integers(-5, 5, 20), rng.integers(0, 1000, 20)
        found.add(a, s, score, ids)
        all_ += zip((a * 2 + s).tolist(), (-score).tolist(), ids.tolist(), strict=True)
    want = [(c, -s, i) for cell in range(6) for c, s, i in sorted(x for x in all_ if x[0] == cell)[:4]]
    assert [tuple(r) for r in found.best().tolist()] == want
