"""Best common ancestors against their definition."""

from __future__ import annotations

import random

import pytest

from lodestone import storage
from lodestone.operators import commits


def closure(parents, sha):
    seen, open_ = {sha}, [sha]
    while open_:
        for p in parents.get(open_.pop(), ()):
            if p not in seen:
                seen.add(p)
                open_.append(p)
    return seen


def brute(parents, a, b):
    both = closure(parents, a) & closure(parents, b)
    return {c for c in both if not any(c in closure(parents, d) for d in both if d != c)}


def history(seed, n=60):
    """Long lines with branches, merges, criss-cross merges and several roots."""
    rng = random.Random(seed)
    parents: dict = {}
    for i in range(n):
        if i == 0 or rng.random() < 0.04:
            parents[i] = []
        elif i > 3 and rng.random() < 0.25:
            parents[i] = rng.sample(range(max(0, i - 8), i), rng.choice((2, 2, 3)))
        else:
            parents[i] = [i - 1 if rng.random() < 0.8 else rng.randrange(max(0, i - 6), i)]
    return parents


def rows(spark, parents):
    return spark.createDataFrame([(c, p) for c, own in parents.items() for p in (own or [None])], "sha long, parent long")


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_bases(spark, seed):
    parents = history(seed)
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(60) for b in rng.sample(range(60), 8)]
    got: dict = {}
    for r in commits.merge_bases(spark.createDataFrame([*pairs, pairs[0], (1, 999)], "a long, b long"), rows(spark, parents)).collect():
        got.setdefault((r["a"], r["b"]), set()).add(r["base"])
    assert got == {p: b for p in pairs if (b := brute(parents, *p))}


def test_criss_cross_and_lines(spark):
    parents = {0: [], 1: [0], 2: [0], 3: [1, 2], 4: [2, 1], **{n: [n - 1] for n in range(5, 120)}, 200: [3], 5: [4]}
    df = rows(spark, parents)
    got = {(r["a"], r["b"], r["base"]) for r in commits.merge_bases(spark.createDataFrame([(3, 4), (119, 200), (119, 60), (7, 7), (0, 119)], "a long, b long"), df).collect()}
    assert got == {(3, 4, 1), (3, 4, 2), (119, 200, 1), (119, 200, 2), (119, 60, 60), (7, 7, 7), (0, 119, 0)}
    places, down = commits.chains(df)
    assert places.select("chain").distinct().count() == 5 and places.where("chain = 4").count() == 116  # a line of commits is one chain
    assert commits.merge_bases(spark.createDataFrame([], "a long, b long"), df).count() == 0
    with pytest.raises(ValueError):
        commits.chains(rows(spark, {0: [], 1: [3], 2: [1], 3: [2]}))


def test_below_a_commit_once_for_all_its_pairs(spark, monkeypatch):
    """Many pairs of few commits: what is below is found by commit, not by pair; and rows are dealt to more tasks as they grow."""
    parents = history(3)
    df = rows(spark, parents)
    places, down = commits.chains(df)
    ends = spark.createDataFrame([(n,) for n in (50, 59, 59, 50)], "sha long").join(places, "sha").select("chain")
    below = commits._reached(ends, down)
    assert below.count() == below.select("start", "chain").distinct().count() and below.select("start").distinct().count() <= 2
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    dealt = []
    real = commits.tasks
    monkeypatch.setattr(commits, "tasks", lambda s, n: dealt.append((n, real(s, n))) or dealt[-1][1])
    pairs = [(a, b) for a in (40, 50, 59) for b in range(60)]
    got: dict = {}
    for r in commits.merge_bases(spark.createDataFrame(pairs, "a long, b long"), df).collect():
        got.setdefault((r["a"], r["b"]), set()).add(r["base"])
    assert got == {p: b for p in pairs if (b := brute(parents, *p))}
    assert dealt[-1][1] == max(spark.sparkContext.defaultParallelism, -(-dealt[-1][0] // 50)) > 10
