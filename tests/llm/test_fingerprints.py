from __future__ import annotations

import functools
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints as fp
from lodestone.llm.queries import QUERIES

from .conftest import ODD, words

SEED = 42  # of Spark's xxhash64


def hash_text(text, seed=SEED):
    return xxhash.xxh64(text.encode(), seed).intdigest()


def hash_numbers(*values):
    h = SEED
    for v, size in values:
        h = xxhash.xxh64((v % (1 << 8 * size)).to_bytes(size, "little"), h).intdigest()
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=None)
def draws(j):
    first = [j, *[hash_numbers((j, 4), (t, 4)) % fp.BINS for t in range(fp.ROUNDS)]]
    return first + sorted(range(fp.BINS), key=lambda b: signed(hash_numbers((j, 4), (b, 4), (-1, 4))))


@functools.lru_cache(maxsize=None)
def brute(text):
    """The values of a text's bins from the definition: least hash a bin, then draws until one isn't empty."""
    w = [hash_text(x) for x in words(text)]
    if not w:
        hashes = [hash_text(text)]
    elif len(w) < fp.WORDS:
        h = 0
        for x in w:
            h = hash_numbers((h, 8), (x, 8))
        hashes = [h]
    else:
        hashes = [hash_numbers(*[(x, 8) for x in w[i : i + fp.WORDS]]) for i in range(len(w) - fp.WORDS + 1)]
    bins = {}
    for h in map(signed, hashes):
        b = (h >> 55) + 256
        bins[b] = min(bins.get(b, h), h)
    out = []
    for j in range(fp.BINS):
        out.append(next(bins[b] for b in draws(j) if b in bins) & 15)
    return "".join(f"{v:X}" for v in out)


def shingles(text):
    w = words(text)
    return {tuple(w[n : n + fp.WORDS]) for n in range(max(1, len(w) - fp.WORDS + 1))} if w else {text}


def corpus():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(700)]
    rows = [(n, " ".join(base[rng.randrange(400) :][: rng.randrange(1, 300)])) for n in range(20, 60)]
    return [*ODD, *rows, (61, " ".join(base)), (62, " ".join([*base[:690], "other", "end"])), (63, "Four words are few"), (64, "four WORDS are few"), (65, "four words, are: many")]


def followed(rows):
    """The rows in descending order of id and hash of the text, each with the next one's text."""
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), signed(hash_text(r[1] or ""))), reverse=True)
    return [(i, t or "", order[(n + 1) % len(order)][1] or "") for n, (i, t) in enumerate(order)]


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_against_the_definition(spark, parts):
    rows = corpus()
    rows += [(70, f"the same id {n}") for n in range(40)]  # more than a range holds
    rows += [(None, f"no id {n}") for n in range(20)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parts=parts).collect()
    want = []
    for i, text, after in followed(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [brute(x) for x in (text, edited, after)]
        near = [max((sum(a == b for a, b in zip(prints[0], x, strict=True)) / fp.BINS - 1 / 16) / (15 / 16), 0.0) for x in prints[1:]]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *[round(x, 9) for x in near]))
    assert sorted([(*r[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=repr) == sorted(want, key=repr)


def test_likeness_estimates_similarity(spark):
    rng = random.Random(2)
    rows = []
    for n in range(60):
        base = [f"d{n}w{k}" for k in range(600)]
        for at in rng.sample(range(600), n):
            base[at] = f"edit{at}"
        rows.append((n, " ".join(f"d{n}w{k}" for k in range(600)), " ".join(base)))
    df = spark.createDataFrame(rows, "n long, a string, b string")
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "x"), "b", "y").select("n", fp.likeness(F.col("x"), F.col("y")).alias("near"))
    off = []
    for r in df.collect():
        a, b = shingles(rows[r["n"]][1]), shingles(rows[r["n"]][2])
        off.append(r["near"] - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.08


def test_odd_rows(spark, odd, nothing):
    got = fp.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (6, 7)}) == 1  # equal texts
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)}) == 3  # texts without words are told apart
    assert fp.fingerprints(nothing).count() == 0
    alone = fp.fingerprints(odd.where("doc_id = 6")).collect()
    assert [(r["near_next"], r["near_edited"] < 1) for r in alone] == [(1.0, True)]


def test_plan_is_native(spark, data):
    plan = QUERIES["op13_fingerprints"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
