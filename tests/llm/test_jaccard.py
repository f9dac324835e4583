from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import jaccard
from lodestone.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD, thue_morse, words


def brute(rows, k=5, threshold=0.8):
    docs = {}
    for i, t in rows:
        w = words(t)
        docs[i] = frozenset(tuple(w[n : n + k]) for n in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids, root, n = sorted(docs), {i: i for i in docs}, dict.fromkeys(docs, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(ids):
        for b in ids[:p]:
            both = len(docs[a] & docs[b])
            if both and both >= threshold * (len(docs[a]) + len(docs[b]) - both) - 1e-9:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, find(i), n[i]) for i in ids)


def corpus(seed):
    """A large group of near copies with chains, smaller ones, exact copies, short texts."""
    rng = random.Random(seed)
    rows = []
    for base, size in ((0, 120), (1, 8), (2, 3)):
        text = [f"b{base}w{n}" for n in range(90)]
        for k in range(size):
            own = list(text)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append((1000 * base + k, " ".join(own)))
    rows += [(5000 + k, rows[3][1].upper()) for k in range(30)]
    rows += [(6000 + k, f"short {k % 2}") for k in range(5)] + [(7000 + k, " ".join(f"r{k}x{n}" for n in range(60))) for k in range(20)]
    return rows


@pytest.mark.parametrize("small, block", [(32, 512), (4, 16)])
def test_join_against_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(small)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_join(df).collect())) == brute(rows)


def test_odd_rows(spark, odd, nothing):
    rows = list({i: (i, t) for i, t in ODD if i is not None}.values())
    assert sorted(map(tuple, jaccard.jaccard_join(odd).collect())) == brute(rows)
    kept = jaccard.dedup_near(odd)
    assert kept.columns == odd.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([i for i, _ in ODD if i != 7], key=repr)
    assert jaccard.jaccard_join(nothing).count() == 0 and jaccard.dedup_near(nothing).count() == 0


def test_rows_that_share_an_id(spark):
    """Each text of an id is joined, and its texts are in one class."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (3, b), (4, b), (2, b + " more"), (5, c), (2, None), (2, a + " more"), (6, None), (6, "x")]
    for kind in ("int", "long"):
        got = sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()))
        assert got == [(1, 1, 1), (2, 1, 3), (3, 1, 2), (4, 1, 2), (5, 5, 0), (6, 6, 0)]


def test_thue_morse_words_are_not_linked(spark):
    rows = [(2 * n + k, t) for n in range(10, 14) for k, t in enumerate(thue_morse(1 << n))]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, i, 0) for i, _ in rows]


def test_other_thresholds(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(df, threshold=0.9).collect())) == brute(rows, threshold=0.9)
    with pytest.raises(ValueError):
        jaccard.jaccard_join(df, threshold=0.5)


def test_bitmaps(spark, monkeypatch):
    from lodestone.llm import bitmaps

    keys = spark.range(1000).selectExpr("xxhash64(id) AS k")
    own = np.array([r["k"] for r in keys.collect()], np.int64)
    bitmap = bitmaps.bitmap_of(keys)
    assert bitmap.has(own).all() and bitmap.has(own + 12345).mean() < 0.1
    monkeypatch.setattr(bitmaps, "MOST_BITS", 1 << 11)
    assert bitmaps.bitmap_of(keys) is None and bitmaps.bitmap_of(keys.where("false")).has(own).sum() == 0
    rows = corpus(5)
    assert sorted(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_pruning_is_the_posterior():
    rng = np.random.default_rng(0)
    least = jaccard.least_agreements(0.8, 1e-3, 32)
    for n, m in zip((32, 64, 96, 128), least, strict=True):
        sampled = rng.beta(m + 1, n - m + 1, 400_000)
        assert (sampled >= 0.8).mean() == pytest.approx(1e-3, rel=3) and (rng.beta(m - 4 + 1, n - m + 4 + 1, 400_000) >= 0.8).mean() < 1e-3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)))
    agree = (jaccard.signature(np.unique(a)) == jaccard.signature(np.unique(b))).mean()
    assert agree == pytest.approx(800 / 1100, abs=0.15)


def test_components(spark):
    e = [(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 3), (6, 6)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}


# ---- pipeline and registered queries


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept and kept <= {r[0] for r in docs.select("doc_id").collect()}
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, data).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert near == {c for _, c, _ in brute(rows)}
    packed = corpus_pipeline.best_fit_packing(spark, docs.limit(20), data)
    assert packed.select("doc_id").distinct().count() == 20


def test_stages_take_odd_rows(spark, data, odd, nothing):
    frame = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "piece", "class_id")
    for docs in (frame, frame.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.best_fit_packing(spark, docs, data).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    want = c.sql(ORACLE_SQL[name])
    by = sorted(df.columns)
    assert by == sorted(want.columns)
    columns = list(want.columns)
    assert sorted(tuple(r[c] for c in by) for r in df.collect()) == sorted(tuple(r[columns.index(c)] for c in by) for r in want.fetchall())
