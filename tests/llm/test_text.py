from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chatformat, decontam, langid, licenses, linededup, quality, topk
from lodestone.llm.tokens import default_tokenizer

from .conftest import ODD, thue_morse, words

KEYS = ["doc_id", "text", "piece", "n", "class_id", "score"]


# ---- line dedup


def brute_lines(rows, min_chars, min_docs):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, odd, nothing):
    shared = "A line that Many documents share, long enough é"
    rows = [*ODD, *[(n, f"own {n}\n  {shared.upper() if n % 2 else shared} \t\n{shared}\nend") for n in range(20, 27)], (30, shared), (31, shared), (31, shared), (None, shared)]
    rows = [(i, t.replace("É", "é") if t else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.dedup_lines(df, min_docs=3)
    assert sorted(((r["doc_id"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["text"]) for r in got.collect()), key=repr) == brute_lines(rows, 40, 3)
    assert linededup.dedup_lines(odd).columns == [*KEYS, "line_dedup"]
    assert linededup.dedup_lines(nothing).count() == 0


# ---- licences


def places(text, phrase):
    w, p = words(text), phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_licenses(spark, odd, nothing):
    head = "Lorem ipsum. "
    rows = [
        *ODD, (20, head + "Released Under the MIT License, under the mit license."), (21, "apache\nlicense version 2 cc-by-nc 4.0"), (22, "under the mit licenses"), (23, "CC BY NC"),
        (24, "Permission is hereby granted, free of any charge, to any person obtaining one copy of this software and associated documentation files"), (25, "permission is granted to nobody"),
        (26, "This wor\u212a is licensed under cc by nc 4.0"), (27, "THIS WORK IS licensed under CC by"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for i, t in rows:
        found = sorted((p, label) for phrase, label in licenses.PHRASES for p in places(t, phrase))
        r = by[i]
        assert (r["n_words"], r["n_base"]) == (len(words(t)), len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert by[24]["labels"] == "mit" and by[24]["base_labels"] == "" and by[24]["spans"][0]["label"] == "mit" and by[25]["labels"] == ""
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(nothing).count() == 0


def test_license_plan_is_native(odd):
    plan = licenses.scan_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- search


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.3, (400, 24)).astype(np.float32)
    vectors[50:150] = vectors[0]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (500, [None] * 24), (600, [float("nan")] * 24), (700, [float("inf")] * 24), (800, []), (None, vectors[1].tolist()), (900, [1.0, 2.0]), (901, [3.0, 1.0]), (41, vectors[7].tolist())]
    rows += [(40, (vectors[40] * 2).tolist()), (60, vectors[60].tolist()), (60, vectors[60].tolist()), (902, vectors[3].tolist() + [5.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            whole.setdefault(i, []).append(np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int).tolist())
    want = []
    for q in [i for i in whole if i % 20 == 0]:
        own = min(whole[q])
        others = [(i, x) for i, xs in whole.items() for x in xs]
        others.remove((q, own))
        scored = sorted((-sum(a * b for a, b in zip(own, x, strict=False)), i) for i, x in others)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    for block in (4096, 7):
        assert sorted(map(tuple, topk.exact_top_k(df, k=10, every=20, block=block).collect())) == sorted(want)
    assert topk.exact_top_k(df.where("false")).count() == 0


def test_top_k_of_wide_numbers(spark):
    vectors = {20: [123456.5, -98765.25], 21: [123456.75, 98765.0], 22: [-7.0, 5.5], 40: [1e30, -1e30], 41: [1e12, 1e12], 42: [1e12, 1e12 + 1]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    near = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    whole = {i: [int(float(near(int(np.floor(1024 * c))))) for c in v] for i, v in vectors.items()}
    want = []
    for q in (20, 40):
        scored = sorted((-near(sum(a * b for a, b in zip(whole[q], x, strict=True))), i) for i, x in whole.items() if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.exact_top_k(df, k=4, every=20).collect())) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_bounds_hold(n, seed):
    rng = np.random.default_rng(seed)
    q, x = rng.normal(0, 100, (5, n)), rng.normal(0, 100, (9, n))
    bounds = [topk._features(q, s) @ topk._features(x, s).T for s in topk.LEVELS]
    assert all((b + 1e-6 >= q @ x.T).all() for b in bounds)


# ---- chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\\n>imend_sart ok", max_size=30))
def test_escapes(text):
    assert chatformat.unescape(chatformat.escape(text)) == text and "<|" not in chatformat.escape(text)
    role = chatformat.escape_role(text)
    assert chatformat.unescape_role(role) == text and "\n" not in role and "<|" not in role


def test_chat_trees(spark, nothing):
    said = "<|im_end|><|im_start|>assistant ok"
    talks = {c: [("user", "Hello there"), ("assistant", "Hi!"), ("user", f"Question {c % 3}"), ("assistant", said)][: c % 4 + 1] for c in range(1, 30)}
    talks[40] = [("user", None), (None, ""), ("we\nird<|", "x"), ("assistant", "a"), ("assistant", "a")]
    rows = [(c, n, r, t) for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for limit in (1 << 16, 20):
        trees = chatformat.format_conversations(df, default_tokenizer(), max_tokens=limit)
        got = {r["conv_id"]: r for r in chatformat.read_conversations(trees, default_tokenizer()).collect()}
        assert set(got) == set(talks)
        for c, turns in talks.items():
            assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r or "", t or "") for r, t in turns]
            assert got[c]["loss_text"] == "".join(t or "" for r, t in turns if r == "assistant")
        for tree in trees.collect():
            check_tree(tree)
    whole = chatformat.format_conversations(df.coalesce(1), default_tokenizer()).collect()
    turns = {tuple(t[: n + 1]) for t in talks.values() for n in range(len(t))}
    assert sum(len(t["segments"]) for t in whole) <= len(turns) + 4 * len(whole)
    assert chatformat.format_conversations(df.where("false"), default_tokenizer()).count() == 0


@pytest.mark.parametrize("size", [10, 13])
def test_thue_morse_words_are_told_apart(spark, size):
    s, t = thue_morse(1 << size)
    talk = spark.createDataFrame([(1, 0, "user", s), (1, 1, "assistant", t)], "conv_id long, turn long, role string, text string")
    back = chatformat.read_conversations(chatformat.format_conversations(talk, default_tokenizer()), default_tokenizer()).first()
    assert [x["text"] for x in back["turns"]] == [s, t] and back["loss_text"] == t
    item = spark.createDataFrame([(1, " ".join([s] * 9))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([s] * 9)), (2, " ".join([t] * 9))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.contaminated(docs, item).collect()] == [1]


def test_long_conversations(spark, monkeypatch):
    """Conversations past the bounds come in parts and are read back whole, in order, repeated turns and null ids among them."""
    monkeypatch.setattr(chatformat, "MAX_TURNS", 7)
    monkeypatch.setattr(chatformat, "MAX_CHARS", 400)
    rows = [(1, n, ("user", "assistant")[n % 2], f"turn {n} <|x|> " * (n % 5)) for n in range(60)]
    rows += [(2, n, "user", "short") for n in range(3)] + [(None, n % 4, "assistant", "null id") for n in range(30)] + [(3, None, "assistant", "word " * 300), (3, 1, None, None)]
    rows += [(4, 1, "user", "the same")] * 25
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    trees = chatformat.format_conversations(df, default_tokenizer())
    parts = chatformat.read_conversations(trees, default_tokenizer()).collect()
    assert max(len(r["turns"]) for r in parts) <= 7 and sum(r["conv_id"] == 1 for r in parts) >= 9 and [r["part"] for r in parts if r["conv_id"] == 2] == [None]
    for tree in trees.collect():
        check_tree(tree)
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        said, loss = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chatformat.digests(trees, default_tokenizer()).collect()}
    assert got == want


def check_tree(tree):
    at = 0
    for n, s in enumerate(tree["segments"]):
        assert s["start"] == at and s["parent"] < n
        at += s["length"]
        up, k = [], s["parent"]
        while k >= 0:
            up.append(tree["segments"][k])
            k = up[-1]["parent"]
        assert s["position"] == sum(u["length"] for u in up)
        seen = {p for a in s["attends"] for p in range(a["from"], a["to"])}
        assert seen == {p for u in up for p in range(u["start"], u["start"] + u["length"])}
    assert at == len(tree["ids"])


# ---- language


def brute_profile(texts, top):
    from collections import Counter

    n: Counter = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = f" {w} "
            n.update(w)
            n.update(p[i : i + 2] for i in range(len(p) - 1))
            n.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))[:top]]


@pytest.mark.parametrize("text", ["Hello, wörld! Hello", "a", "日本 日本語", "x1y  z"])
def test_ranks(text):
    assert langid.ranked(text, 20).tolist() == brute_profile([text], 20)


def test_long_texts_are_counted_as_a_whole(spark, monkeypatch):
    texts = ["abcdefg hij " * 40, "a" * 700, "ab1cd_ef, ΑΣ.Α ΑΣ " * 30, "wörter und längere Wörter " * 25, "x" * 90 + " " + "y" * 200]
    want = [langid.ranked(t, 50).tolist() for t in texts]
    assert want[0] == brute_profile([texts[0]], 50)
    whole = langid.learn_profiles(spark.createDataFrame([(t, "l") for t in texts], "text string, lang string"), top=50).orderBy("rank").collect()
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "CHUNK_CHARS", size)
        assert ["".join(langid._parts(t)) for t in texts] == [t.lower() for t in texts]
        assert [langid.ranked(t, 50).tolist() for t in texts] == want
    assert [r["gram"] for r in whole] == brute_profile(texts, 50)


def test_profiles_and_answers(spark, odd, nothing, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    learned = langid.learn_profiles(docs, top=50)
    texts = {r["doc_id"]: r for r in docs.collect()}
    for lang in ("en", "de"):
        got = [r["gram"] for r in learned.where(f"lang = '{lang}'").orderBy("rank").collect()]
        assert got == brute_profile([r["text"] for r in texts.values() if r["lang"] == lang], 50)
    out = langid.identify(docs, langid.learn_profiles(docs.where("doc_id % 2 = 0"))).where("doc_id % 2 = 1").collect()
    assert sum(r["language"]["lang"] == r["lang"] for r in out) / len(out) > 0.97
    by = {r["doc_id"]: r["language"] for r in langid.identify(odd, learned).collect()}
    assert all(by[n] == ("und", 0.0) for n in (1, 2, 3, 4)) and all(0 <= r["score"] <= 1 for r in by.values())
    assert langid.identify(nothing, learned).columns == [*KEYS, "language"]
    assert {r["language"]["lang"] for r in langid.identify(odd, learned.where("false")).collect()} == {"und"}


# ---- quality


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_interactions_by_all_pairs(seed):
    rng = np.random.default_rng(seed)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, quality.RANK)))
    slot, x = rng.choice(quality.SLOTS, 6, replace=False), rng.normal(size=6)
    pairs = sum(m.factor[slot[i]] @ m.factor[slot[j]] * x[i] * x[j] for i in range(6) for j in range(i))
    assert m.margin([(slot, x)])[0] == pytest.approx(0.3 + m.weight[slot] @ x + pairs)


def test_quality_of_held_out(spark, odd, nothing, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet").select("doc_id", "quality")
    held = langid.held_out("doc_id", 3, 1)
    machine = quality.learn(docs.where(~held).join(labels, "doc_id"))
    out = quality.score_quality(docs.where(held).join(labels, "doc_id"), machine).collect()
    assert sum((r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in out) / len(out) > 0.93
    scores = [r["quality_score"] for r in quality.score_quality(odd, machine).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.score_quality(nothing, machine).count() == 0
    none = quality.learn(docs.where("false").withColumn("quality", docs["doc_id"]))
    assert quality.score_quality(odd, none).first()["quality_score"] == pytest.approx(0.5)
    few = quality.learn(docs.join(labels, "doc_id"), max_rows=40)
    assert quality.score_quality(odd, few).count() == len(ODD)


def brute_quality(rows, labels):
    """Features, fit order, scores and answers of the whole query, row by row."""
    crc = lambda i: zlib.crc32(str(i).encode())
    learned = [(i, t, n, labels[i]) for i, t, n in rows if crc(i) % 3 != 1 and labels.get(i) is not None]
    return learned, {i: crc(i) % 3 == 1 for i, _, _ in rows}


def test_quality_query_by_hand(spark, data, monkeypatch):
    """The query against the machine fitted and scored here, over other partitions and a tighter bound."""
    from lodestone.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    learned, held = brute_quality([tuple(r) for r in docs.collect()], labels)
    by = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learned.sort(key=lambda r: by[r[0]])
    rows = [next(quality.features([t], [[n]])) for _, t, n, _ in learned]
    machine = quality.fit([(s, v.astype(np.float32).astype(float)) for s, v in rows], np.array([float(q) for *_, q in learned]), ["n_chars"])
    want = {r["doc_id"]: float(machine.score([next(quality.features([r["text"]], [[r["n_chars"]]]))])[0]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, data).collect()}
    assert got.keys() == want.keys() and len(learned) > 50
    for i, r in got.items():
        assert r["held_out"] == held[i] and r["score"] == pytest.approx(want[i], abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_does_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "n_chars")
    both = docs.join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality"), "doc_id")
    machines = [quality.learn(both.repartition(n).unionByName(both.limit(5)), metadata=["n_chars"], max_rows=60) for n in (1, 3, 7)]
    for m in machines[1:]:
        assert m.bias == machines[0].bias and (m.weight == machines[0].weight).all() and (m.factor == machines[0].factor).all()


def test_quality_reads_metadata(spark):
    rows = [(n, "the same words", float(10 ** (n % 2 * 3)) if n % 7 else None, n % 2) for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size double, quality int")
    scored = quality.score_quality(df, quality.learn(df, metadata=["size"])).collect()
    assert all((r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in scored if r["size"] is not None)
    assert all(0 <= r["quality_score"] <= 1 for r in scored)


# ---- decontamination


def brute_tiles(doc, item, seed):
    """Greedy string tiling from its definition: all pairs of places, longest first."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < seed:
            return sum(t[2] for t in tiles), tiles
        tiles.append((d, i, n))
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=14), st.integers(2, 4))
def test_tiles(doc, item, seed):
    at = [(d, i) for d in range(len(doc) - seed + 1) for i in range(len(item) - seed + 1) if doc[d : d + seed] == item[i : i + seed]]
    if not at:
        return
    places = np.array(at)
    got = decontam.tile(places[:, 0], places[:, 1], seed)
    covered, want = brute_tiles(doc, item, seed)
    assert sorted(got) == sorted(want) and sum(t[2] for t in got) == covered
    for d, i, n in got:
        assert doc[d : d + n] == item[i : i + n]


def test_leaks_of_items_with_common_stems(spark):
    rng = np.random.default_rng(9)
    stem = [f"stem{n}" for n in range(8)]
    items = {n: stem[: n % 9] + [f"w{w}" for w in rng.integers(0, 6, 4 + n % 12)] for n in range(24)}
    texts = {n: stem + items[n % 24][(n % 5) :] + [f"w{w}" for w in rng.integers(0, 6, 10)] for n in range(40)} | {50: stem, 51: stem * 3}
    want = set()
    for d, text in texts.items():
        for i, item in items.items():
            covered = brute_tiles(text, item, 3)[0]
            if covered >= 0.5 * len(item):
                want.add((d, i, covered))
    frame = lambda rows, name: spark.createDataFrame([(n, " ".join(t)) for n, t in rows.items()], f"{name} long, text string")
    got = decontam.contaminated(frame(texts, "doc_id"), frame(items, "item_id"), seed=3)
    assert sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in got.collect()) == sorted(want)
    grams = spark.createDataFrame([(1, 1, 30, 7, 0, 1), (1, 1, 30, 8, 1, 1), (1, 1, 30, 9, 2, 1), (1, 1, 30, 6, 3, 1), (2, 2, 30, 7, 0, 1), (2, 2, 30, 5, 1, 1)], "_item long, _item_text long, _item_words int, _run long, _item_at int, _n int")
    ranked = decontam.ranked_places(grams, 0.5, 5)
    assert sorted((r["_item"], r["_run"]) for r in ranked.where("_common").collect()) == [(1, 7), (2, 7)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 5))
def test_progressions_hold_each_place_once(runs, length):
    run = np.array(runs, dtype=np.uint64)
    r, first, n, step = decontam.progressions(run, np.arange(len(run)), length)
    places = sorted((int(x), int(a + k * s)) for x, a, m, s in zip(r, first, n, step, strict=True) for k in range(m))
    assert places == sorted((x, i) for i, x in enumerate(runs)) and (step <= length).all() and ((n > 1) == (step > 0)).all()


def test_repeated_words(spark):
    """Texts that repeat themselves with short periods against tiles from their definition."""
    rng = np.random.default_rng(4)
    words = ["a"] * 12 + ["b", "a"] * 7 + ["a", "b", "c"] * 6
    texts = {n: words[n : n + 20] + [str(x) for x in rng.integers(0, 3, 4)] + words[(5 * n) % 30 :][:15] for n in range(12)} | {20: ["a"] * 60, 21: ["a", "b"] * 30, 22: ["a", "b", "c", "a", "b"] * 8}
    items = {n: (texts[n][3:12] + texts[n][-12:]) for n in range(6)} | {20: ["a"] * 25, 21: ["b", "a"] * 12, 22: ["a", "b", "a", "c", "a", "b", "a"] * 3, 23: ["a", "b", "c", "a", "b"] * 4}
    want = {(d, i, c) for d, text in texts.items() for i, item in items.items() if (c := brute_tiles(text, item, 5)[0]) >= 0.5 * len(item)}
    frame = lambda rows, name: spark.createDataFrame([(n, " ".join(t)) for n, t in rows.items()], f"{name} long, text string")
    got = decontam.contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert len(want) > 20 and {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got} == want
    long_ = decontam.contaminated(frame({1: ["a"] * 20_000}, "doc_id"), frame({1: ["a"] * 1000}, "item_id")).collect()
    assert [(r["coverage"], len(r["tiles"])) for r in long_] == [(1.0, 1)]


def test_leaks(spark, odd, nothing):
    passage = [f"tok{n}" for n in range(40)]
    turned = passage[20:] + passage[:20]
    filler = [f"fill{n}" for n in range(200)]
    rows = [
        (100, " ".join(filler + passage + filler)), (101, " ".join(turned)), (102, " ".join(passage[:15] + filler)), (103, ", ".join(w.upper() for w in passage)), (104, " ".join(filler)),
        (105, " ".join(passage)), (105, " ".join(passage)), (106, None), (None, " ".join(passage)), (107, " ".join(reversed(passage))),
    ]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, "too short"), (3, None), (None, " ".join(passage)), (1, " ".join(passage))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], len(r["tiles"])) for r in got) == [(100, 1, 1.0, 1), (101, 1, 1.0, 2), (103, 1, 1.0, 1), (105, 1, 1.0, 1)]
    kept = decontam.decontaminate(df, bench)
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == [102, 104, 106, 107, None]
    assert decontam.decontaminate(odd, bench).columns == KEYS and decontam.contaminated(odd, bench.where("false")).count() == 0 and decontam.contaminated(nothing, bench).count() == 0


def test_digest_of_lines_is_sha256():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
