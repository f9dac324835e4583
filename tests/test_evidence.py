from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators import evidence as ev


def test_evidence_is_bounded(spark):
    modules = spark.createDataFrame([(1, "a"), (2, "b")], "node long, summary string")
    symbols = spark.createDataFrame([(1, n, f"s{n}", "function") for n in range(9)], "node long, start_line int, name string, kind string")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "source long, target long")
    changes = spark.createDataFrame([(1, f"2024-01-{n:02}", f"c{n}") for n in range(1, 12)], "node long, at string, sha string")
    row = ev.evidence(modules, symbols, edges, changes, symbol_limit=4).where("node = 1").first()
    assert [s["name"] for s in row["symbols"]] == ["s0", "s1", "s2", "s3"] and len(row["relations"]) == 2
    assert [c["sha"] for c in row["latest"]] == [f"c{n}" for n in range(11, 3, -1)]
    docs = ev.neighbour_documents(edges, spark.createDataFrame([(2, "text")], "node long, text string"))
    assert [(r["node"], len(r["documents"])) for r in docs.collect()] == [(1, 1)]
    claims = spark.createDataFrame([(1, "intrinsic", 9, "new"), (1, "context", 3, "best")], "node long, kind string, id long, claim string")
    assert [(r["summary"], r["deterministic_summary"]) for r in ev.overlaid(modules, claims).orderBy("node").collect()] == [("best", "a"), ("b", "b")]


def test_evidence_of_a_module_with_many_rows(spark, monkeypatch):
    """Its rows are dealt to several tasks; what belongs to no module is neither sorted nor counted."""
    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    dealt = []
    monkeypatch.setattr(ev, "tasks", lambda s, n: dealt.append((n, storage.tasks(s, n))) or dealt[-1][1])
    modules = spark.createDataFrame([(1, "a"), (2, "b")], "node long, summary string")
    symbols = spark.createDataFrame([(1, n % 7, f"s{n:03}", "function") for n in range(200)], "node long, start_line int, name string, kind string")
    edges = spark.createDataFrame([(1, 1000 + n) for n in range(150)] + [(5, 6 + n) for n in range(900)], "source long, target long")
    changes = spark.createDataFrame([(1, f"2024-{n % 12 + 1:02}", f"c{n:03}") for n in range(100)], "node long, at string, sha string")
    row = ev.evidence(modules, symbols, edges, changes, 9, 5, 4).where("node = 1").first()
    assert [(s["start_line"], s["name"]) for s in row["symbols"]] == sorted((n % 7, f"s{n:03}") for n in range(200))[:9]
    assert [tuple(r) for r in row["relations"]] == [("uses", 1000 + n) for n in range(5)]
    assert sorted(c["sha"] for c in row["latest"]) == sorted(f"c{n:03}" for n in range(100) if n % 12 == 11)[:4]
    assert dealt == [(200, 10)]


def test_contexts_and_members(spark):
    f = spark.createDataFrame([("k", ["b", "a"])], "stable_key string, affected array<string>")
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert ev.finding_context(f, path("c", "a"), path("d", "c")).first()["paths"] == ["b", "a", "c", "d"]
    groups = spark.createDataFrame([("top", None), ("low", "top")], "name string, parent string")
    modules = spark.createDataFrame([("low", "x"), ("top", "y")], "grp string, path string")
    assert {r["grp"]: r["members"] for r in ev.members_of(groups, modules).collect()} == {"top": ["x", "y"], "low": ["x"]}
    assert [r["path"] for r in ev.forbidden_paths(path("a.key", "b.key", "c.py"), ["*.key"], ["b.*"]).collect()] == ["a.key"]
    areas = spark.createDataFrame([("a",), ("a",), ("b",)], "root string")
    assert {tuple(r) for r in ev.visible_counts(areas, ["b"]).collect()} == {("a", 2, 2), ("b", 0, 1)}


def test_summaries_are_those_of_whole_contexts(spark):
    """Repeated, null and empty lists of paths, paths in scope and impact, equal findings; and no array of the shared paths for each finding."""
    f = spark.createDataFrame([("k", ["b", "a", "b"]), ("k", ["b", "a", "b"]), ("l", []), ("m", None), ("n", ["c", None, "z"]), (None, ["d"])], "stable_key string, affected array<string>")
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    for scope, impact in ((path("c", "a", "c"), path("d", "c", None)), (path(), path())):
        want = sorted((str(r["stable_key"]), None if r["paths"] is None else len(r["paths"]), r["paths"] and r["paths"][:2]) for r in ev.finding_context(f, scope, impact).collect())
        assert sorted((str(r["stable_key"]), r["n"], r["paths"]) for r in ev.context_summaries(f, scope, impact, 2).collect()) == want
    n = 20_000  # as whole contexts: 800 million paths
    keys = spark.range(n).select(F.col("id").cast("string").alias("stable_key"), F.array(F.col("id").cast("string")).alias("affected"))
    many = spark.range(2 * n).select(F.col("id").cast("string").alias("path"))
    assert [tuple(r) for r in ev.context_summaries(keys, many, many).groupBy("n").count().collect()] == [(2 * n, n)]


def test_formats(spark):
    row = spark.range(1).select(
        ev.percent(F.lit(0.256)).alias("p"), ev.thousands(F.lit(12345)).alias("t"), ev.eta_seconds(F.lit(10.0), F.lit(4), F.lit(8)).alias("e"), ev.cost(F.lit(1000), F.lit(500), 3.0, 15.0).alias("c"),
        ev.reasons(F.lit(12), F.lit(3), F.lit(30.0), F.lit(0.4), F.lit(True)).alias("r"), ev.action_kind(F.lit("dependency_cycle")).alias("a"),
    ).first()
    assert tuple(row) == ("25.6%", "12,345", 10.0, 0.0105, ["it was resolved before and is back", "changed 12 times", "complex code", "covered to 40%"], "decouple")
    claims = spark.createDataFrame([("a", 0.9, ["x"] * 6, 90), ("b", 0.5, ["x"] * 9, 99)], "path string, confidence double, responsibilities array<string>, split_score int")
    assert sorted(r["signal"] for r in ev.cohesion_signals(claims).collect()) == ["many_responsibilities", "split"]


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"b": 1, // note\n "a": "http://x", }', "json"), (2, "b: 1\na: [x]", "yaml"), (3, "{", "json")], "k int, t string, l string")
    assert {r["k"]: r["canonical"] for r in ev.canonical_documents(df, "k", "t", "l").collect()} == {1: '{"a":"http://x","b":1}', 2: '{"a":["x"],"b":1}', 3: None}
    texts = spark.createDataFrame([('{"name": "  long name ", "confidence": 3.5}',), ("bad",)], "t string")
    assert [(r["name"], r["confidence"]) for r in ev.validated(texts, "t", "name string, confidence double", {"name": 4}).collect()] == [("long", 1.0), (None, None)]


def test_payload():
    payload = {"primary": [{"path": "p"}], "related": [{"path": f"r{n}", "summary": "x" * 300} for n in range(20)], "goal": "g"}
    out = ev.trim_payload(payload, ["related", "primary"], 900)
    assert len(json.dumps(out).encode()) <= 900 and out["primary"] and out["omitted"]["related"] == 20 - len(out["related"])
