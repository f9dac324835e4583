from __future__ import annotations

import fnmatch
from pathlib import PurePath

import pytest
from pyspark.sql import functions as F

from lodestone.functions import exprs as x
from lodestone.functions import scores


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_half_even(spark):
    halves = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4, 2.6]
    got = [r["v"] for r in spark.createDataFrame([(n, h) for n, h in enumerate(halves)], "n int, h double").orderBy("n").select(x.half_even("h").alias("v")).collect()]
    assert got == [round(h) for h in halves]


@pytest.mark.parametrize("text, term", [("aaaa", "aa"), ("abcabc", "bc"), ("", "a"), ("a", ""), ("ééé", "é"), ("aXa", "x")])
def test_literal_count(spark, text, term):
    want = text.count(term) if term else 0
    assert value(spark, x.literal_count(F.lit(text), term)) == want


def test_effective_skips_empty(spark):
    assert value(spark, x.effective(F.lit(""), F.lit(None).cast("string"), F.lit("b"), default="c")) == "b"
    assert value(spark, x.effective(F.lit(""), F.lit(None).cast("string"), default="c")) == "c"


@pytest.mark.parametrize("pattern", ["*.py", "src/*", "**/test_*.py", "docs/**", "src/?.py", "src/[ab].py", "src/[!a].py", "a/*.py", "web/**/x.ts"])
def test_glob(spark, pattern):
    paths = ["a.py", "src/a.py", "src/b.py", "src/c/d.py", "test_x.py", "a/test_x.py", "docs/x.md", "docs/a/b.md", "x/a/b.py", "web/a/x.ts", "web/x.ts", "src/a.pyc"]

    def matches(p):
        return fnmatch.fnmatchcase(p, pattern) or PurePath(p).match(pattern) or (pattern.startswith("**/") and fnmatch.fnmatchcase(p, pattern[3:]))

    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", x.glob_any("p", [pattern]).alias("m"))
    assert {r["p"]: r["m"] for r in df.collect()} == {p: matches(p) for p in paths}


def test_included_and_groups(spark):
    df = spark.createDataFrame([("src/a.py",), ("src/gen/b.py",), ("docs/c.md",)], "p string")
    got = df.select("p", x.included("p", ["src/**"], ["**/gen/*"]).alias("i"), x.first_group("p", [("core", ["src/a*"]), ("rest", ["*"])]).alias("g")).collect()
    assert [(r["i"], r["g"]) for r in got] == [(True, "core"), (False, "rest"), (False, "rest")]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.d.py",), ("top.py",), ("./x//y.py",)], "p string")
    got = df.select(x.basename("p"), x.stem("p"), x.parent("p"), x.normalised_path("p")).collect()
    assert [tuple(r) for r in got] == [("c.d.py", "c.d", "a/b", "a/b/c.d.py"), ("top.py", "top", ".", "top.py"), ("y.py", "y", "./x/", "x/y.py")]
    assert [value(spark, x.safe_path(F.lit(p))) for p in ("a/b", "../a", "a/../b", "/a", "a..b")] == [True, False, False, False, True]


def test_goal_terms(spark):
    assert value(spark, x.goal_terms(F.lit("Add a new parseTree for the Widgets of X"))) == ["new", "parse", "tree", "widgets", "widget"]


def test_module_aliases(spark):
    assert value(spark, x.module_aliases(F.lit("pkg.src.app.core"))) == ["pkg.src.app.core", "src.app.core", "app.core"]
    assert value(spark, x.relative_import(F.lit("a.b.c"), F.lit("..d"))) == "a.b.d"
    assert value(spark, x.relative_import(F.lit("a.b.c"), F.lit("d"))) == "d"


def test_fingerprint_ignores_order(spark):
    one, two = F.array(F.lit("B  c"), F.lit("a")), F.array(F.lit("A"), F.lit("b C"), F.lit("a "))
    assert value(spark, x.intent_fingerprint(one)) == value(spark, x.intent_fingerprint(two))


def test_scores(spark):
    row = spark.range(1).select(
        scores.finding_priority(F.lit("critical"), F.lit(1.0), F.lit(40), F.lit(60), F.lit(9), F.lit(80.0), F.lit(0.0), F.lit(True)).alias("most"),
        scores.finding_priority(F.lit("info"), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(None).cast("double"), F.lit(False)).alias("least"),
        scores.module_attention(F.lit(500), F.lit(50.0), F.lit(30), F.lit(20), F.lit(99), F.lit(True)).alias("full"),
        scores.module_attention(F.lit(500), F.lit(50.0), F.lit(30), F.lit(20), F.lit(99), F.lit(False)).alias("none"),
        x.backoff_seconds(F.lit(3)).alias("b3"), x.backoff_seconds(F.lit(20)).alias("b20"), scores.adaptive_limit(F.lit(2001)).alias("limit"),
    ).first()
    assert tuple(row) == (100, 8, 100, None, 8.0, 300.0, 16)


def test_visibility_and_joined_paths(spark):
    names = {"__own": "private", "__init__": "protected", "_half": "protected", "run": "public", "__": "protected", "": "public"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", x.visibility("n").alias("v")).collect()
    assert {r["n"]: r["v"] for r in got} == names
    for folder, path, want in (("a/b", "../c", "a/c"), ("a", "../../../c", "c"), (".", "./x//y", "x/y"), ("a/b", ".", "a/b"), ("", "", "")):
        assert value(spark, x.joined_path(F.lit(folder), F.lit(path))) == want
