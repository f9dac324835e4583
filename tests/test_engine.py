"""A small repository from files to findings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import engine
from lodestone.sources import files

POLICY = """
groups:
  - {name: core, paths: ["pkg/**"], parent: product}
  - {name: web, paths: ["web/**"], parent: product}
aliases: {"@/": "web/"}
ignore: ["ignored/**"]
"""
SOURCES = {
    "pkg/__init__.py": '"""The package."""\n',
    "pkg/util.py": "def helper(x):\n    return x\n",
    "pkg/core.py": "from .util import helper\nimport os\n\nclass Core:\n    def run(self):\n        return helper(1)\n",
    "pkg/consumer.py": "from pkg.core import Core\nfrom .missing import nothing\n\ndef main():\n    return Core().run()\n",
    "tests/test_core.py": "from pkg.core import Core\nfrom pkg.util import helper\n",
    "web/App.tsx": "import {h} from './helper';\nimport x from '@/lib/none';\nimport React from 'react';\nexport const App = () => h\n",
    "web/helper.ts": "export function h() {}\n",
    "docs/a.md": "# Title\n[core](../pkg/core.py)\n",
    "ignored/secret.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    for path, text in SOURCES.items():
        (at / path).parent.mkdir(exist_ok=True)
        (at / path).write_text(text)
    return at


@pytest.fixture(scope="module")
def frame(spark, root):
    return engine.scan(spark, str(root), files.policy(POLICY))


def test_scan(frame):
    facts = {r["path"]: r for r in frame["facts"].collect()}
    assert set(facts) == set(SOURCES) - {"ignored/secret.py"}
    assert facts["pkg/core.py"]["grp"] == "core" and facts["tests/test_core.py"]["artifact_type"] == "test" and facts["docs/a.md"]["artifact_type"] == "documentation"
    assert facts["pkg/__init__.py"]["summary"] == "The package." and "Core" in facts["pkg/core.py"]["symbols"]
    edges = {(r["source"], r["target"] or r["external"], r["status"]) for r in frame["edges"].collect()}
    assert edges == {
        ("pkg/core.py", "pkg/util.py", "resolved_internal"), ("pkg/core.py", "os", "external"), ("pkg/consumer.py", "pkg/core.py", "resolved_internal"), ("pkg/consumer.py", "pkg.missing", "unresolved_internal"),
        ("tests/test_core.py", "pkg/core.py", "resolved_internal"), ("tests/test_core.py", "pkg/util.py", "resolved_internal"),
        ("web/App.tsx", "web/helper.ts", "resolved_internal"), ("web/App.tsx", "@/lib/none", "unresolved_internal"), ("web/App.tsx", "react", "external"),
    }
    assert frame["deltas"].where("kind = 'add'").count() == 8


def test_second_scan(spark, root, frame):
    before = spark.createDataFrame(frame["facts"].collect(), frame["facts"].schema)
    (root / "pkg/util.py").write_text('def helper(x):\n    "says"\n    return x\n')
    (root / "web/helper.ts").unlink()
    after = engine.scan(spark, str(root), files.policy(POLICY), before.drop("analysis_status", "node"), 1)
    status = {r["path"]: r["analysis_status"] for r in after["facts"].collect()}
    assert status["pkg/util.py"] == "metadata_only" and status["pkg/core.py"] == "raw_unchanged"
    assert {r["path"]: r["kind"] for r in after["deltas"].collect()} == {"pkg/util.py": "change", "web/helper.ts": "delete"}


@pytest.fixture(scope="module")
def model(spark, root):
    f = {p: n for n, p in enumerate(sorted(set(SOURCES) - {"ignored/secret.py"}))}
    modules = spark.createDataFrame([(n, p, "core" if p.startswith("pkg") else "web" if p.startswith("web") else "", "python" if p.endswith("py") else "other", "test" if p.startswith("tests") else "source", 100 * n, float(n), None, p.replace("/", " ")) for p, n in f.items()], "node long, path string, grp string, language string, kind string, loc long, complexity double, summary string, symbols string")
    e = [("pkg/core.py", "pkg/util.py"), ("pkg/consumer.py", "pkg/core.py"), ("tests/test_core.py", "pkg/core.py"), ("tests/test_core.py", "pkg/util.py"), ("web/App.tsx", "web/helper.ts")]
    edges = spark.createDataFrame([(f[a], f[b], None, "imports", "resolved_internal", 1) for a, b in e] + [(f["pkg/core.py"], None, "os", "imports", "external", 1)], "source long, target long, external string, type string, status string, weight long")
    changes = spark.createDataFrame([(f["pkg/core.py"], "pkg/core.py", f"2024-01-0{n}", f"s{n}", n) for n in range(1, 6)], "node long, path string, at string, sha string, additions long").withColumn("at", F.col("at").cast("timestamp"))
    coverage = spark.createDataFrame([(f["pkg/core.py"], 0.5, 1, 2)], "node long, line double, covered long, total long")
    findings = spark.createDataFrame([(f"k{n:02}", "r", "large_module", ("info", "error")[n % 2], "new", 0.9, ["pkg/core.py"] if n % 3 else ["pkg/util.py", "pkg/core.py"]) for n in range(12)], "stable_key string, rule string, finding_type string, severity string, status string, confidence double, affected array<string>")
    groups = spark.createDataFrame([("core", "product"), ("web", "product"), ("spare", None)], "name string, parent string")
    return engine.Engine(modules, edges, changes, coverage, findings, groups), f


def test_inventory(model):
    eng, f = model
    rows = {r["path"]: r for r in eng.ledger().collect()}
    assert (rows["pkg/core.py"]["fan_in"], rows["pkg/core.py"]["fan_out"], rows["pkg/core.py"]["change_count"], rows["pkg/core.py"]["line_coverage"]) == (2, 2, 5, 0.5)
    assert rows["pkg/core.py"]["finding_count"] == 12 and rows["pkg/core.py"]["last_commit"] == "s5"
    o = eng.overview().first()
    assert (o["files"], o["total"], o["resolution_rate"], o["open_findings"]) == (8, 6, 1.0, 12)
    totals = {r["name"]: r["total_files"] for r in eng.hierarchy().collect()}
    assert totals == {"core": 4, "web": 2, "product": 6, "ungrouped": 2}
    assert eng.module_table(text="core", limit=1).first()["path"] in ("pkg/core.py", "tests/test_core.py")
    assert {r["check"]: r["faults"] for r in eng.doctor().collect()} == {"repeated_nodes": 0, "repeated_paths": 0, "edges_without_module": 0}
    assert eng.timeline(3).count() == 3 and eng.digest().first()["n_rows"] == 8 and eng.metrics().first()["maximum_degree"] == 3


def test_graph_and_search(model):
    eng, f = model
    nodes, links = eng.graph(external=True)
    assert nodes.count() == 8 and links.where("target = 'external:os'").count() == 1
    assert eng.overlay("size").agg(F.max("heat")).first()[0] == 1.0
    with pytest.raises(ValueError):
        eng.overlay("odd")
    assert eng.search("pkg/core.py").first()["path"] == "pkg/core.py"
    detail = eng.file_detail("pkg/core.py")
    assert detail["uses"].count() == 2 and detail["used_by"].count() == 2 and detail["changes"].count() == 5


def test_questions(model):
    eng, f = model
    got = eng.impact("pkg/util.py")
    assert (got["direct"], got["transitive"], got["risk"]) == (2, 1, "medium")
    assert eng.impact("pkg/util.py", protected=("pkg/util.py",))["risk"] == "high"
    scope = eng.scope("Change the core helper", primary=2)
    assert "pkg/core.py" in {r["path"] for r in scope["primary"].collect()}
    assert [r["path"] for r in scope["tests"].collect()] == ["tests/test_core.py"]


def test_scope_past_two_hundred(spark, model):
    """A module behind 300 better ones of one folder is primary with its rank, and keeps its lexical score among the related."""
    f = [(n, f"a/parser_{n:03}.py", "core", "python", "source") for n in range(300)] + [(300, "b/parser.txt", "core", "python", "source")]
    one = model[0]
    modules = one.modules.limit(0).unionByName(spark.createDataFrame(f, "node long, path string, grp string, language string, kind string"), allowMissingColumns=True)
    modules = modules.fillna("", [c for c, t in modules.dtypes if t == "string"])
    eng = engine.Engine(modules, spark.createDataFrame([(0, 299, None, "imports", "resolved_internal", 1), (0, 298, None, "imports", "resolved_internal", 1)], one.edges.schema), one.changes, one.coverage, one.findings, one.groups)
    scope = eng.scope("parser", primary=3)
    got = scope["primary"].orderBy("place").collect()
    ranked = [r["node"] for r in eng.rank_goal("parser").collect()]
    assert len(ranked) == 301 and 300 in {r["node"] for r in got} and [r["rank"] for r in got] == [ranked.index(r["node"]) + 1 for r in got]
    lexical = {r["node"]: r["score"] for r in scope["related"].collect()}
    assert {298, 299} <= set(lexical)


def test_findings(model):
    eng, f = model
    page = eng.findings_page(size=5)
    seen, cursor = [r["stable_key"] for r in page.rows], page.cursor
    while cursor:
        page = eng.findings_page(size=5, cursor=cursor)
        seen, cursor = seen + [r["stable_key"] for r in page.rows], page.cursor
    assert len(seen) == len(set(seen)) == page.total
    assert eng.findings_page(view="diagnostics", severity="info").total == 6 and eng.findings_page(view="diagnostics", module="UTIL").total == 4
    with pytest.raises(ValueError):
        eng.findings_page(view="odd")
    assert {(r["facet"], r["value"]): r["n"] for r in eng.finding_facets().collect()}[("severity", "error")] == 6
