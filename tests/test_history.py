"""Trees and histories read from git objects."""

from __future__ import annotations

import hashlib
import os
import subprocess

import pytest

from lodestone import engine
from lodestone.history import HistoryImport
from lodestone.operators import temporal
from lodestone.sources import files, gitsource

POLICY = files.policy("groups: [{name: core, paths: ['pkg/**']}]")
FRAMES = (
    {"pkg/a.py": "x = 1\n", "pkg/b.py": "import pkg.a\n", "blob.bin": "a\0b", "notes.md": "# n\n"},
    {"pkg/a.py": "x = 2\n", "pkg/b.py": "import pkg.a\n", "web/c.ts": "import './d'\n"},
    {"pkg/b.py": "import pkg.a\ny = 1\n", "web/c.ts": "import './d'\n", "web/d.ts": "export class D {}\n"},
)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at = tmp_path_factory.mktemp("git")
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, frame in enumerate(FRAMES):
        for path in [p.relative_to(at) for p in at.rglob("*") if p.is_file() and ".git" not in p.parts]:
            (at / path).unlink()
        for path, text in frame.items():
            (at / path).parent.mkdir(exist_ok=True)
            (at / path).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", f"frame {n}")
    (at / ".gitignore").write_text("*.log\n")
    (at / "x.log").write_text("ignored")
    (at / "new.py").write_text("z = 1\n")
    os.symlink(at / "new.py", at / "link.py")
    return str(at)


def test_revisions(spark, repository):
    shas = gitsource.commits(repository)
    assert len(shas) == 3 and gitsource.commit_of(repository, "HEAD~1") == shas[1]
    for sha, frame in zip(shas, FRAMES, strict=True):
        got = {r["path"]: r["text"] for r in files.git_tree(spark, repository, sha).collect()}
        assert got == {p: t for p, t in frame.items() if "\0" not in t}
    assert {r["path"] for r in files.git_tree(spark, repository).collect()} == {*FRAMES[2], "new.py", ".gitignore"}
    assert [r["path"] for r in files.git_tree(spark, repository, "HEAD", include=["web/**"], max_bytes=14).collect()] == ["web/c.ts"]
    for name in ("--all", "nowhere"):
        with pytest.raises(ValueError):
            gitsource.commit_of(repository, name)


def test_import_goes_on_where_it_stopped(spark, repository, tmp_path):
    shas = gitsource.commits(repository)
    asked = []
    job = HistoryImport(spark, str(tmp_path / "job"), POLICY, lambda sha: files.git_tree(spark, repository, sha))
    assert job.state()["status"] == "queued"
    assert job.run(shas, lambda: len(asked) == 1 or asked.append(1))["status"] == "cancelled" and job.state()["done"] == 1

    def broken(sha):
        raise OSError("away")

    with pytest.raises(OSError):
        HistoryImport(spark, str(tmp_path / "job"), POLICY, broken).run(shas)
    assert job.state()["status"] == "failed" and "away" in job.state()["error"]
    done = HistoryImport(spark, str(tmp_path / "job"), POLICY, lambda sha: files.git_tree(spark, repository, sha)).run(shas)
    assert (done["status"], done["done"], done["total"], done["error"]) == ("completed", 3, 3, None)
    for n, frame in enumerate(FRAMES):
        at = {r["path"] for r in temporal.as_of(job.deltas(), ["path"], n).collect()}
        assert at == {p for p, t in frame.items() if "\0" not in t}
    kinds = {(r["seq"], r["path"]): r["kind"] for r in job.deltas().collect()}
    assert kinds[(1, "pkg/a.py")] == "change" and kinds[(1, "notes.md")] == "delete" and kinds[(2, "web/d.ts")] == "add" and (1, "pkg/b.py") not in kinds
    assert job.facts(2).where("path = 'web/d.ts'").first()["symbols"] == "D"


# ---- what a frame costs


def tree(spark, frame):
    return spark.createDataFrame([(p, hashlib.sha256(t.encode()).hexdigest(), t) for p, t in frame.items()], "path string, raw_hash string, text string")


def test_a_frame_costs_what_changed(spark, tmp_path):
    """Contents are parsed once, whatever frames and files they are in; carried edges are those of a scan from scratch."""
    start = {f"pkg/m{n}.py": f"import pkg.m{(n + 1) % 12}\nfrom pkg.core import Core\n\ndef f{n}():\n    return {n}\n" for n in range(12)}
    start |= {"pkg/core.py": "class Core:\n    pass\n", "pkg/copy.py": "class Core:\n    pass\n", "solo/a.py": "import os\nimport ext.lib\n", "web/a.ts": "import './b'\nimport '@/c'\n", "web/b.ts": "export const b = 1\n", "web/lone.ts": "import 'react'\n"}
    frames = [start]
    frames.append(frames[-1] | {"pkg/m3.py": start["pkg/m3.py"] + "# a comment\n"})  # content only
    frames.append({p: t for p, t in frames[-1].items() if p not in ("pkg/core.py", "web/b.ts")} | {"web/c.ts": "export const c = 1\n"})  # names go and come
    frames.append(frames[-1] | {"ext/lib.py": "x = 1\n", "pkg/m3.py": start["pkg/m3.py"]})  # a new top-level name; an old content again
    by = {str(n): tree(spark, f) for n, f in enumerate(frames)}
    policy = files.policy("groups: [{name: core, paths: ['pkg/**']}]\naliases: {'@/': 'web/'}")
    job = HistoryImport(spark, str(tmp_path / "job"), policy, by.__getitem__)
    seen, work = set(), {}
    edges = lambda df: {tuple(r[c] for c in ("source", "target", "external", "status", "weight")) for r in df.collect()}
    for n, frame in enumerate(frames):
        job.run([str(k) for k in range(n + 1)])
        work = {r["reason"]: r["files"] for r in job.work().where(f"seq = {n}").collect()}
        fresh = {t for t in frame.values()} - seen  # the same text is the same content in one language
        fresh = {(p.rsplit(".")[-1], t) for p, t in frame.items() if t in fresh}
        assert {r["n_parsed"] for r in job.work().where(f"seq = {n}").collect()} == {len(fresh)}
        seen |= set(frame.values())
        whole = engine.scan_tree(spark, by[str(n)], policy)
        assert edges(job.edges(n)) == edges(whole["edges"])
        if n == 1:
            assert work == {"content_changed": 1, "carried_forward": len(frame) - 1}
        if n == 2:  # all that import pkg.core, and the scripts that import b or c
            assert work["resolver_context_changed"] >= 13 and work["carried_forward"] >= 2
        if n == 3:
            assert ("solo/a.py", "ext/lib.py", None, "resolved_internal", 1) in edges(job.edges(n))


def test_invalidation_reasons(spark):
    none: list = []
    rows = [
        ("new", ["a.new"], ["F"], none, True, None), ("moved", ["a.moved2"], none, none, True, None), ("offers", ["a.offers"], ["G", "H"], none, True, None), ("refers", ["a.refers"], none, ["x", "y"], True, None),
        ("text", ["a.text"], ["T"], ["x"], True, None), ("upgraded", ["a.up"], none, none, True, "analyzer_upgraded"), ("policy", ["a.policy"], none, none, False, "policy_changed"),
        ("equal", ["q1"], none, ["H"], False, None), ("longer", ["q2"], none, ["lib.a.new"], False, None), ("shorter", ["q3"], none, ["moved2"], False, None), ("gone", ["q4"], none, ["a.lost"], False, None),
        ("other", ["q5"], none, ["b.new2", "oved2", ""], False, None), ("same", ["q6"], none, ["T"], False, None),
    ]
    now = spark.createDataFrame(rows, "path string, namespace array<string>, interface array<string>, refs array<string>, changed boolean, cause string")
    was = [("moved", ["a.moved"], none, none), ("offers", ["a.offers"], ["G"], none), ("refers", ["a.refers"], none, ["x"]), ("lost", ["a.lost"], none, none)]
    was += [(p, n, i, r) for p, n, i, r, *_ in rows if p in ("text", "upgraded", "policy", "equal", "longer", "shorter", "gone", "other", "same")]
    plan = temporal.invalidation_plan(now, spark.createDataFrame(was, "path string, namespace array<string>, interface array<string>, refs array<string>"), "path")
    assert {r["path"]: r["reason"] for r in plan.collect()} == {
        "new": "namespace_changed", "moved": "namespace_changed", "offers": "interface_changed", "refers": "resolver_context_changed", "text": "content_changed", "upgraded": "analyzer_upgraded", "policy": "policy_changed",
        "equal": "resolver_context_changed", "longer": "resolver_context_changed", "shorter": "resolver_context_changed", "gone": "resolver_context_changed", "other": "carried_forward", "same": "carried_forward",
    }
    tokens = spark.createDataFrame([(1, "core"), (2, "pkg.core"), (3, "score"), (4, "pkg"), (5, "")], "k long, token string")
    hit = temporal.invalidated(tokens, spark.createDataFrame([("pkg.core",), ("",)], "token string"), "k", "token")
    assert sorted(r["k"] for r in hit.collect()) == [1, 2]
