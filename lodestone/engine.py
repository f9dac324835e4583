"""The query surface over one versioned entity graph.

``Engine`` holds the model as DataFrames and answers the catalogue of questions; each answer
is a DataFrame (or, for pages and contexts of bounded size, plain values).  ``scan`` turns a source tree into the next frame.

Model columns:

* ``modules``: node, path, grp, language, kind, loc, complexity, summary, symbols
* ``edges``: source, target, external, type, status, weight
* ``changes``: node, path, at, sha, additions
* ``coverage``: node, line, covered, total
* ``findings``: stable_key, rule, finding_type, severity, status, confidence, affected (array of paths), first_at
* ``groups``: name, parent
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.factstore import KEY, FactStore
from lodestone.functions import scores
from lodestone.functions.exprs import WORD, effective, first_group, half_even, joined_path, module_aliases, parent, ratio, relative_import, saturated, stem
from lodestone.operators import evidence as ev
from lodestone.operators import extract, graph, paging, search, temporal, windows
from lodestone.operators import relational as rel
from lodestone.sources import files
from lodestone.storage import checkpointed

FACTS = ("raw_hash", "structural_hash", "language", "artifact_type", "loc", "complexity", "grp")


@dataclass
class Engine:
    modules: DataFrame
    edges: DataFrame
    changes: DataFrame
    coverage: DataFrame
    findings: DataFrame
    groups: DataFrame

    # ---- inventory

    def degrees(self) -> DataFrame:
        return graph.degree_all(self.edges)

    def ledger(self) -> DataFrame:
        """One row per module with degrees, churn, coverage, finding pressure and attention."""
        churn = rel.change_summary(self.changes, "node", "at", "sha")
        cover = self.coverage.groupBy("node").agg(F.coalesce(ratio(F.sum("covered"), F.sum("total")), F.avg("line")).alias("line_coverage"))
        points = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in scores.PRESSURE.items()], F.lit(2))
        open_ = self.findings.where(F.col("status").isin(*paging.ACTIVE)).select(F.explode("affected").alias("path"), points.alias("p")).groupBy("path").agg(F.count("*").alias("finding_count"), F.sum("p").alias("pressure"))
        own = self.modules.join(self.degrees(), "node", "left").join(churn, "node", "left").join(cover, "node", "left").join(open_, "path", "left")
        own = own.fillna({"fan_in": 0, "fan_out": 0, "change_count": 0, "finding_count": 0, "pressure": 0})
        score = scores.module_attention(F.col("loc"), F.col("complexity"), F.col("fan_in") + F.col("fan_out"), F.col("change_count"), F.col("pressure"), F.col("kind").isin("source", "test"))
        return own.withColumn("attention_score", score).withColumn("attention_label", scores.attention_label(score))

    def module_table(self, text: str = "", grp: str = "", language: str = "", sort: str = "attention_score", descending: bool = True, limit: int = 50) -> DataFrame:
        rows = self.ledger()
        for name, value in (("grp", grp), ("language", language)):
            rows = rows.where(F.col(name) == value) if value else rows
        rows = rows.where(F.contains(F.lower("path"), F.lit(text.lower()))) if text else rows
        return paging.sorted_nulls_last(rows, sort, descending, ["attention_score", "loc", "complexity", "path", "change_count", "fan_in", "fan_out", "line_coverage"], "path").limit(paging.clamped(limit, 500))

    def overview(self) -> DataFrame:
        """One row of totals."""
        m = self.modules.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.avg("complexity").alias("mean_complexity"), F.count_distinct("language").alias("languages"))
        q = rel.edge_quality(self.edges).select("total", "internal", "resolution_rate", F.col("status").alias("resolution"))
        f = self.findings.where(F.col("status").isin(*paging.ACTIVE)).agg(F.count("*").alias("open_findings"))
        return m.join(F.broadcast(q)).join(F.broadcast(f))  # one row each

    def languages(self) -> DataFrame:
        return self.modules.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.col("loc").desc(), "language")

    def hierarchy(self) -> DataFrame:
        own = self.modules.select(effective("grp", default="ungrouped").alias("name"), F.lit(1).alias("files"), "loc")
        named = self.groups.select("name", "parent").unionByName(own.select("name", F.lit(None).cast("string").alias("parent")).distinct().join(self.groups.select("name"), "name", "left_anti"))
        return graph.rollup_tree(named, own, ["files", "loc"]).where("total_files > 0")

    def metrics(self) -> DataFrame:
        d = graph.degree_internal(self.edges).agg(F.sum("fan_out").alias("dependency_count"), F.max(F.col("fan_in") + F.col("fan_out")).alias("maximum_degree"))
        m = self.modules.agg(F.count("*").alias("artifact_count"), F.sum("loc").alias("total_loc"), F.avg("complexity").alias("average_complexity"))
        return m.join(F.broadcast(d)).withColumn("average_degree", 2 * F.col("dependency_count") / F.nullif(F.col("artifact_count"), F.lit(0)))

    # ---- graph

    def graph(self, external: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes with degrees, churn and coverage, and edges; external labels as nodes where asked for."""
        nodes = self.ledger().select("node", "path", "grp", "loc", "fan_in", "fan_out", "change_count", "line_coverage")
        links = self.edges.where("target is not null").select("source", F.col("target").cast("string").alias("target"), "type", "weight")
        if external:
            out = self.edges.where("target is null").select("source", F.concat_ws(":", "status", "external").alias("target"), "type", "weight")
            links = links.unionByName(out)
        return nodes, links

    def overlay(self, lens: str) -> DataFrame:
        """``node, heat`` from 0 to 1 for one of the lenses."""
        values: dict[str, Column] = {
            "size": F.col("loc"), "complexity": F.col("complexity"), "coupling": F.col("fan_in") + F.col("fan_out"), "incoming": F.col("fan_in"), "outgoing": F.col("fan_out"),
            "churn": F.col("change_count"), "findings": F.col("finding_count"), "coverage": 1 - F.col("line_coverage"),
        }
        if lens not in values:
            raise ValueError(f"no lens {lens}")
        rows = self.ledger().select("node", values[lens].cast("double").alias("v"))
        top = rows.agg(F.max("v").alias("top"))
        return rows.join(F.broadcast(top)).select("node", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("v") / F.nullif("top", F.lit(0)), F.lit(0.0)))).alias("heat"))

    def file_detail(self, path: str, limit: int = 50) -> dict[str, DataFrame]:
        one = self.modules.where(F.col("path") == path)
        names = self.modules.select("node", F.col("path").alias("other"))
        uses = self.edges.join(one.select(F.col("node").alias("source")), "source", "left_semi").join(names.withColumnRenamed("node", "target"), "target", "left")
        used = self.edges.join(one.select(F.col("node").alias("target")), "target", "left_semi").join(names.withColumnRenamed("node", "source"), "source", "left")
        return {
            "module": one, "uses": uses.orderBy("type", "other", "external").limit(limit), "used_by": used.orderBy("type", "other").limit(limit),
            "changes": self.changes.where(F.col("path") == path).orderBy(F.col("at").desc(), "sha").limit(limit), "findings": self.findings.where(F.array_contains("affected", path)),
        }

    def search(self, query: str, limit: int = 50) -> DataFrame:
        text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("symbols", F.lit("")))
        return search.search(self.modules.withColumn("_text", text), query, "path", "_text", paging.clamped(limit, 200)).drop("_text")

    def timeline(self, limit: int = 32) -> DataFrame:
        """Commits, evenly sampled with both ends."""
        commits = self.changes.groupBy("sha").agg(F.max("at").alias("at"), F.count("*").alias("files"), F.sum("additions").alias("additions"))
        return windows.even_sample(commits, ["at", "sha"], limit).orderBy("at", "sha")

    # ---- findings

    def ranked_findings(self) -> DataFrame:
        """Findings with the largest figures of their modules and a priority."""
        m = self.ledger().select("path", "change_count", (F.col("fan_in") + F.col("fan_out")).alias("degree"), "complexity", "line_coverage")
        figures = self.findings.select("stable_key", F.explode("affected").alias("path")).join(m, "path", "left").groupBy("stable_key").agg(
            F.count("*").alias("affected_count"), F.max("change_count").alias("changes"), F.max("degree").alias("degree"), F.max("complexity").alias("complexity"), F.min("line_coverage").alias("coverage")
        )
        both = self.findings.join(figures, "stable_key", "left").fillna({"affected_count": 0})
        score = scores.finding_priority(F.col("severity"), F.coalesce("confidence", F.lit(0.0)), F.col("changes"), F.col("degree"), F.col("affected_count"), F.col("complexity"), F.col("coverage"), F.col("status") == "regressed")
        return both.withColumn("priority_score", score).withColumn("priority_label", scores.priority_label(score)).withColumn("_regressed", (F.col("status") == "regressed").cast("int"))

    def findings_page(self, view: str = "attention", size: int = 20, cursor: str | None = None, statuses: tuple[str, ...] = (), severity: str = "", module: str = "", budget: int | None = None) -> paging.Page:
        if view not in ("attention", "diagnostics"):
            raise ValueError(f"no view {view}")
        rows = self.ranked_findings()
        rows = rows.where(paging.attention()) if view == "attention" else rows
        wanted = paging.statuses(statuses)
        rows = rows.where(F.col("status").isin(*wanted)) if wanted else rows
        rows = rows.where(F.col("severity") == severity) if severity else rows
        rows = rows.where(F.exists("affected", lambda p: F.contains(F.lower(p), F.lit(module.lower())))) if module else rows
        keys = [("priority_score", True), ("_regressed", True), ("stable_key", False)]
        return paging.read_page(rows, keys, size, cursor, budget, view=view, statuses=wanted, severity=severity, module=module)

    def finding_facets(self) -> DataFrame:
        return rel.facets(self.findings, "severity", "status", "finding_type")

    # ---- questions of an agent

    def rank_goal(self, goal: str) -> DataFrame:
        m = self.modules.withColumns({"stem": F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", ""), "semantic": F.lit("")})
        return search.rank_goal(m, goal, F.col("kind") == "test")

    def scope(self, goal: str, primary: int = 8, limit: int = 50, depth: int = 2) -> dict[str, DataFrame]:
        """What to read for a goal: primary modules spread over folders, related ones by proximity, tests, and open findings."""
        ranked = checkpointed(self.rank_goal(goal).select("node", "path", "grp", "score"))
        rows = ranked.select(F.lit("goal").alias("key"), "node", parent("path").alias("folder"), effective("grp", default="ungrouped").alias("grp"), "path", "score")
        top = windows.diversity_bound(rows, "key", [F.col("score").desc(), F.col("path")], primary).drop("_fill").distinct()
        chosen = windows.diversity_select(top.withColumn("rank", F.row_number().over(_by_score()).cast("long")), "key", primary).drop("rank")
        before = ranked.select(F.col("score").alias("_score"), F.col("path").alias("_path"))
        ahead = F.count_if((F.col("_score") > F.col("score")) | ((F.col("_score") == F.col("score")) & (F.col("_path") < F.col("path"))))
        ranks = before.join(F.broadcast(chosen.select("node", "score", "path"))).groupBy("node").agg((ahead + 1).alias("rank"))
        chosen = checkpointed(chosen.join(ranks, "node").select("key", "rank", "node", "folder", "grp", "path", "score", "place"))
        seeds = chosen.select("node")
        nodes = self.modules.select("node", parent("path").alias("folder"), "grp", "path").join(ranked.select("node", F.col("score").alias("lexical")), "node", "left")
        related = graph.related(self.edges, seeds, nodes, depth, limit)
        context = self.modules.join(seeds.withColumn("primary", F.lit(True)).unionByName(related.select("node", F.lit(False).alias("primary"))), "node").select("path", "primary")
        found = ev.scoped_findings(self.findings.where(F.col("status").isin(*paging.ACTIVE)), context)
        return {"primary": chosen, "related": related, "tests": self.related_tests(seeds, related.select("node"), goal), "findings": found}

    def related_tests(self, primary: DataFrame, related: DataFrame, goal: str = "", limit: int = 12) -> DataFrame:
        """Tests by their neighbours among the primary modules and the related ones, the primary modules' names in their paths, and
        the goal's words there."""
        near = graph.undirected(self.edges)
        hits = lambda of, name: near.join(of.select(F.col("node").alias("target")).distinct(), "target", "left_semi").groupBy(F.col("source").alias("node")).agg(F.count("*").alias(name))
        chosen = self.modules.join(primary, "node", "left_semi").select(F.regexp_replace(F.lower(stem("path")), "^test_|_test$", "").alias("s")).where("s <> ''").distinct()
        tests = self.modules.where("kind = 'test'").select("node", "path")
        words = {w.lower() for w in re.findall(WORD, goal) if len(w) > 3}
        goals = sum((F.contains(F.lower("path"), F.lit(w)).cast("int") for w in sorted(words)), F.lit(0))
        t = tests.join(hits(primary, "p"), "node", "left").join(hits(related, "r"), "node", "left").join(_named(tests, chosen), "node", "left").fillna(0)
        return t.withColumn("score", scores.related_test(F.col("p"), F.col("r"), F.col("names"), goals)).where("score > 0").orderBy(F.col("score").desc(), "path").limit(limit).select("node", "path", "score")

    def impact(self, path: str, protected: tuple[str, ...] = (), conflicts: int = 0) -> dict:
        """Who depends on a module, directly and through others, and how risky a change is."""
        target = self.modules.where(F.col("path") == path).select("node")
        found = graph.dependants(self.edges, target).join(self.modules.select("node", "path", "kind"), "node")
        found = checkpointed(found)
        d = graph.degree_distinct(self.edges).join(target, "node", "left_semi").select((F.col("fan_in") + F.col("fan_out")).alias("d")).first()
        n = found.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"), F.count_if(F.contains(F.lower("path"), F.lit("migration"))).alias("migrations")).first()
        row = found.sparkSession.range(1).select(scores.impact_risk(F.lit(path in protected), F.lit(conflicts), F.lit(n["transitive"]), F.lit(d["d"] if d else 0), F.lit(n["direct"]), F.lit(n["migrations"])).alias("risk")).first()
        return {"dependants": found, "direct": n["direct"], "transitive": n["transitive"], "risk": row["risk"]}

    def collisions(self, branches: DataFrame) -> DataFrame:
        """Branches ``(branch, path)`` that touch the same paths."""
        return rel.collisions(branches, "branch", "path")

    # ---- health

    def doctor(self) -> DataFrame:
        """``check, faults``: repeated nodes and paths, edges without a module."""
        ends = self.edges.select(F.col("source").alias("node")).unionByName(self.edges.where("target is not null").select(F.col("target").alias("node")))
        checks = {"repeated_nodes": rel.duplicates(self.modules, ["node"]), "repeated_paths": rel.duplicates(self.modules, ["path"]), "edges_without_module": rel.orphans(ends, ["node"], self.modules)}
        return rel.inventory(checks).withColumnsRenamed({"table": "check", "rows": "faults"})

    def digest(self) -> DataFrame:
        return rel.table_digest(self.modules, ["path", "loc", "grp"])

    def risk_heat(self) -> DataFrame:
        """``node, risk``: size, churn and coupling together, from 0 to 100."""
        return self.ledger().select("node", half_even(40 * saturated("loc", 500) + 30 * saturated("change_count", 20) + 30 * saturated(F.col("fan_in") + F.col("fan_out"), 30)).cast("int").alias("risk"))


def _named(tests: DataFrame, stems: DataFrame) -> DataFrame:
    """``node, names``: how many of the stems ``s`` each test's path holds.  The pieces of a path that are as long as some stem are
    joined with the stems, so neither table is gathered; the lengths are fewer than a path has characters."""
    lengths = stems.agg(F.collect_set(F.char_length("s")).alias("lengths"))
    p = F.lower("path")
    pieces = F.transform(F.filter("lengths", lambda n: n <= F.char_length(p)), lambda n: F.transform(F.sequence(F.lit(1), F.char_length(p) - n + 1), lambda i: F.substring(p, i, n)))
    held = tests.join(F.broadcast(lengths)).select("node", F.explode(F.array_distinct(F.flatten(pieces))).alias("s"))
    return held.join(stems, "s").groupBy("node").agg(F.count("*").alias("names"))


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.col("score").desc(), "path")  # over the few rows that caps leave


# ---- scanning


def scan(spark: SparkSession, root: str, policy: dict, previous: DataFrame | None = None, sequence: int = 0, store: FactStore | None = None, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next frame of a source tree: facts, edges, and deltas against the frame before.

    ``facts`` has path, FACTS, summary, symbols and an analysis status; ``edges`` resolved imports by path; ``plan`` why each
    file's edges were resolved or carried."""
    return scan_tree(spark, files.tree(spark, root, policy["include"], policy["ignore"]), policy, previous, sequence, store, edges)


def scan_tree(spark: SparkSession, tree: DataFrame, policy: dict, previous: DataFrame | None = None, sequence: int = 0, store: FactStore | None = None, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """``scan`` of files that were read already (``path, text, raw_hash``), of a folder or of a revision.

    Only contents that ``store`` doesn't know are parsed.  With the facts and edges of the frame before, edges of sources that
    the invalidation plan leaves alone are carried forward; the result is the same as without."""
    store = store or FactStore(spark)
    n_parsed = store.learn(tree)
    found = checkpointed(store.of(tree))
    lang = F.nullif(F.col("language"), F.lit(""))
    declared, inferred = first_group("path", [(g["name"], g.get("paths", [])) for g in policy["groups"]]), extract.inferred_group("path", lang)
    facts = found.select(
        "path", "raw_hash", "structural_hash", lang.alias("language"), extract.artifact_type("path", lang).alias("artifact_type"), F.col("lines_of_code").alias("loc"), "complexity", F.coalesce(declared, inferred).alias("grp"),
        extract.group_source(declared).alias("group_source"), extract.runtime("path", lang).alias("runtime"), "summary", F.array_join("symbols", " ").alias("symbols"), "analyzer", F.lit(policy_digest(policy)).alias("policy"),
    )
    facts = temporal.reuse_status(facts, previous, "path") if previous is not None else facts.withColumn("analysis_status", F.lit("new"))
    facts = checkpointed(facts.withColumn("node", F.xxhash64("path")))
    if previous is None or edges is None:
        plan = facts.select("path", F.lit("content_changed").alias("reason"), F.lit(True).alias("recompute"))
        resolved = resolve_edges(found, found, policy["aliases"])
    else:
        plan = checkpointed(_plan(store, facts, found, previous, policy))
        again = plan.where("recompute").select(F.col("path").alias("source"))
        fresh = resolve_edges(found, found.join(again.withColumnRenamed("source", "path"), "path", "left_semi"), policy["aliases"])
        old = edges.join(found.select(F.col("path").alias("source")), "source", "left_semi").select(*fresh.columns)
        resolved = temporal.carry_forward(old, fresh, again)
    frame = facts.select("path", *FACTS)
    empty = frame.where("false")
    deltas = temporal.delta_encode(empty if previous is None else previous.select("path", *FACTS), frame, ["path"], FACTS, sequence)
    return {"facts": facts, "edges": resolved, "deltas": deltas, "plan": plan, "n_parsed": n_parsed}


def policy_digest(policy: dict) -> str:
    return hashlib.sha256(json.dumps(policy, sort_keys=True, default=str).encode()).hexdigest()


def _module(path: str = "path") -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))


def _package(path: str = "path") -> Column:
    """The package that one leading dot of a module's imports means; of a package, its own directory."""
    return F.when(F.col(path).rlike(r"/__init__\.pyi?$"), _module(path)).otherwise(F.regexp_replace(_module(path), r"\.?[^.]*$", ""))


def views(found: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``path, namespace, interface, refs`` of files with their facts: the dotted names that a file is known by, offers and refers to."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    dotted = F.replace(bare, F.lit("/"), F.lit("."))
    parts = F.split(dotted, r"\.")
    short = F.array(bare, dotted, F.element_at(parts, -1), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), ".")), F.regexp_replace(dotted, r"\.index$", ""))
    namespace = F.array_compact(F.concat(short, F.when(F.col("language") == "python", module_aliases(_module())).otherwise(F.array().cast("array<string>"))))
    base = lambda i: F.when(i["module"].startswith("."), relative_import(F.col("_package"), i["module"])).otherwise(i["module"])
    imported = F.flatten(F.transform("imports", lambda i: F.array_compact(F.array(base(i), i["name"], F.concat_ws(".", base(i), i["name"])))))
    wanted = F.transform("scripts", lambda s: F.replace(F.regexp_replace(_wanted(s, aliases), r"\.[jt]sx?$", ""), F.lit("/"), F.lit(".")))
    return found.withColumn("_package", _package()).select("path", namespace.alias("namespace"), F.col("symbols").alias("interface"), F.concat(imported, wanted).alias("refs"))


def _plan(store: FactStore, facts: DataFrame, found: DataFrame, previous: DataFrame, policy: dict) -> DataFrame:
    """The invalidation plan of a frame.  Besides, whether an import is one of the repository's or external depends on the first parts of all
    module names, so where one of those comes or goes, all that refer to it are resolved again."""
    before = previous.select("path", "raw_hash", F.coalesce("language", F.lit("")).alias("language"), "analyzer").join(store.facts(), KEY)
    now, was = views(found, policy["aliases"]), views(before, policy["aliases"])
    old = previous.select("path", F.col("analyzer").alias("_analyzer"), F.col("policy").alias("_policy"))
    about = facts.join(old, "path", "left").select(
        "path", (F.col("analysis_status") != "raw_unchanged").alias("changed"), F.when(F.col("analyzer") != F.col("_analyzer"), "analyzer_upgraded").when(F.col("policy") != F.col("_policy"), "policy_changed").alias("cause"))
    plan = temporal.invalidation_plan(now.join(about, "path"), was, "path")
    first = lambda rows, names: rows.select(F.explode(names).alias("n")).select(F.split_part("n", F.lit("."), F.lit(1)).alias("root")).distinct()
    roots = [first(x.where(F.col("path").rlike(r"\.pyi?$")), module_aliases(_module())) for x in (found, before)]
    moved = roots[0].join(roots[1], "root", "left_anti").unionByName(roots[1].join(roots[0], "root", "left_anti"))
    refers = now.select("path", F.explode("refs").alias("n")).select("path", F.split_part("n", F.lit("."), F.lit(1)).alias("root")).join(moved, "root", "left_semi").select("path", F.lit(True).alias("_root")).distinct()
    reason = F.when((F.col("reason") == "carried_forward") & F.col("_root"), "resolver_context_changed").otherwise(F.col("reason"))
    return plan.join(refers, "path", "left").select("path", reason.alias("reason"), (reason != "carried_forward").alias("recompute"))


def resolve_edges(found: DataFrame, sources: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The edges of ``sources`` (files with facts) among all files ``found``."""
    return python_edges(found.select("path"), sources.where(F.col("language") == "python")).unionByName(script_edges(found.where(F.col("language").isin(*extract.SCRIPTS)).select("path"), sources.where(F.col("language").isin(*extract.SCRIPTS)), aliases))


def python_edges(paths: DataFrame, parsed: DataFrame) -> DataFrame:
    """Imports resolved through module aliases: ``source, target, external, status, weight`` by path."""
    known = paths.where(F.col("path").rlike(r"\.pyi?$")).select(F.col("path").alias("target"), F.explode(module_aliases(_module())).alias("name"))
    i = parsed.select(F.col("path").alias("source"), _package().alias("pkg"), F.posexplode("imports").alias("at", "i"))
    base = F.when(F.col("i.module").startswith("."), relative_import("pkg", "i.module")).otherwise(F.col("i.module"))
    tried = i.select("source", "at", F.col("i.module").startswith(".").alias("relative"), base.alias("m"), F.explode(F.array_compact(F.array(F.concat_ws(".", base, "i.name"), base))).alias("name"), F.col("i.name").alias("member"))
    hit = tried.join(known, "name").where("target <> source").groupBy("source", "at").agg(F.max(F.struct(F.length("name"), "name")).alias("best"))
    named = tried.join(hit, ["source", "at"], "left").where("best IS NULL OR name = best.name").join(known, "name", "left")
    # One target is all that an edge names, so of several only their number is kept.
    best = named.groupBy("source", "at").agg(F.countDistinct("target").alias("n"), F.min("target").alias("only"), F.first("m").alias("external"), F.first("relative").alias("relative"))
    roots = known.select(F.split_part("name", F.lit("."), F.lit(1)).alias("root")).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("n") == 1, "resolved_internal").when(F.col("n") > 1, "ambiguous_internal").when(F.col("relative") | F.coalesce("_known", F.lit(False)), "unresolved_internal").otherwise("external")
    rated = best.join(roots, F.split_part("external", F.lit("."), F.lit(1)) == F.col("root"), "left").withColumn("status", status)
    rows = rated.select("source", F.when(F.col("n") == 1, F.col("only")).alias("target"), F.when(F.col("n") != 1, F.col("external")).alias("external"), "status")
    return rows.groupBy("source", "target", "external", "status").agg(F.count("*").alias("weight"))


def _wanted(target: Column, aliases: dict[str, str], path: str = "path") -> Column:
    """The path that a script's import means, as far as it is written out."""
    named = target
    for alias, place in sorted(aliases.items(), key=lambda a: -len(a[0])):
        named = F.when(target.startswith(alias), F.concat(F.lit(place), F.substring(target, F.lit(len(alias) + 1), F.length(target)))).otherwise(named)
    return F.when(target.startswith("."), joined_path(parent(path), named)).otherwise(named)


def script_edges(paths: DataFrame, scripts: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Path imports of scripts: aliases replaced, then suffixes tried in order."""
    inside = F.col("target").startswith(".") | F.lit(False)
    for alias in aliases:
        inside = inside | F.col("target").startswith(alias)
    own = scripts.select("path", F.explode("scripts").alias("target"))
    own = own.select(F.col("path").alias("source"), F.col("target").alias("external"), inside.alias("inside"), _wanted(F.col("target"), aliases).alias("wanted"))
    own = own.withColumn("id", F.concat_ws("\n", "source", "external"))
    ends = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
    found = rel.first_candidate(own, F.array(*[F.concat("wanted", F.lit(e)) for e in ends]), paths, "id")
    status = F.when(F.col("resolved").isNotNull(), "resolved_internal").when(F.col("inside"), "unresolved_internal").otherwise("external")
    rows = found.select("source", F.col("resolved").alias("target"), F.when(F.col("resolved").isNull(), F.col("external")).alias("external"), status.alias("status"))
    return rows.groupBy("source", "target", "external", "status").agg(F.count("*").alias("weight"))
