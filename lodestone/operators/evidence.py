"""Bounded evidence for people and agents: contexts, explanations, budgets, normalised documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.exprs import glob_any
from lodestone.functions.scores import scoped_finding
from lodestone.operators.graph import ancestors
from lodestone.operators.relational import symmetric_neighbours
from lodestone.storage import checkpointed, tasks

SPREAD = 8  # parts of one module's rows

# ---- evidence of a module


def top_rows(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; the window limit is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def evidence(modules: DataFrame, symbols: DataFrame, edges: DataFrame, changes: DataFrame, symbol_limit: int = 250, edge_limit: int = 250, change_limit: int = 8) -> DataFrame:
    """``modules`` with arrays of their first symbols, relations and latest changes.

    Only what belongs to a module is sorted.  A module's rows are dealt to SPREAD parts and, part by part, to as many tasks as
    all rows need; the first of each part are enough to find the module's first."""
    spark, own = modules.sparkSession, modules.select("node").distinct()
    near = checkpointed(symmetric_neighbours(edges.where("target is not null")).join(own, "node", "left_semi"))
    n = tasks(spark, max(symbols.count(), near.count(), changes.count()))

    def first(df: DataFrame, limit: int, order: list[Column], *columns: str) -> DataFrame:
        dealt = df.select("node", *columns).withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(SPREAD))).repartition(n, "node", "_part")
        of_part = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("node", "_part").orderBy(*order))).where(F.col("_n") <= limit).drop("_n", "_part")
        return top_rows(of_part.join(own, "node", "left_semi").repartition(n, "node"), "node", limit, *order).groupBy("node")

    s = first(symbols, symbol_limit, [F.col("start_line"), F.col("name")], "start_line", "name", "kind").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "kind"))).alias("symbols"))
    r = first(near, edge_limit, [F.col("direction"), F.col("neighbour")], "direction", "neighbour").agg(F.array_sort(F.collect_list(F.struct("direction", "neighbour"))).alias("relations"))
    c = first(changes, change_limit, [F.col("at").desc(), F.col("sha")], "at", "sha").agg(F.sort_array(F.collect_list(F.struct("at", "sha")), asc=False).alias("latest"))
    return modules.join(s, "node", "left").join(r, "node", "left").join(c, "node", "left")


def neighbour_documents(edges: DataFrame, documents: DataFrame, limit: int = 24) -> DataFrame:
    """``node, documents``: up to ``limit`` texts of a module's neighbours, by neighbour."""
    near = symmetric_neighbours(edges.where("target is not null")).select("node", "neighbour").distinct().join(documents.select(F.col("node").alias("neighbour"), "text"), "neighbour")
    return top_rows(near, "node", limit, F.col("neighbour")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("neighbour", "text"))).alias("documents"))


def overlaid(modules: DataFrame, claims: DataFrame, key: str = "node") -> DataFrame:
    """Modules whose summary is replaced by the best claim (context before intrinsic, then the latest); the first summary stays
    as ``deterministic_summary``."""
    rank = F.when(F.col("kind") == "context", 1).otherwise(0)
    best = claims.groupBy(key).agg(F.max(F.struct(rank.alias("r"), "id", "claim")).alias("b")).select(key, F.col("b.claim").alias("_claim"))
    return modules.join(best, key, "left").withColumn("deterministic_summary", F.col("summary")).withColumn("summary", F.coalesce("_claim", "summary")).drop("_claim")


def finding_context(finding: DataFrame, scope: DataFrame, impact: DataFrame) -> DataFrame:
    """``stable_key, paths``: a finding's own paths, then the scope's, then the impact's, each once.  Scope and impact are answers of
    bounded size (``eng.scope``: 50, ``graph.dependants``: 500), so the one row made of them is, too."""
    extra = scope.select(F.lit(1).alias("p"), "path").unionByName(impact.select(F.lit(2).alias("p"), "path")).agg(F.array_sort(F.collect_set(F.struct("p", "path"))).alias("x"))
    return finding.select("stable_key", "affected").join(F.broadcast(extra)).select("stable_key", F.array_distinct(F.concat("affected", F.transform("x", lambda s: s["path"]))).alias("paths"))


def context_summaries(findings: DataFrame, scope: DataFrame, impact: DataFrame, sample: int = 1) -> DataFrame:
    """``stable_key, n, paths``: of the context that ``finding_context`` gives each finding, how many paths there are and the first
    ``sample`` of them.  All findings share what scope and impact hold, so its paths are counted once and only those that a finding
    names itself are looked up in it: the work grows with the findings and the paths, not with their product."""
    shared = scope.select(F.lit(1).alias("p"), "path").unionByName(impact.select(F.lit(2).alias("p"), "path")).groupBy("path").agg(F.min("p").alias("p"))
    head = shared.orderBy("p", "path").limit(sample).agg(F.array_sort(F.collect_list(F.struct("p", "path"))).alias("x"))
    own = findings.select("stable_key", "affected")
    named = own.distinct().select(F.col("stable_key").alias("_k"), F.col("affected").alias("_a"), F.explode(F.array_distinct("affected")).alias("_p"))
    met = named.join(shared, F.col("_p").eqNullSafe(F.col("path"))).groupBy("_k", "_a").agg(F.count("*").alias("met"))
    # One row each, of a count and of the sample.
    rows = own.join(met, F.col("stable_key").eqNullSafe(F.col("_k")) & F.col("affected").eqNullSafe(F.col("_a")), "left").join(F.broadcast(shared.agg(F.count("*").alias("all")))).join(F.broadcast(head))
    n = F.size(F.array_distinct("affected")) + F.col("all") - F.coalesce("met", F.lit(0))
    return rows.select("stable_key", n.alias("n"), F.slice(F.array_distinct(F.concat("affected", F.transform("x", lambda s: s["path"]))), 1, sample).alias("paths"))


def scoped_findings(findings: DataFrame, context: DataFrame, limit: int = 12) -> DataFrame:
    """The findings that matter for a task, by score: ``findings`` has ``stable_key, severity, confidence, affected``, ``context``
    the task's modules ``path, primary``.  ``direct``: it affects a primary module; ``relevant``: how many of the task's it affects."""
    own = context.groupBy("path").agg(F.bool_or("primary").alias("primary"))
    met = findings.select("stable_key", F.explode(F.array_distinct("affected")).alias("path")).join(own, "path")
    about = met.groupBy("stable_key").agg(F.bool_or("primary").alias("direct"), F.count("*").alias("relevant"))
    spans = F.size(F.array_distinct("affected"))
    where = F.when(F.col("direct"), "affects a module of the task").otherwise("affects what the task's modules depend on")
    why = F.array_compact(F.array(F.concat("severity", F.lit(" severity")), where, F.when(spans > 1, F.concat(F.lit("spans "), spans.cast("string"), F.lit(" modules")))))
    rated = findings.join(about, "stable_key").withColumn("score", scoped_finding(F.col("severity"), F.col("direct"), F.col("relevant"), F.col("confidence")))
    return rated.select("stable_key", "severity", "score", "direct", "relevant", why.alias("reasons")).orderBy(F.col("score").desc(), "stable_key").limit(limit)


def members_of(groups: DataFrame, modules: DataFrame) -> DataFrame:
    """``grp, members``: all modules of a group and of those below it, sorted."""
    below = ancestors(groups).select(F.col("name").alias("grp"), F.col("ancestor"))
    return modules.join(below, "grp").groupBy(F.col("ancestor").alias("grp")).agg(F.array_sort(F.collect_set("path")).alias("members"))


# ---- counts, times, formats


def forbidden_paths(paths: DataFrame, deny: Sequence[str], allow: Sequence[str]) -> DataFrame:
    return paths.where(glob_any("path", deny) & ~glob_any("path", allow)).select("path").distinct().orderBy("path")


def visible_counts(nodes: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """``root, visible, total`` of each area."""
    return nodes.groupBy("root").agg(F.count_if(~F.col("root").isin(*hidden) if hidden else F.lit(True)).alias("visible"), F.count("*").alias("total"))


def work_totals(runs: DataFrame, *counters: str) -> DataFrame:
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.round(elapsed / F.nullif(done, F.lit(0)) * (total - done), 1)


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """In currency units, from prices of a million tokens, to eight places."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1_000_000, 8)


# ---- explanations


def reasons(changes: Column, degree: Column, complexity: Column, coverage: Column, regressed: Column) -> Column:
    """Why a finding ranks where it does: an array of texts."""
    return F.array_compact(F.array(
        F.when(regressed, "it was resolved before and is back"), F.when(changes >= 10, F.concat(F.lit("changed "), changes.cast("string"), F.lit(" times"))),
        F.when(degree >= 15, F.concat(degree.cast("string"), F.lit(" modules are connected"))), F.when(complexity >= 25, "complex code"), F.when(coverage < 0.5, F.concat(F.lit("covered to "), percent(coverage, 0))),
    ))


def action_kind(finding_type: Column) -> Column:
    return F.when(finding_type.isin("large_module", "long_function"), "split").when(finding_type.isin("dependency_cycle", "forbidden_dependency"), "decouple").when(finding_type == "low_coverage", "test").when(finding_type == "possible_dead_code", "verify").otherwise("review")


def cohesion_signals(claims: DataFrame, least: float = 0.7, responsibilities: int = 5, split: int = 80) -> DataFrame:
    """Modules that confident claims call incohesive: too many responsibilities, or a high split score."""
    sure = claims.where(F.col("confidence") >= least)
    many = sure.where(F.size("responsibilities") > responsibilities).select("path", F.lit("many_responsibilities").alias("signal"))
    return many.unionByName(sure.where(F.col("split_score") >= split).select("path", F.lit("split").alias("signal")))


# ---- documents


def _plain(text: str) -> str:
    """JSON with comments and trailing commas, as JSON."""
    keep = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", keep)


def canonical(text: str | None, language: str) -> str | None:
    """A configuration text as JSON with sorted keys; null where it can't be read."""
    try:
        data = yaml.safe_load(text or "") if language == "yaml" else json.loads(_plain(text or ""))
        return json.dumps(data, sort_keys=True, separators=(",", ":"), default=str)
    except (ValueError, yaml.YAMLError, RecursionError):
        return None


def canonical_documents(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "canonical": [canonical(t, n) for t, n in zip(b[text], b[language], strict=True)]})

    return df.select(key, text, language).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, canonical string")


def validated(df: DataFrame, text: str, schema: str, limits: dict[str, int]) -> DataFrame:
    """JSON texts read by a schema (null where they don't fit): strings trimmed and cut, numbers of 0 to 1 clamped."""
    parsed = df.withColumn("_p", F.from_json(text, schema))
    fields = [f.name for f in parsed.schema["_p"].dataType.fields]
    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema["_p"].dataType.fields}

    def pick(f: str) -> Column:
        c = F.col(f"_p.{f}")
        if kinds[f] == "string":
            return F.substring(F.trim(c), 1, limits.get(f, 4000))
        return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) if kinds[f] == "double" else c

    return parsed.select(*df.columns, *[pick(f).alias(f) for f in fields])


def trim_payload(payload: dict, order: Sequence[str], budget: int) -> dict:
    """Drops the tails of the lists in ``order``, first ones first, until the JSON fits; counts what went."""
    size = lambda: len(json.dumps(payload, default=str).encode())
    payload = {k: list(v) if isinstance(v, list) else v for k, v in payload.items()} | {"omitted": {}}
    for width in (120, 80):  # first shorter summaries
        if size() <= budget:
            return payload
        for k in order:
            payload[k] = [{**r, "summary": r["summary"][: width - 3] + "..."} if isinstance(r, dict) and len(r.get("summary") or "") > width else r for r in payload.get(k, [])]
    for k in order:
        while payload.get(k) and size() > budget:
            payload[k].pop()
            payload["omitted"][k] = payload["omitted"].get(k, 0) + 1
    return payload
