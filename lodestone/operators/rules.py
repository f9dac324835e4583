"""Declarative rules that turn entities and edges into findings, and the findings' life."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import glob_any, stable_key
from lodestone.operators.graph import degree_internal, strongly_connected
from lodestone.operators.relational import edge_quality

# Default thresholds of the rules.
DEFAULTS = {
    "max_module_loc": {"max": 300, "severity": "warning"},
    "max_function_lines": {"max": 25, "severity": "info"},
    "max_symbol_complexity": {"max": 10, "severity": "warning"},
    "max_fan_out": {"max": 12, "severity": "warning"},
    "max_fan_in": {"max": 30, "severity": "warning"},
    "no_cycles": {"severity": "warning"},
    "declared_group_drift": {"severity": "warning"},
    "minimum_line_coverage": {"min": 0.8, "severity": "warning"},
    "dead_code": {"minimum_age_days": 90, "minimum_resolution_rate": 0.95, "severity": "info"},
}
ENTRY_POINTS = ("main", "__main__", "__init__", "app", "index", "cli", "manage", "setup", "conftest", "wsgi", "asgi")


def configured(rules: Sequence[dict]) -> list[dict]:
    """The default rules with those of equal id replaced, and the rest appended."""
    own = {r["id"]: r for r in rules}
    out = [{"id": k, "type": k, **v, **own.pop(k, {})} for k, v in DEFAULTS.items()]
    return out + list(own.values())


def in_scope(path: Column, paths: str | Sequence[str] | None) -> Column:
    return F.lit(True) if not paths else glob_any(path, [paths] if isinstance(paths, str) else list(paths))


def finding(df: DataFrame, rule: str, kind: str, severity: str, subject: str, measured: Column, confidence: Column | float = 1.0) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.select(stable_key(F.lit(rule), F.col(subject)).alias("stable_key"), F.lit(rule).alias("rule"), F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), measured.cast("double").alias("measured"), c.cast("double").alias("confidence"))


def above(df: DataFrame, rule: str, kind: str, subject: str, value: str, most: float, severity: str = "warning", scope: Column | None = None) -> DataFrame:
    """Findings of subjects whose value passes a limit (size, complexity, function length)."""
    return finding(df.where((F.col(value) > most) & (F.lit(True) if scope is None else scope)), rule, kind, severity, subject, F.col(value))


def fan_findings(edges: DataFrame, max_out: int = 12, max_in: int = 30) -> DataFrame:
    d = degree_internal(edges)
    return above(d, "max_fan_out", "high_fan_out", "node", "fan_out", max_out).unionByName(above(d, "max_fan_in", "high_fan_in", "node", "fan_in", max_in))


def cycle_findings(edges: DataFrame) -> DataFrame:
    """One finding per strongly connected component; its key is the sorted members joined by a pipe."""
    members = strongly_connected(edges).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), "|").alias("members"), F.count("*").alias("n"))
    return finding(members, "no_cycles", "dependency_cycle", "warning", "members", F.col("n"))


def drift(df: DataFrame, declared: str, inferred: str) -> Column:
    """Both groups are set and differ."""
    return F.col(declared).isNotNull() & F.col(inferred).isNotNull() & (F.col(declared) != "") & (F.col(inferred) != "") & (F.col(declared) != F.col(inferred))


def low_coverage(coverage: DataFrame, subject: str, value: str, least: float = 0.8) -> DataFrame:
    best = coverage.groupBy(subject).agg(F.max(value).alias("best")).where(F.col("best") < least)
    return finding(best, "minimum_line_coverage", "low_coverage", "warning", subject, F.col("best"))


def entry_point(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "").isin(*ENTRY_POINTS)


def dead_code(modules: DataFrame, edges: DataFrame, changes: DataFrame, as_of: str, age_days: int = 90, least_rate: float = 0.95) -> DataFrame:
    """Source modules ``(node, path, kind)`` that nothing refers to and nobody changed for ``age_days``.

    ``edges`` has ``source, target, status, candidates`` and ``changes`` has ``node, at``.  No findings where too few references
    could be resolved: no incoming edge says little then."""
    quality = edge_quality(edges).select("resolution_rate").where(F.col("resolution_rate") >= least_rate)
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(age_days)} DAYS")
    used = edges.where("target is not null").select(F.col("target").alias("node")).distinct()
    maybe = edges.where("status = 'ambiguous_internal'").select(F.explode("candidates").alias("path")).distinct()
    last = changes.groupBy("node").agg(F.max("at").alias("last_at")).where(F.col("last_at") <= cutoff)
    idle = modules.where((F.col("kind") == "source") & ~entry_point(F.col("path"))).join(used, "node", "left_anti").join(maybe, "path", "left_anti").join(last, "node")
    rate = idle.join(F.broadcast(quality))  # one row at most
    return finding(rate, "dead_code", "possible_dead_code", "info", "path", F.datediff(F.lit(as_of).cast("timestamp_ntz"), "last_at"), F.round(F.least(F.lit(0.8), 0.45 + 0.3 * F.col("resolution_rate")), 2))


# ---- life of findings


def lifecycle(stored: DataFrame, detected: DataFrame, snapshot: int, at: str) -> DataFrame:
    """Stored findings after an evaluation that detected ``stable_key``s.

    New keys are ``new``; resolved ones that return are ``regressed``; dismissed ones stay; what isn't detected is
    ``resolved`` unless dismissed."""
    hit = detected.select("stable_key").distinct().withColumn("_hit", F.lit(True))
    both = stored.join(hit, "stable_key", "full_outer")
    known, seen, now = F.col("status").isNotNull(), F.coalesce("_hit", F.lit(False)), F.lit(at).cast(stored.schema["resolved_at"].dataType)
    status = F.when(~known, "new").when(seen & (F.col("status") == "resolved"), "regressed").when(~seen & (F.col("status") != "dismissed"), "resolved").otherwise(F.col("status"))
    resolved = F.when(seen, F.when(F.col("status") == "dismissed", F.col("resolved_at"))).when(F.col("status").isin("dismissed", "resolved"), F.col("resolved_at")).otherwise(now)
    return both.select(
        "stable_key", status.alias("status"), F.when(known, F.col("first_snapshot")).otherwise(F.lit(snapshot)).cast("long").alias("first_snapshot"),
        F.when(seen, F.lit(snapshot)).otherwise(F.col("last_snapshot")).cast("long").alias("last_snapshot"), resolved.alias("resolved_at"),
    )


STATES = ("new", "acknowledged", "accepted", "planned", "dismissed", "resolved", "regressed")


def set_status(findings: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Manual change: resolving sets the time, leaving ``resolved`` clears it."""
    if status not in STATES:
        raise ValueError(f"no status {status}")
    this = F.col("stable_key") == key
    kind = findings.schema["resolved_at"].dataType
    when = F.lit(at).cast(kind) if status == "resolved" else F.when(F.col("status") != "resolved", F.col("resolved_at"))
    return findings.withColumn("resolved_at", F.when(this, when).otherwise(F.col("resolved_at"))).withColumn("status", F.when(this, F.lit(status)).otherwise(F.col("status")))


def presence_history(presence: DataFrame, frames: DataFrame, key: str, frame: str) -> DataFrame:
    """The states of all keys over all frames at once, from ``(key, frame)`` presence: where runs of presence start and
    end.  ``frames`` numbers them (``frame, n``)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("n")
    at = presence.select(key, frame).distinct().join(frames, frame)
    runs = at.withColumn("_before", F.lag("n").over(w)).withColumn("_next", F.lead("n").over(w))
    start = runs.where(F.col("_before").isNull() | (F.col("_before") < F.col("n") - 1)).select(key, "n", F.when(F.col("_before").isNull(), "new").otherwise("regressed").alias("state"))
    last = frames.agg(F.max("n").alias("_last"))
    end = runs.join(F.broadcast(last)).where((F.col("n") < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col("n") + 1))).select(key, (F.col("n") + 1).alias("n"), F.lit("resolved").alias("state"))
    return start.unionByName(end)
