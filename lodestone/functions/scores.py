"""Scores of findings, modules, files and work, as expressions over joined features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.exprs import clamp, half_even, label_by, lookup, saturated

# Points and cuts of the scores.
SEVERITY = {"critical": 45, "error": 38, "warning": 24, "info": 8}
PRIORITY_CUTS = ((80, "Urgent"), (60, "High"), (35, "Medium"))
ATTENTION_CUTS = ((75, "Priority"), (50, "Review"), (25, "Watch"))
PRESSURE = {"critical": 8, "error": 7, "warning": 5, "info": 2}


def finding_priority(severity: Column, confidence: Column, changes: Column, degree: Column, modules: Column, complexity: Column, coverage: Column, regressed: Column) -> Column:
    """0 to 100 from severity, confidence and the largest figures among affected modules."""
    points = (
        lookup(severity, SEVERITY, 8) + half_even(12 * confidence) + half_even(14 * saturated(changes, 20)) + half_even(16 * saturated(degree, 30)) + half_even(8 * saturated(modules, 5))
        + half_even(10 * saturated(changes, 10) * saturated(complexity, 50))
        + F.coalesce(half_even(5 * (1 - coverage)), F.lit(0.0)) + F.when(regressed, 8).otherwise(0)
    )
    return clamp(points, 0, 100).cast("int")


def module_attention(loc: Column, complexity: Column, degree: Column, changes: Column, pressure: Column, scored: Column) -> Column:
    """0 to 100; null for modules that aren't scored (neither source nor test)."""
    points = 25 * saturated(loc, 500) + 20 * saturated(complexity, 50) + 20 * saturated(degree, 30) + 15 * saturated(changes, 20) + F.least(F.coalesce(pressure, F.lit(0)), F.lit(20))
    return F.when(scored, F.least(half_even(points), F.lit(100)).cast("int"))


def attention_label(score: Column) -> Column:
    return label_by(score, ATTENTION_CUTS, "Low")


def priority_label(score: Column) -> Column:
    return label_by(score, PRIORITY_CUTS, "Low")


def proximity(distance: Column, direct: Column, lexical: Column, same_folder: Column, same_group: Column, degree: Column) -> Column:
    """``direct`` is the number of seeds that the module is joined to."""
    return 100 / F.greatest(distance, F.lit(1)) + 60 * direct + 0.35 * lexical + 25 * same_folder.cast("int") + 8 * same_group.cast("int") - 0.8 * F.greatest(F.lit(0), degree - 20)


def search_score(path_hits: Column, text_hits: Column, exact: Column) -> Column:
    return 8 * path_hits + 3 * text_hits + F.when(exact, 10).otherwise(0)


def work_priority(reason: Column, loc: Column, complexity: Column) -> Column:
    return reason + F.least(F.lit(20), F.floor(loc / 100)) + F.least(F.lit(20), F.floor(complexity / 10))


def adaptive_limit(files: Column) -> Column:
    """Fewer frames for larger repositories."""
    return F.when(files <= 500, 32).when(files <= 2000, 24).when(files <= 5000, 16).otherwise(12)


def impact_risk(protected: Column, conflicts: Column, transitive: Column, degree: Column, direct: Column, migrations: Column) -> Column:
    high = protected | (conflicts > 0) | (transitive >= 25) | (degree >= 20)
    return F.when(high, "high").when((direct > 0) | (migrations > 0), "medium").otherwise("low")


def scope_risk(protected: Column, conflicts: Column, degree: Column, related: Column) -> Column:
    return F.when(protected | (conflicts > 0) | (degree >= 20), "high").when(related > 0, "medium").otherwise("low")


def related_test(primary: Column, related: Column, names: Column, words: Column) -> Column:
    """Counts of primary and related neighbours, of primary names and goal words in the path."""
    return 12 * primary + 3 * related + 6 * names + words


def scoped_finding(severity: Column, direct: Column, modules: Column, confidence: Column) -> Column:
    points = lookup(severity, {"critical": 72, "error": 62, "warning": 42, "info": 20}, 20) + F.when(direct, 18).otherwise(7)
    return F.least(F.lit(100), points + F.least(F.lit(6), 2 * modules) + half_even(4 * F.coalesce(confidence, F.lit(0.0)))).cast("int")
