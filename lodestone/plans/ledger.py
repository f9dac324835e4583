"""Inventory: totals, rollups, module ledger, coverage, facets, metrics, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import effective
from lodestone.functions.scores import attention_label, module_attention
from lodestone.operators import relational as rel
from lodestone.plans import analogs as a
from lodestone.plans.registry import query
from lodestone.sources.tables import Tables


@query(f"WITH {a.MODULES} SELECT count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, round(avg(complexity), 4) AS mean_complexity, max(loc) AS largest, count(DISTINCT grp) AS groups, count(DISTINCT language) AS languages FROM m")
def overview_totals(t: Tables) -> DataFrame:
    return a.modules(t).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.round(F.avg("complexity"), 4).alias("mean_complexity"), F.max("loc").alias("largest"), F.count_distinct("grp").alias("groups"), F.count_distinct("language").alias("languages"))


@query(f"WITH {a.MODULES} SELECT language, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, count(*) FILTER (WHERE kind = 'test') AS tests FROM m GROUP BY language")
def language_rollup(t: Tables) -> DataFrame:
    return a.modules(t).groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count_if(F.col("kind") == "test").alias("tests"))


@query("SELECT coalesce(nullif(lang, ''), nullif(source, ''), 'ungrouped') AS grp, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS loc, round(sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) / count(*), 4) AS long_share FROM documents GROUP BY 1")
def group_rollup(t: Tables) -> DataFrame:
    d = t("documents", "lang", "source", "n_chars").withColumn("grp", effective("lang", "source", default="ungrouped"))
    return d.groupBy("grp").agg(F.count("*").alias("files"), F.sum("n_chars").alias("loc"), F.round(F.sum(F.when(F.col("n_chars") > 2000, 1).otherwise(0)) / F.count("*"), 4).alias("long_share"))


_LEDGER = f"""{a.MODULES}, {a.CHANGES}, x AS (SELECT node, count(*) AS change_count, min(ts) AS first_at, max(ts) AS last_at, arg_min(sha, struct_pack(a := ts, b := sha)) AS first_commit, arg_max(sha, struct_pack(a := ts, b := sha)) AS last_commit FROM c GROUP BY node)"""


@query(f"WITH {_LEDGER} SELECT m.node, path, grp, loc, kind, coalesce(change_count, 0) AS change_count, first_commit, last_commit, CAST(CAST(last_at AS DATE) AS VARCHAR) AS last_day FROM m LEFT JOIN x ON m.node = x.node")
def module_ledger(t: Tables) -> DataFrame:
    seen = rel.change_summary(a.changes(t), "node", "at", "sha")
    return a.modules(t).join(seen, "node", "left").select("node", "path", "grp", "loc", "kind", F.coalesce("change_count", F.lit(0)).alias("change_count"), "first_commit", "last_commit", F.to_date("last_at").cast("string").alias("last_day"))


@query(f"""WITH {_LEDGER}, s AS (SELECT m.node, CASE WHEN kind IN ('source', 'test') THEN least(100, CAST(round_even(25 * least(loc / 500.0, 1) + 20 * least(complexity / 50.0, 1) + 20 * least((m.node % 40) / 30.0, 1) + 15 * least(coalesce(change_count, 0) / 20.0, 1) + least(m.node % 25, 20), 0) AS INTEGER)) END AS score
FROM m LEFT JOIN x ON m.node = x.node)
SELECT node, score, CASE WHEN score >= 75 THEN 'Priority' WHEN score >= 50 THEN 'Review' WHEN score >= 25 THEN 'Watch' WHEN score IS NULL THEN NULL ELSE 'Low' END AS label FROM s""")
def module_attention_scores(t: Tables) -> DataFrame:
    counted = rel.with_counts(a.modules(t), "node", a.changes(t), change_count=F.count("*"))
    score = module_attention(F.col("loc"), F.col("complexity"), F.pmod("node", F.lit(40)), F.coalesce("change_count", F.lit(0)), F.pmod("node", F.lit(25)), F.col("kind").isin("source", "test"))
    return counted.select("node", score.alias("score")).withColumn("label", attention_label(F.col("score")))


@query("""WITH c AS (SELECT source, quality, CASE WHEN n_chars > 3000 THEN n_chars END AS total, CASE WHEN n_chars > 3000 THEN n_chars // 2 END AS covered FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, round(coalesce(CAST(sum(covered) AS DOUBLE) / nullif(sum(total), 0), avg(quality)), 4) AS ratio, count(quality) AS measured, count(*) AS files FROM c GROUP BY source""")
def coverage_ratio(t: Tables) -> DataFrame:
    long = F.col("n_chars") > 3000
    c = t("documents", "doc_id", "source", "n_chars").join(t("labels", "doc_id", "quality"), "doc_id", "left").withColumn("total", F.when(long, F.col("n_chars"))).withColumn("covered", F.when(long, F.floor(F.col("n_chars") / 2)))
    return c.groupBy("source").agg(F.round(F.coalesce(F.sum("covered").cast("double") / F.nullif(F.sum("total"), F.lit(0)), F.avg("quality")), 4).alias("ratio"), F.count("quality").alias("measured"), F.count("*").alias("files"))


@query("SELECT source AS subject, round(max(quality * (n_chars % 100) / 100.0), 4) AS best FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING max(quality * (n_chars % 100) / 100.0) < 0.98")
def coverage_gap_rule(t: Tables) -> DataFrame:
    from lodestone.operators.rules import low_coverage

    c = t("documents", "doc_id", "source", "n_chars").join(t("labels", "doc_id", "quality"), "doc_id").withColumn("cov", F.col("quality") * F.pmod("n_chars", F.lit(100)) / 100.0)
    return low_coverage(c, "source", "cov", 0.98).select("subject", F.round("measured", 4).alias("best"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'imported' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_diagnostics(t: Tables) -> DataFrame:
    d, seen = t("documents", "doc_id"), t("labels", "doc_id").withColumn("measured", F.lit(True))
    return d.join(seen, "doc_id", "left").select("doc_id", F.when(F.col("measured"), "imported").otherwise("missing").alias("status"))


@query("SELECT l_partkey AS node, l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS additions FROM lineitem GROUP BY ALL HAVING count(*) > 12")
def hot_paths_having(t: Tables) -> DataFrame:
    return t("lineitem", "l_partkey", "l_returnflag", "l_quantity").groupBy(F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("additions")).where("n > 12")


@query(f"WITH {a.MODULES} SELECT grp, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages, count(*) AS files FROM m GROUP BY grp")
def listagg_symbols(t: Tables) -> DataFrame:
    return a.modules(t).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"), F.count("*").alias("files"))


@query(f"WITH {a.FINDINGS} SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM f GROUP BY severity UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY status UNION ALL SELECT 'finding_type', finding_type, count(*) FROM f GROUP BY finding_type")
def status_facets(t: Tables) -> DataFrame:
    return rel.facets(a.findings(t), "severity", "status", "finding_type")


@query(f"""WITH {a.FINDINGS} SELECT grp, count(*) AS n, max(CASE severity WHEN 'critical' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS top,
array_to_string(list_sort(list(DISTINCT path))[1:3], ',') AS sample FROM f GROUP BY grp HAVING count(*) >= 2""")
def diagnostic_groups(t: Tables) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return rel.diagnostic_groups(a.findings(t), "grp", "path", rank)


@query(f"""WITH {a.REFERENCES}, g AS (SELECT source, target, external, type, status, count(*) AS weight, max(confidence) AS confidence, min(CASE WHEN line >= 0 THEN line END) AS line,
list(struct_pack(line := line, evidence := evidence)) AS ev, string_agg(DISTINCT original, ',' ORDER BY original) AS originals FROM r GROUP BY ALL),
h AS (SELECT source, target, external, type, status, evidence, min(line) AS l FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source, target, external, type, status ORDER BY l, evidence) AS n FROM h)
SELECT g.source, g.target, g.external, g.type, g.status, weight, round(confidence, 4) AS confidence, line, string_agg(k.evidence, ' | ' ORDER BY n) AS evidence, originals
FROM g JOIN k ON g.source = k.source AND g.target IS NOT DISTINCT FROM k.target AND g.external IS NOT DISTINCT FROM k.external AND g.type = k.type AND g.status = k.status AND n <= 5
GROUP BY ALL""")
def edge_merge(t: Tables) -> DataFrame:
    return rel.merge_edges(a.references(t)).withColumn("originals", F.array_join("originals", ",")).withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH {a.REFERENCES}, q AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'resolved_internal') AS resolved, count(*) FILTER (WHERE status = 'ambiguous_internal') AS ambiguous,
count(*) FILTER (WHERE status = 'unresolved_internal') AS unresolved, count(*) FILTER (WHERE status = 'external') AS external FROM r)
SELECT *, resolved + ambiguous + unresolved AS internal, round(resolved / nullif(resolved + ambiguous + unresolved, 0), 6) AS resolution_rate,
CASE WHEN resolved + ambiguous + unresolved = 0 THEN 'unavailable' WHEN ambiguous + unresolved = 0 THEN 'complete' ELSE 'partial' END AS status FROM q""")
def edge_quality(t: Tables) -> DataFrame:
    return rel.edge_quality(a.references(t)).withColumn("resolution_rate", F.round("resolution_rate", 6))


@query(f"""WITH {a.MODULES}, v AS (SELECT grp, kind, 'files' AS name, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY grp, kind UNION ALL SELECT grp, kind, 'loc', CAST(sum(loc) AS DOUBLE) FROM m GROUP BY grp, kind)
SELECT grp, kind, max(value) FILTER (WHERE name = 'files') AS files, max(value) FILTER (WHERE name = 'loc') AS loc FROM v GROUP BY grp, kind""")
def trend_pivot(t: Tables) -> DataFrame:
    by = a.modules(t).groupBy("grp", "kind").agg(F.count("*").cast("double").alias("files"), F.sum("loc").cast("double").alias("loc"))
    eav = by.unpivot(["grp", "kind"], ["files", "loc"], "name", "value")
    return eav.groupBy("grp", "kind").pivot("name", ["files", "loc"]).agg(F.first("value", ignorenulls=True))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def hierarchy_rollup(t: Tables) -> DataFrame:
    c = t("customer", "c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.count("*").alias("k"), F.sum("c_acctbal").alias("b"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.sum("k").alias("n"), F.round(F.sum("b"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(t: Tables) -> DataFrame:
    x = t("lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return x.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_events(t: Tables) -> DataFrame:
    return t("events", "event_type", "user_id").withColumn("shard", F.col("user_id") % 3).cube("event_type", "shard").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT 'part' AS \"table\", count(*) AS \"rows\" FROM part UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents)")
def row_inventory(t: Tables) -> DataFrame:
    return rel.inventory({n: t(n) for n in ("part", "events", "documents")})


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1""")
def daily_usage(t: Tables) -> DataFrame:
    e = t("events", "ts", "event_type", "value")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent"), F.count_if(F.col("event_type") == "error").alias("failures"))


@query("SELECT sum(n_lines) AS executable, sum(CASE WHEN hit THEN n_lines ELSE 0 END) AS covered FROM (SELECT CAST(l_linenumber AS BIGINT) AS n_lines, l_discount > 0.04 AS hit FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))".replace("sum(n_lines)", "CAST(sum(n_lines) AS BIGINT)").replace("sum(CASE WHEN hit THEN n_lines ELSE 0 END)", "CAST(sum(CASE WHEN hit THEN n_lines ELSE 0 END) AS BIGINT)"))
def changed_line_coverage(t: Tables) -> DataFrame:
    urgent = t("orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    x = t("lineitem", "l_orderkey", "l_linenumber", "l_discount").join(urgent, "l_orderkey", "left_semi")
    n = F.col("l_linenumber").cast("long")
    return x.agg(F.sum(n).alias("executable"), F.sum(F.when(F.col("l_discount") > 0.04, n).otherwise(0)).alias("covered"))
