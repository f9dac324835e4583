"""Degrees, reachability, cycles, hierarchies and rules over the graph of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import commits, extract, graph, rules
from lodestone.plans import analogs as a
from lodestone.plans.registry import query
from lodestone.sources.tables import Tables

_START = 7


def _start(t: Tables, n: int = _START) -> DataFrame:
    return t.spark.range(n, n + 1).select(F.col("id").alias("node"))


@query(f"WITH {a.REFERENCES} SELECT coalesce(o.node, i.node) AS node, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM (SELECT source AS node, count(*) AS fan_out FROM r GROUP BY 1) o FULL JOIN (SELECT target AS node, count(*) AS fan_in FROM r WHERE target IS NOT NULL GROUP BY 1) i ON o.node = i.node")
def fan_in_out(t: Tables) -> DataFrame:
    return graph.degree_all(a.references(t).select("source", "target"))


@query(f"WITH {a.REFERENCES} SELECT coalesce(o.node, i.node) AS node, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM (SELECT source AS node, count(*) AS fan_out FROM r WHERE target IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT target AS node, count(*) AS fan_in FROM r WHERE target IS NOT NULL GROUP BY 1) i ON o.node = i.node")
def fan_in_out_internal(t: Tables) -> DataFrame:
    return graph.degree_internal(a.references(t).select("source", "target"))


@query(f"WITH {a.REFERENCES}, x AS (SELECT DISTINCT source, target FROM r WHERE target IS NOT NULL) SELECT coalesce(o.node, i.node) AS node, CAST(coalesce(fan_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(fan_out, 0) AS BIGINT) AS fan_out FROM (SELECT source AS node, count(*) AS fan_out FROM x GROUP BY 1) o FULL JOIN (SELECT target AS node, count(*) AS fan_in FROM x GROUP BY 1) i ON o.node = i.node")
def fan_in_out_distinct(t: Tables) -> DataFrame:
    return graph.degree_distinct(a.references(t).select("source", "target"))


@query(f"WITH {a.EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), g AS (SELECT node, count(*) AS k FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node) SELECT (SELECT count(*) FROM n) AS artifact_count, (SELECT count(*) FROM e) AS dependency_count, round(2 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n), 4) AS average_degree, (SELECT max(k) FROM g) AS maximum_degree")
def repository_metrics(t: Tables) -> DataFrame:
    d = graph.degree_internal(a.edges(t))
    return d.agg(F.count("*").alias("artifact_count"), F.sum("fan_out").alias("dependency_count"), F.round(F.sum(F.col("fan_in") + F.col("fan_out")) / F.count("*"), 4).alias("average_degree"), F.max(F.col("fan_in") + F.col("fan_out")).alias("maximum_degree"))


_REACH = "r AS (SELECT source AS node FROM e WHERE target = 7 UNION SELECT e.source FROM e JOIN r ON e.target = r.node)"


@query(f"WITH RECURSIVE {a.EDGES}, {_REACH} SELECT node FROM r WHERE node <> 7")
def reach_reverse(t: Tables) -> DataFrame:
    return graph.reach(graph.reversed_edges(a.edges(t)), _start(t)).where("distance > 0").select("node")


@query(f"WITH {a.EDGES}, x AS (SELECT DISTINCT source AS node FROM e WHERE target = 7), y AS (SELECT DISTINCT source AS node FROM e WHERE target IN (SELECT node FROM x)) SELECT node, 1 AS ring FROM x UNION ALL SELECT node, 2 FROM y WHERE node <> 7 AND node NOT IN (SELECT node FROM x)")
def second_order(t: Tables) -> DataFrame:
    return graph.second_order(a.edges(t), _start(t))


_HOPS = f"""{a.EDGES}, u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), g AS (SELECT source AS node, count(*) AS k FROM (SELECT source FROM e UNION ALL SELECT target FROM e) GROUP BY source),
h1 AS (SELECT DISTINCT target AS node FROM u WHERE source = 7 AND target <> 7), h2 AS (SELECT DISTINCT u.target AS node FROM u JOIN h1 ON u.source = h1.node JOIN g ON g.node = h1.node WHERE k <= 5 AND u.target <> 7 AND u.target NOT IN (SELECT node FROM h1))"""


@query(f"WITH {_HOPS} SELECT node, 1 AS distance FROM h1 UNION ALL SELECT node, 2 FROM h2")
def khop_hubcut(t: Tables) -> DataFrame:
    return graph.expand(a.edges(t), _start(t), depth=2, hub=5).where("distance > 0")


@query(f"""WITH {_HOPS.replace("k <= 5", "k <= 80")}, f AS (SELECT node, 1 AS d FROM h1 UNION ALL SELECT node, 2 FROM h2)
SELECT f.node, d AS distance, round(100.0 / d + CASE WHEN d = 1 THEN 60 ELSE 0 END + CASE WHEN f.node % 4 = 3 THEN 25 ELSE 0 END + CASE WHEN f.node % 3 = 1 THEN 8 ELSE 0 END - 0.8 * greatest(0, k - 20), 4) AS score
FROM f JOIN g ON g.node = f.node ORDER BY score DESC, lpad(CAST(f.node AS VARCHAR), 9, '0') LIMIT 20""")
def proximity_score(t: Tables) -> DataFrame:
    e = a.edges(t)
    nodes = graph.degree_internal(e).select("node", (F.col("node") % 4).alias("folder"), (F.col("node") % 3).alias("grp"), F.lpad(F.col("node").cast("string"), 9, "0").alias("path"), F.lit(0.0).alias("lexical"))
    return graph.related(e, _start(t), nodes, depth=2, limit=20).select("node", "distance", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {a.EDGES}, p AS (SELECT source, target FROM e UNION SELECT p.source, e.target FROM p JOIN e ON p.target = e.source),
m AS (SELECT p.source AS node, p.target AS other FROM p JOIN p q ON p.source = q.target AND p.target = q.source WHERE p.source <> p.target)
SELECT node, least(node, min(other)) AS component FROM m GROUP BY node""")
def scc_cycles(t: Tables) -> DataFrame:
    return graph.strongly_connected(a.edges(t))


@query(f"""WITH RECURSIVE {a.EDGES}, p AS (SELECT source, target FROM e UNION SELECT p.source, e.target FROM p JOIN e ON p.target = e.source),
m AS (SELECT p.source AS node, p.target AS other FROM p JOIN p q ON p.source = q.target AND p.target = q.source WHERE p.source <> p.target),
c AS (SELECT node, least(node, min(other)) AS component FROM m GROUP BY node)
SELECT string_agg(CAST(node AS VARCHAR), '|' ORDER BY CAST(node AS VARCHAR)) AS subject, CAST(count(*) AS DOUBLE) AS measured, 'dependency_cycle' AS finding_type FROM c GROUP BY component""")
def cycle_rule(t: Tables) -> DataFrame:
    return rules.cycle_findings(a.edges(t)).select("subject", "measured", "finding_type")


@query("""WITH n AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey), d AS (SELECT n_name AS name, count(*) AS files, CAST(sum(c_custkey % 100) AS BIGINT) AS loc FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n.name, parent, coalesce(files, 0) AS direct_files, coalesce(loc, 0) AS direct_loc, coalesce(files, 0) AS total_files, coalesce(loc, 0) AS total_loc FROM n LEFT JOIN d ON n.name = d.name
UNION ALL SELECT parent, NULL, 0, 0, CAST(sum(coalesce(files, 0)) AS BIGINT), CAST(sum(coalesce(loc, 0)) AS BIGINT) FROM n LEFT JOIN d ON n.name = d.name GROUP BY parent""")
def group_tree(t: Tables) -> DataFrame:
    """Nations below regions that aren't declared: virtual parents."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    direct = t("customer", "c_nationkey", "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("name").agg(F.count("*").alias("files"), F.sum(F.col("c_custkey") % 100).alias("loc"))
    return graph.rollup_tree(n.select("name", "parent"), direct, ["files", "loc"])


@query(f"WITH {a.REFERENCES} SELECT status || ':' || external AS node, status, external, count(*) AS \"references\" FROM r WHERE target IS NULL GROUP BY status, external")
def external_nodes(t: Tables) -> DataFrame:
    return graph.external_nodes(a.references(t))


@query(f"WITH {a.EDGES} SELECT source, target FROM e WHERE source % 4 = 0 AND target % 4 = 2")
def forbidden_edges(t: Tables) -> DataFrame:
    e = a.edges(t)
    nodes = graph.degree_internal(e).select("node", (F.col("node") % 4).alias("layer"))
    return graph.forbidden_edges(e, nodes, F.col("source_layer") == 0, F.col("target_layer") == 2).select("source", "target")


@query(f"WITH {a.EDGES} SELECT 'not_allowed' AS fault, source, CAST(target AS VARCHAR) AS target FROM e WHERE source % 3 <> target % 3 AND NOT (source % 3 = 0) AND source % 10 <> 9 AND target % 10 <> 9 UNION ALL SELECT 'unclassified', node, NULL FROM (SELECT source AS node FROM e UNION SELECT target FROM e) WHERE node % 10 = 9")
def layer_policy(t: Tables) -> DataFrame:
    e = a.edges(t)
    layers = graph.degree_internal(e).where("node % 10 <> 9").select("node", (F.col("node") % 3).alias("layer"))
    allowed = t.spark.createDataFrame([(0, 1), (0, 2)], "from_layer long, to_layer long")
    return graph.layer_faults(e, layers, allowed)


@query(f"""WITH {a.EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), p AS (SELECT node, CASE WHEN node % 3 = 0 THEN 'tests/m' ELSE 'src/m' END || node || '.py' AS path FROM n),
k AS (SELECT node, 'tests' AS layer FROM p WHERE starts_with(path, 'tests/') UNION ALL SELECT node, 'low' FROM p WHERE regexp_matches(path, '^src/m[1-4]') UNION ALL SELECT node, 'high' FROM p WHERE regexp_matches(path, '^src/m[^/]*[5-9]\\.py$')),
o AS (SELECT node, min(layer) AS layer, count(*) AS n FROM k GROUP BY node),
b AS (SELECT source, target FROM e JOIN o x ON x.node = source AND x.n = 1 JOIN o y ON y.node = target AND y.n = 1 WHERE x.layer <> y.layer AND x.layer <> 'tests' AND NOT (x.layer = 'high' AND y.layer = 'low')),
g AS (SELECT source, target FROM e WHERE source % 7 = 0)
SELECT 'not_allowed' AS fault, source, CAST(target AS VARCHAR) AS target FROM (SELECT * FROM b EXCEPT SELECT * FROM g) UNION ALL SELECT 'stale', source, CAST(target AS VARCHAR) FROM (SELECT * FROM g EXCEPT SELECT * FROM b)
UNION ALL SELECT CASE WHEN o.n IS NULL THEN 'unclassified' ELSE 'ambiguous' END, p.node, NULL FROM p LEFT JOIN o ON o.node = p.node WHERE o.n IS NULL OR o.n > 1""")
def layer_exceptions(t: Tables) -> DataFrame:
    """Layers by globs; edges from every seventh node are excepted, those of them that needn't be are stale."""
    e = a.edges(t)
    node = F.col("node")
    named = graph.degree_internal(e).select("node", F.concat(F.when(node % 3 == 0, "tests/m").otherwise("src/m"), node.cast("string"), F.lit(".py")).alias("path"))
    layers = graph.layers_of(named, [("tests", ["tests/**"]), ("low", ["src/m[1-4]*"]), ("high", ["src/m*[5-9].py"])])
    allowed = t.spark.createDataFrame([("tests", "low"), ("tests", "high"), ("high", "low")], "from_layer string, to_layer string")
    return graph.layer_faults(e, layers, allowed, e.where("source % 7 = 0"))


@query(f"WITH {a.EDGES}, s AS (SELECT source AS test, target FROM e WHERE source % 5 = 0) SELECT e.source, e.target, 1.0::DOUBLE AS coverage, array_to_string((list_sort(list(x.test)))[1:10], ',') AS evidence FROM e JOIN s x ON x.target = e.source JOIN s y ON y.target = e.target AND y.test = x.test WHERE e.source % 5 <> 0 GROUP BY e.source, e.target")
def edge_coverage(t: Tables) -> DataFrame:
    e = a.edges(t)
    tests = e.select(F.col("source").alias("node")).where("node % 5 = 0").distinct()
    return graph.edge_coverage(e, tests).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {a.MODULES} SELECT path AS subject, CAST(loc AS DOUBLE) AS measured, 'large_module' AS finding_type FROM m WHERE loc > 300 AND kind IN ('source', 'test')")
def size_rule(t: Tables) -> DataFrame:
    return rules.above(a.modules(t), "max_module_loc", "large_module", "path", "loc", 300, scope=F.col("kind").isin("source", "test")).select("subject", "measured", "finding_type")


@query(f"WITH {a.REFERENCES} SELECT CAST(source AS VARCHAR) AS subject, CAST(count(*) AS DOUBLE) AS measured, 'high_fan_out' AS finding_type FROM r WHERE target IS NOT NULL GROUP BY source HAVING count(*) > 480 UNION ALL SELECT CAST(target AS VARCHAR), count(*), 'high_fan_in' FROM r WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 1200")
def fan_rules(t: Tables) -> DataFrame:
    return rules.fan_findings(a.references(t).select("source", "target"), 480, 1200).select("subject", "measured", "finding_type")


@query("SELECT doc_id FROM documents WHERE lang <> '' AND source <> '' AND lang <> CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END")
def drift_rule(t: Tables) -> DataFrame:
    d = t("documents", "doc_id", "lang", "source").withColumn("inferred", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("source")))
    return d.where(rules.drift(d, "lang", "inferred")).select("doc_id")


@query(f"""WITH {a.MODULES}, {a.CHANGES} SELECT path AS subject, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2001-12-01') AS DOUBLE) AS measured, 0.75::DOUBLE AS confidence FROM m JOIN c ON m.node = c.node
WHERE kind = 'source' AND m.node % 3 <> 0 GROUP BY path HAVING max(ts) <= TIMESTAMP '2001-12-01' - INTERVAL 200 DAY""")
def dead_entities(t: Tables) -> DataFrame:
    m = a.modules(t)
    e = m.where("node % 3 = 0").select(F.lit(0).cast("long").alias("source"), F.col("node").alias("target"), F.lit("resolved_internal").alias("status"), F.array().cast("array<string>").alias("candidates"))
    return rules.dead_code(m.select("node", "path", "kind"), e, a.changes(t).select("node", "at"), a.AS_OF, 200).select("subject", "measured", "confidence")


@query("SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS place, unnest(l) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def extract_links(t: Tables) -> DataFrame:
    return extract.links(t("pages", "page_id", "html"), "page_id")


@query("""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(#|//|--|;|\\*|/\\*|<!--)'))) AS INTEGER) AS comment_lines FROM documents""")
def code_metrics(t: Tables) -> DataFrame:
    return extract.line_facts(t("documents", "doc_id", "text")).select("doc_id", "lines", "comment_lines")


@query()
def python_facts(t: Tables) -> DataFrame:
    """Conversation texts read as source: what parses, and what it holds."""
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    facts = extract.conforming(extract.parse_python(t("conversations", "conv_id", "turn", "text").select(key.alias("path"), "text"), "path"))
    return facts.select("path", "structural_hash", "complexity", "parse_error", F.size("symbols").alias("symbols"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(i * 5 + 1 AS INTEGER) AS start_line, array_to_string(a[i * 5 + 1 : i * 5 + 5], chr(10)) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS a, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 5 + 1)) AS i FROM documents)")
def source_chunks(t: Tables) -> DataFrame:
    return extract.chunks(t("documents", "doc_id", "text"), "doc_id", lines=5)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS sha, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1 UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey > 1 AND c_custkey % 5 = 0),
q AS (SELECT DISTINCT o_custkey AS a, (o_orderkey - 1) % (SELECT count(*) FROM customer) + 1 AS b FROM orders WHERE o_orderstatus = 'P'),
r AS (SELECT a AS start, a AS sha FROM q UNION SELECT b, b FROM q UNION SELECT r.start, p.parent FROM r JOIN p ON p.sha = r.sha),
c AS (SELECT a, b, x.sha FROM q JOIN r x ON x.start = a JOIN r y ON y.start = b AND y.sha = x.sha)
SELECT a, b, sha AS base FROM c WHERE NOT EXISTS (SELECT 1 FROM p JOIN c d ON d.sha = p.sha WHERE p.parent = c.sha AND d.a = c.a AND d.b = c.b)""")
def merge_base_pairs(t: Tables) -> DataFrame:
    """Customers as commits with one parent, a fifth of them with two; pairs from the open orders."""
    c = t("customer", "c_custkey").select(F.col("c_custkey").alias("sha"))
    parents = c.where("sha > 1").select("sha", F.floor(F.col("sha") / 2).alias("parent")).unionByName(c.where("sha > 1 AND sha % 5 = 0").select("sha", F.floor(F.col("sha") / 3).alias("parent")))
    n = c.count()
    pairs = t("orders", "o_custkey", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), ((F.col("o_orderkey") - 1) % n + 1).alias("b"))
    return commits.merge_bases(pairs, parents)
