"""Joins, diffs, resolution, sets, explodes, as-of and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import extract, temporal, windows
from lodestone.operators import relational as rel
from lodestone.plans import analogs as a
from lodestone.plans.registry import query
from lodestone.sources.tables import Tables

_FRAMES = f"""{a.DELTAS},
b AS (SELECT node, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS n FROM d WHERE seq <= 10) WHERE n = 1 AND kind <> 'delete'),
x AS (SELECT node, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS n FROM d WHERE seq <= 20) WHERE n = 1 AND kind <> 'delete')"""


@query(f"WITH {_FRAMES} SELECT coalesce(b.node, x.node) AS node, CASE WHEN b.node IS NULL THEN 'add' WHEN x.node IS NULL THEN 'delete' ELSE 'change' END AS change_kind, b.value AS before_value, x.value AS after_value FROM b FULL JOIN x ON b.node = x.node WHERE b.node IS NULL OR x.node IS NULL OR b.value IS DISTINCT FROM x.value")
def frame_diff(t: Tables) -> DataFrame:
    d = a.deltas(t)
    diff = rel.diff_frames(temporal.as_of(d, ["node"], 10), temporal.as_of(d, ["node"], 20), ["node"], ["value"])
    return diff.select("node", "change_kind", F.col("before.value").alias("before_value"), F.col("after.value").alias("after_value"))


@query(f"WITH {_FRAMES} SELECT node FROM b WHERE node NOT IN (SELECT node FROM x)")
def removed_entities(t: Tables) -> DataFrame:
    d = a.deltas(t)
    return temporal.as_of(d, ["node"], 10).select("node").join(temporal.as_of(d, ["node"], 20).select("node"), "node", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def exists_semi(t: Tables) -> DataFrame:
    return t("orders", "o_orderkey", "o_totalprice").join(t("lineitem", "l_orderkey", "l_quantity").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query(f"""WITH {a.MODULES}, n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN replace(lower(p_type), ' ', '_') || '/m' || CAST(p_partkey AS VARCHAR) || '.py' ELSE 'm' || CAST(p_partkey % 500 AS VARCHAR) || '.py' END AS name FROM part)
SELECT name, min(path) AS path FROM n JOIN m ON m.path = n.name OR ends_with(m.path, '/' || n.name) GROUP BY name HAVING count(*) = 1""")
def suffix_match_unique(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    two = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("/m"), key.cast("string"), F.lit(".py"))
    names = t("part", "p_partkey", "p_type").select(F.when(key % 2 == 0, two).otherwise(F.concat(F.lit("m"), F.pmod(key, F.lit(500)).cast("string"), F.lit(".py"))).alias("name"))
    return rel.resolve_unique_suffix(names, a.modules(t).select("path"))


@query("""WITH k AS (SELECT DISTINCT p_brand || '.' || CAST(p_size AS VARCHAR) AS path FROM part),
r AS (SELECT s_suppkey AS id, unnest(['Brand#' || CAST(s_suppkey % 60 AS VARCHAR) || '.' || CAST(s_suppkey % 50 AS VARCHAR), 'Brand#11.' || CAST(s_suppkey % 50 AS VARCHAR), 'Brand#12.' || CAST(s_suppkey % 50 AS VARCHAR), 'Brand#13.1']) AS path, unnest([0, 1, 2, 3]) AS n FROM supplier)
SELECT s_suppkey AS id, arg_min(path, n) AS resolved, CAST(min(n) AS INTEGER) AS attempt FROM supplier LEFT JOIN (SELECT id, path, n FROM r JOIN k USING (path)) x ON x.id = s_suppkey GROUP BY s_suppkey""")
def first_candidate(t: Tables) -> DataFrame:
    known = t("part", "p_brand", "p_size").select(F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("path"))
    n = F.pmod("id", F.lit(50)).cast("string")
    tries = F.array(F.concat(F.lit("Brand#"), F.pmod("id", F.lit(60)).cast("string"), F.lit("."), n), F.concat(F.lit("Brand#11."), n), F.concat(F.lit("Brand#12."), n), F.lit("Brand#13.1"))
    return rel.first_candidate(t("supplier", "s_suppkey").select(F.col("s_suppkey").alias("id")), tries, known, "id").select("id", "resolved", "attempt")


@query("""WITH n AS (SELECT DISTINCT replace(lower(p_type), ' ', '.') || '.' || CAST(p_size AS VARCHAR) AS module FROM part),
k AS (SELECT DISTINCT split_part(lower(p_type), ' ', 1) AS known FROM part UNION SELECT DISTINCT replace(lower(p_type), ' ', '.') FROM part WHERE p_size < 3)
SELECT module, arg_max(known, length(known)) AS known FROM n LEFT JOIN k ON module = known OR starts_with(module, known || '.') GROUP BY module""")
def longest_prefix(t: Tables) -> DataFrame:
    low = F.lower("p_type")
    dotted = F.replace(low, F.lit(" "), F.lit("."))
    names = t("part", "p_type", "p_size").select(F.concat(dotted, F.lit("."), F.col("p_size").cast("string")).alias("module")).distinct()
    known = t("part", "p_type").select(F.split_part(low, F.lit(" "), F.lit(1)).alias("known")).unionByName(t("part", "p_type", "p_size").where("p_size < 3").select(dotted.alias("known")))
    return rel.longest_prefix(names, known, "module", "known").select("module", "known")


@query("""WITH n AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT c_mktsegment FROM customer),
w AS (SELECT n_name AS name, 0 AS way, count(DISTINCT r_name) AS k, min(r_name) AS target FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_name
  UNION ALL SELECT s_name, 1, count(DISTINCT n_name), min(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_name
  UNION ALL SELECT c_mktsegment, 2, count(DISTINCT n_name), min(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment)
SELECT n.name, arg_min(target, way) AS target, CAST(min(way) AS INTEGER) AS way FROM n LEFT JOIN w ON n.name = w.name AND k = 1 GROUP BY n.name""")
def resolve_target(t: Tables) -> DataFrame:
    """Nations by region, suppliers by nation; segments are ambiguous."""
    n, r = t("nation", "n_nationkey", "n_name", "n_regionkey"), t("region", "r_regionkey", "r_name")
    s, c = t("supplier", "s_name", "s_nationkey"), t("customer", "c_mktsegment", "c_nationkey")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("target"))
    suppliers = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("target"))
    segments = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("name"), F.col("n_name").alias("target"))
    names = n.select(F.col("n_name").alias("name")).unionByName(s.select(F.col("s_name").alias("name"))).unionByName(c.select(F.col("c_mktsegment").alias("name")))
    return rel.resolve_by_priority(names, nations, suppliers, segments)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages),
u AS (SELECT regexp_replace(url, '^https?://[^/]+', '') AS target, CAST(page_id AS VARCHAR) AS page FROM pages)
SELECT target, count(DISTINCT page) AS n, CASE WHEN count(DISTINCT page) = 1 THEN 'resolved_internal' WHEN count(DISTINCT page) > 1 THEN 'ambiguous_internal' WHEN regexp_matches(target, '^[./]') THEN 'unresolved_internal' ELSE 'external' END AS status
FROM (SELECT DISTINCT target FROM l) LEFT JOIN u USING (target) GROUP BY target""")
def resolve_links(t: Tables) -> DataFrame:
    names = extract.links(t("pages", "page_id", "html"), "page_id").select("target").distinct().withColumnRenamed("target", "name")
    own = t("pages", "page_id", "url").select(F.regexp_replace("url", "^https?://[^/]+", "").alias("name"), F.col("page_id").cast("string").alias("target"))
    return rel.candidate_counts(names, own).select(F.col("name").alias("target"), "n", "status")


@query(f"""WITH {a.EDGES}, s AS (SELECT DISTINCT user_id, CAST(floor(value / 4) AS BIGINT) AS test FROM events WHERE event_type = 'click')
SELECT source AS a, target AS b, count(*) AS proofs FROM e JOIN s x ON x.user_id = source JOIN s y ON y.user_id = target AND x.test = y.test GROUP BY ALL""")
def set_containment(t: Tables) -> DataFrame:
    members = t("events", "user_id", "event_type", "value").where("event_type = 'click'").select(F.floor(F.col("value") / 4).alias("test"), "user_id")
    return rel.contained_pairs(members, a.edges(t).select(F.col("source").alias("a"), F.col("target").alias("b")), "test", "user_id")


@query("""WITH s AS (SELECT DISTINCT p_brand AS g, l_orderkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT x.g AS "left", y.g AS "right", count(*) AS shared FROM s x JOIN s y ON x.p = y.p AND x.g < y.g GROUP BY ALL""")
def pair_collisions(t: Tables) -> DataFrame:
    """Pairs of brands that share orders."""
    x = t("lineitem", "l_orderkey", "l_partkey").join(t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rel.collisions(x.select("p_brand", "l_orderkey"), "p_brand", "l_orderkey").select("left", "right", "shared")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS p FROM lineitem)
SELECT x.g AS "left", y.g AS "right", count(*) AS shared FROM s x JOIN s y ON x.p = y.p AND x.g < y.g GROUP BY ALL""")
def supplier_collisions(t: Tables) -> DataFrame:
    """All pairs of suppliers that share parts, over the whole table."""
    return rel.collision_counts(t("lineitem", "l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query(f"""WITH {a.FINDINGS}, p AS (SELECT node, unnest(string_split(path, '/')) AS part FROM f) SELECT part, count(*) AS findings FROM p GROUP BY part""")
def explode_findings(t: Tables) -> DataFrame:
    return a.findings(t).select(F.explode(F.split("path", "/")).alias("part")).groupBy("part").agg(F.count("*").alias("findings"))


@query(f"WITH {a.EDGES} SELECT source AS node, target AS neighbour, 'uses' AS direction FROM e UNION ALL SELECT target, source, 'used_by' FROM e")
def symmetric_neighbours(t: Tables) -> DataFrame:
    return rel.symmetric_neighbours(a.edges(t))


@query("""WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), x AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT x.event_id, round(p.value, 4) AS price FROM x ASOF JOIN p ON x.user_id = p.user_id AND x.ts >= p.ts""")
def asof_latest_price(t: Tables) -> DataFrame:
    """The last purchase at or before each error: one sort of both kinds together per user."""
    e = t("events", "event_id", "user_id", "ts", "event_type", "value").where(F.col("event_type").isin("purchase", "error"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc()).rowsBetween(Window.unboundedPreceding, 0)
    price = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("price", F.round(price, 4)).where("event_type = 'error' AND price IS NOT NULL").select("event_id", "price")


@query(f"WITH {a.DELTAS} SELECT node, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS n FROM d) WHERE n = 1 AND kind <> 'delete'")
def latest_state(t: Tables) -> DataFrame:
    return windows.latest_state(a.deltas(t), ["node"], "seq").select("node", "seq", "value")


@query(f"WITH {a.DELTAS} SELECT node, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS n FROM d WHERE seq <= 20) WHERE n = 1 AND kind <> 'delete'")
def as_of_snapshot(t: Tables) -> DataFrame:
    """Frame 20 from the checkpoint at 15 and the deltas behind it."""
    d, at = a.deltas(t), temporal.checkpoint_before(20)
    base = temporal.as_of(d, ["node"], at)
    return temporal.as_of(d, ["node"], 20, base, at).select("node", "seq", "value")


@query(f"WITH {a.DELTAS}, k AS (SELECT *, lead(seq) OVER (PARTITION BY node ORDER BY seq) AS till FROM d) SELECT s.seq AS frame, count(*) AS nodes FROM (SELECT DISTINCT seq FROM d) s JOIN k ON s.seq >= k.seq AND (till IS NULL OR s.seq < till) AND kind <> 'delete' GROUP BY s.seq")
def frame_sizes(t: Tables) -> DataFrame:
    d = a.deltas(t)
    return temporal.frame_sizes(d, d.select("seq").distinct(), ["node"])


@query("SELECT true AS equal")
def checkpoint_equivalence(t: Tables) -> DataFrame:
    d, at = a.deltas(t), temporal.checkpoint_before(25)
    direct, rebuilt = temporal.as_of(d, ["node"], 25), temporal.as_of(d, ["node"], 25, temporal.as_of(d, ["node"], at), at)
    return temporal.parity(direct, rebuilt, ["node", "seq", "value"]).select("equal")


@query(f"""WITH {a.DELTAS}, {a.EDGES}, f AS (SELECT node, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq DESC) AS n FROM d WHERE seq <= 25) WHERE n = 1 AND kind <> 'delete'),
lost AS (SELECT * FROM e WHERE source = (SELECT min(source) FROM e)), named AS (SELECT * FROM part WHERE p_size = (SELECT max(p_size) FROM part))
SELECT 'files' AS "table", (SELECT count(*) FROM f) AS left_rows, (SELECT count(*) FROM f) AS right_rows, 0 AS differing, true AS equal, NULL AS first_key
UNION ALL SELECT 'relationships', (SELECT count(*) FROM e), (SELECT count(*) FROM e) - count(*), count(*), false, '{{"source":' || min(source) || ',"target":' || min(target) || '}}' FROM lost
UNION ALL SELECT 'symbols', (SELECT count(*) FROM part), (SELECT count(*) FROM part), 2 * count(*), false, '{{"node":' || min(p_partkey) || '}}' FROM named""")
def projection_parity(t: Tables) -> DataFrame:
    """Three tables of a frame against those of a rebuilt one: files from a checkpoint and the deltas behind it, relationships that lost a source, and
    symbols of which some have another name."""
    d, e, at = a.deltas(t), a.edges(t), temporal.checkpoint_before(25)
    files = temporal.as_of(d, ["node"], 25).select("node", "value")
    again = temporal.as_of(d, ["node"], 25, temporal.as_of(d, ["node"], at), at).select("node", "value")
    fewer = e.join(F.broadcast(e.agg(F.min("source").alias("least"))), F.col("source") != F.col("least")).select("source", "target")
    p = t("part", "p_partkey", "p_name", "p_size")
    named = p.join(F.broadcast(p.agg(F.max("p_size").alias("most"))))
    symbols = named.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    other = named.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") == F.col("most"), F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return temporal.joint_parity({"files": files, "relationships": e, "symbols": symbols}, {"files": again, "relationships": fewer, "symbols": other}, {"files": ["node"], "relationships": ["source", "target"], "symbols": ["node"]})


@query(f"WITH {a.DELTAS} SELECT seq, sha256(string_agg(sha256(CAST(node AS VARCHAR) || '|' || kind), '' ORDER BY sha256(CAST(node AS VARCHAR) || '|' || kind))) AS digest, count(*) AS n FROM d GROUP BY seq")
def frame_digest(t: Tables) -> DataFrame:
    row = F.sha2(F.concat_ws("|", F.col("node").cast("string"), "kind"), 256)
    return rel.ordered_digest(a.deltas(t).select("seq", row.alias("row")), "seq", "row")


_DAYS = "y AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), z AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM y)"


@query(f"WITH {_DAYS} SELECT CAST(day AS VARCHAR) AS day FROM z WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 11.0, 0) AS BIGINT) FROM range(12) r(k), (SELECT max(n) AS n FROM z))")
def timeline_sample(t: Tables) -> DataFrame:
    """Twelve days spread over the timeline, which is bounded by the calendar."""
    days = t("orders", "o_orderdate").select(F.to_date("o_orderdate").alias("day")).distinct()
    return windows.even_sample(days, ["day"], 12).select(F.col("day").cast("string").alias("day"))


def _strata_sql(limit: int, strata: list[tuple[str, float]]) -> str:
    """Stratum by stratum: how many are chosen, how many are open, which of those are."""
    spread = "CASE WHEN k >= m THEN true WHEN k < 1 THEN false WHEN k = 1 THEN place = m - 1 ELSE list_contains(list_transform(range(CAST(k AS BIGINT)), lambda i: CAST(round_even(i * (m - 1) / (k - 1), 0) AS BIGINT)), place) END"
    steps = [f"s0 AS (SELECT *, n <= {limit} OR pos IN (0, n - 1) AS chosen FROM o)"]
    for i, (flag, share) in enumerate([*strata, ("true", None)]):
        k = f"greatest({limit} - have, 0)" if share is None else f"least(ceil({share} * greatest({limit} - have, 0)), m)"
        take = "place >= m - k" if share is None else spread
        steps.append(f"""c{i} AS (SELECT *, {flag} AND NOT chosen AS open, count(*) FILTER (WHERE chosen) OVER (PARTITION BY p) AS have, count(*) FILTER (WHERE {flag} AND NOT chosen) OVER (PARTITION BY p) AS m,
  count(*) FILTER (WHERE {flag} AND NOT chosen) OVER (PARTITION BY p ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS place FROM s{i}),
k{i} AS (SELECT *, {k} AS k FROM c{i}),
s{i + 1} AS (SELECT p, id, pos, n, tagged, structural, last, chosen OR (open AND k > 0 AND {take}) AS chosen FROM k{i})""")
    return ",\n".join(steps) + f" SELECT p AS priority, id FROM s{len(strata) + 1} WHERE chosen"


@query("""WITH o AS (SELECT o_orderpriority AS p, o_orderkey AS id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n, o_totalprice > 300000 AS tagged, o_custkey % 40 = 0 AS structural,
  row_number() OVER (PARTITION BY o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS last FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)),
""" + _strata_sql(60, [("tagged", 1.0), ("structural", 0.5), ("last", 0.5)]))
def stratified_orders(t: Tables) -> DataFrame:
    """For each priority sixty of its orders: the first and last, large ones, those of some customers, the last of each month, the newest."""
    o = t("orders", "o_orderpriority", "o_orderkey", "o_orderdate", "o_totalprice", "o_custkey").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    order = ["o_orderdate", "o_orderkey"]
    strata = [(F.col("o_totalprice") > 300000, 1.0), (F.col("o_custkey") % 40 == 0, 0.5), (windows.last_of(["o_orderpriority", "month"], order), 0.5)]
    return windows.stratified_sample(o, order, 60, strata, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("id"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, max(struct_pack(a := o_orderdate, b := o_orderkey)).b AS id FROM orders GROUP BY 1")
def calendar_last(t: Tables) -> DataFrame:
    return windows.last_per_month(t("orders", "o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey").select("month", F.col("o_orderkey").alias("id"))


@query("SELECT source, doc_id, running_size FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running_size FROM documents) WHERE running_size <= 20000")
def budget_prefix(t: Tables) -> DataFrame:
    return windows.budget_prefix(t("documents", "source", "doc_id", "n_chars"), ["doc_id"], F.col("n_chars"), 20000, ["source"]).select("source", "doc_id", "running_size")


@query("SELECT o_custkey % 50 AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey % 60 FROM customer WHERE c_acctbal < 0 EXCEPT SELECT s_suppkey % 40 FROM supplier WHERE s_acctbal > 9000")
def set_ops(t: Tables) -> DataFrame:
    o, c, s = (t(n, k, v).where(p).select(F.pmod(k, F.lit(m)).alias("k")) for n, k, v, p, m in (("orders", "o_custkey", "o_orderstatus", "o_orderstatus = 'F'", 50), ("customer", "c_custkey", "c_acctbal", "c_acctbal < 0", 60), ("supplier", "s_suppkey", "s_acctbal", "s_acctbal > 9000", 40)))
    return o.union(c).distinct().subtract(s)


@query("""SELECT doc_id, CASE WHEN p.id IS NULL THEN 'new' WHEN d.n_chars = p.raw AND d.lang = p.an THEN 'raw_unchanged' WHEN d.n_chars = p.raw THEN 'analyzer_changed' WHEN d.n_chars % 10 = p.st THEN 'metadata_only' ELSE 'structural_changed' END AS analysis_status
FROM documents d LEFT JOIN (SELECT doc_id AS id, n_chars + CASE WHEN doc_id % 3 = 0 THEN 10 WHEN doc_id % 3 = 1 THEN 0 ELSE 3 END AS raw, (n_chars + CASE WHEN doc_id % 3 = 0 THEN 10 WHEN doc_id % 3 = 1 THEN 0 ELSE 3 END) % 10 AS st, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS an FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) p ON p.id = d.doc_id""")
def incremental_reuse(t: Tables) -> DataFrame:
    d = t("documents", "doc_id", "lang", "n_chars")
    now = d.select("doc_id", F.col("n_chars").alias("raw_hash"), (F.col("n_chars") % 10).alias("structural_hash"), F.col("lang").alias("analyzer"))
    third = F.pmod("doc_id", F.lit(3))
    raw = F.col("n_chars") + F.when(third == 0, 10).when(third == 1, 0).otherwise(3)
    was = d.join(t("labels", "doc_id"), "doc_id", "left_semi").select("doc_id", raw.alias("raw_hash"), (raw % 10).alias("structural_hash"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("analyzer"))
    return temporal.reuse_status(now, was, "doc_id").select("doc_id", "analysis_status")


@query(f"""WITH {a.MODULES}, n AS (SELECT node, loc FROM m WHERE kind <> 'documentation'), w AS (SELECT node, loc + (node % 3 - 1) * 20 AS loc FROM m WHERE kind <> 'test')
SELECT coalesce(n.node, w.node) AS node, w.loc AS baseline, n.loc AS current, CASE WHEN w.loc IS NULL AND n.loc > 600 THEN 'new_violation' WHEN n.loc IS NULL THEN 'stale_baseline' WHEN w.loc IS NULL THEN 'ok' WHEN n.loc > w.loc THEN 'growth' WHEN n.loc < w.loc THEN 'stale_baseline' ELSE 'ok' END AS verdict FROM n FULL JOIN w ON n.node = w.node""")
def ratchet_diff(t: Tables) -> DataFrame:
    m = a.modules(t).select("node", "loc", "kind")
    was = m.where("kind <> 'test'").withColumn("loc", F.col("loc") + (F.pmod("node", F.lit(3)) - 1) * 20)
    return rel.ratchet(m.where("kind <> 'documentation'").drop("kind"), was.drop("kind"), "node", "loc", 600)


@query("""WITH r AS (SELECT doc_id, CAST(0 AS INTEGER) AS quality FROM documents WHERE n_chars > 1500)
SELECT * FROM r UNION ALL SELECT doc_id, CAST(quality AS INTEGER) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM r)""")
def upsert_rows(t: Tables) -> DataFrame:
    """Long documents are labelled anew."""
    fresh = t("documents", "doc_id", "n_chars").where("n_chars > 1500").select("doc_id", F.lit(0).alias("quality"))
    return rel.upsert(_labels(t), fresh, ["doc_id"])


@query("""SELECT doc_id, CAST(quality AS INTEGER) AS quality FROM labels UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_absent_rows(t: Tables) -> DataFrame:
    """Documents without a label get one."""
    return rel.insert_absent(_labels(t), t("documents", "doc_id").select("doc_id", F.lit(0).alias("quality")), ["doc_id"])


def _labels(t: Tables) -> DataFrame:
    return t("labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins_rows(t: Tables) -> DataFrame:
    return rel.latest_wins(t("events", "user_id", "event_id", "event_type", "ts"), ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return rel.duplicates(t("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
