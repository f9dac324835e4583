"""The engine's model over the driver's tables: modules, changes, references, edges, deltas, jobs.

Each analog is a DataFrame and, for the equivalents, the text of a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import Tables

AS_OF = "2001-12-01 00:00:00"


def modules(t: Tables) -> DataFrame:
    """``part`` as modules: node, path, grp, language, loc, complexity, kind."""
    p = t("part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    kind = F.when(F.col("p_size") % 5 == 0, "test").when(F.col("p_size") % 7 == 0, "documentation").otherwise("source")
    return p.select(
        F.col("p_partkey").alias("node"), F.concat_ws("/", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py"))).alias("path"),
        F.col("p_brand").alias("grp"), F.col("p_type").alias("language"), (F.col("p_size") * 20).cast("long").alias("loc"), (F.col("p_retailprice") / 40).alias("complexity"), kind.alias("kind"),
    )


MODULES = """m AS (SELECT p_partkey AS node,
  concat_ws('/', replace(lower(p_brand), '#', '_'), replace(lower(p_type), ' ', '_'), 'm' || CAST(p_partkey AS VARCHAR) || '.py') AS path,
  p_brand AS grp, p_type AS language, CAST(p_size * 20 AS BIGINT) AS loc, p_retailprice / 40 AS complexity,
  CASE WHEN p_size % 5 = 0 THEN 'test' WHEN p_size % 7 = 0 THEN 'documentation' ELSE 'source' END AS kind FROM part)"""


def changes(t: Tables) -> DataFrame:
    """``lineitem`` as a change log: node, at, sha, additions."""
    return t("lineitem", "l_partkey", "l_shipdate", "l_orderkey", "l_quantity").select(F.col("l_partkey").alias("node"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("sha"), F.col("l_quantity").cast("long").alias("additions"))


CHANGES = "c AS (SELECT l_partkey AS node, l_shipdate AS ts, l_orderkey AS sha, CAST(l_quantity AS BIGINT) AS additions FROM lineitem)"


def references(t: Tables) -> DataFrame:
    """``lineitem`` as raw references of suppliers to part groups, some ambiguous, unresolved or external."""
    x = t("lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_quantity")
    status = F.when(F.col("l_quantity") <= 5, "external").when(F.col("l_quantity") <= 8, "unresolved_internal").when(F.col("l_quantity") <= 11, "ambiguous_internal").otherwise("resolved_internal")
    inside = status == "resolved_internal"
    return x.select(
        F.col("l_suppkey").alias("source"), F.when(inside, F.pmod("l_partkey", F.lit(40))).alias("target"), F.when(~inside, F.concat(F.lit("lib"), F.pmod("l_partkey", F.lit(9)).cast("string"))).alias("external"),
        F.col("l_returnflag").alias("type"), status.alias("status"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("confidence"),
        F.concat(F.lit("e"), F.pmod("l_partkey", F.lit(7)).cast("string")).alias("evidence"), F.concat(F.lit("t"), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("original"),
    )


REFERENCES = """r0 AS (SELECT *, CASE WHEN l_quantity <= 5 THEN 'external' WHEN l_quantity <= 8 THEN 'unresolved_internal' WHEN l_quantity <= 11 THEN 'ambiguous_internal' ELSE 'resolved_internal' END AS status FROM lineitem),
r AS (SELECT l_suppkey AS source, CASE WHEN status = 'resolved_internal' THEN l_partkey % 40 END AS target,
  CASE WHEN status <> 'resolved_internal' THEN 'lib' || CAST(l_partkey % 9 AS VARCHAR) END AS external, l_returnflag AS type, status, l_linenumber AS line,
  l_discount AS confidence, 'e' || CAST(l_partkey % 7 AS VARCHAR) AS evidence, 't' || CAST(l_partkey % 40 AS VARCHAR) AS original FROM r0)"""


def edges(t: Tables) -> DataFrame:
    """``events`` as a graph of users: a purchase that is followed, within the hour, by another user's error."""
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    e = t("events", "event_id", "ts", "user_id", "event_type").withColumn("target", F.lead("user_id").over(w)).withColumn("_next", F.lead("event_type").over(w))
    return e.where("event_type = 'purchase' AND _next = 'error' AND target <> user_id").select(F.col("user_id").alias("source"), "target").distinct()


EDGES = """e AS (SELECT DISTINCT user_id AS source, nu AS target FROM (
  SELECT user_id, event_type, lead(user_id) OVER w AS nu, lead(event_type) OVER w AS nt FROM events
  WINDOW w AS (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id))
  WHERE event_type = 'purchase' AND nt = 'error' AND nu <> user_id)"""


def deltas(t: Tables) -> DataFrame:
    """``events`` as sparse deltas: a frame per day; a user's last event of the day adds, deletes or changes it."""
    e = t("events", "event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
    last = e.groupBy("day", "user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("s"))
    kind = F.when(F.col("s.event_type") == "signup", "add").when(F.col("s.event_type") == "error", "delete").otherwise("change")
    frames = e.agg(F.min("day").alias("first"))
    return last.join(F.broadcast(frames)).select(F.col("user_id").alias("node"), F.datediff("day", "first").alias("seq"), kind.alias("kind"), F.round("s.value", 4).alias("value"))


DELTAS = """d AS (SELECT user_id AS node, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS seq,
  CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'change' END AS kind, round(value, 4) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"""


def jobs(t: Tables) -> DataFrame:
    """``orders`` as a work queue."""
    o = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    kind = F.element_at(F.array(*map(F.lit, ("intrinsic", "context", "group", "repository"))), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), status.alias("status"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("at"), kind.alias("kind"), F.pmod("o_orderkey", F.lit(9)).cast("int").alias("attempts"))


JOBS = """j AS (SELECT o_orderkey AS id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_totalprice AS cost, o_orderdate AS ts,
  ['intrinsic', 'context', 'group', 'repository'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS kind, CAST(o_orderkey % 9 AS INTEGER) AS attempts FROM orders)"""


def findings(t: Tables) -> DataFrame:
    """Modules that are too large, with the features that rank them."""
    c = changes(t).groupBy("node").agg(F.count("*").alias("change_count"), F.min("at").alias("first_at"))
    m = modules(t).where("loc > 300").join(c, "node", "left")
    severity = F.when(F.col("loc") > 900, "critical").when(F.col("loc") > 700, "error").when(F.col("loc") > 500, "warning").otherwise("info")
    status = F.element_at(F.array(*map(F.lit, ("new", "acknowledged", "planned", "regressed", "dismissed", "resolved"))), (F.pmod("node", F.lit(6)) + 1).cast("int"))
    kind = F.when(F.pmod("node", F.lit(3)) == 0, "long_function").otherwise("large_module")
    return m.select("node", "path", "grp", kind.alias("finding_type"), severity.alias("severity"), status.alias("status"), F.coalesce("change_count", F.lit(0)).cast("long").alias("change_count"), "complexity", (F.pmod("node", F.lit(10)) / 10).alias("confidence"), F.pmod("node", F.lit(40)).alias("degree"), "first_at")


FINDINGS = f"""{MODULES}, {CHANGES}, f AS (SELECT m.node, path, grp, CASE WHEN m.node % 3 = 0 THEN 'long_function' ELSE 'large_module' END AS finding_type,
  CASE WHEN loc > 900 THEN 'critical' WHEN loc > 700 THEN 'error' WHEN loc > 500 THEN 'warning' ELSE 'info' END AS severity,
  ['new', 'acknowledged', 'planned', 'regressed', 'dismissed', 'resolved'][CAST(m.node % 6 + 1 AS INTEGER)] AS status,
  CAST(coalesce(n, 0) AS BIGINT) AS change_count, complexity, (m.node % 10) / 10 AS confidence, m.node % 40 AS degree, first_at
  FROM m LEFT JOIN (SELECT node, count(*) AS n, min(ts) AS first_at FROM c GROUP BY node) x ON m.node = x.node WHERE loc > 300)"""
PRIORITY = """least(100, CAST(CASE severity WHEN 'critical' THEN 45 WHEN 'error' THEN 38 WHEN 'warning' THEN 24 ELSE 8 END + round_even(12 * confidence, 0) + round_even(14 * least(change_count / 20.0, 1), 0)
  + round_even(16 * least(degree / 30.0, 1), 0) + round_even(8 * least(1 / 5.0, 1), 0) + round_even(10 * (least(change_count / 10.0, 1) * least(complexity / 50.0, 1)), 0) + CASE WHEN status = 'regressed' THEN 8 ELSE 0 END AS INTEGER))"""
