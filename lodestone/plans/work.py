"""Findings, pages, search, queues, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import backoff_seconds, basename, effective, glob_any, intent_fingerprint, literal_count, parent, slug, stem
from lodestone.functions.scores import finding_priority, priority_label, work_priority
from lodestone.operators import extract, paging, queue, rules, search, windows
from lodestone.plans import analogs as a
from lodestone.plans.registry import query
from lodestone.sources.tables import Tables
from lodestone.storage import shared_path
from lodestone.streaming import leases, streams


def _ranked(t: Tables) -> DataFrame:
    f = a.findings(t)
    score = finding_priority(F.col("severity"), F.col("confidence"), F.col("change_count"), F.col("degree"), F.lit(1), F.col("complexity"), F.lit(None).cast("double"), F.col("status") == "regressed")
    return f.withColumn("priority_score", score)


_RANKED = f"{a.FINDINGS}, k AS (SELECT *, {a.PRIORITY} AS priority_score FROM f)"
_WORTH = "status IN ('planned', 'regressed') OR (status IN ('new', 'acknowledged') AND NOT (finding_type = 'long_function' AND severity = 'info') AND (severity IN ('warning', 'error', 'critical') OR priority_score >= 35))"


@query(f"WITH {_RANKED} SELECT node, priority_score, CASE WHEN priority_score >= 80 THEN 'Urgent' WHEN priority_score >= 60 THEN 'High' WHEN priority_score >= 35 THEN 'Medium' ELSE 'Low' END AS label FROM k")
def finding_priorities(t: Tables) -> DataFrame:
    return _ranked(t).select("node", "priority_score", priority_label(F.col("priority_score")).alias("label"))


@query(f"WITH {_RANKED} SELECT node, priority_score FROM k WHERE {_WORTH}")
def attention_view(t: Tables) -> DataFrame:
    return _ranked(t).where(paging.attention()).select("node", "priority_score")


_KEYS = [("priority_score", True), ("path", False)]


@query(f"WITH {_RANKED} SELECT node, path, priority_score FROM k WHERE {_WORTH} ORDER BY priority_score DESC, path LIMIT 20")
def keyset_page_1(t: Tables) -> DataFrame:
    return paging.keyset_page(_ranked(t).where(paging.attention()), _KEYS, 20).select("node", "path", "priority_score")


@query(f"WITH {_RANKED} SELECT node, path, priority_score FROM k WHERE ({_WORTH}) AND (priority_score < 70 OR (priority_score = 70 AND path > 'brand_2')) ORDER BY priority_score DESC, path LIMIT 20")
def keyset_page_2(t: Tables) -> DataFrame:
    return paging.keyset_page(_ranked(t).where(paging.attention()), _KEYS, 20, [70, "brand_2"]).select("node", "path", "priority_score")


@query(f"WITH {_RANKED} SELECT count(*) AS total, count(*) FILTER (WHERE {_WORTH}) AS attention, count(*) FILTER (WHERE severity = 'critical') AS critical FROM k")
def page_totals(t: Tables) -> DataFrame:
    return _ranked(t).agg(F.count("*").alias("total"), F.count_if(paging.attention()).alias("attention"), F.count_if(F.col("severity") == "critical").alias("critical"))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 50")
def nulls_last_sort(t: Tables) -> DataFrame:
    d = t("documents", "doc_id").join(t("labels", "doc_id", "quality"), "doc_id", "left")
    return paging.sorted_nulls_last(d, "quality", True, ["quality", "doc_id"], "doc_id").limit(paging.clamped(50, 200))


@query("""WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), z AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
x AS (SELECT user_id, n, lag(n) OVER w AS b, lead(n) OVER w AS f FROM p JOIN z USING (day) WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, n, CASE WHEN b IS NULL THEN 'new' ELSE 'regressed' END AS state FROM x WHERE b IS NULL OR b < n - 1
UNION ALL SELECT user_id, n + 1, 'resolved' FROM x WHERE n < (SELECT max(n) FROM z) AND (f IS NULL OR f > n + 1)""")
def finding_lifecycle(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = t("events", "user_id", "ts", "event_type").withColumn("day", F.to_date("ts"))
    frames = e.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")))  # as many rows as days
    return rules.presence_history(e.where("event_type = 'error'").select("user_id", "day"), frames, "user_id", "day")


@query("""WITH s AS (SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'planned' ELSE 'new' END AS status FROM labels),
d AS (SELECT DISTINCT doc_id AS k FROM documents WHERE n_chars > 1500)
SELECT CAST(coalesce(s.k, d.k) AS VARCHAR) AS stable_key, CASE WHEN s.status IS NULL THEN 'new' WHEN d.k IS NOT NULL AND status = 'resolved' THEN 'regressed' WHEN d.k IS NULL AND status <> 'dismissed' THEN 'resolved' ELSE status END AS status FROM s FULL JOIN d ON s.k = d.k""")
def lifecycle_step(t: Tables) -> DataFrame:
    """Labels as stored findings; the rule that is evaluated finds long documents."""
    status = F.element_at(F.array(*map(F.lit, ("resolved", "dismissed", "planned", "new"))), (F.col("doc_id") % 4 + 1).cast("int"))
    stored = t("labels", "doc_id").select(F.col("doc_id").cast("string").alias("stable_key"), status.alias("status"), F.lit(1).cast("long").alias("first_snapshot"), F.lit(1).cast("long").alias("last_snapshot"), F.lit(None).cast("timestamp").alias("resolved_at"))
    seen = t("documents", "doc_id", "n_chars").where("n_chars > 1500").select(F.col("doc_id").cast("string").alias("stable_key"))
    return rules.lifecycle(stored, seen, 2, "2026-01-01 00:00:00").select("stable_key", "status")


@query("""SELECT doc_id, 8 * (len(string_split(lower(source), 'src1')) - 1 + len(string_split(lower(source), 'the')) - 1) + 3 * (len(string_split(lower(text), 'src1')) - 1 + len(string_split(lower(text), 'the')) - 1) + CASE WHEN lower(source) = 'src1 the' THEN 10 ELSE 0 END AS score
FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'src1') OR contains(lower(text), 'src1') ORDER BY score DESC, doc_id LIMIT 50""")
def search_scores(t: Tables) -> DataFrame:
    d = t("documents", "doc_id", "source", "text")
    hits = lambda c: literal_count(F.lower(c), "src1") + literal_count(F.lower(c), "the")
    score = 8 * hits("source") + 3 * hits("text") + F.when(F.lower("source") == "src1 the", 10).otherwise(0)
    return d.select("doc_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(50)


_TERMS = ("ation", "heit", "src1")
_TF = " + ".join(f"(1 + ln(((SELECT count(*) FROM documents) + 1.0) / ((SELECT count(*) FROM documents WHERE contains(lower(source || ' ' || text), '{w}')) + 1.0))) * (7.0 * (len(string_split(lower(source), '{w}')) - 1) + 3.0 * (len(string_split(lower(text), '{w}')) - 1))" for w in _TERMS)


@query(f"SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, {_TF} AS score FROM documents) WHERE score > 0")
def tfidf_rank(t: Tables) -> DataFrame:
    return search.tfidf(t("documents", "doc_id", "source", "text"), _TERMS, {"source": 7.0, "text": 3.0}).select("doc_id", F.round("score", 4).alias("score"))


@query()
def diversity_selection(t: Tables) -> DataFrame:
    """For each language, sixteen of the largest modules, spread over folders and groups."""
    from pyspark.sql import Window

    w = Window.partitionBy("language").orderBy(F.col("loc").desc(), "node")
    top = a.modules(t).withColumn("rank", F.row_number().over(w)).select("language", "rank", "node", parent("path").alias("folder"), "grp")
    return windows.diversity_select(top, "language", 16)


@query()
def greedy_batches(t: Tables) -> DataFrame:
    return windows.size_batches(t("documents", "doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20000)


@query(f"WITH {a.JOBS} SELECT id, priority FROM j WHERE status = 'pending' AND ts <= TIMESTAMP '1998-06-01' ORDER BY priority DESC, id LIMIT 25")
def queue_claim(t: Tables) -> DataFrame:
    j = a.jobs(t).withColumnRenamed("at", "available_at")
    return queue.claim(j, 25, "1998-06-01 00:00:00").select("id", "priority")


@query(f"WITH {a.JOBS} SELECT kind, round(sum(cost), 2) AS spent, sum(cost) > 1000000 AS paused FROM j WHERE status = 'running' OR (status = 'completed' AND CAST(ts AS DATE) = DATE '1995-03-15') GROUP BY kind")
def budget_guard(t: Tables) -> DataFrame:
    j = a.jobs(t).withColumnsRenamed({"cost": "actual_cost", "at": "completed_at"}).withColumn("estimated_cost", F.col("actual_cost"))
    return queue.spent(j, "1995-03-15", "kind").select("kind", F.round("spent", 2).alias("spent"), (F.col("spent") > 1000000).alias("paused"))


@query(f"WITH {a.JOBS} SELECT id, least(300.0, pow(2.0, attempts))::DOUBLE AS wait FROM j WHERE status = 'running'")
def backoff_schedule(t: Tables) -> DataFrame:
    return a.jobs(t).where("status = 'running'").select("id", backoff_seconds(F.col("attempts").cast("double")).alias("wait"))


@query(f"WITH {a.JOBS}, g AS (SELECT kind, count(*) FILTER (WHERE status <> 'completed' AND NOT (kind = 'intrinsic')) AS active FROM j GROUP BY kind), p AS (SELECT *, list_position(['intrinsic', 'context', 'group', 'repository'], kind) AS n FROM g) SELECT kind, active, n <= (SELECT min(n) FROM p WHERE active > 0) AS open FROM p")
def stage_barrier(t: Tables) -> DataFrame:
    j = a.jobs(t).withColumn("status", F.when(F.col("kind") == "intrinsic", "completed").otherwise(F.col("status")))
    return queue.open_stage(j)


@query("SELECT o_orderkey AS id, 50 + least(20, o_totalprice // 10000)::BIGINT + least(20, (o_custkey % 300) // 10)::BIGINT AS priority FROM orders".replace("o_totalprice // 10000", "floor(o_totalprice / 10000)"))
def work_priorities(t: Tables) -> DataFrame:
    o = t("orders", "o_orderkey", "o_totalprice", "o_custkey")
    return o.select(F.col("o_orderkey").alias("id"), work_priority(F.lit(50), F.col("o_totalprice") / 100, F.col("o_custkey") % 300).cast("long").alias("priority"))


@query("SELECT doc_id, sha256(list_aggregate(list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: regexp_replace(lower(trim(x)), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')))), 'string_agg', chr(10))) AS fingerprint FROM documents")
def intent_fingerprints(t: Tables) -> DataFrame:
    return t("documents", "doc_id", "text").select("doc_id", intent_fingerprint(F.split("text", " ")).alias("fingerprint"))


@query(f"WITH {a.MODULES} SELECT node, split_part(path, '/', 3) AS base, 'm' || CAST(node AS VARCHAR) AS stem, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS parent, regexp_matches(path, '^brand_1') AS in_scope, trim(regexp_replace(lower(language), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'python' AS detected FROM m")
def path_parts(t: Tables) -> DataFrame:
    return a.modules(t).select("node", basename("path").alias("base"), stem("path").alias("stem"), parent("path").alias("parent"), glob_any("path", ["brand_1*/**"]).alias("in_scope"), slug("language").alias("slug"), extract.language("path").alias("detected"))


@query(f"WITH {a.MODULES}, g AS (SELECT split_part(path, '/', 1) AS folder, count(*) AS files FROM m GROUP BY 1 ORDER BY files DESC, folder LIMIT 16) SELECT folder, files FROM g")
def default_groups(t: Tables) -> DataFrame:
    return extract.top_folders(a.modules(t)).select("folder", "files")


@query("SELECT url, coalesce(nullif(regexp_extract(url, '\\.([a-z]+)/', 1), ''), 'none') AS zone FROM pages")
def effective_zone(t: Tables) -> DataFrame:
    return t("pages", "url").select("url", effective(F.regexp_extract("url", r"\.([a-z]+)/", 1), default="none").alias("zone"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(t: Tables) -> DataFrame:
    return streams.tumbling(t("events", "ts", "event_type", "value")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1")
def sliding_windows(t: Tables) -> DataFrame:
    return streams.sliding(t("events", "ts")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    return streams.sessions(t("events", "ts", "user_id")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(t: Tables) -> DataFrame:
    """The tumbling windows of a stream over the same file, run to its end."""
    out = streams.run_once(streams.tumbling(streams.event_stream(t.spark, t.folder)), "result", shared_path(t.spark, "windows"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH RECURSIVE l AS (SELECT user_id * 10 + (day(ts) - 1) // 5 AS job, event_id AS id, epoch_us(ts) // 1000 AS m, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'complete' ELSE 'heartbeat' END AS kind FROM events),
w AS (SELECT max(m) - 3600000 AS clock FROM l), n AS (SELECT job, m, kind, row_number() OVER (PARTITION BY job ORDER BY m, id) AS n FROM l, w WHERE m < clock UNION ALL SELECT job, min(clock), 'end', count(*) FILTER (WHERE m < clock) + 1 FROM l, w GROUP BY job),
s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, '' AS status, 0 AS attempt, CAST(0 AS BIGINT) AS lease, CAST(NULL AS BIGINT) AS lost_at, CAST(NULL AS INTEGER) AS lost_attempt, '' AS lost, false AS changed FROM l
  UNION ALL SELECT job, n, m, CASE WHEN began THEN 'running' WHEN kind = 'complete' AND held = 'running' THEN 'completed' ELSE held END, attempt + CASE WHEN began THEN 1 ELSE 0 END,
    CASE WHEN began OR (kind = 'heartbeat' AND held = 'running') THEN m + 28800000 ELSE lease END, CASE WHEN over THEN lease END, attempt, CASE WHEN over THEN held END, began OR (kind = 'complete' AND held = 'running')
  FROM (SELECT *, kind = 'claim' AND held IN ('', 'retry') AS began FROM (SELECT n.job, n.n, n.m, n.kind, s.attempt, s.lease, s.status = 'running' AND s.lease < n.m AS over,
    CASE WHEN s.status = 'running' AND s.lease < n.m THEN CASE WHEN s.attempt >= 3 THEN 'failed' ELSE 'retry' END ELSE s.status END AS held FROM s JOIN n ON n.job = s.job AND n.n = s.n + 1)))
SELECT job, lost_at AS "at", lost_attempt AS attempt, lost AS status FROM s WHERE lost_at IS NOT NULL UNION ALL SELECT job, m, attempt, status FROM s WHERE changed""")
def lease_changes(t: Tables) -> DataFrame:
    """Events as the log of five days' jobs of each user, streamed: leases of eight hours, three attempts."""
    kind = F.when(F.col("event_type").isin("signup", "view"), "claim").when(F.col("event_type") == "purchase", "complete").otherwise("heartbeat")
    job = F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 5)
    log = streams.event_stream(t.spark, t.folder).select(job.alias("job"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"))
    leases.use_state_store(t.spark)
    return streams.run_once(leases.lease_changes(log, 28_800_000, 3), "result", shared_path(t.spark, "leases"), "append")
