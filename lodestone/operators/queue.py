"""A leased work queue as keyed state: claims, budgets, leases, retries and stages.

A claim is a ranking over the queue; whoever writes the next version of the table makes it
atomic (one writer, see ``sources.versioned``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import backoff_seconds
from lodestone.storage import checkpointed


def spent(jobs: DataFrame, today: str, *by: str) -> DataFrame:
    """One row, or one for each value of ``by``: estimates of running jobs and actual (else estimated) cost of those completed today."""
    cost = F.when(F.col("status") == "running", F.coalesce("estimated_cost", F.lit(0.0))).otherwise(F.coalesce("actual_cost", "estimated_cost", F.lit(0.0)))
    counts = (F.col("status") == "running") | ((F.col("status") == "completed") & (F.to_date("completed_at") == F.lit(today).cast("date")))
    return jobs.groupBy(*by).agg(F.coalesce(F.sum(F.when(counts, cost)), F.lit(0.0)).alias("spent"))


def claimable(now: Column) -> Column:
    return F.col("status").isin("pending", "retry") & (F.col("available_at").isNull() | (F.col("available_at") <= now))


def claim(jobs: DataFrame, n: int, now: str) -> DataFrame:
    """The next ``n`` jobs by priority, then id."""
    at = F.lit(now).cast(jobs.schema["available_at"].dataType)
    return jobs.where(claimable(at)).orderBy(F.col("priority").desc(), "id").limit(n)


def claim_within(jobs: DataFrame, workers: int, budget: float | None, now: str, today: str, lease_seconds: int = 90) -> DataFrame:
    """The queue after one claim: refused at the cap on running jobs and where the job would pass the budget."""
    kind = jobs.schema["available_at"].dataType
    at = F.lit(now).cast(kind)
    running = jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") >= at)).count()
    first = claim(jobs, 1, now).first()
    over = budget is not None and first is not None and spent(jobs, today).first()["spent"] + (first["estimated_cost"] or 0.0) > budget
    if first is None or running >= workers or over:
        return jobs
    own = F.col("id") == first["id"]
    lease = at + F.expr(f"INTERVAL {max(90, int(lease_seconds))} SECONDS")
    return (
        jobs.withColumn("attempts", F.col("attempts") + own.cast("int")).withColumn("lease_expires_at", F.when(own, lease).otherwise(F.col("lease_expires_at")))
        .withColumn("status", F.when(own, "running").otherwise(F.col("status")))
    )


def expire_leases(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs whose lease ran out are tried again, or fail after the last attempt."""
    at = F.lit(now).cast(jobs.schema["lease_expires_at"].dataType)
    lost = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < at))
    status = F.when(lost & (F.col("attempts") >= F.col("max_attempts")), "failed").when(lost, "retry").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "lease_expires_at": F.when(lost, None).otherwise(F.col("lease_expires_at"))})  # both from the old row


def fail(jobs: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """Failed jobs wait ``min(300, 2^attempts)`` seconds, or fail for good."""
    hit = jobs.join(failed.select("id").distinct().withColumn("_failed", F.lit(True)), "id", "left")
    own, last = F.coalesce("_failed", F.lit(False)), F.col("attempts") >= F.col("max_attempts")
    wait = F.make_dt_interval(secs=backoff_seconds(F.col("attempts").cast("double")))
    at = F.lit(now).cast(jobs.schema["available_at"].dataType)
    return hit.withColumn("available_at", F.when(own & ~last, at + wait).otherwise(F.col("available_at"))).withColumn("status", F.when(own & last, "failed").when(own, "retry").otherwise(F.col("status"))).drop("_failed")


def supersede(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """Waiting jobs whose input hash isn't the current one of their scope are superseded."""
    now = current.select("scope", F.col("input_hash").alias("_now"))
    stale = F.col("status").isin("pending", "retry") & F.col("_now").isNotNull() & (F.col("input_hash") != F.col("_now"))
    return jobs.join(now, "scope", "left").withColumn("status", F.when(stale, "superseded").otherwise(F.col("status"))).drop("_now")


def open_stage(jobs: DataFrame, order: tuple[str, ...] = ("intrinsic", "context", "group", "repository")) -> DataFrame:
    """``kind, active, open``: a stage is open when no earlier one has waiting or running jobs."""
    active = jobs.groupBy("kind").agg(F.count_if(F.col("status").isin("pending", "retry", "running")).alias("active")).withColumn("place", F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")))
    before = active.agg(F.min(F.when(F.col("active") > 0, F.col("place"))).alias("_first"))
    return active.join(F.broadcast(before)).select("kind", "active", (F.col("_first").isNull() | (F.col("place") <= F.col("_first"))).alias("open"))


def readiness(modules: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row from module states and scope states: what is eligible, current, pending and failed, and whether all is ready."""
    n = lambda c, name: F.count_if(c).alias(name)
    pending = F.col("state").startswith("pending_") | (F.col("state") == "intrinsic_current")
    m = modules.agg(F.count("*").alias("total"), n(F.col("state") == "excluded", "excluded"), n(F.col("state") == "current", "current"), n(pending, "pending"), n(F.col("state") == "failed", "failed"))
    s = scopes.agg(n(F.col("state").startswith("pending"), "pending_scopes"), F.coalesce(F.bool_or((F.col("scope") == "repository") & (F.col("state") == "current")), F.lit(False)).alias("repository_current"))
    eligible = F.col("total") - F.col("excluded")
    return m.join(F.broadcast(s)).select(
        "*", eligible.alias("eligible"), ((F.col("total") > 0) & (F.col("pending") == 0) & (F.col("pending_scopes") == 0)).alias("baseline_complete"),
        ((eligible > 0) & (F.col("current") == eligible) & (F.col("failed") == 0) & F.col("repository_current")).alias("ready"),
    )


def reduce_tree(items: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Levels of a reduction by ``width``: ``level, part, n, total`` for each key, up to one part.

    Levels are computed from one another, each once; their number is the logarithm of the longest key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    level = items.select(key, ((F.row_number().over(w) - 1) / width).cast("long").alias("part"), F.col(value).cast("double").alias("total"))
    level = checkpointed(level.groupBy(key, "part").agg(F.count("*").alias("n"), F.sum("total").alias("total")))
    out, at = level.withColumn("level", F.lit(0)), 0
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        at += 1
        level = checkpointed(level.groupBy(key, F.floor(F.col("part") / width).alias("part")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        out = out.unionByName(level.withColumn("level", F.lit(at)))
    return out
