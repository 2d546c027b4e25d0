"""The work queue as relations (T01-T05, F34, O08, S12, R01, R06): requests, transitions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.operators.views import ATTEMPTS, request_view

PAGES = 3


def download_requests(users: DataFrame, name: str, priority: int = 0, pages: int = PAGES, at: Column | None = None) -> DataFrame:
    """A request for every page of every user, made ``at`` that time (now); the key is a hash of its content."""
    made = users.select(F.col(name).alias("username")).where("username is not null").distinct().withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(pages).cast("bigint"))))
    return made.select(F.sha2(F.concat_ws("/", "username", F.col("page").cast("string")), 256).alias("request_id"), "username", "page", F.lit(priority).cast("bigint").alias("priority"), F.lit("download_request").alias("doc_type"), (F.current_timestamp() if at is None else at).alias("request_time"), *[F.lit(None).cast(kind).alias(c) for c, kind in (("started_time", "timestamp"), ("completed_time", "timestamp"), ("attempts", "bigint"))])


def dequeue(requests: DataFrame, n: int = 350, view: str = "queued_downloads") -> DataFrame:
    """The first ``n`` queued requests by priority, time and key."""
    return request_view(requests, view).orderBy("priority", "request_time", "request_id").limit(n)


def backoff(attempts: Column | str, start: float = 0.5, most: float = 600.0) -> Column:
    """seconds to wait after a number of failures: doubled each time up to ``most``."""
    n = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.least(F.lit(most), F.lit(start) * F.pow(F.lit(2.0), n.cast("double")))


#: What an event does to a request.
EVENTS = ("requested", "started", "completed", "failed")


def request_state(events: DataFrame) -> DataFrame:
    """The state of every request after its events (request_id, event, ts), the last of equal times by name.

    A failure clears the start and adds an attempt; a request with ATTEMPTS failures is dead, a completed one stays so.
    Rows with another event or a null key or time change nothing.
    """
    known = events.where(F.col("event").isin(*EVENTS) & F.col("request_id").isNotNull() & F.col("ts").isNotNull())
    at = F.struct("ts", "event")
    per = known.groupBy("request_id").agg(
        F.sum(F.when(F.col("event") == "failed", 1).otherwise(0)).alias("attempts"),
        F.min(F.when(F.col("event") == "completed", F.col("ts"))).alias("completed_time"),
        F.max(F.when(F.col("event").isin("started", "failed"), at)).alias("last"),
    )
    started = F.when(F.col("last.event") == "started", F.col("last.ts"))
    state = F.when(F.col("completed_time").isNotNull(), "completed").when(F.col("attempts") >= ATTEMPTS, "dead").when(started.isNotNull(), "underway").otherwise("queued")
    return per.select("request_id", F.col("attempts").cast("bigint").alias("attempts"), started.alias("started_time"), "completed_time", state.alias("state"))


def upserted(stored: DataFrame, arrived: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key, the latest by time; of equal times the arrived one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(arrived.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def updated(rows: DataFrame, values: DataFrame, key: str, col: str) -> DataFrame:
    """A column replaced where ``values`` has a value for the key."""
    fresh = values.select(key, F.col(col).alias("_v"))
    return rows.join(fresh, key, "left").withColumn(col, F.coalesce("_v", col)).drop("_v")
