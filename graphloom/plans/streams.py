"""Job states, windows and sessions over the events table; streams run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import ranking
from graphloom.plans.registry import Registry
from graphloom.session import table
from graphloom.streaming import jobs

registry = query = Registry()


def event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    # a pattern: a streamed path is a folder or a pattern, and the table may be one file
    rows = jobs.read(spark, path + "*", spark.read.parquet(path).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def closed_stream(spark, sf_dir):
    """The events, and one a week behind the last, that closes all windows."""
    (last,) = table(spark, sf_dir, "events").agg(F.max("ts") + F.expr("INTERVAL 7 DAYS")).first()
    return jobs.ended(event_stream(spark, sf_dir), "ts", last)


@query("latest_artifact", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_artifact(spark, sf_dir):
    return ranking.top_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(
    "latest_job",
    """
    WITH l AS (SELECT user_id, event_id % 2 AS side, ts, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE event_type END AS stage FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) = 1),
    m AS (SELECT * FROM l WHERE side = 1), s AS (SELECT * FROM l WHERE side = 0)
    SELECT coalesce(m.user_id, s.user_id) AS job_id, CASE WHEN m.user_id IS NULL OR s.ts >= m.ts OR (m.stage <> 'completed' AND s.stage <> m.stage) THEN s.stage ELSE m.stage END AS stage FROM m FULL JOIN s ON m.user_id = s.user_id
    """,
)
def latest_job(spark, sf_dir):
    """Of each user the last even event is stored, the last odd one in memory; every third event finishes."""
    last = ranking.top_per_key(table(spark, sf_dir, "events").withColumn("side", F.col("event_id") % 2), ["user_id", "side"], [F.desc("ts"), F.desc("event_id")])
    stage = F.when(F.col("event_id") % 3 == 0, "completed").otherwise(F.col("event_type"))
    rows = last.select(F.col("user_id").alias("job_id"), F.col("ts").alias("updated_at"), stage.alias("stage"), "side")
    return jobs.latest_job(rows.where("side = 1").drop("side"), rows.where("side = 0").drop("side")).select("job_id", "stage")


STAGE = "CASE event_type WHEN 'view' THEN 'cloning' WHEN 'click' THEN 'parsing' ELSE 'embedding' END"


@query(
    "job_state_fold",
    f"SELECT user_id AS job_id, arg_max({STAGE}, event_id) AS stage, arg_max(event_id, event_id) FILTER (WHERE event_id % 3 = 0) AS message, CASE arg_max({STAGE}, event_id) WHEN 'cloning' THEN 20 WHEN 'parsing' THEN 50 ELSE 90 END AS progress FROM events GROUP BY user_id",
)
def job_state_fold(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "cloning").when(F.col("event_type") == "click", "parsing").otherwise("embedding")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", stage.alias("stage"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("message"))
    state = ranking.last_known(rows, "job_id", "event_id", ["stage", "message"])
    return state.withColumn("progress", jobs.stage_progress(F.col("stage"), F.lit(None).cast("int")))


@query("progress_changes", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def progress_changes(spark, sf_dir):
    return ranking.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("stream_job_states", "SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(count(*) AS INTEGER) AS updates, arg_max(event_type, event_id) AS stage FROM events GROUP BY user_id")
def stream_job_states(spark, sf_dir):
    """The fold as a stream with state; event types are the stages."""
    updates = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.lit(None).cast("int").alias("progress"), F.lit(None).cast("string").alias("message"), F.col("ts").alias("at"))
    rows = jobs.finished(jobs.job_states(updates))
    return ranking.top_per_key(rows, ["job_id"], [F.desc("updates")]).select("job_id", "updates", "stage")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    rows = jobs.finished(jobs.tumbling(closed_stream(spark, sf_dir), "ts", ["event_type"], "value", "1 hour", "1 hour"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "stream_session",
    """
    WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def stream_session(spark, sf_dir):
    rows = jobs.finished(jobs.sessions(closed_stream(spark, sf_dir), "ts", "user_id", "30 minutes", "1 hour"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return jobs.finished(jobs.first_of(event_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "40 days")).select("user_id", "event_type")
