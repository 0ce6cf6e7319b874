"""Jobs, windows and queues over streams of events.

Every function takes a streaming or a batch DataFrame unless it says otherwise.  Event
times are `timestamp` (a watermark takes no other); `finished` runs a stream over all that
is there now and gives its rows, with its checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.session import shared_dir

# Stages of a job with the progress that they stand for.
STAGES = {"queued": 0, "validating": 5, "cloning": 20, "parsing": 50, "graphing": 65, "indexing": 75, "embedding": 90, "completed": 100, "failed": 0}
LAST_STAGES = ("completed", "failed")


def stage_progress(stage: Column, given: Column) -> Column:
    """Progress of an update: what is given, or else the stage's, from 0 to 100."""
    own = F.coalesce(*(F.when(stage == s, F.lit(p)) for s, p in STAGES.items()))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(given, own)))


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files; new files are new rows."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def finished(stream: DataFrame) -> DataFrame:
    """The rows of a stream over all input that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def ended(events: DataFrame, time: str, at) -> DataFrame:
    """The stream with one more event, `at` a time behind all others and empty elsewhere: it moves the watermark on, so that what is open before it closes."""
    spark = events.sparkSession
    last = spark.range(1).select(*(F.lit(at if f.name == time else None).cast(f.dataType).alias(f.name) for f in events.schema.fields))
    folder = f"{shared_dir(spark)}/closing-{uuid.uuid4().hex}"
    last.write.parquet(folder)
    return events.unionByName(read(spark, folder, last.schema))


def tumbling(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """start, keys, n, total of each window."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of each session."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


JOB = "job_id string, stage string, progress int, message string, updates int, changed boolean"


def job_states(updates: DataFrame, time: str = "at", kept: str = "1 day") -> DataFrame:
    """The state of each job behind each micro-batch of updates (job_id, ord, stage, progress, message and `time`).

    Updates of a job are folded in order; what an update leaves out stays; a row is given when
    stage or progress changed, and when the state goes: of a finished job at once, of another one
    `kept` after its last update (an event time).  What comes for a finished job in the same
    micro-batch is left out."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, progress, message, n, _ = state.get if state.exists else (None, 0, None, 0, 0)
        gone = state.hasTimedOut
        before, last = (stage, progress), 0
        for row in [] if gone else pd.concat(list(frames)).sort_values("ord").itertuples():
            if stage in LAST_STAGES:
                break
            stage = row.stage if isinstance(row.stage, str) else stage
            given = row.progress
            progress = STAGES.get(stage, progress) if given is None or given != given else int(given)
            progress = max(0, min(100, progress))
            message = row.message if isinstance(row.message, str) else message
            last = max(last, int(row.until))
            n += 1
        changed = (stage, progress) != before
        if gone or stage in LAST_STAGES:
            state.remove()
        else:
            last = max(last, _)
            state.update((stage, progress, message, n, last))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        if changed or gone:
            yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "progress": [progress], "message": [message], "updates": [n], "changed": [changed]})

    until = F.unix_millis(F.col(time) + F.expr(f"INTERVAL {kept}")).alias("until")
    rows = updates.withWatermark(time, "0 seconds").select("job_id", "ord", "stage", "progress", "message", until, time)
    return rows.groupBy("job_id").applyInPandasWithState(fold, JOB, "stage string, progress int, message string, n int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_job(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """For each job one of two snapshots (job_id, updated_at, stage, ...): the stored one where it is as new or newer, or
    where the one in memory has not finished and is at another stage; else the one in memory."""
    rest = [c for c in memory.columns if c != "job_id"]
    both = memory.select("job_id", F.struct(*rest).alias("m")).join(stored.select("job_id", F.struct(*rest).alias("s")), "job_id", "full_outer")
    newer = F.col("s.updated_at") >= F.col("m.updated_at")
    behind = ~F.col("m.stage").isin(*LAST_STAGES) & (F.col("s.stage") != F.col("m.stage"))
    taken = F.when(F.col("m").isNull() | F.coalesce(newer, F.lit(False)) | F.coalesce(behind, F.lit(False)), F.coalesce("s", "m")).otherwise(F.col("m"))
    return both.select("job_id", taken.alias("j")).select("job_id", "j.*")


SNAPSHOT = "job_id string, stage string, progress int, message string, updates long, updated_at timestamp"


def fold_jobs(updates: DataFrame, before: DataFrame) -> DataFrame:
    """The snapshots of the jobs in `updates` (job_id, ord, stage, progress, message, at) on top of those in `before`.

    What an update leaves out stays; progress is what was last given or what the last stage stands for.  Behind the
    update that finishes a job, in this or an earlier run, nothing counts.  Two runs over two parts of the updates
    give what one run over all gives, if no update of the second part is ordered before one of the first."""
    ends = updates.where(F.col("stage").isin(*LAST_STAGES)).groupBy("job_id").agg(F.min("ord").alias("end"))
    kept = updates.join(ends, "job_id", "left").where(F.col("end").isNull() | (F.col("ord") <= F.col("end")))
    own = F.coalesce("progress", *(F.when(F.col("stage") == s, F.lit(p)) for s, p in STAGES.items()))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("ord")))
    new = kept.groupBy("job_id").agg(last(F.col("stage")).alias("stage"), last(own).alias("progress"), last(F.col("message")).alias("message"), F.count("*").alias("updates"), F.max("at").alias("updated_at"))
    old = before.select("job_id", F.struct("stage", "progress", "message", "updates", "updated_at").alias("o"))
    met = new.join(old, "job_id", "left")
    done = F.coalesce(F.col("o.stage").isin(*LAST_STAGES), F.lit(False))
    pick = lambda c: F.when(done, F.col(f"o.{c}")).otherwise(F.coalesce(c, f"o.{c}"))
    return met.select(
        "job_id", pick("stage").alias("stage"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(pick("progress"), F.lit(0)))).cast("int").alias("progress"), pick("message").alias("message"),
        F.when(done, F.col("o.updates")).otherwise(F.col("updates") + F.coalesce("o.updates", F.lit(0))).alias("updates"), F.when(done, F.col("o.updated_at")).otherwise(F.greatest("updated_at", "o.updated_at")).alias("updated_at"),
    )


def _snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SNAPSHOT + ", part string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT + ", part string")


def load_snapshots(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """The last snapshot of each job; of those written before a part, if one is named."""
    rows = _snapshot_rows(spark, path)
    rows = rows if before is None else rows.where(F.col("part") < before)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("stage", "progress", "message", "updates", "updated_at"), "part").alias("s"))
    return last.select("job_id", "s.*")


def save_snapshots(updates: DataFrame, path: str, checkpoint: str, run: int):
    """Starts a stream that writes, for each micro-batch of updates, the snapshots of its jobs as a part of the table at `path`.

    A part is named after the run and the number of the micro-batch, and made from parts before it: doing
    it twice leaves it as it was.  A run that goes on from its checkpoint keeps its number, a new one takes a higher."""

    def put(batch: DataFrame, number: int) -> None:
        part = f"{run:06d}-{number:09d}"
        before = load_snapshots(batch.sparkSession, path, part).join(batch.select("job_id").distinct(), "job_id", "left_semi")
        fold_jobs(batch, before).write.mode("overwrite").parquet(f"{path}/part={part}")

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatch(queue: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a stream that gives each micro-batch's tasks (type, payload) to the handler of their type.

    Delivery is at least once: handlers write what a second writing does not change."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, handle in handlers.items():
                handle(batch.where(F.col("type") == kind))
        finally:
            batch.unpersist()

    return queue.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


