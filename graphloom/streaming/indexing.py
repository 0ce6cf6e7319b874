"""Embedding of chunks in batches, some of which may fail, with a manifest to go on from."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ranking import missing
from graphloom.session import stage

VECTORS = "chunk_id string, batch long, vector array<double>"
MANIFEST = "batch long, chunks long, failed long, error string"
#: Characters of an error that are kept.
ERROR = 200


def embed_batches(chunks: DataFrame, embed: Callable[[list[str]], list]) -> DataFrame:
    """Chunks (chunk_id, batch, document) with vector and error: the documents of a batch go to `embed` together, and where
    that fails all of them have its error and no vector.  Null documents are empty.  A batch is as large as it is made
    (`operators.chunks.batches`), so what a task holds has a bound."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[["chunk_id", "batch"]].copy()
        out["vector"], out["error"] = None, None
        try:
            found = [list(map(float, v)) for v in embed([d or "" for d in frame["document"]])]
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} vectors for {len(frame)} documents")
            out["vector"] = pd.Series(found, index=out.index, dtype=object)
        except Exception as e:  # noqa: BLE001  a batch fails by itself, whatever went wrong
            out["error"] = f"{type(e).__name__}: {e}"[:ERROR]
        return out

    rows = chunks.select("chunk_id", F.col("batch").cast("long").alias("batch"), "document")
    return rows.groupBy("batch").applyInPandas(one, VECTORS + ", error string")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema + ", part string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema + ", part string")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, batch, vector, part of all chunks that are indexed."""
    return _read(spark, f"{folder}/vectors", VECTORS)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """batch, chunks, failed, error, part: a row for each batch of each part."""
    return _read(spark, f"{folder}/manifest", MANIFEST)


def index(chunks: DataFrame, embed: Callable[[list[str]], list], folder: str, checkpoint: str, run: int):
    """Starts a stream that embeds chunks that `folder` has no vectors of; batches that fail are counted and skipped.

    Vectors and manifest are parts named after the run and the number of the micro-batch.  What a micro-batch has to
    do depends on other parts alone, so doing it twice leaves what it left.  The next run, which
    takes a higher number and reads all chunks again, does what failed and what is new."""

    def put(batch: DataFrame, number: int) -> None:
        spark, part = batch.sparkSession, f"{run:06d}-{number:09d}"
        done = vectors(spark, folder).where(F.col("part") != part).select("chunk_id")
        todo = missing(batch, done, "chunk_id").dropDuplicates(["chunk_id"])
        made = stage(embed_batches(todo, embed), "embedded")
        made.where("error is null").drop("error").write.mode("overwrite").parquet(f"{folder}/vectors/part={part}")
        told = made.groupBy("batch").agg(F.count("*").alias("chunks"), F.count("error").alias("failed"), F.max("error").alias("error"))
        told.write.mode("overwrite").parquet(f"{folder}/manifest/part={part}")

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
