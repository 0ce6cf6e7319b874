"""Session settings, table access and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects; `conf` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where only the driver's path has it."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in one process, as in tests, one of our own."""
    context = spark.sparkContext
    if not (where := context.getConf().get("spark.checkpoint.dir")):
        where = getattr(context, "_graphloom_dir", None)
        if where is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = context._graphloom_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return where.rstrip("/")


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """`df` as a table written to the shared folder and read again: a cut in the lineage that outlives executors.

    `freed`: what was shuffled for it goes as soon as it is written, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    if freed:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    return spark.read.schema(df.schema).parquet(path)
