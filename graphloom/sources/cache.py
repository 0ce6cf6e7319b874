"""Tables with a time to live, parse artefacts and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ranking import top_per_key

FUNCTION = "struct<name:string,parameters:array<struct<name:string,type:string>>,return_type:string,start_line:int,end_line:int,docstring:string,is_method:boolean,class_name:string,body_score:int>"
PARSED = (
    f"file string, language string, functions array<{FUNCTION}>, "
    f"classes array<struct<name:string,methods:array<{FUNCTION}>,bases:array<string>,implements:array<string>,attributes:array<string>,start_line:int,end_line:int,docstring:string>>, "
    "imports array<struct<module:string,names:array<string>,is_external:boolean,start_line:int>>, "
    "api_endpoints array<struct<route:string,method:string,handler:string,start_line:int>>, "
    "calls array<struct<caller:string,callee:string,receiver:string,start_line:int,is_method_call:boolean>>, "
    "metadata struct<complexity:string,lines:int,symbol_count:int>, parse_error string"
)


def still_valid(stored: Column, seconds: int, now: Column | None = None) -> Column:
    now = F.current_timestamp() if now is None else now
    return stored + F.expr(f"INTERVAL '{int(seconds)}' SECOND") > now


def cached(spark: SparkSession, path: str, make, seconds: int) -> DataFrame:
    """A table kept at `path` for some seconds, made again when it is older or missing.

    Rows of each making stay under their own name; the newest complete one is read."""
    from pyspark.errors import AnalysisException

    try:
        kept = spark.read.option("mergeSchema", False).parquet(f"{path}/*")
        if not kept.where(still_valid(F.col("_stored"), seconds)).isEmpty():
            return kept.where(F.col("_stored") == kept.agg(F.max("_stored")).first()[0]).drop("_stored")
    except AnalysisException:
        pass
    import uuid

    rows = make().withColumn("_stored", F.current_timestamp())
    where = f"{path}/{uuid.uuid4().hex}"
    rows.write.parquet(where)
    return spark.read.parquet(where).drop("_stored")


def write_artifact(parsed: DataFrame, path: str, job_id: str, owner: str = "", name: str = "") -> None:
    """Parsed files of a job as JSON lines."""
    repo = F.concat_ws("/", F.lit(owner), F.lit(name))
    parsed.withColumns({"job_id": F.lit(job_id), "repo_id": repo}).write.mode("overwrite").json(f"{path}/{job_id}")


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Parsed files of all jobs below a path, with job_id, repo_id and the time of their file."""
    rows = spark.read.schema(PARSED + ", job_id string, repo_id string").option("recursiveFileLookup", True).json(path)
    return rows.withColumn("modified", F.col("_metadata.file_modification_time"))


def resolve(artifacts: DataFrame, wanted: str) -> DataFrame:
    """Of the jobs with this id, or else this repository, the files of the newest."""
    hits = artifacts.where((F.col("job_id") == wanted) | (F.col("repo_id") == wanted))
    jobs = hits.groupBy("job_id").agg(F.max("modified").alias("at")).withColumn("_all", F.lit(1)).withColumn("_p", F.when(F.col("job_id") == wanted, 0).otherwise(1))
    newest = top_per_key(jobs, ["_all"], [F.col("_p"), F.desc("at"), F.col("job_id")])
    return hits.join(newest.select("job_id"), "job_id", "left_semi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """repo_id, path, sha256 of the last indexing; empty where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "repo_id string, path string, sha256 string")


def write_manifest(files: DataFrame, path: str) -> None:
    """Replaces the manifest of the repositories in `files` (repo_id, path, sha256) and of no other."""
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)
