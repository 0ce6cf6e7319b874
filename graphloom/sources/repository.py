"""Source trees and archives as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T

MOST_UNPACKED = 500 * 1024 * 1024
MOST_PACKED = 200 * 1024 * 1024


def owner_and_name(url: Column, form: str = T.REPOSITORY_URL) -> list[Column]:
    """owner and name of a repository url, empty where the url has another form."""
    return [F.regexp_extract(url, form, 1).alias("owner"), F.regexp_extract(url, form, 2).alias("name")]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), language, size_bytes, content of the code files of a tree, without ignored directories."""
    top = root if "://" in root else f"file:{root}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    short = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    base = "/" + top.split(":", 1)[1].strip("/") + "/"
    rows = raw.select(F.substring(short, len(base) + 1, 1 << 30).alias("path"), F.col("length").alias("size_bytes"), "content")
    rows = rows.where(T.is_code(F.col("path")) & ~T.in_ignored_dir(F.col("path")))
    return rows.select("path", T.language(F.col("path")).alias("language"), "size_bytes", F.decode("content", "UTF-8").alias("content"))


def scan_result(files: DataFrame) -> DataFrame:
    """files, size_bytes, languages (map to files) of a scan, as one row."""
    by = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return by.agg(F.sum("n").alias("files"), F.sum("b").alias("size_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))


def unpack(spark: SparkSession, path: str, most: int = MOST_UNPACKED) -> DataFrame:
    """archive, path, size_bytes, content, error: files of zip archives, a single top directory taken away.

    A task takes one archive; one of more than MOST_PACKED bytes, or that unpacks to more than
    `most`, gives a row with an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)

    def give(frames):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir() and ".." not in i.filename.split("/")]
                        if sum(i.file_size for i in infos) > most:
                            rows.append((name, None, 0, None, "too large"))
                            continue
                        tops = {i.filename.split("/", 1)[0] for i in infos if "/" in i.filename}
                        flat = len(tops) == 1 and all("/" in i.filename for i in infos)
                        for i in infos:
                            rows.append((name, i.filename.split("/", 1)[1] if flat else i.filename, i.file_size, z.read(i).decode("utf-8", "replace"), None))
                except zipfile.BadZipFile:
                    rows.append((name, None, 0, None, "not an archive"))
            yield pd.DataFrame(rows, columns=["archive", "path", "size_bytes", "content", "error"])

    files = raw.where(F.col("length") <= MOST_PACKED).select("path", "content").mapInPandas(give, "archive string, path string, size_bytes long, content string, error string")
    none = F.lit(None).cast("string")
    large = raw.where(F.col("length") > MOST_PACKED).select(F.col("path").alias("archive"), none.alias("path"), F.col("length").alias("size_bytes"), none.alias("content"), F.lit("too large").alias("error"))
    return files.unionByName(large)
