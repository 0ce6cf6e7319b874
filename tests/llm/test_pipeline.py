"""The pipeline against its stages applied by hand."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import near_duplicates
from graphloom.session import stage, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    rows = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(function(spark, rows, SF), "test")
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
        a, b = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in rows.select("doc_id").collect()}
        assert b <= a
        if name == "quality classifier":
            assert len((a - b) & bad) >= 0.95 * len(a & bad) and len(a - b - bad) < 0.1 * len(a)
        if name == "n-gram Jaccard join":
            groups = defaultdict(set)
            for r in near_duplicates.near_duplicates(before).collect():
                groups[r.component_id].add(r.doc_id)
            assert b == {min(g) for g in groups.values()}
        if name == "PII":
            assert a == b and rows.where(F.col("text").rlike(r"@[a-z0-9]+\.example\.com")).count() == 0
            assert rows.where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.where("n <> m").count() == 0 and whole.count() == rows.count()
    assert toxic


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns, and no rows."""
    from .conftest import ODD

    where = str(tmp_path)
    spark.createDataFrame([(2, 1, 0), (4, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rows = [(i, t, None, "s" if i else None, None, "x", 1.0) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, score double")
    for name, function in corpus_pipeline.STAGES:
        made = function(spark, docs, where)
        if name != "packing":
            assert made.columns == docs.columns
        if name == "n-gram Jaccard join":
            assert sorted((r.doc_id or -1) for r in made.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
        else:
            assert made.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert function(spark, docs.limit(0), where).count() == 0
