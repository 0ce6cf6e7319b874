"""Every query against its SQL on the small tables, and operators that SQL does not reach."""

from datetime import datetime

import os

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import retrieval, vectors
from graphloom.plans import catalogue
from graphloom.session import table
from graphloom.streaming import jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    value = lambda x: "-" if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else int(x) if isinstance(x, (bool, int)) or hasattr(x, "dtype") and x.dtype.kind in "iub" else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_python_in_plain_queries(spark):
    for name in ("hybrid_merge", "uncovered_ranges", "find_dependencies", "vector_topk"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


hit = st.tuples(st.integers(0, 5), st.text("ab", max_size=3), st.floats(0, 1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(hit, max_size=8), st.lists(hit, max_size=8))
def test_merge_hits(spark, a, b):
    frame = lambda x: spark.createDataFrame(x, "k int, content string, score double")
    got = retrieval.merge_hits(frame(a), frame(b), ["k"]).collect()
    assert len({r.k for r in got}) == len(got) == len({x[0] for x in a + b})
    for r in got:
        v, g = [x[2] for x in a if x[0] == r.k], [x[2] for x in b if x[0] == r.k]
        want = min(1.0, max(v) * 0.55 + max(g) * 0.45 + 0.15) if v and g else max(v) * 0.55 if v else max(g) * 0.45
        assert abs(r.score - want) < 1e-9


def test_embedder(spark):
    rows = vectors.hashing_embedder(spark.createDataFrame([("a b a",), ("",), (None,), ("a b a",)], "t string"), "t", "v", 16).collect()
    assert rows[0].v == rows[3].v and abs(sum(x * x for x in rows[0].v) - 1) < 1e-9 and set(rows[1].v) == {0.0}


def test_job_stream(spark, tmp_path):
    schema = "job_id string, ord long, stage string, progress int, message string, at timestamp"
    day = lambda n: datetime(2024, 1, n)
    one = [("j", 1, "cloning", None, "a", day(1)), ("j", 2, None, 30, None, day(1)), ("j", 3, "completed", None, None, day(1)), ("j", 4, "failed", None, None, day(1)), ("k", 1, "parsing", 500, None, day(1)), ("m", 1, "cloning", None, None, day(1))]
    two = [("m", 2, None, None, "same stage", day(2)), ("z", 1, "cloning", None, None, day(9))]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.job_states(jobs.read(spark, str(tmp_path / "in"), schema), "at", "1 day")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        kept = q.lastProgress.stateOperators[0].numRowsTotal
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        if i == 0:
            by = {r.job_id: r for r in got}
            assert len(got) == 3 and kept == 2  # the finished job's state is gone
            assert (by["j"].stage, by["j"].progress, by["j"].message, by["j"].updates) == ("completed", 100, "a", 3) and by["k"].progress == 100
    # k and m were silent for a day: a last row each, and only z is kept
    assert kept == 1 and sorted((r.job_id, r.changed) for r in got if not r.changed) == [("k", False), ("m", False)]
    assert {r.job_id: r.message for r in got if not r.changed}["m"] == "same stage"


def test_windows_close(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    rows = [(datetime(2024, 1, 1, h % 24, 5 * h % 60), "ab"[h % 2], float(h)) for h in range(48)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    events = jobs.ended(jobs.read(spark, str(tmp_path / "in"), schema), "ts", datetime(2024, 2, 1))
    got = jobs.finished(jobs.tumbling(events, "ts", ["k"], "v", "1 hour", "1 hour")).collect()
    assert sum(r.n for r in got) == 48 and sum(r.total for r in got) == sum(v for *_, v in rows)


def test_queue(spark, tmp_path):
    spark.createDataFrame([("x", "1"), ("y", "2")], "type string, payload string").write.parquet(str(tmp_path / "q"))
    seen = []
    jobs.dispatch(jobs.read(spark, str(tmp_path / "q"), "type string, payload string"), {"x": lambda df: seen.extend(r.payload for r in df.collect())}, str(tmp_path / "c")).awaitTermination()
    assert seen == ["1"]


def test_history(spark):
    c = table(spark, SF, "conversations")
    assert retrieval.history(c, "conv_id", "turn", 2).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 2").count() == 0
