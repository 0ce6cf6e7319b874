"""Batches that fail and job snapshots: done twice, cut anywhere, the result is the same."""

from datetime import datetime

from graphloom.streaming import indexing, jobs

CHUNKS = "chunk_id string, batch long, document string"
UPDATES = "job_id string, ord long, stage string, progress int, message string, at timestamp"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    put = lambda rows: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 1, "x"), ("b", 1, None), ("c", 2, "bad"), ("d", 2, "y"), ("e", None, "z"), ("a", 1, "x")])
    strict = lambda texts: [[float(len(t))] for t in texts] if "bad" not in texts else 1 / 0
    short = lambda texts: [[0.0]] * (len(texts) - 1)
    run = lambda n, embed, name: indexing.index(jobs.read(spark, str(tmp_path / "in"), CHUNKS), embed, folder, str(tmp_path / name), n).awaitTermination()
    run(1, strict, "c1")
    told = [(1, 2, 0, None), (2, 2, 2, "ZeroDivisionError: division by zero"), (None, 1, 0, None)]
    state = rows_of(indexing.vectors(spark, folder).select("chunk_id", "batch", "vector"))
    assert rows_of(indexing.manifest(spark, folder).drop("part")) == sorted(told, key=str) and state == [("a", 1, [1.0]), ("b", 1, [0.0]), ("e", None, [1.0])]
    # the same micro-batch again, as after a lost driver
    run(1, strict, "c1-again")
    assert rows_of(indexing.vectors(spark, folder).select("chunk_id", "batch", "vector")) == state and indexing.manifest(spark, folder).count() == 3
    run(2, short, "c2")
    assert rows_of(indexing.manifest(spark, folder).where("part > '000002'").drop("part")) == [(2, 2, 2, "ValueError: 1 vectors for 2 documents")]
    put([("f", 3, "new")])
    run(3, lambda texts: [[9.0]] * len(texts), "c3")
    assert rows_of(indexing.vectors(spark, folder).where("part > '000003'").select("chunk_id", "vector")) == [("c", [9.0]), ("d", [9.0]), ("f", [9.0])]
    assert indexing.vectors(spark, folder).count() == 6


def test_snapshots(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n)
    rows = [
        ("j", 1, "cloning", None, "a", day(1)), ("j", 2, None, 30, None, day(2)), ("k", 1, "parsing", 500, None, day(1)), ("m", 1, None, None, None, day(1)),
        ("j", 3, "completed", None, None, day(3)), ("j", 4, "failed", 7, "late", day(4)), ("k", 2, "unheard of", None, "b", day(2)), ("z", 1, "cloning", -5, None, day(9)), ("j", 5, "cloning", 1, "x", day(5)),
    ]
    none = spark.createDataFrame([], jobs.SNAPSHOT)
    df = spark.createDataFrame(rows, UPDATES)
    want = rows_of(jobs.fold_jobs(df, none))
    assert want == [("j", "completed", 100, "a", 3, day(3)), ("k", "unheard of", 100, "b", 2, day(2)), ("m", None, 0, None, 1, day(1)), ("z", "cloning", 0, None, 1, day(9))]
    assert jobs.load_snapshots(spark, str(tmp_path / "none")).count() == 0
    for cut in (2, 4):
        path = str(tmp_path / f"s{cut}")
        for run, part in ((1, rows[:cut]), (2, rows[cut:])):
            spark.createDataFrame(part, UPDATES).coalesce(1).write.parquet(f"{path}-in{run}")
            for again in range(2):  # a repeated micro-batch changes nothing
                jobs.save_snapshots(jobs.read(spark, f"{path}-in{run}", UPDATES), path, f"{path}-c{run}{again}", run).awaitTermination()
        assert rows_of(jobs.load_snapshots(spark, path)) == want


def test_reconcile(spark):
    day = lambda n: datetime(2024, 1, n)
    shape = "job_id string, updated_at timestamp, stage string"
    memory = [("tie", day(2), "completed"), ("newer", day(3), "completed"), ("behind", day(3), "parsing"), ("same", day(3), "parsing"), ("only", day(1), "queued"), ("no stage", day(3), None)]
    stored = [("tie", day(2), "failed"), ("newer", day(2), "parsing"), ("behind", day(2), "cloning"), ("same", day(1), "parsing"), ("kept", day(1), "failed"), ("no stage", day(2), "failed")]
    got = {r.job_id: (r.updated_at.day, r.stage) for r in jobs.latest_job(spark.createDataFrame(memory, shape), spark.createDataFrame(stored, shape)).collect()}
    assert got == {"tie": (2, "failed"), "newer": (3, "completed"), "behind": (2, "cloning"), "same": (3, "parsing"), "only": (1, "queued"), "kept": (1, "failed"), "no stage": (3, None)}
