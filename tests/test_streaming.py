"""Streams give what their batch twins give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import recall, temporal
from corpusmill.operators.sessions import sessions
from corpusmill.streaming import jobs

T0 = dt.datetime(2024, 3, 1, 10)
SCHEMA = "sender string, ts timestamp, id long"


@pytest.fixture
def files(spark, tmp_path):
    rows = [("a", 0, 1), ("A ", 1800, 2), ("a", 3601, 3), ("b", 100, 4), ("b", 101, 5), ("b", 101, 5), ("a", 90_000, 6), ("z", 900_000, 7)]
    folder = str(tmp_path / "in")
    for i in range(0, len(rows), 3):
        spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), k) for s, t, k in rows[i : i + 3]], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_sessions(spark, files, tmp_path):
    got = drain(jobs.session_stream(spark.readStream.schema(SCHEMA).parquet(files), "sender", "ts", "id", "2 hours"), "append", tmp_path, "s1")
    got = {(r.sender, r.start_time.strftime("%F %T"), r.end_time.strftime("%F %T"), r.n_events) for r in got.collect()}
    want = {tuple(r) for r in sessions(spark.read.parquet(files), "sender", "ts", "id").where("sender <> 'z'").select("sender", "start_time", "end_time", "n_events").collect()}
    assert got == want and ("a", "2024-03-01 10:00:00", "2024-03-01 10:30:00", 2) in got


def test_requery(spark, files, tmp_path):
    spark.read.parquet(files).coalesce(1).write.mode("overwrite").parquet(files + "1")
    got = drain(jobs.requery_stream(spark.readStream.schema(SCHEMA).parquet(files + "1"), ["sender"], "id", "ts"), "append", tmp_path, "s2")
    batch = temporal.next_within(spark.read.parquet(files).dropDuplicates(["id"]).withColumn("t", F.unix_micros("ts")), "id", ["sender"], "t", 3_600_000_000)
    assert {(r.a, r.b) for r in got.collect()} == {(r.a, r.b) for r in batch.collect()} == {(4, 5)}


def test_recall(spark, tmp_path):
    folder = str(tmp_path / "r")
    for day, g in ((0.0, 3), (2.0, 3), (9.0, 1)):
        spark.createDataFrame([("k", day, g)], "i string, d double, g int").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("i string, d double, g int").option("maxFilesPerTrigger", 10).parquet(folder)
    got = drain(jobs.recall_stream(stream, "i", "d", "g"), "update", tmp_path, "s3").orderBy(F.desc("reps")).first()
    want = recall.recall_states(spark.read.parquet(folder), "i", "d", "g").first()
    assert (got.stability, got.difficulty, got.reps, got.lapses) == (want.stability, want.difficulty, 3, 1)


def test_upserts(spark, tmp_path):
    run = jobs.upsert_batches(str(tmp_path / "u"), "id", "t")
    run(spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), 0)
    two = spark.createDataFrame([(2, "c"), (3, None)], "id long, t string")
    run(two, 1)
    run(two, 1)
    assert sorted((r.id, r.t) for r in jobs.read_upserted(spark, str(tmp_path / "u"), 1).collect()) == [(1, "a"), (2, "c"), (3, None)]
