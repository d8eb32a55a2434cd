"""Streams with state per key, fed file by file."""

import time

import pytest
from pyspark.sql import functions as F

from postlens.operators import embed
from postlens.operators.joins import pending_keys
from postlens.streaming import keyed

JOBS = "source string, job_id bigint, version int, text string"
EMBEDDED = "source string, job_id bigint, model_name string, embedding array<float>, created_at timestamp"
BIG = 2**60 + 1


def _files(spark, folder, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, df, tmp_path, name="out"):
    path = str(tmp_path / name)
    keyed.start_table(df, path, str(tmp_path / f"{name}-state")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_each_key_once_over_batches(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    first = [("a", BIG, 1, "old"), ("a", BIG, 2, "new"), ("a", BIG, None, "undated"), ("a", BIG + 1, 1, "x"), (None, None, 1, None), ("b", 1, 1, "")]
    _files(spark, folder, JOBS, first)
    texts = keyed.unseen_texts(_stream(spark, folder, JOBS), ["source", "job_id"], ["version"], "text")
    got = rows(_run(spark, texts, tmp_path))
    assert got == sorted([("a", BIG, "new"), ("a", BIG + 1, "x"), (None, None, None), ("b", 1, "")], key=str)
    _files(spark, folder, JOBS, [("a", BIG, 9, "newest"), ("c", 1, 1, "late"), ("c", 1, 1, "later"), (None, None, 2, "again")])
    assert rows(_run(spark, texts, tmp_path)) == sorted([*got, ("c", 1, "late")], key=str)


def test_known_keys_and_a_hot_key(spark, tmp_path, rows):
    jobs_path, known_path = str(tmp_path / "jobs"), str(tmp_path / "known")
    hot = [("hot", 1, i, f"t{i:05}") for i in range(30000)]
    rest = [("s", i, 1, f"text {i}") for i in range(200)]
    _files(spark, jobs_path, JOBS, hot + rest)
    _files(spark, known_path, "source string, job_id bigint", [("s", i) for i in range(0, 200, 2)] + [("elsewhere", 1)])
    known = _stream(spark, known_path, "source string, job_id bigint")
    texts = keyed.unseen_texts(_stream(spark, jobs_path, JOBS), ["source", "job_id"], ["version"], "text", known)
    got = rows(_run(spark, texts, tmp_path))
    pending = pending_keys(spark.read.schema(JOBS).parquet(jobs_path), spark.read.parquet(known_path), ["source", "job_id"], "version", [])
    assert got == rows(pending.select("source", "job_id", "text"))
    assert ("hot", 1, "t29999") in got and len(got) == 101


def test_embedded_as_in_batch(spark, tmp_path, rows):
    folder, target, state = str(tmp_path / "in"), str(tmp_path / "target"), str(tmp_path / "state")
    embedder = embed.hashing_embedder(16)
    for part in ([("a", 1, 1, "one two"), ("a", 2, 1, None)], [("a", 1, 2, "three"), ("b", 1, 1, "two two")]):
        _files(spark, folder, JOBS, part)
        keyed.stream_embed_unseen(_stream(spark, folder, JOBS), ["source", "job_id"], ["version"], "text", embedder, "h16", target, state).awaitTermination()
    stored = spark.read.schema(EMBEDDED).parquet(target)
    told = spark.createDataFrame([("a", 1, "one two"), ("a", 2, ""), ("b", 1, "two two")], "source string, job_id bigint, text string")
    assert rows(stored.select("source", "job_id", "embedding")) == rows(embedder(told, "text", "embedding").select("source", "job_id", "embedding"))


def test_no_jobs(spark, tmp_path):
    folder = str(tmp_path / "in")
    _files(spark, folder, JOBS, [])
    assert _run(spark, keyed.unseen_texts(_stream(spark, folder, JOBS), ["job_id"], ["version"], "text"), tmp_path).count() == 0


def test_forgotten_keys_are_new_again(spark, tmp_path, rows):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _files(spark, folder, JOBS, [("a", 1, 1, "x")])
    texts = keyed.unseen_texts(_stream(spark, folder, JOBS), ["source", "job_id"], ["version"], "text", forget_after=500)
    running = keyed.start_table(texts, out, str(tmp_path / "state"), "200 milliseconds")
    _until(running, lambda: _kept(running) == 0)
    _files(spark, folder, JOBS, [("a", 1, 2, "y")])
    _until(running, lambda: len(rows(spark.read.schema(texts.schema).parquet(out))) == 2)
    running.stop()
    assert rows(spark.read.schema(texts.schema).parquet(out)) == [("a", 1, "x"), ("a", 1, "y")]


def _kept(running):
    """Keys with state after the last batch, or None before there was one."""
    batch = running.lastProgress
    return batch["stateOperators"][0]["numRowsTotal"] if batch and batch["stateOperators"] and batch["batchId"] > 0 else None


def _until(running, reached, seconds=60):
    end = time.time() + seconds
    while not reached():
        assert running.isActive and time.time() < end, running.exception()
        time.sleep(0.1)


def test_alert_without_a_later_event(spark, tmp_path, rows):
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k bigint, ts timestamp"
    day = F.timestamp_seconds(F.lit(1700000000) + F.col("id"))
    spark.range(1000).select(F.when(F.col("id") % 10 > 0, BIG + F.col("id") % 10).alias("k"), F.when(F.col("id") % 10 != 3, day).alias("ts")).write.parquet(folder)
    alerts = keyed.silence_timers(_stream(spark, folder, schema), ["k"], "ts", 1000)
    keyed.stop_when_silent(keyed.start_table(alerts, out, str(tmp_path / "state"), "200 milliseconds"), 60)
    stored = spark.read.schema(alerts.schema).parquet(out)
    want = spark.read.parquet(folder).groupBy("k").agg(F.max("ts").alias("silent_from"), F.count("*").alias("n"))
    assert rows(stored.select("k", "silent_from", "n")) == rows(want)
    assert stored.filter("alert_at IS NULL").count() == 0


def test_waiting_ends(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "k bigint, ts timestamp"
    _files(spark, folder, schema, [(1, None)])
    alerts = keyed.silence_timers(_stream(spark, folder, schema), ["k"], "ts", 3600000)
    with pytest.raises(TimeoutError):
        keyed.stop_when_silent(keyed.start_table(alerts, str(tmp_path / "out"), str(tmp_path / "state"), "200 milliseconds"), 1)


@pytest.mark.parametrize("fold", [keyed._newest_of_batch(["version"]), keyed._last_of_batch])
def test_nothing_to_fold(fold):
    assert list(fold(iter([]))) == []
