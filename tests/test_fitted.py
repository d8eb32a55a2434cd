"""The fitted embedding against a dense singular value decomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import embed, fitted
from postlens.streaming import keyed

FEATURES, DIM = 512, 4


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(DIM)]
    made = [" ".join(rng.choice(topics[i % DIM], 30)) + f" Extra{i % 7}" for i in range(240)]
    return [(i, t) for i, t in enumerate(made)] + [(900, None), (901, ""), (902, "-- !"), (903, "t0w1 " * 30000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "id long, text string").repartition(5)


@pytest.fixture(scope="module")
def model(docs):
    return fitted.fit_embedding(docs, "text", DIM, FEATURES, passes=4)


def _dense(docs):
    """Unit TF-IDF rows of the texts with words, by plain loops."""
    ids = [r["ids"] for r in docs.orderBy("id").select(fitted.word_buckets("text", FEATURES).alias("ids")).collect()]
    rows = [i for i in ids if i]
    matrix = np.zeros((len(rows), FEATURES))
    for r, row in enumerate(rows):
        for b in row:
            matrix[r, b] += 1
    idf = np.array([math.log((len(rows) + 1) / ((matrix[:, b] > 0).sum() + 1)) + 1 for b in range(FEATURES)])
    matrix *= idf
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True), idf


def test_leading_directions(docs, model):
    matrix, idf = _dense(docs)
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:DIM].T
    assert model.idf == pytest.approx(idf)
    assert model.vectors @ model.vectors.T == pytest.approx(exact @ exact.T, abs=1e-3)


def test_vectors_of_all_texts(spark, docs, model):
    matrix, _ = _dense(docs)
    want = matrix @ model.vectors
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r["id"]: np.array(r["v"]) for r in model.embedder(spark)(docs, "text", "v").collect()}
    assert len(got) == 244 and all(not got[i].any() for i in (900, 901, 902))
    for vector, i in zip(want, [*range(240), 903], strict=True):
        assert got[i] == pytest.approx(vector, abs=1e-5)


def test_saved_model_in_batch_stream_and_for_queries(spark, docs, model, tmp_path, rows):
    model.save(spark, str(tmp_path / "model"))
    embedder = fitted.load(spark, str(tmp_path / "model")).embedder(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    target = str(tmp_path / "out")
    keyed.stream_embed_unseen(stream, ["id"], [], "text", embedder, "fitted", target, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(target).select("id", "embedding")) == rows(model.embedder(spark)(docs, "text", "embedding").select("id", "embedding"))
    asked = embed.embed_queries(spark.createDataFrame([(1, " t2w3 t2w4 ")], "q int, text string"), embedder)
    near = asked.select(F.col("embedding").alias("a")).crossJoin(embedder(docs.filter("id < 240"), "text", "b")).collect()
    best = sorted(near, key=lambda r: -np.dot(r["a"], r["b"]))[:20]
    assert all(r["id"] % DIM == 2 for r in best)


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([(1, None), (2, "?")], "id long, text string")
    model = fitted.fit_embedding(empty, "text", 3, 64)
    assert [r["v"] for r in model.embedder(spark)(empty, "text", "v").collect()] == [[0.0] * 3] * 2
    assert fitted.fit_embedding(empty.limit(0), "text", 3, 64).vectors.shape == (64, 3)


def test_a_task_without_texts(spark):
    """A written table may have a part without rows, whose task has no sums to send."""
    both = spark.range(0, 2, numPartitions=2).select("id", F.array(F.lit(3), F.lit(5), F.lit(5)).cast("array<int>").alias("ids"))
    one = both.where("id = 1").select("ids")
    assert [r[0] for r in one.select(F.spark_partition_id()).collect()] == [1]
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(FEATURES, 4)))[0]
    row = np.zeros(FEATURES)
    row[[3, 5]] = np.array([1, 2]) / math.sqrt(5)
    assert np.allclose(fitted._pass(one, np.ones(FEATURES), basis, True), np.outer(row, row @ basis))
    assert np.allclose(fitted._pass(one, np.ones(FEATURES), basis, False), np.outer(row @ basis, row @ basis))


def test_a_pass_has_no_more_tasks_than_cores(spark, docs, monkeypatch):
    """Every task of a pass sends a whole model's rows, so many small files must not make many tasks."""
    taken, plain = [], type(docs).mapInPandas

    def watched(df, *args, **named):
        taken.append(df.rdd.getNumPartitions())
        return plain(df, *args, **named)

    rows = docs.repartition(60).select(fitted.word_buckets("text", FEATURES).alias("ids"))
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(FEATURES, 4)))[0]
    want = fitted._pass(docs.coalesce(1).select(fitted.word_buckets("text", FEATURES).alias("ids")), np.ones(FEATURES), basis, True)
    monkeypatch.setattr(type(docs), "mapInPandas", watched)
    assert np.allclose(fitted._pass(rows, np.ones(FEATURES), basis, True), want)
    assert taken and max(taken) <= spark.sparkContext.defaultParallelism
