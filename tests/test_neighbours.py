"""The neighbour graph against exact search, and similar items of keys with several vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators.neighbours import neighbour_graph
from postlens.operators.search import knn_search, similar_items

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("size", "block"), [("sf0.01", 64), ("sf0.1", 256)])
def test_graph_finds_nine_in_ten(spark, size, block):
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    found = neighbour_graph(rows, 10, block_rows=block).where("reference_vec_id % 100 = 0").withColumnRenamed("reference_vec_id", "query_id")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    truth = knn_search(rows, asked, 11).where("vec_id != query_id").where("rank <= 11").select("query_id", "vec_id")
    met = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = met.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    print("recall", size, row["hits"] / row["n"])
    assert row["hits"] >= 0.9 * row["n"] > 0


def brute(rows, k):
    """Least cosine distance between the vectors of each two keys."""
    best = {}
    for a, x in rows:
        for b, y in rows:
            if a != b and x is not None and y is not None:
                lengths = np.linalg.norm(x) * np.linalg.norm(y)
                d = round(1 - float(np.dot(x, y)) / (lengths or 1.0), 5)
                best[a, b] = min(d, best.get((a, b), d))
    keys = {a for a, _ in best}
    return {a: sorted((d, b) for (c, b), d in best.items() if c == a)[:k] for a in keys}


def test_one_block_is_exact_with_nulls_zeros_and_several_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 25, [float(x) for x in rng.standard_normal(8)]) for i in range(40)] + [(50, None), (51, [0.0] * 8), (7, None)]
    got = {}
    for r in neighbour_graph(spark.createDataFrame(rows, SCHEMA), 5).collect():
        got.setdefault(r["reference_vec_id"], []).append((round(r["distance"], 5), r["rank"]))
    want = brute(rows, 5)
    assert set(got) == set(want) and 50 not in got
    for key, near in want.items():
        assert [d for d, _ in sorted(got[key], key=lambda x: x[1])] == pytest.approx([d for d, _ in near], abs=2e-5)


def test_copies_and_an_empty_corpus(spark):
    rows = [(i, [1.0, 0.0]) for i in range(600)] + [(1000 + i, [0.0, 1.0 + i]) for i in range(30)]
    found = neighbour_graph(spark.createDataFrame(rows, SCHEMA), 3, width=8, block_rows=64).collect()
    assert len(found) == 3 * 630 and all(r["distance"] < 1e-6 for r in found)
    assert all((r["vec_id"] < 1000) == (r["reference_vec_id"] < 1000) for r in found)
    assert neighbour_graph(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_two_columns(spark):
    rows = [("a", i, [1.0, i / 10]) for i in range(6)]
    found = neighbour_graph(spark.createDataFrame(rows, "source string, job long, embedding array<double>"), 1, id_col=["source", "job"])
    assert found.columns == ["reference_source", "reference_job", "source", "job", "distance", "rank"] and found.count() == 6


@pytest.mark.parametrize("most", [64 << 20, 1])
def test_similar_items_of_a_key_with_several_vectors(spark, most):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (1, [1.0, 0.02]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, SCHEMA)
    found = similar_items(corpus, corpus.select("vec_id"), top_k=2, min_similarity=-1.0, max_query_bytes=most).collect()
    assert {(r["reference_vec_id"], r["rank"], r["vec_id"]) for r in found if r["reference_vec_id"] == 1} == {(1, 1, 2), (1, 2, 3)}
    near = similar_items(corpus, corpus.select("vec_id"), top_k=1, max_query_bytes=most).collect()
    assert {(r["reference_vec_id"], r["vec_id"]) for r in near} == {(1, 2), (2, 1)}


def test_best_rows_are_kept_in_tiles_of_queries(monkeypatch):
    """No slice is scored against more queries than a tile has, and the best are those of one whole sort, ties by id."""
    from postlens.operators import search

    rng = np.random.default_rng(5)
    rows, queries = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(-2, 3, (70, 3)).astype(float)
    ids, seen, plain = rng.permutation(300) + 10, [], search.distances
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(search, "distances", lambda r, q, m: seen.append(len(q)) or plain(r, q, m))
    for kind in (np.int64, object):
        best = search.Best(4, len(queries))
        for part in np.array_split(np.arange(300), 7):
            search.score_into(best, ids[part].astype(kind), rows[part], queries, "cosine", own={12: [3], 15: [60]})
        whole = plain(rows, queries, "cosine")
        whole[np.flatnonzero(ids == 12), 3] = whole[np.flatnonzero(ids == 15), 60] = np.inf
        want = [(q, i, whole[np.flatnonzero(ids == i)[0], q]) for q in range(70) for i in sorted(ids.tolist(), key=lambda i: (whole[np.flatnonzero(ids == i)[0], q], i))[:4]]
        assert list(zip(*best.rows(list(range(70))))) == want
    assert max(seen) <= 16


@pytest.mark.parametrize("metric", ["cosine", "dot_product", "euclidean"])
def test_graph_of_vectors_without_clusters_is_exact(spark, monkeypatch, metric):
    """Where no two rows share many neighbours, local joins stop short of them; also in small tiles and parts."""
    from postlens.operators import neighbours, search

    monkeypatch.setattr(neighbours, "TILE_ROWS", 1000)
    monkeypatch.setattr(neighbours, "TILE_PART", (64, 300))
    vectors = np.random.default_rng(7).standard_normal((3000, 64))
    keys = np.r_[np.arange(2900), np.arange(100)]  # a hundred keys have two vectors, often in two tiles
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, vectors)], SCHEMA)
    dist = search.distances(vectors.astype(np.float32).astype(float), vectors.astype(np.float32).astype(float), metric)
    dist = np.minimum.reduceat(dist[np.argsort(keys, kind="stable")], np.searchsorted(np.sort(keys), np.arange(2900)), axis=0)
    dist = np.minimum.reduceat(dist[:, np.argsort(keys, kind="stable")], np.searchsorted(np.sort(keys), np.arange(2900)), axis=1)
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, axis=1)[:, :10]
    found = neighbours.neighbour_graph(rows, 10, metric=metric, block_rows=64).toPandas().sort_values(["reference_vec_id", "rank"])
    assert (found["vec_id"].to_numpy().reshape(2900, 10) == want).all()
    assert found["distance"].to_numpy().reshape(2900, 10) == pytest.approx(np.take_along_axis(dist, want, axis=1), abs=1e-8)


def test_local_joins_find_nine_in_ten(spark):
    """The graph beyond ``exact_rows``, on vectors without clusters, against the exact one."""
    vectors = np.random.default_rng(8).standard_normal((4000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    exact = {(r["reference_vec_id"], r["vec_id"]) for r in neighbour_graph(rows, 10).collect()}
    near = neighbour_graph(rows, 10, block_rows=64, exact_rows=0).collect()
    assert len(near) == 40000 and len(exact & {(r["reference_vec_id"], r["vec_id"]) for r in near}) >= 0.9 * 40000
    pairs = [(i % 25, [float(x) for x in v[:8]]) for i, v in enumerate(vectors[:40])] + [(50, None), (51, [0.0] * 8)]
    both = [neighbour_graph(spark.createDataFrame(pairs, SCHEMA), 5, exact_rows=most).select("reference_vec_id", "rank", F.round("distance", 6)) for most in (0, 1000)]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))
    assert neighbour_graph(spark.createDataFrame([], SCHEMA), exact_rows=-1).count() == 0


def test_a_team_gets_each_vector_once(spark):
    """Rows 0 and 1 share a team and a neighbour, which is sent to it once and introduced in both neighbourhoods."""
    from postlens.operators import neighbours

    rows = spark.createDataFrame([(i, i, [1.0, i / 10]) for i in range(4)], "at long, own long, vector array<float>")
    graph = spark.createDataFrame([(0, 2, 0.9, True), (1, 2, 0.9, True), (0, 3, 0.9, True), (1, 3, 0.9, True)], neighbours.EDGES + ", fresh boolean")
    made = neighbours.introductions(graph, rows, 2, "cosine", 1, 1)
    told = [(r["at"], r["other"]) for r in made.collect()]
    assert len(told) == len(set(told)) and {(2, 3), (3, 2)} <= set(told)
