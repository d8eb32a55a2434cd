"""Null vectors, columns without values and missing embeddings have defined results."""

from pyspark.sql import functions as F

from postlens.operators import features, models, search, stats


def test_vectors_that_are_missing(spark):
    rows = [(i, [float(i), float(i % 3), 1.0]) for i in range(12)] + [(20, None), (21, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    model, _ = models.fit_pca(df, "v", 2)
    reduced = {r["id"]: r["reduced"] for r in models.reduce_vectors(model, df, "v").collect()}
    assert len(reduced) == 14 and reduced[20] is None and len(reduced[3]) == 2
    clusters = models.kmeans_fit(df, "v", 3, tries=2)
    assert clusters.metrics["n_samples"] == 12
    placed = {r["id"]: r["cluster_id"] for r in clusters.predict(df, "v").collect()}
    assert placed[20] is None and placed[0] is not None and len(placed) == 14
    assert models.elbow(df, "v", 2, 3, tries=1).count() == 2


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    scaling = features.fit_scaling(df, ["a", "b"])
    assert (scaling.medians, scaling.means["b"], scaling.deviations["b"]) == ({"a": 2.0, "b": 0.0}, 0.0, 0.0)
    empty = features.fit_scaling(df.limit(0), ["a"])
    assert (empty.medians, empty.means) == ({"a": 0.0}, {"a": 0.0})


def test_matrix_without_any_embedding(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (3.0, 4.0, None)], "a double, y double, v array<float>")
    made = features.training_matrix(df, ["a"], "y", embedding="v")
    assert sorted(r["features"].toArray().tolist() for r in made.collect()) == [[1.0], [3.0]]


def test_vectors_of_zeros_are_at_distance_one(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    hits = {(r["query_id"], r["vec_id"]): r["distance"] for r in search.knn_search(df, df.withColumnRenamed("vec_id", "query_id"), 3).collect()}
    assert hits == {(a, b): 1.0 if 1 in (a, b) else 0.0 if a == b else 2.0 for a in (1, 2, 3) for b in (1, 2, 3)}


def test_quantiles_of_one_hot_value_and_of_many_groups(spark):
    hot = [("hot", 5.0)] * 3000 + [("hot", float(i)) for i in range(100)]
    rows = hot + [(f"g{i}", float(i * k)) for i in range(50) for k in range(i % 7 + 1)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    found = {r["g"]: r for r in stats.exact_quantiles(df, "v", [0.0, 0.5, 1.0], ["g"], also={"mean": F.avg("v")}).collect()}
    assert len(found) == 51 and (found["hot"]["q0"], found["hot"]["q1"], found["hot"]["q2"]) == (0.0, 5.0, 99.0) and found["hot"]["n"] == 3100
    for i in range(50):
        values = sorted(float(i * k) for k in range(i % 7 + 1))
        assert found[f"g{i}"]["q1"] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert stats.exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_quantiles_of_a_null_group(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 4.0), ("a", 3.0), ("a", None), ("b", None)], "g string, v double")
    assert rows(stats.exact_quantiles(df, "v", [0.5], ["g"])) == [("a", 1, 3.0), (None, 3, 2.0)]
    totals = stats.exact_quantiles(df, "v", [0.5], ["g"], also={"s": F.sum("v")})
    assert rows(totals.select("g", "s", "q0")) == [("a", 3.0, 3.0), (None, 7.0, 2.0)]


def test_rows_without_a_cluster(spark):
    df = spark.createDataFrame([(0, "cook", 1.0, "x", 1), (None, "driver", 3.0, "y", 2), (None, None, 5.0, None, 3)], "c int, t string, pay double, place string, id int")
    labels = models.cluster_labels(df, "c", "t", "id", 2, unassigned="none")
    got = {r.c: (r.cluster_name, r["count"], r.pct, r.avg_salary, r.median_salary, r.top_location) for r in models.cluster_stats(df, "c", "pay", "place", labels).collect()}
    assert got == {0: ("Cook", 1, 33.3, 1.0, 1.0, "x"), 1: ("Cluster 1", 0, 0.0, None, None, "N/A"), None: ("none", 2, 66.7, 4.0, 4.0, "y")}
    assert {r.c for r in models.cluster_labels(df, "c", "t", "id", 2).collect()} == {0, 1}
