"""Brute-force comparisons, hot groups and independence from partitioning."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import dedup, embed, features, grading, ivf, models, search, stats


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(400, 8)).astype(np.float32)
    points[150:290] = points[150]  # a third of all rows are copies of one vector
    rows = [(f"id{i:04d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(7), points


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(9, 8))
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "query_id int, embedding array<double>"), points


def brute(points, asked, k, metric):
    rows = points.astype(np.float64)
    result = []
    for q, v in enumerate(asked):
        if metric == "cosine":
            d = 1 - rows @ v / (np.linalg.norm(rows, axis=1) * np.linalg.norm(v))
        elif metric == "euclidean":
            d = np.linalg.norm(rows - v, axis=1)
        else:
            d = -(rows @ v)
        order = sorted(range(len(rows)), key=lambda i: (round(d[i], 8), f"id{i:04d}"))[:k]
        result += [(q, f"id{i:04d}") for i in order]
    return sorted(result)


@pytest.mark.parametrize("metric", search.METRICS)
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_knn_is_exact(vectors, queries, metric, max_bytes):
    found = search.knn_search(vectors[0], queries[0], 12, id_col="id", metric=metric, max_query_bytes=max_bytes, grid_block_rows=90)
    got = sorted((r["query_id"], r["id"]) for r in found.collect())
    assert got == brute(vectors[1], queries[1], 12, metric)


def test_a_vector_is_sent_to_few_blocks():
    """All keys against all: copies of a vector grow with the bytes of all vectors, not with blocks of some thousand rows."""
    assert search.grid_blocks(615_000, 615_000, 64, 6, None) == (10, 10)
    assert search.grid_blocks(140_000, 140_000, 64, 6, None) == (6, 6) and search.grid_blocks(9_000, 300, 64, 6, None) == (3, 1)
    assert search.grid_blocks(615_000, 70_000, 384, 6, None) == (57, 7) and search.grid_blocks(400, 9, 16, 8, 90) == (5, 1)


def test_few_pairs_are_compared_in_full(monkeypatch):
    """What single precision leaves out is not among the best: copies, near copies, ties, zeros, NaN and own ids as in one whole sort."""
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((5000, 16)) * rng.choice([1e-20, 1.0, 1e20], 5000)[:, None]
    rows[100:140], rows[140:150], rows[150:153] = rows[99], rows[99] * (1 + 1e-7 * rng.standard_normal((10, 16))), 0.0
    rows[153, 0] = np.nan
    queries, ids, own = rows[np.r_[90:160, 4000:4100]].copy(), rng.permutation(5000), {}
    for place, row in enumerate(np.r_[90:160, 4000:4100]):
        own[int(ids[row])] = [place]
    whole, cells, plain = search.distances(rows, queries, "cosine"), [], search.distances
    for place, row in enumerate(np.r_[90:160, 4000:4100]):
        whole[row, place] = np.nan
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 20_000)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(search, "distances", lambda r, q, m: cells.append(len(r) * len(q)) or plain(r, q, m))
    best = search.Best(6, len(queries))
    for part in np.array_split(np.arange(5000), 3):
        search.score_into(best, ids[part], rows[part], queries, "cosine", own=own)
    told = np.where(np.isnan(whole), np.inf, whole)
    order = [np.lexsort((ids, told[:, q]))[:6] for q in range(len(queries))]
    want = [(q, ids[row], whole[row, q]) for q, rows_of in enumerate(order) for row in rows_of if np.isfinite(told[row, q])]
    got = list(zip(*best.rows(list(range(len(queries))))))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-10)
    assert sum(cells) < 0.2 * whole.size


def test_knn_with_more_neighbours_than_rows(vectors, queries):
    assert search.knn_search(vectors[0], queries[0], 1000, id_col="id").count() == 9 * 400


def test_ivf_with_all_lists_is_flat(vectors, queries):
    index = ivf.ivf_build(vectors[0], 6, id_col="id")
    flat = {(r["query_id"], r["id"]) for r in search.knn_search(vectors[0], queries[0], 10, id_col="id").collect()}
    assert {(r["query_id"], r["id"]) for r in ivf.ivf_search(index, queries[0], 10, 6).collect()} == flat
    blocked = ivf.ivf_search(index, queries[0], 10, 6, max_query_bytes=0, grid_block_rows=50)
    assert {(r["query_id"], r["id"]) for r in blocked.collect()} == flat
    few = ivf.ivf_search(index, queries[0], 10, 1)
    few_blocked = ivf.ivf_search(index, queries[0], 10, 1, max_query_bytes=0, grid_block_rows=50)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, few_blocked.collect()))
    truth = search.knn_search(vectors[0], queries[0], 10, id_col="id")
    assert 0 < ivf.recall_of(few, truth, "query_id", "id").first()["recall"] <= 1
    assert ivf.ivf_health(index).agg(F.sum("n_rows")).first()[0] == 400
    assert ivf.assign_lists(index.model, vectors[0]).join(index.rows.withColumnRenamed("list_id", "was"), "id").filter("list_id <> was").count() == 0


def test_similar_items_small(vectors):
    found = search.similar_items(vectors[0], vectors[0].filter("id IN ('id0000', 'id0200')").select("id"), 5, 0.0, id_col="id")
    per = {r["reference_id"]: r["n"] for r in found.groupBy("reference_id").agg(F.count("*").alias("n")).collect()}
    assert per["id0200"] <= 6 and all(r["similarity_score"] >= 0 for r in found.collect())


def test_nothing_to_embed(spark):
    none = spark.createDataFrame([], "k int, title string, text string")
    known = spark.createDataFrame([], "k int")
    done = embed.embed_table(none, known, ["k"], "k", [], "title", "text", embed.hashing_embedder(16), "m")
    assert done.count() == 0


def test_plans_have_no_cross_joins(spark, vectors, queries):
    found = search.knn_search(vectors[0], queries[0], 5, id_col="id", max_query_bytes=0, grid_block_rows=90)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intra_group_similarity(spark, vectors):
    points = vectors[1].astype(np.float64)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    grouped = vectors[0].withColumn("g", F.substring("id", 4, 1))
    for row in embed.intra_group_similarity(grouped, "g").collect():
        own = unit[[i for i in range(400) if f"id{i:04d}"[3] == row["g"]]]
        sims = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert row["avg_similarity"] == pytest.approx(sims.mean(), abs=1e-5)


def test_hybrid_short_queries_and_prefilter(spark, vectors):
    jobs = vectors[0].select("id", F.concat(F.lit("Title "), "id").alias("title"), F.lit("python chef").alias("text"))
    asked = spark.createDataFrame([(1, " ab ", [1.0] * 8), (2, "Python the chef", [1.0] * 8)], "query_id int, text string, embedding array<double>")
    found = search.hybrid_search(asked, vectors[0], jobs, 4, id_col="id")
    assert {r["query_id"] for r in found.collect()} == {2}
    assert found.first()["keyword_score"] == pytest.approx(2 / 3)
    rare = F.col("id") == "id0399"
    assert search.hybrid_search(asked, vectors[0], jobs, 4, where=rare, prefilter=True, id_col="id").count() == 1


@pytest.mark.parametrize("case", ["spread", "hot", "constant", "outlier"])
def test_exact_quantiles(spark, case):
    rng = np.random.default_rng(3)
    values = {"spread": rng.normal(size=30011), "hot": np.where(rng.random(20000) < 0.4, 5.0, rng.random(20000) * 10), "constant": np.full(500, 2.5), "outlier": np.append(rng.random(9999), 1e12)}[case]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    row = stats.exact_quantiles(df, "v", probs, ["g"], accuracy=500).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))
    row = stats.exact_quantiles(df, "v", probs, ["g"], accuracy=500, discrete=True).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == list(np.quantile(values, probs, method="inverted_cdf"))


def test_exact_quantiles_of_every_size(spark):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 7, 99, 100, 101, 102, 150, 199, 200, 201, 333, 1001, 4999]
    data = {n: rng.exponential(size=n) for n in sizes}
    df = spark.createDataFrame([(n, float(v)) for n, values in data.items() for v in values], "g int, v double").repartition(6)
    probs = [0.01, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.99]
    for row in stats.exact_quantiles(df, "v", probs, ["g"], accuracy=100).collect():
        assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(data[row["g"]], probs)))


@pytest.mark.parametrize("case", ["one_day", "one_instant", "mixed", "nulls"])
def test_time_split_sizes(spark, case):
    start = dt.datetime(2024, 1, 1)
    moments = {
        "one_day": [start + dt.timedelta(seconds=i) for i in range(503)],
        "one_instant": [start] * 503,
        "mixed": [start + dt.timedelta(days=i % 7, microseconds=i) for i in range(503)],
        "nulls": [None if i % 3 == 0 else start + dt.timedelta(hours=i) for i in range(503)],
    }[case]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "k int, ts timestamp")
    for share in (0.2, 0.5, 0.001, 1.0):
        split = dedup.time_split(df, "ts", "k", share)
        train = split.filter("split = 'train'")
        assert train.count() == int(503 * (1 - share))
        newest = train.agg(F.max(F.coalesce("ts", F.lit(dt.datetime(9999, 1, 1))))).first()[0]
        oldest = split.filter("split = 'test'").agg(F.min(F.coalesce("ts", F.lit(dt.datetime(9999, 1, 1))))).first()[0]
        assert newest is None or oldest is None or newest <= oldest


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    latest = dedup.latest_per_key(df, ["k"], ["v"])
    assert latest.filter("k = 0").first()["v"] == 99999
    assert "WindowGroupLimit" in latest._jdf.queryExecution().executedPlan().toString()


def test_partitioning_does_not_matter(spark, rows):
    df = spark.range(5000).select((F.col("id") % 17).alias("g"), F.col("id").alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    df = df.withColumn("w", F.col("v") * 2)
    results = [
        (
            rows(stats.group_salary_stats(part, "g", "v", "w")),
            rows(dedup.content_groups(part, "k", ["v"])),
            rows(dedup.top_n(part, "v", 5, ["k"], ["g"])),
        )
        for part in (df.repartition(1), df.repartition(8))
    ]
    assert results[0] == results[1]


def test_too_many_categories(spark):
    with pytest.raises(ValueError):
        features.one_hot(spark.range(50).select(F.col("id").cast("string").alias("c")), ["c"], {"c": features.category_values(spark.range(50).select(F.col("id").cast("string").alias("c")), "c", 10)})


def test_pca_and_clusters(vectors):
    model, explained = models.fit_pca(vectors[0], "embedding", None, 0.9)
    assert 1 <= len(explained) <= 8 and sum(explained) >= 0.9 - 1e-9
    centred = models.reduce_vectors(model, vectors[0], "embedding").select(F.col("reduced")[0].alias("x")).agg(F.avg("x")).first()[0]
    assert centred == pytest.approx(0.0, abs=1e-6)
    fit = models.kmeans_fit(vectors[0], "embedding", 4, tries=2)
    assert fit.metrics["n_samples"] == 400 and -1 <= fit.metrics["silhouette_score"] <= 1


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (0.0, 1.0), (5.0, 3.0)], "y double, p double")
    got = models.regression_metrics(df, "y", "p").first()
    assert (got["rmse"], got["mae"], got["mape"]) == (1.22, 1.0, 46.67)
    assert got["r2"] == pytest.approx(1 - 6 / 14, abs=1e-4)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ np.array([3.0, -2.0]) + 1 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fitted = models.train_pay_model(features.training_matrix(df, ["a", "b"], "y"), ["a", "b"], "linear")
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (y - y.mean()))
    assert list(fitted.model.coefficients) == pytest.approx(list(want), abs=1e-3)
    assert fitted.importance(spark).count() == 0


def test_one_vector_for_one_text(spark):
    rows = [(i, f"chef cook number {i % 3}") for i in range(6)]
    embedder = embed.hashing_embedder(64)
    whole = {r["k"]: r["v"] for r in embedder(spark.createDataFrame(rows, "k int, text string"), "text", "v").collect()}
    single = embedder(spark.createDataFrame(rows[4:5], "k int, text string"), "text", "v").first()["v"]
    assert single == whole[4] == whole[1] and np.linalg.norm(single) == pytest.approx(1, abs=1e-6)
    asked = spark.createDataFrame([(1, "  ab "), (2, "  Chef cook number 1\n"), (3, None)], "query_id int, text string")
    found = embed.embed_queries(asked, embedder).collect()
    assert [r["query_id"] for r in found] == [2] and found[0]["embedding"] == pytest.approx(whole[1])
    short = embed.embed_queries(asked, embedder, max_chars=4).collect()
    assert short[0]["text"] == "Chef"


def test_pluggable_models(spark):
    def lengths():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

    def shout():
        return lambda prompts: np.array([p.upper() for p in prompts])

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "k int, text string")
    made = embed.model_embedder(lengths, batch=1)(df, "text", "v")
    assert {r["k"]: r["v"] for r in made.collect()} == {1: [2.0, 1.0], 2: [4.0, 1.0]}
    assert sorted(r["reply"] for r in grading.model_replies(df, "text", shout).collect()) == ["AB", "ABCD"]


def test_keys_of_two_columns(spark):
    rows = [("a", 7, [1.0, 0.0]), ("b", 7, [0.0, 1.0]), ("a", 8, [0.9, 0.1]), ("b", 9, [0.1, 0.9])]
    corpus = spark.createDataFrame(rows, "source string, job int, embedding array<double>")
    jobs = corpus.select("source", "job", F.concat("source", "job").alias("title"), F.lit("x").alias("text"))
    asked = spark.createDataFrame([(1, "any words", [1.0, 0.0])], "query_id int, text string, embedding array<double>")
    found = search.hybrid_search(asked, corpus, jobs, 2, id_col=["source", "job"]).orderBy("rank").collect()
    assert [(r["source"], r["job"]) for r in found] == [("a", 7), ("a", 8)]
    wanted = spark.createDataFrame([("b", 7), ("c", 1)], "source string, job int")
    near = search.similar_items(corpus, wanted, 1, 0.5, id_col=["source", "job"], jobs=jobs).collect()
    assert {(r["reference_source"], r["reference_job"], r["source"], r["job"], r["found"]) for r in near} == {("b", 7, "b", 9, True), ("c", 1, None, None, False)}


def test_judged_against_an_empty_context(spark):
    answers = spark.createDataFrame([(1, "see job_9"), (2, "see job_9")], "k int, answer string")
    cited = spark.createDataFrame([(1, 0, "job_10"), (1, 1, "job_9"), (2, 0, "job_9")], "k int, position int, job_id string")
    none = spark.createDataFrame([], "k int, job_id string")
    judged = {r["k"]: r["verdict"] for r in grading.judge_answers(answers, cited, none, ["k"], ["k"], F.col("k") == 1).collect()}
    assert not judged[1]["passed"] and [v.split()[3] for v in judged[1]["violations"]] == ["job_10", "job_9"]
    assert judged[2]["passed"]
