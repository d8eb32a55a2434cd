"""Feature, clustering and model queries."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlens.catalog.registry import query
from postlens.operators import features, models
from postlens.plans.training import train_all
from postlens.session import materialise, scratch_dir

AS_OF = dt.datetime(2001, 8, 2, 12)
NUMBERS = ["salary_min", "salary_max", "salary_mid", "salary_range", "salary_min_log", "salary_max_log", "title_length", "days_since_posted"]


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def priced(t):
    orders = t.orders.withColumns({"low": F.col("o_totalprice"), "high": F.col("o_totalprice") * 1.25})
    return features.numeric_features(orders, _as_of(), low="low", high="high", title="o_orderpriority", posted="o_orderdate")


_numbers_sql = (
    "o_totalprice AS salary_min, o_totalprice * 1.25 AS salary_max, (o_totalprice + o_totalprice * 1.25) / 2 AS salary_mid, "
    "o_totalprice * 1.25 - o_totalprice AS salary_range, ln(1 + o_totalprice) AS salary_min_log, ln(1 + o_totalprice * 1.25) AS salary_max_log, "
    "length(o_orderpriority) AS title_length, floor((epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS days_since_posted"
)


@query(
    "numeric_features",
    "SELECT o_orderkey, salary_min, round(salary_max, 4) AS salary_max, round(salary_mid, 4) AS salary_mid, round(salary_range, 4) AS salary_range, "
    "round(salary_min_log, 6) AS salary_min_log, round(salary_max_log, 6) AS salary_max_log, title_length::INTEGER AS title_length, days_since_posted "
    f"FROM (SELECT o_orderkey, {_numbers_sql} FROM orders)",
)
def _(t):
    made = priced(t)
    rounded = {c: F.round(c, 4) for c in ("salary_max", "salary_mid", "salary_range")}
    rounded.update({c: F.round(c, 6) for c in ("salary_min_log", "salary_max_log")})
    return made.withColumns(rounded).select("o_orderkey", *NUMBERS)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"(o_orderpriority = '{p}')::INTEGER AS \"o_orderpriority_{p}\"" for p in _PRIORITIES)
    + ", (o_orderstatus = 'F')::INTEGER AS status_unknown, (o_orderstatus = 'O')::INTEGER AS \"status_O\", (o_orderstatus = 'P')::INTEGER AS \"status_P\" FROM orders",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return features.one_hot(orders, ["o_orderpriority", "status"]).drop("o_orderpriority", "status")


@query(
    "training_matrix",
    f"WITH n AS (SELECT o_orderkey, {_numbers_sql} FROM orders) SELECT o_orderkey, (5 + (SELECT count(DISTINCT o_orderpriority) FROM orders) + (SELECT max(len(embedding)) FROM embeddings))::INTEGER AS width, "
    "round(salary_range + salary_min_log + salary_max_log + title_length + days_since_posted + salary_min * 0 + 1 + coalesce(list_sum(embedding::DOUBLE[]), 0), 2) AS total, round(salary_mid, 6) AS label "
    "FROM n LEFT JOIN embeddings ON vec_id = o_orderkey WHERE o_orderkey % 10 <> 3",
)
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("o_orderkey"), "embedding")
    rows = priced(t).join(vectors, "o_orderkey", "left")
    rows = rows.withColumn("salary_mid", F.when(F.col("o_orderkey") % 10 != 3, F.col("salary_mid")))
    matrix = features.training_matrix(rows, NUMBERS, "salary_mid", embedding="embedding", leaks=["salary_min", "salary_max"], categories=["o_orderpriority"])
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return matrix.select("o_orderkey", F.size(values).alias("width"), F.round(total, 2).alias("total"), F.round("label", 6).alias("label"))


_view_sql = (
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders), "
    "v AS (SELECT o_custkey, o_orderkey, round((o_totalprice + o_totalprice * 1.25) / 2, 4) AS salary_mid_monthly, round(o_totalprice * 1.25 - o_totalprice, 4) AS salary_range, "
    "length(o_orderpriority)::INTEGER AS title_length, floor((epoch(TIMESTAMP '2001-08-02 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS days_since_posted, e.label "
    "FROM l LEFT JOIN embeddings e ON e.vec_id = o_custkey WHERE rn = 1) "
)


def _view(t):
    jobs = t.orders.withColumns({"low": F.col("o_totalprice"), "high": F.col("o_totalprice") * 1.25})
    vectors = t.embeddings.withColumnRenamed("vec_id", "o_custkey")
    view = features.feature_view(
        jobs, vectors, ["o_custkey"], ["o_orderdate", "o_orderkey"], _as_of(), "low", "high", "o_orderpriority", "o_orderstatus", "o_orderdate"
    )
    return view.withColumns({c: F.round(c, 4) for c in ("salary_mid_monthly", "salary_range")})


_view_cols = ["o_custkey", "o_orderkey", "salary_mid_monthly", "salary_range", "title_length", "days_since_posted", "label"]


@query("feature_view", _view_sql + f"SELECT {', '.join(_view_cols)} FROM v")
def _(t):
    return _view(t).select(*_view_cols)


@query("load_features", _view_sql + f"SELECT {', '.join(_view_cols)} FROM v WHERE label IS NOT NULL AND salary_range > 20000")
def _(t):
    return features.load_features(_view(t), F.col("salary_range") > 20000).select(*_view_cols)


@query(
    "impute_scale",
    "WITH g AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price, o_custkey::DOUBLE AS cust FROM orders), "
    "f AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)) AS price, cust FROM g) "
    "SELECT o_orderkey, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price, round((cust - avg(cust) OVER ()) / stddev_pop(cust) OVER (), 6) AS cust FROM f",
)
def _(t):
    gaps = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    scaled = features.fit_scaling(gaps, ["price", "cust"]).transform(gaps)
    return scaled.select("o_orderkey", F.round("price", 6).alias("price"), F.round("cust", 6).alias("cust"))


def _labelled_docs(t):
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"))
    return t.documents.join(labels, "doc_id", "left").withColumn("pay", F.col("n_chars").cast("double"))


_labels_sql = (
    "WITH d AS (SELECT e.label AS cluster_id, d.* FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS rn FROM d WHERE cluster_id IS NOT NULL), "
    "w AS (SELECT cluster_id, rn, unnest(string_split_regex(lower(text), '\\s+')) AS word, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) AS pos FROM f), "
    "c AS (SELECT cluster_id, word, count(*) AS n, min(rn * 1000000 + pos) AS seen FROM w WHERE length(word) > 2 AND word NOT IN "
    "('the', 'a', 'an', 'and', 'or', 'in', 'at', 'for', 'to', 'of', '-') GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, seen) AS r FROM c QUALIFY r <= 3), "
    "s AS (SELECT cluster_id, string_agg(word, ' / ' ORDER BY r) AS joined FROM k GROUP BY 1), "
    "y AS (SELECT i::INTEGER AS cluster_id, coalesce(array_to_string(list_transform(range(1, length(joined) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(joined[i - 1], "
    "'[\\p{Lu}\\p{Ll}\\p{Lt}]') THEN upper(joined[i]) ELSE joined[i] END), ''), 'Cluster ' || i) AS cluster_name FROM range(12) g(i) LEFT JOIN s ON s.cluster_id = i UNION ALL SELECT NULL, 'No cluster') "
)


@query("cluster_labels", _labels_sql + "SELECT * FROM y")
def _(t):
    return models.cluster_labels(_labelled_docs(t), "cluster_id", "text", "doc_id", 12, unassigned="No cluster")


@query(
    "cluster_stats",
    _labels_sql + ", z AS (SELECT cluster_id, source, count(*) AS n FROM d GROUP BY ALL), "
    "top AS (SELECT cluster_id, source, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, source) AS r FROM z QUALIFY r = 1), "
    "a AS (SELECT cluster_id, count(*) AS n, round(avg(n_chars), 0) AS avg_salary, round(quantile_cont(n_chars::DOUBLE, 0.5), 0) AS median_salary FROM d GROUP BY 1) "
    "SELECT y.cluster_id, cluster_name, coalesce(n, 0) AS count, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM d), 1) AS pct, avg_salary, median_salary, "
    "coalesce(source, 'N/A') AS top_location FROM y LEFT JOIN a ON a.cluster_id IS NOT DISTINCT FROM y.cluster_id LEFT JOIN top ON top.cluster_id IS NOT DISTINCT FROM y.cluster_id",
)
def _(t):
    docs = _labelled_docs(t)
    return models.cluster_stats(docs, "cluster_id", "pay", "source", models.cluster_labels(docs, "cluster_id", "text", "doc_id", 12, unassigned="No cluster"))


@query(
    "regression_metrics",
    "WITH p AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS f FROM orders) "
    "SELECT round(sqrt(avg((y - f) ^ 2)), 2) AS val_rmse, round(avg(abs(y - f)), 2) AS val_mae, round(1 - sum((y - f) ^ 2) / sum((y - m) ^ 2), 4) AS val_r2, "
    "round(avg(CASE WHEN y <> 0 THEN abs((y - f) / y) END) * 100, 2) AS val_mape FROM p, (SELECT avg(y) AS m FROM p)",
)
def _(t):
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("guess"))
    return models.regression_metrics(t.orders.join(means, "o_orderpriority"), "o_totalprice", "guess", "val_")


@query(
    "classification_metrics",
    "WITH p AS (SELECT quality AS t, (n_chars > 1500)::INTEGER AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([0, 1]) AS c), "
    "f AS (SELECT c, count(*) FILTER (t = c) AS support, 2.0::DOUBLE * count(*) FILTER (t = c AND p = c) / (count(*) FILTER (t = c) + count(*) FILTER (p = c)) AS f1 FROM p, c GROUP BY c) "
    "SELECT (SELECT round(avg((t = p)::INTEGER), 4) FROM p) AS accuracy, round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted, count(*) AS num_classes FROM f",
)
def _(t):
    rated = t.labels.join(t.documents, "doc_id").select("quality", (F.col("n_chars") > 1500).cast("int").alias("guess"))
    return models.classification_metrics(rated, "quality", "guess")


@query("pca_reduce")
def _(t):
    model, explained = models.fit_pca(t.embeddings, "embedding", 2)
    reduced = models.reduce_vectors(model, t.embeddings, "embedding")
    return reduced.select(
        "vec_id", F.abs(F.round(F.col("reduced")[0], 5)).alias("x"), F.abs(F.round(F.col("reduced")[1], 5)).alias("y"), F.lit(round(float(sum(explained)), 5)).alias("explained")
    )


@query("pca_component_table")
def _(t):
    return models.component_table(t.embeddings, "embedding")


def _metric_rows(spark, metrics):
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")


@query("kmeans_fit")
def _(t):
    return _metric_rows(t.spark, models.kmeans_fit(t.embeddings, "embedding", k=10).metrics)


@query("kmeans_predict", "SELECT 10::BIGINT AS clusters, count(*) AS n, max(len(embedding))::INTEGER AS dims, true AS nearest FROM embeddings")
def _(t):
    clustering = models.kmeans_fit(t.embeddings, "embedding", k=10)
    placed = clustering.predict(t.embeddings, "embedding")
    centers = F.array(*[F.array(*map(F.lit, map(float, c))) for c in clustering.model.clusterCenters()])
    gaps = F.transform(centers, lambda c: F.aggregate(F.zip_with(c, F.col("embedding"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = placed.select("cluster_id", F.size("embedding").alias("dims"), gaps.alias("gaps"))
    near = near.withColumn("nearest", F.get("gaps", F.col("cluster_id")) <= F.array_min("gaps") + 1e-9)
    return near.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("n"), F.max("dims").alias("dims"), F.bool_and("nearest").alias("nearest"))


@query("elbow", "SELECT k::INTEGER AS k, true AS falls FROM range(5, 21) r(k)")
def _(t):
    """Whether the inertia falls with every fifth cluster."""
    costs = models.elbow(t.embeddings, "embedding")
    fewer = costs.select((F.col("k") + 5).alias("k"), F.col("inertia").alias("before"))
    return costs.join(fewer, "k", "left").select("k", (F.col("inertia") < F.coalesce("before", F.lit(float("inf")))).alias("falls"))


PAY_INPUTS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _pay_rows(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    inputs = [F.col(c).cast("double").alias(c) for c in PAY_INPUTS]
    return features.training_matrix(lines.select(*inputs, "l_extendedprice", "l_orderkey"), PAY_INPUTS, "l_extendedprice").select("features", "label", "l_orderkey")


def _pay_model(t, kind, **changes):
    rows = materialise(_pay_rows(t), "pay")
    held_out = F.xxhash64("l_orderkey") % 5 == 0
    train, val = rows.filter(~held_out), rows.filter(held_out)
    model = models.train_pay_model(train, PAY_INPUTS, kind, None if kind == "linear" else val, stored=True, **changes)
    return model, train, val


def _pay_scores(t, kind, **changes):
    model, train, val = _pay_model(t, kind, **changes)
    a = models.regression_metrics(model.predict(train), "label", "prediction", "train_")
    b = models.regression_metrics(model.predict(val), "label", "prediction", "val_")
    return _metric_rows(t.spark, {**a.first().asDict(), **b.first().asDict()})


@query("salary_regressor")
def _(t):
    return _pay_scores(t, "gbt")


@query("salary_regressor_deep")
def _(t):
    return _pay_scores(t, "gbt_deep")


@query("salary_regressor_linear")
def _(t):
    return _pay_scores(t, "linear")


@query("feature_importance", "SELECT 5::BIGINT AS features, 1.0::DOUBLE AS total, true AS ordered")
def _(t):
    """Number of inputs, the sum of their importance, and whether each is a share."""
    found = _pay_model(t, "gbt")[0].importance(t.spark)
    return found.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("ordered"))


def _role_rows(t):
    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}]+").transform(docs)
    return HashingTF(inputCol="words", outputCol="features", numFeatures=4096).transform(words).select("doc_id", "features", "label")


@query("role_classifier")
def _(t):
    rows = _role_rows(t)
    model = models.train_classifier(rows, "label")
    return models.classification_metrics(model.transform(rows), "label", "prediction")


@query("save_load_model", "SELECT true AS same, count(*) AS n, '6' AS k FROM embeddings")
def _(t):
    path = scratch_dir(t.spark, "model")
    fitted = models.kmeans_fit(t.embeddings, "embedding", k=6)
    models.save_artifacts(t.spark, fitted.model, path, {"k": 6}, fitted.metrics)
    model, config, metrics = models.load_artifacts(t.spark, KMeansModel, path)
    again = models.Clustering(model, metrics).predict(t.embeddings, "embedding", "after")
    both = fitted.predict(again.drop("features"), "embedding", "before")
    return both.groupBy((F.col("before") == F.col("after")).alias("same")).agg(F.count("*").alias("n")).withColumn("k", F.lit(config["k"]))


@query("train_all")
def _(t):
    path = scratch_dir(t.spark, "training")
    done = train_all(t.spark, _pay_rows(t), PAY_INPUTS, _role_rows(t), t.embeddings, "embedding", path)
    return done.drop("path")
