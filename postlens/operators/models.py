"""Dimension reduction, clustering, regression and classification with MLlib."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from postlens.functions.fixed import LABEL_STOP_WORDS
from postlens.functions.text import title_case
from postlens.operators.stats import exact_quantiles
from postlens.session import materialise

# Defaults of the pay model.
GBT_DEFAULTS = {"trees": 500, "rate": 0.05, "leaves_depth": 5, "min_rows": 20, "row_share": 0.8, "column_share": "0.8", "seed": 42}
SECOND_GBT_DEPTH = 6
RIDGE_ALPHA = 1.0
# Numbers of the rows that one task of a fit holds, and rows from which another core takes part.
TASK_NUMBERS, CORE_ROWS = 1 << 22, 10_000
COMPONENT_STEPS = [2, 10, 20, 50, 100, 384]


def with_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def fit_pca(df: DataFrame, vec: str, components: int | None = 50, variance: float = 0.95) -> tuple[PipelineModel, np.ndarray]:
    """Centred PCA with a fixed number of components, or as many as reach ``variance`` when it is None."""
    featured = with_features(df.filter(F.col(vec).isNotNull()), vec).select("features")
    dims = len(featured.first()["features"])
    k = dims if components is None else min(components, dims)
    centre = StandardScaler(inputCol="features", outputCol="_centred", withMean=True, withStd=False)
    model = Pipeline(stages=[centre, PCA(k=k, inputCol="_centred", outputCol="reduced")]).fit(featured)
    explained = model.stages[1].explainedVariance.toArray()
    if components is None:
        needed = int(np.searchsorted(np.cumsum(explained), variance) + 1)
        return fit_pca(df, vec, min(needed, dims), variance)
    return model, explained


def reduce_vectors(model: PipelineModel, df: DataFrame, vec: str, out: str = "reduced") -> DataFrame:
    """Add the reduced vector; null where the vector is."""
    reduced = model.transform(with_features(df.filter(F.col(vec).isNotNull()), vec)).drop("features", "_centred")
    reduced = reduced.withColumn(out, vector_to_array("reduced"))
    return reduced.unionByName(df.filter(F.col(vec).isNull()), allowMissingColumns=True)


def component_table(df: DataFrame, vec: str, steps: list[int] | None = None, shares: tuple[float, ...] = (0.7, 0.9)) -> DataFrame:
    """Explained variance for several numbers of components, and the number needed for given shares."""
    dims = len(df.filter(F.col(vec).isNotNull()).select(vec).first()[0])
    total = np.cumsum(fit_pca(df, vec, dims)[1])
    rows = [("components", float(s), int(s), float(total[s - 1])) for s in steps or COMPONENT_STEPS if s <= dims]
    rows += [("share", p, int(np.searchsorted(total, p) + 1), p) for p in shares]
    return df.sparkSession.createDataFrame(rows, "kind string, asked double, components int, explained double")


@dataclass
class Clustering:
    model: KMeansModel
    metrics: dict[str, float]

    def predict(self, df: DataFrame, vec: str, out: str = "cluster_id") -> DataFrame:
        """Add the cluster; null where the vector is."""
        placed = self.model.transform(with_features(df.filter(F.col(vec).isNotNull()), vec)).drop("features").withColumnRenamed("prediction", out)
        return placed.unionByName(df.filter(F.col(vec).isNull()), allowMissingColumns=True)

    def centers(self, spark) -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.model.clusterCenters())]
        return spark.createDataFrame(rows, "cluster_id int, center array<double>")


def _fit_all(rows: DataFrame, learners: list[KMeans], at_once: int = 8) -> list[KMeansModel]:
    """The learners fitted side by side; each is a series of short jobs that leaves executors idle by itself."""
    with ThreadPool(min(at_once, len(learners))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(lambda learner: learner.fit(rows)), learners)


def kmeans_fit(df: DataFrame, vec: str, k: int = 10, seed: int = 42, tries: int = 10, max_iter: int = 20) -> Clustering:
    """The best of several seeded runs by inertia, with silhouette and sizes; rows without vector are left out."""
    rows = materialise(with_features(df.filter(F.col(vec).isNotNull()), vec).select("features"), "kmeans")
    fits = _fit_all(rows, [KMeans(k=k, seed=seed + i, maxIter=max_iter) for i in range(tries)])
    best = min(fits, key=lambda m: m.summary.trainingCost)
    metrics = {
        "inertia": best.summary.trainingCost,
        "n_clusters": float(k),
        "n_samples": float(sum(best.summary.clusterSizes)),
        "silhouette_score": ClusteringEvaluator().evaluate(best.transform(rows)),
    }
    metrics.update({f"cluster_{i}_size": float(n) for i, n in enumerate(best.summary.clusterSizes)})
    return Clustering(best, metrics)


def elbow(df: DataFrame, vec: str, low: int = 5, high: int = 20, seed: int = 42, tries: int = 10, max_iter: int = 20) -> DataFrame:
    """Inertia for every number of clusters in the range, over the rows that have a vector."""
    rows = materialise(with_features(df.filter(F.col(vec).isNotNull()), vec).select("features"), "elbow")
    asked = [(k, KMeans(k=k, seed=seed + i, maxIter=max_iter)) for k in range(low, high + 1) for i in range(tries)]
    fits = _fit_all(rows, [learner for _, learner in asked])
    reached: dict[int, float] = {}
    for (k, _), model in zip(asked, fits, strict=True):
        reached[k] = min(model.summary.trainingCost, reached.get(k, math.inf))
    costs = [(k, float(cost)) for k, cost in reached.items()]
    return df.sparkSession.createDataFrame(costs, "k int, inertia double")


def _place(df: DataFrame, row: str, pos: str) -> Column:
    """The order of (row, position), null rows first.

    For whole numbers it is one number: an aggregate hashes rows by their group if all it keeps has a fixed size, while for
    a struct it sorts every row that it reads.
    """
    if not isinstance(df.schema[row].dataType, IntegralType):
        return F.struct(row, pos)
    number = F.coalesce(F.col(row).cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    return number * F.lit(2**31).cast("decimal(10,0)") + F.col(pos)


def cluster_labels(
    df: DataFrame, cluster: str, title: str, order: str, n_clusters: int, sample: int | None = None, words: int = 3, unassigned: str | None = None
) -> DataFrame:
    """Name per cluster: its most frequent title words, over all titles or the first ``sample`` in order.

    Equal counts go to the word seen first. Clusters without words are called 'Cluster i'. Rows whose cluster is null
    name none; with ``unassigned`` they get a last row of that name, whose cluster is null.
    """
    titled = df.filter((F.coalesce(F.col(title), F.lit("")) != "") & F.col(cluster).isNotNull()).select(cluster, title, F.col(order).alias("_rn"))
    if sample is not None:
        titled = titled.withColumn("_k", F.row_number().over(Window.partitionBy(cluster).orderBy("_rn"))).filter(F.col("_k") <= sample)
    spoken = titled.select(cluster, "_rn", F.posexplode(F.split(F.lower(title), "(?U)\\s+")).alias("_pos", "_word"))
    spoken = spoken.filter((F.length("_word") > 2) & ~F.col("_word").isin(LABEL_STOP_WORDS))
    counts = spoken.groupBy(cluster, "_word").agg(F.count("*").alias("_n"), F.min(_place(spoken, "_rn", "_pos")).alias("_seen"))
    best = Window.partitionBy(cluster).orderBy(F.desc("_n"), "_seen")
    top = counts.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= words)
    named = top.groupBy(cluster).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_word"))), lambda w: w["_word"]), " / ").alias("_label")
    )
    every = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias(cluster))
    label = F.coalesce(title_case(F.col("_label")), F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    labels = every.join(named, cluster, "left").select(cluster, label.alias("cluster_name"))
    if unassigned is None:
        return labels
    return labels.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("int").alias(cluster), F.lit(unassigned).alias("cluster_name")))


def cluster_stats(df: DataFrame, cluster: str, pay: str, location: str, labels: DataFrame) -> DataFrame:
    """Size, share, mean and median pay and most common location of every cluster of ``labels``, empty ones included.

    Rows without a cluster count in all shares, and have a row of their own where ``labels`` names them.
    """

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnRenamed(cluster, "_c"), F.col(cluster).eqNullSafe(F.col("_c")), "left").drop("_c")

    total = df.count()
    sizes = df.groupBy(cluster).agg(F.count("*").alias("count"), F.round(F.avg(pay), 0).alias("avg_salary"))
    medians = exact_quantiles(df, pay, [0.5], [cluster]).select(cluster, F.round("q0", 0).alias("median_salary"))
    places = df.filter(F.col(location).isNotNull()).groupBy(cluster, location).agg(F.count("*").alias("_n"))
    top = places.groupBy(cluster).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(location).alias("place")))["place"].alias("top_location"))
    joined = beside(beside(beside(labels, sizes), medians), top)
    return joined.select(
        cluster,
        "cluster_name",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.round(F.coalesce("count", F.lit(0)) * 100.0 / F.lit(total), 1).alias("pct"),
        "avg_salary",
        "median_salary",
        F.coalesce("top_location", F.lit("N/A")).alias("top_location"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str, prefix: str = "") -> DataFrame:
    """rmse, mae, r2 and mape of one prediction column, in a single aggregate."""
    y, error = F.col(truth), F.col(truth) - F.col(predicted)
    row = df.agg(
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("_mae"),
        F.var_pop(y).alias("_var"),
        F.avg(F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0.0))))).alias("_mape"),
    )
    return row.select(
        F.round(F.sqrt("_mse"), 2).alias(f"{prefix}rmse"),
        F.round("_mae", 2).alias(f"{prefix}mae"),
        F.round(1 - F.try_divide("_mse", "_var"), 4).alias(f"{prefix}r2"),
        F.round(F.col("_mape") * 100, 2).alias(f"{prefix}mape"),
    )


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, macro and weighted F1 from the confusion counts, which are the only rows shuffled."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(none).alias("hit"), F.col("n").alias("support"), none.alias("called")),
                F.struct(F.col("p").alias("c"), none.alias("hit"), none.alias("support"), F.col("n").alias("called")),
            )
        )
    )
    classes = sides.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("called")), F.lit(0.0))
    return classes.withColumn("f1", f1).agg(
        F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("f1"), 4).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("f1_weighted"),
        F.count("*").alias("num_classes"),
    )


@dataclass
class PayModel:
    """A trained regressor with the names of its inputs and its settings."""

    kind: str
    model: object
    feature_names: list[str]
    params: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def importance(self, spark, top: int = 20) -> DataFrame:
        """Most important inputs; empty for the linear model."""
        shape = "feature string, importance double"
        if self.kind == "linear":
            return spark.createDataFrame([], shape)
        weights = self.model.featureImportances.toArray()
        names = self.feature_names + [f"emb_{i}" for i in range(len(weights) - len(self.feature_names))]
        ranked = sorted(zip(names, (float(w) for w in weights)), key=lambda x: (-x[1], x[0]))[:top]
        return spark.createDataFrame(ranked, shape)


def in_small_parts(rows: DataFrame, stored: bool = False) -> DataFrame:
    """Rows with ``features``, dealt out so that a part holds a bounded number of them, of any input.

    They are written first, which fixes their order and so the part that each goes to; ``stored`` rows are read from files.

    A learner keeps its rows in memory by these parts, which take many times the room of the files that they are read from.
    The parts are kept on disk, or each of its passes would deal them anew; the caller gives them up by ``unpersist``.
    """
    rows = rows if stored else materialise(rows, "fit")
    first, count = rows.first(), rows.count()
    if first is None:
        return rows.persist(StorageLevel.DISK_ONLY)
    parts = -(-count * (first["features"].size + 16) // TASK_NUMBERS)
    parts = max(parts, min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // CORE_ROWS)))
    return rows.withColumn("_place", F.monotonically_increasing_id()).repartition(parts, "_place").drop("_place").persist(StorageLevel.DISK_ONLY)


def train_pay_model(train: DataFrame, feature_names: list[str], kind: str = "gbt", validation: DataFrame | None = None, stored: bool = False, **changes) -> PayModel:
    """Boosted trees (``gbt``, or ``gbt_deep``) or ridge regression (``linear``) on (features, label).

    With a validation table the trees stop early when its error no longer falls. Rows that come straight from files are
    ``stored``; others are written before the trees are fitted.
    """
    params = {**GBT_DEFAULTS, **changes}
    if kind == "linear":
        # The learner scales the label, so its penalty has to be scaled by the label's deviation.
        size = train.agg(F.count("*").alias("n"), F.stddev_samp("label").alias("s")).first()
        penalty = RIDGE_ALPHA / size["n"] * (size["s"] or 1.0)
        learner = LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False)
        return PayModel(kind, learner.fit(train), feature_names, {"alpha": RIDGE_ALPHA})
    if kind not in ("gbt", "gbt_deep"):
        raise ValueError(f"unknown model kind {kind}")
    learner = GBTRegressor(
        maxIter=params["trees"],
        stepSize=params["rate"],
        maxDepth=SECOND_GBT_DEPTH if kind == "gbt_deep" else params["leaves_depth"],
        minInstancesPerNode=1 if kind == "gbt_deep" else params["min_rows"],
        subsamplingRate=1.0 if kind == "gbt_deep" else params["row_share"],
        featureSubsetStrategy="all" if kind == "gbt_deep" else params["column_share"],
        seed=params["seed"],
        checkpointInterval=10,
    )
    if validation is not None:
        learner = learner.setValidationIndicatorCol("is_validation")
        train = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
    train = in_small_parts(train.select("features", "label", *(["is_validation"] if validation is not None else [])), stored)
    model = learner.fit(train)
    train.unpersist()
    return PayModel(kind, model, feature_names, params)


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add n / (classes * class size); the per-class table is tiny and joined back."""
    sizes = materialise(df.groupBy(label).agg(F.count("*").alias("_n")), "classes")
    total = sizes.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    weights = sizes.select(label, (F.lit(float(total["n"])) / (F.lit(total["k"]) * F.col("_n"))).alias(out))
    return df.join(weights, label)


def train_classifier(df: DataFrame, label: str, max_iter: int = 50) -> LogisticRegressionModel:
    """Multi-class logistic regression on ``features`` with balanced class weights."""
    return LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter).fit(with_class_weights(df, label))


def save_artifacts(spark, model, path: str, config: dict, metrics: dict[str, float]) -> None:
    """Model, config and metrics under one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(k, str(v)) for k, v in config.items()], "name string, value string").write.mode("overwrite").json(f"{path}/config")
    spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "name string, value double").write.mode("overwrite").json(f"{path}/metrics")


def load_artifacts(spark, kind: type, path: str) -> tuple[object, dict[str, str], dict[str, float]]:
    """Model, config and metrics; ``kind`` is the model class."""
    model = kind.load(f"{path}/model")
    config = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/config").collect()}
    metrics = {r["name"]: r["value"] for r in spark.read.schema("name string, value double").json(f"{path}/metrics").collect()}
    return model, config, metrics
