"""The training runs in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.models import classification_metrics, kmeans_fit, regression_metrics, save_artifacts, train_classifier, train_pay_model
from postlens.session import materialise


def train_all(
    spark: SparkSession, pay: DataFrame, pay_features: list[str], roles: DataFrame, vectors: DataFrame, vec: str, path: str, trees: int = 500, clusters: int = 10, tries: int = 10
) -> DataFrame:
    """Pay model, role classifier and clustering; artifacts under ``path``, one metrics row per figure.

    ``pay`` and ``roles`` hold (features, label), ``vectors`` an embedding column. A fifth of ``pay``, drawn as its rows are
    written, decides when the boosting stops. Rows are made once, as the learners and the metrics read them several times.
    """
    pay = materialise(pay.withColumn("_held_out", F.rand(seed=42) < 0.2), "pay")
    train, held_out = pay.where(~F.col("_held_out")), pay.where("_held_out")
    roles = materialise(roles.select("features", "label"), "roles")
    pay_model = train_pay_model(train, pay_features, validation=held_out, stored=True, trees=trees)
    pay_row = regression_metrics(pay_model.predict(pay), "label", "prediction", "train_").first().asDict()
    save_artifacts(spark, pay_model.model, f"{path}/pay", {"kind": pay_model.kind, "features": ",".join(pay_features)}, pay_row)
    classifier = train_classifier(roles, "label")
    role_row = classification_metrics(classifier.transform(roles), "label", "prediction").first().asDict()
    save_artifacts(spark, classifier, f"{path}/roles", {"classes": classifier.numClasses}, role_row)
    clustering = kmeans_fit(vectors, vec, clusters, tries=tries)
    save_artifacts(spark, clustering.model, f"{path}/clusters", {"k": clusters}, clustering.metrics)
    rows = [(name, k, float(v)) for name, row in (("pay", pay_row), ("roles", role_row), ("clusters", clustering.metrics)) for k, v in row.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double").withColumn("path", F.lit(path))
