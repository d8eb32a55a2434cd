"""Feature columns, training matrices, imputation and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.dedup import latest_per_key
from postlens.operators.stats import exact_quantiles

MAX_CATEGORIES = 1000
SECONDS_PER_DAY = 86400


def numeric_features(
    df: DataFrame,
    as_of: Column,
    low: str | None = None,
    high: str | None = None,
    title: str | None = None,
    description: str | None = None,
    posted: str | None = None,
) -> DataFrame:
    """Add pay, length and age features for the columns that are given. ``as_of`` stands for now."""
    made: dict[str, Column] = {}
    if low and high:
        a, b = F.col(low), F.col(high)
        made.update(
            salary_min=a, salary_max=b, salary_mid=(a + b) / 2, salary_range=b - a, salary_min_log=F.log1p(a), salary_max_log=F.log1p(b)
        )
    if description:
        made["description_length"] = F.length(F.coalesce(F.col(description), F.lit("")))
    if title:
        made["title_length"] = F.length(F.coalesce(F.col(title), F.lit("")))
    if posted:
        seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col(posted).cast("timestamp"))
        made["days_since_posted"] = F.floor(seconds / SECONDS_PER_DAY)
    return df.withColumns(made)


def category_values(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list[str]:
    """Sorted values of a categorical column, null read as 'unknown'; fails beyond ``max_categories``."""
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias("v")).distinct()
    found = values.orderBy("v").limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} values; name it in the categories of training_matrix instead")
    return [r["v"] for r in found]


def one_hot(df: DataFrame, cols: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """Add a 0/1 column ``{col}_{value}`` per value. ``values`` reuses the categories of a fit."""
    made = {}
    for col in cols:
        filled = F.coalesce(F.col(col).cast("string"), F.lit("unknown"))
        for value in values[col] if values else category_values(df, col):
            made[f"{col}_{value}"] = (filled == value).cast("int")
    return df.withColumns(made)


def training_matrix(
    df: DataFrame,
    features: list[str],
    target: str,
    embedding: str | None = None,
    leaks: list[str] | None = None,
    keep_leaks: bool = False,
    categories: list[str] | None = None,
) -> DataFrame:
    """(features vector, label): the target is no feature, rows without it are dropped.

    ``leaks`` lists features the target is computed from; they are left out unless ``keep_leaks``. ``categories`` become
    sparse indicators of their values in sorted order, null as 'unknown', however many there are. A row without
    embedding gets zeros in its place; if no row has one, the matrix goes without.
    """
    used = [f for f in features if f != target and (keep_leaks or f not in (leaks or []))]
    rows = df.filter(F.col(target).isNotNull())
    inputs = list(used)
    for col in categories or []:
        rows = rows.withColumn("_value", F.coalesce(F.col(col).cast("string"), F.lit("unknown")))
        rows = StringIndexer(inputCol="_value", outputCol="_index", stringOrderType="alphabetAsc").fit(rows).transform(rows)
        encoder = OneHotEncoder(inputCol="_index", outputCol=f"_is_{col}", dropLast=False).fit(rows)
        rows = encoder.transform(rows).drop("_value", "_index")
        inputs.append(f"_is_{col}")
    known = rows.filter(F.col(embedding).isNotNull()).select(F.size(embedding)).first() if embedding else None
    if known:
        width = known[0]
        filled = F.coalesce(F.col(embedding).cast("array<double>"), F.array_repeat(F.lit(0.0), width))
        rows = rows.withColumn("_embedding", array_to_vector(filled))
        rows = VectorSizeHint(inputCol="_embedding", size=width, handleInvalid="optimistic").transform(rows)
        inputs.append("_embedding")
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return assembler.transform(rows).withColumn("label", F.col(target).cast("double")).drop("_embedding", *[f"_is_{c}" for c in categories or []])


def feature_view(
    jobs: DataFrame,
    embeddings: DataFrame,
    keys: list[str],
    versions: list[str],
    as_of: Column,
    low: str,
    high: str,
    title: str,
    description: str,
    posted: str,
) -> DataFrame:
    """Latest jobs with derived numbers and their embedding, if any."""
    latest = latest_per_key(jobs, keys, versions)
    derived = latest.withColumns(
        {
            "salary_mid_monthly": (F.col(low) + F.col(high)) / 2,
            "salary_range": F.col(high) - F.col(low),
            "description_length": F.length(description),
            "title_length": F.length(title),
            "days_since_posted": F.timestamp_diff("DAY", F.col(posted), as_of),
        }
    )
    return derived.join(embeddings, keys, "left")


def load_features(view: DataFrame, where: Column | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of the feature view that have an embedding."""
    rows = view.filter(F.col("embedding").isNotNull())
    if where is not None:
        rows = rows.filter(where)
    return rows if limit is None else rows.orderBy(*(order or [])).limit(limit)


@dataclass
class Scaling:
    """Median, mean and deviation per column, learnt once and applied to any table."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        filled = self.impute(df)
        return filled.withColumns(
            {c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0) for c in self.medians}
        )


def fit_scaling(df: DataFrame, cols: list[str]) -> Scaling:
    """Exact medians for gaps, then mean and population deviation of the filled columns.

    A column without any value has median, mean and deviation zero, so that it becomes zeros.
    """
    parts = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.inline(F.array(*parts)))
    medians = {r["field"]: r["q0"] for r in exact_quantiles(long, "v", [0.5], ["field"]).collect()}
    scaling = Scaling({c: medians.get(c, 0.0) for c in cols}, {}, {})
    row = scaling.impute(df).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    ).first()
    scaling.means = {c: row[f"m_{c}"] or 0.0 for c in cols}
    scaling.deviations = {c: row[f"s_{c}"] or 0.0 for c in cols}
    return scaling
