"""Embedding jobs and checks on stored embeddings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import vectors
from postlens.functions.text import strip_ws
from postlens.operators.filters import embedding_text
from postlens.operators.joins import pending_keys

EMBEDDING_DIM = 384
BATCH = 32


def hashing_embedder(dim: int = EMBEDDING_DIM) -> Callable[[DataFrame, str, str], DataFrame]:
    """Default embedding: hashed word counts, scaled to unit length.

    Nothing is fitted, so a text has the same vector in every run, batch or stream. A text without words gets zeros.
    """

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern="[\\p{L}\\p{N}]+", gaps=False).transform(df)
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(words)
        scaled = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
        return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_unit")

    return embed


def embed_queries(
    queries: DataFrame, embed_fn: Callable[[DataFrame, str, str], DataFrame], text: str = "text", max_chars: int | None = None, out: str = "embedding"
) -> DataFrame:
    """Query texts as unit vectors, by the model of the table they search: stripped, those under three characters left out.

    ``max_chars`` cuts longer texts for models with a limit.
    """
    stripped = strip_ws(F.col(text))
    asked = queries.withColumn(text, stripped if max_chars is None else F.substring(stripped, 1, max_chars)).filter(F.length(text) >= 3)
    embedded = embed_fn(asked, text, "_raw")
    return vectors.with_unit_vector(embedded, "_raw", out).drop("_raw")


def model_embedder(make_model: Callable, batch: int = BATCH) -> Callable[[DataFrame, str, str], DataFrame]:
    """Embedding through a model: ``make_model`` returns a function from an array of texts to a matrix.

    It is called once per Python worker; texts arrive in batches.
    """

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
        return df.withColumn(out, predict(text))

    return embed


def embed_table(
    jobs: DataFrame,
    embedded: DataFrame,
    keys: list[str],
    version: str,
    tie_break: list[str],
    title: str,
    description: str,
    embed_fn: Callable[[DataFrame, str, str], DataFrame],
    model_name: str,
    created: Column | None = None,
    target_day: dt.date | None = None,
    limit: int | None = None,
    read: int | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Embeddings of the latest jobs that have none: (keys, model_name, embedding, created_at).

    ``read`` and ``keep`` cut descriptions for models with a short input. Nothing is written; append the result to the embedding table, or count it for a dry run.
    """
    pending = pending_keys(jobs, embedded, keys, version, tie_break, target_day, limit)
    texts = embedding_text(pending, title, description, "_text", read, keep).select(*keys, "_text")
    return embed_fn(texts, "_text", "embedding").select(
        *keys,
        F.lit(model_name).alias("model_name"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        (F.current_timestamp() if created is None else created).alias("created_at"),
    )


def embedding_quality(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: dimensions, value range and spread, norm statistics, and whether vectors have unit length.

    Each vector is folded to a few numbers in place; nothing is exploded or shuffled but one partial row.
    """
    v = F.col(vec)
    folded = df.filter(v.isNotNull()).select(
        F.size(v).alias("d"),
        F.array_min(v).cast("double").alias("lo"),
        F.array_max(v).cast("double").alias("hi"),
        vectors.sum_of(v).alias("s"),
        vectors.sum_of_squares(v).alias("q"),
    )
    length = F.sqrt("q")
    totals = folded.agg(
        F.count("*").alias("n"),
        F.max("d").alias("dims"),
        F.min("lo").alias("value_min"),
        F.max("hi").alias("value_max"),
        (F.sum("s") / F.sum("d")).alias("value_mean"),
        (F.sum("q") / F.sum("d")).alias("_square"),
        F.avg(length).alias("norm_mean"),
        F.stddev_pop(length).alias("norm_std"),
        F.min(length).alias("norm_min"),
        F.max(length).alias("norm_max"),
    )
    spread = F.sqrt(F.col("_square") - F.col("value_mean") * F.col("value_mean"))
    digits = ["value_min", "value_max", "value_mean", "value_std", "norm_mean", "norm_std", "norm_min", "norm_max"]
    shown = totals.withColumn("value_std", spread).withColumn("is_unit", F.abs(F.col("norm_mean") - 1.0) < 0.01)
    return shown.select("n", "dims", *[F.round(c, 5).alias(c) for c in digits], "is_unit")


def intra_group_similarity(df: DataFrame, group: str, vec: str = "embedding", top: int | None = None) -> DataFrame:
    """Mean cosine over all pairs of a group, for all groups or the ``top`` largest; null below two members.

    For unit vectors the sum over all pairs follows from the length of the vector sum, so no pair is ever
    formed: one sum of vectors per group is enough.
    """
    unit = vectors.with_unit_vector(df.filter(F.col(vec).isNotNull()), vec, "_unit")
    featured = unit.select(group, array_to_vector(F.col("_unit").cast("array<double>")).alias("_vector"))
    sums = featured.groupBy(group).agg(F.count("*").alias("count"), vector_to_array(Summarizer.sum(F.col("_vector"))).alias("_sum"))
    groups = sums.select(group, "count", vectors.sum_of_squares(F.col("_sum")).alias("_square"))
    if top is not None:
        groups = groups.orderBy(F.desc("count"), group).limit(top)
    n = F.col("count")
    mean = F.when(n > 1, (F.col("_square") - n) / (n * (n - 1)))
    return groups.select(group, "count", F.round(mean, 6).alias("avg_similarity"))
