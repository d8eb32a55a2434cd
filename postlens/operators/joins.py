"""Joins between jobs, embeddings, citations and lookup tables.

No join carries a broadcast hint: the planner broadcasts a side when its size is below the threshold and
shuffles both otherwise, with skewed partitions split at run time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.dedup import latest_per_key


def pending_keys(
    jobs: DataFrame,
    embedded: DataFrame,
    keys: list[str],
    version: str,
    tie_break: list[str],
    target_day: dt.date | None = None,
    limit: int | None = None,
    join_on: list[str] | None = None,
) -> DataFrame:
    """Latest jobs without an embedding.

    ``target_day`` filters before the newest version is chosen, so a job counts with its newest version of
    that day. The anti join needs the keys of the embedded side only (``join_on``, by default all keys).
    """
    if target_day is not None:
        start = dt.datetime.combine(target_day, dt.time())
        jobs = jobs.filter((F.col(version) >= F.lit(start)) & (F.col(version) < F.lit(start + dt.timedelta(days=1))))
    on = join_on or keys
    pending = latest_per_key(jobs, keys, [version, *tie_break]).join(embedded.select(*on), on, "left_anti")
    if limit is not None:
        pending = pending.orderBy(*keys).limit(limit)
    return pending


def feature_join(latest: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """All latest jobs with their embedding where there is one."""
    return latest.join(embeddings, keys, "left")


def join_latest(hits: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the latest version of their job."""
    return hits.join(latest, keys, "inner")


def reference_lookup(embeddings: DataFrame, jobs: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Embedding and job of each wanted key; keys without either are left out."""
    return wanted.select(*keys).distinct().join(embeddings, keys, "inner").join(jobs, keys, "inner")


def uncited_sources(cited: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """Cited jobs that the context of the same answer does not hold."""
    return cited.distinct().join(context.select(*keys), keys, "left_anti")


def map_lookup(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, default: Column, out: str) -> DataFrame:
    """Add ``out``: the mapped value, or ``default``."""
    named = mapping.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(named, df[col] == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_value"), default)).drop("_key", "_value")


def job_details(jobs: DataFrame, keys: list[str], wanted: DataFrame, version: str, tie_break: list[str]) -> DataFrame:
    """The latest full record of each wanted key."""
    return latest_per_key(jobs.join(wanted.select(*keys).distinct(), keys, "left_semi"), keys, [version, *tie_break])
