"""Versions, duplicates, ordering and splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The newest version per key. ``order_by`` lists the version column first, then tie-breaks, all descending.

    Spark plans a group limit below the shuffle, so every map task sends at most one row per key and a
    key with very many versions stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def drop_reingested(df: DataFrame, keys: list[str], ingested: str, tie_break: list[str] | None = None) -> DataFrame:
    """Keep the newest ingestion of every delivered version; ``keys`` include the version timestamp."""
    return latest_per_key(df, keys, [ingested, *(tie_break or [])])


def content_hash(*cols: str) -> Column:
    """Stable hash of the listed text columns, null read as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def content_groups(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """Per distinct content: hash, smallest id, number of copies. Only hashes and ids are shuffled."""
    hashed = df.select(F.col(id_col), content_hash(*text_cols).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def dedup_by_content(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """One full row per distinct content, the one with the smallest id."""
    return df.join(content_groups(df, id_col, text_cols).select(id_col), id_col, "left_semi")


def duplicate_report(df: DataFrame, keys: list[str], limit: int | None = 10) -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    if limit is None:
        return found
    return found.orderBy(F.desc("n"), *keys).limit(limit)


def top_n(df: DataFrame, score: str, n: int, tie_break: list[str], per: list[str] | None = None) -> DataFrame:
    """The n highest rows, over all or per group."""
    order = [F.col(score).desc(), *[F.col(c) for c in tie_break]]
    if per is None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def recent_sample(
    df: DataFrame, ts: str, as_of: dt.datetime, within: dt.timedelta, n: int, tie_break: list[str]
) -> DataFrame:
    """The newest n rows of the time span before ``as_of``."""
    recent = df.filter((F.col(ts) >= F.lit(as_of - within)) & (F.col(ts) <= F.lit(as_of)))
    return recent.orderBy(F.col(ts).desc(), *tie_break).limit(n)


def time_split(df: DataFrame, time_col: str, key_col: str, test_size: float = 0.2) -> DataFrame:
    """Add ``split``: the first int(n * (1 - test_size)) rows by time are 'train', the rest 'test'.

    Rows of one timestamp are ordered by the md5 of their unique key. The cut is found by counting, level by
    level (day, second, microsecond, key prefix, key), and going down only into the group that
    holds the cut. No row is sorted, and each counted table is small however many rows share one timestamp.
    """
    wanted = int(df.count() * (1 - test_size))
    at = F.coalesce(F.col(time_col).cast("timestamp_ntz"), F.lit(dt.datetime(9999, 12, 31)))
    digest = F.md5(F.col(key_col).cast("string"))
    levels = [
        F.to_date(at),
        F.date_trunc("second", at),
        at,
        F.substring(digest, 1, 4),
        digest,
    ]
    is_train, inside = F.lit(False), F.lit(True)
    for level in levels:
        counts = df.filter(inside).groupBy(level.alias("v")).agg(F.count("*").alias("n"))
        running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
        cut = running.filter(F.col("upto") >= wanted).orderBy("v").first()
        if cut is None or wanted == 0:
            break
        is_train = is_train | (inside & (level < F.lit(cut["v"])))
        inside = inside & (level == F.lit(cut["v"]))
        wanted -= cut["upto"] - cut["n"]
        if wanted == cut["n"]:
            is_train = is_train | inside
            break
    return df.withColumn("split", F.when(is_train, "train").otherwise("test"))
