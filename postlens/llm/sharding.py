"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, Fisher-Yates within each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from postlens.llm.worker import rest_of

#: Text bytes that a bucket holds on average. A task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20

#: Columns that the files hold besides those of the documents.
MADE = ("shard", "bucket", "place")


def text_size(text: Column) -> Column:
    """The UTF-8 bytes of a text (null: none) and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash for this key. One more shard takes keys from all others, and moves no other key."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.xxhash64(key, F.lit(seed), k).alias("score"), k.alias("shard")))
    return F.array_max(scores)["shard"]


def write_shards(
    docs: DataFrame, path: str, shards: int = 16, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES
) -> StructType:
    """Write ``docs`` below ``path`` as ``shard=0`` to ``shard=n-1``, each in a seeded random order.

    Id and number of shards decide the shard. A first pass over ids and sizes finds how many buckets of ``bucket_bytes``
    a shard takes (one row for each shard comes to the driver). The first shuffle pass scatters the rows of a shard over
    its buckets by a seeded hash of id and row number, so that neither equal ids nor equal rows share a bucket. The
    second takes one bucket at a time, shuffles its rows by Fisher-Yates and writes them as one file, with the number of
    the bucket and the place in it. ``docs`` is a stored table: its row numbers must be the same if a task runs again.
    Rows without id form one key. Null texts count one byte. An empty table gives an empty folder. Returns the schema of
    the files. Columns named ``shard``,
    ``bucket`` or ``place`` are replaced.
    """
    kept = rest_of(docs.columns, *MADE)
    dealt = docs.select(*kept, shard_of(F.col(id_col), shards, seed).alias("shard"))
    sums = dealt.groupBy("shard").agg(F.sum(text_size(F.col(text_col))).alias("bytes")).collect()
    counts = {row["shard"]: max(1, math.ceil(row["bytes"] / bucket_bytes)) for row in sums}
    first, total = [], 0
    for shard in range(shards):
        first.append(total)
        total += counts.get(shard, 1)
    number = F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id(), id_col)
    begin, size = (F.array(*map(F.lit, values)) for values in (first, [counts.get(k, 1) for k in range(shards)]))
    scattered = dealt.select(*kept, "shard", number.alias("_llm_at")).withColumn(
        "bucket", F.get(begin, F.col("shard")) + F.pmod("_llm_at", F.get(size, F.col("shard"))).cast("int")
    )
    ordered = scattered.repartitionById(total, "bucket").sortWithinPartitions("bucket", "_llm_at")
    rows = ordered.groupBy("shard", "bucket").agg(F.collect_list(F.struct(*kept)).alias("_llm_all"))
    mixed = rows.select("shard", "bucket", F.shuffle("_llm_all", seed).alias("_llm_all"))
    placed = mixed.select("shard", "bucket", F.posexplode("_llm_all").alias("place", "_llm_row")).select("shard", "bucket", "place", "_llm_row.*")
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return placed.schema


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows with ``shard`` and ``slot``, their gapless place in it: bucket after bucket, in the order of the files."""
    rows = spark.read.schema(schema).parquet(path)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place")).drop("bucket", "place", "before")
