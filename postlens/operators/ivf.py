"""Inverted-file vector search: k-means lists as data layout, a few lists probed per query."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.search import (
    GRID_BLOCK_ROWS,
    MAX_QUERY_BYTES,
    Best,
    _batch_of,
    _hit_schema,
    distances,
    grid_hits,
    id_array,
    matrix_of,
    query_block,
    score_into,
)
from postlens.session import materialise


@dataclass
class IvfIndex:
    """Centroids and the rows with their list; ``rows`` has (id, embedding, list_id)."""

    model: KMeansModel
    rows: DataFrame
    id_col: str
    metric: str

    @property
    def centroids(self) -> np.ndarray:
        return np.array(self.model.clusterCenters()) if self.model else np.zeros((0, 0))


def default_lists(n: int) -> int:
    """The square-root rule."""
    return max(1, int(math.sqrt(n)))


def assign_lists(model: KMeansModel, rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Add ``list_id``, the nearest centroid; also how new vectors join an index without a rebuild."""
    featured = rows.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    return model.transform(featured).drop("_features")


def ivf_build(
    corpus: DataFrame,
    num_lists: int = 100,
    id_col: str = "vec_id",
    vec: str = "embedding",
    metric: str = "cosine",
    seed: int = 42,
    max_iter: int = 20,
    path: str | None = None,
) -> IvfIndex:
    """Train the lists and store the rows by list. ``path`` keeps the index; otherwise it goes to scratch.

    A corpus without vectors gives an index without lists, which finds nothing.
    """
    if metric == "dot_product":
        raise ValueError("lists are trained for cosine or euclidean distance")
    rows = corpus.select(id_col, vec).filter(F.col(vec).isNotNull())
    if rows.isEmpty():
        return IvfIndex(None, rows.withColumn("list_id", F.lit(None).cast("int")), id_col, metric)
    featured = rows.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    measure = "cosine" if metric == "cosine" else "euclidean"
    trainer = KMeans(k=num_lists, seed=seed, maxIter=max_iter, distanceMeasure=measure, featuresCol="_features", predictionCol="list_id")
    model = trainer.fit(featured.select("_features"))
    listed = model.transform(featured).drop("_features")
    if path is None:
        stored = materialise(listed, "ivf")
    else:
        listed.write.mode("overwrite").partitionBy("list_id").parquet(path)
        stored = corpus.sparkSession.read.parquet(path)
    return IvfIndex(model, stored, id_col, metric)


def probed_lists(index: IvfIndex, queries: DataFrame, qid: str, qvec: str, nprobe: int) -> DataFrame:
    """The ``nprobe`` lists nearest to each query, one row per query and list."""
    centroids, metric = index.centroids, index.metric
    query_type = queries.schema[qid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(distances(matrix_of(batch.column(1)), centroids, metric), axis=1, kind="stable")[:, :nprobe]
            taken = np.repeat(np.arange(len(order)), order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(taken)), batch.column(1).take(pa.array(taken)), pa.array(order.ravel().astype(np.int32))],
                names=[qid, qvec, "list_id"],
            )

    held = queries.filter(F.col(qvec).isNotNull()).select(qid, F.col(qvec).cast("array<double>").alias(qvec))
    return held.mapInArrow(run, f"{qid} {query_type}, {qvec} array<double>, list_id int")


def ivf_search(
    index: IvfIndex,
    queries: DataFrame,
    k: int,
    nprobe: int,
    qid: str = "query_id",
    qvec: str = "embedding",
    max_query_bytes: int = MAX_QUERY_BYTES,
    grid_block_rows: int = GRID_BLOCK_ROWS,
) -> DataFrame:
    """The k nearest rows among the ``nprobe`` lists nearest to each query.

    With a query set of bounded size rows stay where they are: a task scores each row only against the
    queries that probe its list, so a list with a large share of all rows is still worked on by all tasks
    that read it. Larger query sets meet the rows list by list, in blocks.
    """
    id_col, metric = index.id_col, index.metric
    schema = _hit_schema(index.rows, queries, id_col, qid)
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    nearest = Window.partitionBy(qid).orderBy("distance", id_col)
    stored = index.rows.select(id_col, "embedding", F.col("list_id").cast("int").alias("list_id"))
    block = query_block(queries, qid, qvec, max_query_bytes)
    if block is None:
        asked = materialise(probed_lists(index, queries, qid, qvec, nprobe), "probes")

        def blocks(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("list_id").agg(F.ceil(F.count("*") / grid_block_rows).alias(name))

        sizes = materialise(blocks(stored, "_row_blocks").join(blocks(asked, "_query_blocks"), "list_id"), "grid")
        sized = [side.join(sizes, "list_id") for side in (stored, asked)]
        hits = grid_hits(*sized, schema, k, id_col, "embedding", qid, qvec, metric, "list_id")
        return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    order = np.argsort(distances(block.vectors, index.centroids, metric), axis=1, kind="stable")[:, :nprobe]
    probing: dict[int, list[int]] = {}
    for query, lists in enumerate(order):
        for list_id in lists:
            probing.setdefault(int(list_id), []).append(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(block.ids))
        for batch in batches:
            ids = id_array(batch.column(0))
            rows, lists = matrix_of(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for list_id in np.unique(lists):
                here = np.flatnonzero(lists == list_id)
                score_into(best, ids[here], rows[here], block.vectors, metric, probing.get(int(list_id), []))
        yield _batch_of(schema, best.rows(block.ids))

    if len(probing) < len(index.centroids):
        stored = stored.filter(F.col("list_id").isin(sorted(probing)))
    hits = stored.mapInArrow(run, schema)
    return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def ivf_health(index: IvfIndex) -> DataFrame:
    """Rows per list against the even share, and whether the number of lists is far from the square root."""
    if not len(index.centroids):
        return index.rows.sparkSession.createDataFrame([], "list_id int, n_rows long, load double, num_lists int, optimal_lists int, rebuild boolean")
    counts = index.rows.groupBy("list_id").agg(F.count("*").alias("n_rows"))
    total = index.rows.count()
    lists = len(index.centroids)
    optimal = default_lists(total)
    every = index.rows.sparkSession.range(lists).select(F.col("id").cast("int").alias("list_id"))
    joined = every.join(counts, "list_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return joined.select(
        "list_id",
        "n_rows",
        F.round(F.col("n_rows") / F.lit(total / lists), 3).alias("load"),
        F.lit(lists).alias("num_lists"),
        F.lit(optimal).alias("optimal_lists"),
        F.lit(optimal > 2 * lists).alias("rebuild"),
    )


def recall_of(found: DataFrame, truth: DataFrame, qid: str, id_col: str) -> DataFrame:
    """Mean share of the true neighbours that were found."""
    marked = truth.select(qid, id_col).join(found.select(qid, id_col, F.lit(1).alias("hit")), [qid, id_col], "left")
    per_query = marked.groupBy(qid).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per_query.agg(F.round(F.avg("recall"), 4).alias("recall"), F.count("*").alias("queries"))


def recall_sweep(
    corpus: DataFrame, queries: DataFrame, truth: DataFrame, k: int, num_lists: list[int], nprobes: list[int], id_col: str, qid: str
) -> DataFrame:
    """recall@k against the flat search ``truth`` for every number of lists and of probes."""
    results = None
    for lists in num_lists:
        index = ivf_build(corpus, lists, id_col=id_col)
        for nprobe in nprobes:
            if nprobe > lists:
                continue
            row = recall_of(ivf_search(index, queries, k, nprobe, qid), truth, qid, id_col)
            row = row.select(F.lit(lists).alias("num_lists"), F.lit(nprobe).alias("nprobe"), "recall", "queries")
            results = row if results is None else results.unionByName(row)
    return results
