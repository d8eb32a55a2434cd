"""Exact vector search, hybrid ranking and similar items.

Every task scores its rows against all query vectors with one matrix product per batch and keeps its own k
best per query; only those candidates are shuffled. Query sets that are too large to ship to every task go
through a block grid instead, where each task meets one block of queries and one block of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import strip_ws
from postlens.operators.dedup import latest_per_key
from postlens.session import materialise

METRICS = ("cosine", "euclidean", "dot_product")
MAX_QUERY_BYTES = 64 << 20
GRID_BLOCK_ROWS = 4096
#: Single-precision vectors of a block, where a search has no lists: every block of one side meets all of the other.
GRID_BLOCK_BYTES = 16 << 20
SCORES_AT_ONCE = 4_000_000
#: Queries that a slice of rows is scored against at once.
QUERIES_AT_ONCE = 4096
#: Pairs of a row and a query that are compared one by one at once.
PAIRS_AT_ONCE = 1 << 16


def matrix_of(column) -> np.ndarray:
    """An Arrow list column of equal-length vectors as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row (first axis) to every query; cosine 1 - cos (1 where a vector is zero), dot product negated.

    Rounded to ten digits: a matrix product may differ in the last bits between equal rows, and copies of a
    vector have to tie.
    """
    products = rows @ queries.T
    if metric == "dot_product":
        return np.round(-products, 10)
    if metric == "euclidean":
        squares = (rows**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2 * products
        return np.sqrt(np.maximum(np.round(squares, 10), 0.0))
    lengths = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.round(1.0 - products / np.where(lengths > 0, lengths, 1.0), 10)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; a row of zeros stays."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def true_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true entries of a matrix, looked for by eight entries at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    near = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])]), mask.shape[1])


def id_array(column) -> np.ndarray:
    """Ids as an array that sorts like the column; keys of several columns become tuples, those of one its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(column.type) and column.type.num_fields == 1:
        column = column.flatten()[0]
    if pa.types.is_integer(column.type) and column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.to_pylist()
    found = np.empty(len(values), dtype=object)
    found[:] = [tuple(v.values()) for v in values] if pa.types.is_struct(column.type) else values
    return found


@dataclass
class Best:
    """The k nearest rows per query seen so far, a row of ``distance`` and ``id`` for each; equal distances are settled by id.

    What an addition costs depends on the queries that it improves, not on all that are held.
    """

    k: int
    count: int

    def __post_init__(self):
        self.distance = np.full((self.count, self.k), np.inf)
        self.id = np.zeros((self.count, self.k), dtype=np.int64)
        self.held = np.zeros(self.count, dtype=np.int64)
        self.limit = np.full(self.count, np.inf)

    def add(self, wanted: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Take in the distances of some rows (first axis) to the ``wanted`` queries."""
        limit = self.limit[wanted]
        if len(ids) > self.k and not np.isfinite(limit).all():
            limit = np.fmin(limit, np.partition(dist, self.k - 1, axis=0)[self.k - 1])
        row, column = np.nonzero(dist <= limit)
        self.take(wanted[column], ids[row], dist[row, column])

    def take(self, query: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Take in single rows, each with the query that it was compared with."""
        if query.size == 0:
            return
        if self.id.dtype != ids.dtype:
            self.id = self.id.astype(ids.dtype)
        touched = np.unique(query)
        old, place = np.nonzero(np.arange(self.k) < self.held[touched, None])
        query = np.concatenate([touched[old], query])
        distance = np.concatenate([self.distance[touched[old], place], distance])
        held = np.concatenate([self.id[touched[old], place], ids])
        first = np.argsort(held, kind="stable")
        order = first[np.lexsort((distance[first], query[first]))]
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
        kept, place = order[place < self.k], place[place < self.k]
        self.distance[query[kept], place], self.id[query[kept], place] = distance[kept], held[kept]
        self.held[touched] = np.bincount(np.searchsorted(touched, query[kept]), minlength=len(touched))
        full = touched[self.held[touched] == self.k]
        self.limit[full] = self.distance[full, -1]

    def rows(self, query_ids: list) -> tuple[list, list, list]:
        query, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return [query_ids[q] for q in query.tolist()], self.id[query, place].tolist(), self.distance[query, place].tolist()


def places_of(ids: list) -> dict:
    """Where each query id stands; a key of several columns as a tuple."""
    places: dict = {}
    for place, value in enumerate(ids):
        parts = tuple(value.values()) if isinstance(value, dict) else (value,)
        places.setdefault(parts if len(parts) > 1 else parts[0], []).append(place)
    return places


def score_into(best: Best, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, metric: str, wanted=None, own: dict | None = None) -> None:
    """Score a batch, a slice at a time so that the score matrix stays small; with ``own`` places, no row for its own id.

    For cosine, a product in single precision leaves out what cannot be among the best of a query that has ``k`` rows; its error
    is bounded by the width of the vectors, and the distances of all others are computed in full.
    """
    wanted = np.arange(len(queries)) if wanted is None else np.asarray(list(wanted), dtype=np.int64)
    if len(wanted) == 0 or len(ids) == 0:
        return
    itself = [(row, place) for row, value in enumerate(ids.tolist()) for place in own.get(value, ())] if own is not None else []
    own_row, own_place = np.array(itself, dtype=np.int64).reshape(-1, 2).T
    spare = 2 * (rows.shape[1] + 4) * 2.0**-24
    if metric == "cosine":
        short = unit(rows).astype(np.float32)
        lengths, query_lengths = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)

    def compare(some: np.ndarray, part: slice) -> None:
        dist = distances(rows[part], queries[some], metric)
        at = np.full(len(queries), -1)
        at[some] = np.arange(len(some))
        here = (own_row >= part.start) & (own_row < part.stop) & (at[own_place] >= 0)
        dist[own_row[here] - part.start, at[own_place[here]]] = np.nan
        best.add(some, ids[part], dist)

    for some in np.array_split(wanted, -(-len(wanted) // QUERIES_AT_ONCE)):
        step = max(1, SCORES_AT_ONCE // len(some))
        asked = unit(queries[some]).astype(np.float32).T.copy() if metric == "cosine" else None
        for start in range(0, len(ids), step):
            part = slice(start, min(start + step, len(ids)))
            ready = np.isfinite(best.limit[some])
            if metric != "cosine" or not ready.any():
                compare(some, part)
                continue
            if not ready.all():
                compare(some[~ready], part)
            least = np.where(ready, 1.0 - best.limit[some] - spare, np.inf).astype(np.float32)
            row, column = true_places(short[part] @ asked >= least)
            if len(row) > (part.stop - start) * len(some) // 16:
                compare(some[ready], part)
                continue
            row, query = row + start, some[column]
            if len(itself):
                here = slice(*np.searchsorted(own_row, [part.start, part.stop]))
                kept = ~np.isin(row * len(queries) + query, own_row[here] * len(queries) + own_place[here])
                row, query = row[kept], query[kept]
            for pairs in np.array_split(np.arange(len(row)), -(-len(row) // PAIRS_AT_ONCE)) if len(row) else []:
                one, other = row[pairs], query[pairs]
                length = lengths[one] * query_lengths[other]
                dist = np.round(1.0 - np.einsum("ij,ij->i", rows[one], queries[other]) / np.where(length > 0, length, 1.0), 10)
                kept = dist <= best.limit[other]
                best.take(other[kept], ids[one[kept]], dist[kept])


@dataclass
class QueryBlock:
    ids: list
    vectors: np.ndarray


def query_block(queries: DataFrame, qid: str, qvec: str, max_bytes: int) -> QueryBlock | None:
    """The query set as one matrix, or None when it is larger than ``max_bytes``."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(qvec)).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > max_bytes:
        return None
    held = queries.select(qid, F.col(qvec).cast("array<double>").alias(qvec)).filter(F.col(qvec).isNotNull()).toArrow()
    return QueryBlock(held.column(0).to_pylist(), matrix_of(held.column(1)))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _hit_schema(corpus: DataFrame, queries: DataFrame, id_col: str, qid: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(qid, queries.schema[qid].dataType),
            T.StructField(id_col, corpus.schema[id_col].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _batch_of(schema: T.StructType, columns: tuple[list, list, list], told: pa.Array | None = None) -> pa.RecordBatch:
    """Columns as a batch; ``told`` stands for the first of them."""
    as_struct = lambda v, names: v if isinstance(v, dict) else dict(zip(names, v if isinstance(v, tuple) else (v,)))
    arrays = [] if told is None else [told]
    for c, f in list(zip(columns, schema.fields))[len(arrays) :]:
        keyed = [as_struct(v, f.dataType.names) for v in c] if isinstance(f.dataType, T.StructType) else c
        arrays.append(pa.array(keyed, type=_arrow_type(f.dataType)))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def scan_best(schema: T.StructType, block: QueryBlock, k: int, metric: str, others: bool = False) -> Callable:
    """Per task: stream the rows past the query block, emit the task's k best per query; ``others``: of other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own = Best(k, len(block.ids)), places_of(block.ids) if others else None
        for batch in batches:
            ids = id_array(batch.column(0))
            score_into(best, ids, matrix_of(batch.column(1)), block.vectors, metric, own=own)
        yield _batch_of(schema, best.rows(block.ids))

    return run


def grid_hits(
    rows: DataFrame,
    asked: DataFrame,
    schema: T.StructType,
    k: int,
    id_col: str,
    vec: str,
    qid: str,
    qvec: str,
    metric: str,
    list_col: str = "_list",
    others: bool = False,
) -> DataFrame:
    """Rows against queries of the same list, block by block.

    Both sides carry ``_row_blocks`` and ``_query_blocks``, the number of blocks their list is cut into, so
    that every group holds one bounded block of each, whatever share of all rows a list has. Blocks are
    dealt out by a hash of the key, which a task that runs again repeats. Only the k best per query leave a group.
    """
    zero = F.lit(0).cast("bigint")

    def dealt(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        key = id_col if own == "_rb" else qid
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.col(own_blocks)))
        return placed.withColumn(other, F.explode(F.sequence(zero, F.col(other_blocks) - 1))).drop("_row_blocks", "_query_blocks")

    row_side = dealt(rows, "_rb", "_row_blocks", "_qb", "_query_blocks")
    query_side = dealt(asked, "_qb", "_query_blocks", "_rb", "_row_blocks")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(k, left.num_rows)
        if left.num_rows and right.num_rows:
            row_ids = id_array(right.column(id_col))
            own = places_of(left.column(qid).to_pylist()) if others else None
            score_into(best, row_ids, matrix_of(right.column(vec)), matrix_of(left.column(qvec)), metric, own=own)
        query, _ = np.nonzero(np.arange(k) < best.held[:, None])
        found = _batch_of(schema, best.rows(range(left.num_rows)), told=left.column(qid).combine_chunks().take(pa.array(query)))
        return pa.Table.from_batches([found])

    cells = [list_col, "_qb", "_rb"]
    return query_side.groupBy(*cells).cogroup(row_side.groupBy(*cells)).applyInArrow(meet, schema)


def grid_blocks(rows: int, queries: int, width: int, cores: int, block_rows: int | None) -> tuple[int, int]:
    """Into how many blocks rows and queries are cut: as few as their size allows, but for a few pairs of blocks to each core."""
    most = block_rows or max(1, GRID_BLOCK_BYTES // (4 * width))
    cut = [-(-rows // most), -(-queries // most)]
    if block_rows is None and 0 < cut[0] * cut[1] < 6 * cores:
        more = math.sqrt(6 * cores / (cut[0] * cut[1]))
        cut = [max(least, min(math.ceil(least * more), -(-n // GRID_BLOCK_ROWS))) for least, n in zip(cut, (rows, queries))]
    return cut[0], cut[1]


def knn_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec: str = "embedding",
    qid: str = "query_id",
    qvec: str = "embedding",
    metric: str = "cosine",
    max_query_bytes: int = MAX_QUERY_BYTES,
    grid_block_rows: int | None = None,
    others: bool = False,
) -> DataFrame:
    """The k nearest rows of every query: (qid, id, distance, rank), equal distances in id order.

    Query sets over ``max_query_bytes`` meet the rows in blocks of ``grid_block_rows``, by default as many as have
    GRID_BLOCK_BYTES, or fewer where that would leave cores idle. A block is sent once for each block of the other side. With ``others``, rows of the query's own id are left out, and an id counts once, by its least distance.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = corpus.select(id_col, vec).filter(F.col(vec).isNotNull())
    schema = _hit_schema(corpus, queries, id_col, qid)
    block = query_block(queries, qid, qvec, max_query_bytes)
    if block is None:
        asked = queries.filter(F.col(qvec).isNotNull()).select(qid, qvec)
        width = asked.agg(F.max(F.size(qvec))).first()[0] or 1
        row_blocks, query_blocks = grid_blocks(rows.count(), asked.count(), width, corpus.sparkSession.sparkContext.defaultParallelism, grid_block_rows)
        blocks = {"_row_blocks": F.lit(row_blocks).cast("bigint"), "_query_blocks": F.lit(query_blocks).cast("bigint"), "_list": F.lit(0)}
        hits = grid_hits(rows.withColumns(blocks), asked.withColumns(blocks), schema, k, id_col, vec, qid, qvec, metric, others=others)
    else:
        hits = rows.mapInArrow(scan_best(schema, block, k, metric, others), schema)
    if others:  # dealt by query alone, so that the ranks need no second exchange
        hits = (hits if block else hits.repartition(qid)).groupBy(qid, id_col).agg(F.min("distance").alias("distance"))
    nearest = Window.partitionBy(qid).orderBy("distance", id_col)
    return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def keyword_score(terms: Column, title: Column, description: Column, first: int | None = None) -> Column:
    """Share of the query terms found in title or description; ``first`` looks for that many only, as a share of all."""
    low_title, low_text = F.lower(title), F.lower(description)

    def found(term: Column) -> Column:
        return F.coalesce(F.contains(low_title, term), F.lit(False)) | F.coalesce(F.contains(low_text, term), F.lit(False))

    looked_for = terms if first is None else F.slice(terms, 1, first)
    return F.when(F.size(terms) > 0, F.size(F.filter(looked_for, found)) / F.size(terms)).otherwise(0.0)


def query_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda w: w != "")


def with_key(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Several id columns as one key, which compares column by column."""
    return df.withColumn(key, F.struct(*columns))


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    jobs: DataFrame,
    top_k: int = 10,
    weight: float = 0.7,
    where: Column | None = None,
    prefilter: bool = True,
    id_col: str | list[str] = "doc_id",
    title: str = "title",
    description: str = "text",
    versions: list[str] | None = None,
    qid: str = "query_id",
    first_terms: int | None = None,
) -> DataFrame:
    """Vector search, filter, and a blend of vector and keyword score, for a table of queries.

    ``queries`` has (qid, text, embedding), ``corpus`` (id, embedding). An id may consist of several columns, such as
    source and job. The corpus is restricted to jobs that pass ``where`` before the search; without ``prefilter`` three
    times ``top_k`` neighbours are filtered afterwards, so that fewer than ``top_k`` rows can remain. Queries shorter
    than three characters find nothing. ``versions`` orders job versions; the newest is taken, and only for jobs that
    were hit. Texts come whole; a preview is the caller's.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    asked = queries.filter(F.length(strip_ws(F.col("text"))) >= 3)
    if prefilter and where is not None:
        newest = latest_per_key(jobs, ids, versions) if versions else jobs
        corpus = corpus.join(newest.filter(where).select(*ids).distinct(), ids, "left_semi")
    keyed = with_key(corpus, ids, "_key").select("_key", "embedding")
    hits = knn_search(keyed, asked, top_k * 3, id_col="_key", qid=qid).withColumnRenamed("rank", "vector_rank")
    hits = materialise(hits.select(qid, "_key.*", "distance", "vector_rank"), "hits")
    if versions:
        jobs = latest_per_key(jobs.join(hits.select(*ids).distinct(), ids, "left_semi"), ids, versions)
    joined = jobs.join(hits, ids)
    if where is not None:
        joined = joined.filter(where)
    terms = asked.select(qid, query_terms(F.col("text")).alias("_terms"))
    score = keyword_score(F.col("_terms"), F.col(title), F.col(description), first_terms)
    scored = joined.join(terms, qid).withColumn("keyword_score", score)
    scored = scored.withColumn(
        "hybrid_score", weight * (1.0 - F.col("distance") / 2.0) + (1.0 - weight) * F.col("keyword_score")
    )
    order = Window.partitionBy(qid).orderBy(F.desc("hybrid_score"), *ids)
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.drop("_terms")


def similar_items(
    corpus: DataFrame,
    wanted: DataFrame,
    top_k: int = 5,
    min_similarity: float = 0.7,
    id_col: str | list[str] = "vec_id",
    jobs: DataFrame | None = None,
    versions: list[str] | None = None,
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """Neighbours of each wanted key by its own vector, itself left out: reference ids, ids, rank and scores.

    An id may consist of several columns; the reference columns are named ``reference_<id>``. Rows of the wanted key itself
    are not scored, so that a key of several vectors keeps its neighbours. A neighbour of several vectors counts once, by its least
    distance, but may take up some of the ``top_k`` places of each search.
    ``jobs`` adds the columns of each neighbour, of its newest version if
    ``versions`` are given, and a row without neighbour (``found`` false) for each wanted key that has no vector.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    keys = wanted.select(*ids).distinct()
    vectors = with_key(corpus, ids, "_key").select("_key", *ids, "embedding")
    queries = vectors.join(keys, ids, "left_semi").select(F.col("_key").alias("_reference"), F.col("embedding").alias("_vector"))
    hits = knn_search(vectors.select("_key", "embedding"), queries, top_k, id_col="_key", qid="_reference", qvec="_vector", max_query_bytes=max_query_bytes, others=True)
    kept = hits.filter(F.col("distance") <= 1.0 - min_similarity)
    order = Window.partitionBy("_reference").orderBy("distance", "_key")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    shown = ranked.select(
        *[F.col(f"_reference.{c}").alias(f"reference_{c}") for c in ids],
        "_key.*",
        "rank",
        F.round(1.0 - F.col("distance"), 4).alias("similarity_score"),
        F.round("distance", 4).alias("vector_distance"),
    )
    if jobs is None:
        return shown
    known = latest_per_key(jobs, ids, versions) if versions else jobs
    absent = keys.join(vectors.select(*ids), ids, "left_anti").select(*[F.col(c).alias(f"reference_{c}") for c in ids], F.lit(False).alias("found"))
    return shown.join(known, ids).withColumn("found", F.lit(True)).unionByName(absent, allowMissingColumns=True)
