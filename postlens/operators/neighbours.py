"""A neighbour graph over all vectors: by comparing all pairs in tiles, or on very large tables by repeated local joins.

Up to EXACT_ROWS vectors, comparing all pairs takes less time and moves less data than local joins, and is exact. Rows
are dealt into a few tiles, and one task compares two of them; with as many tiles as the cores call for, what is moved
grows as the rows do.

Beyond that, seeded hyperplanes cut the rows into blocks of bounded size, and each row's best within its blocks are the first
graph. Then every row introduces its neighbours to each other: what is near to a common row is often near to one
another. Rows are numbered so that near ones mostly follow each other, and a run of them is a team. Each round ships a
vector once to every team with a neighbourhood that it is in, which is at most rows x width, and a round compares only
what the round before has changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.search import METRICS, distances, matrix_of, with_key
from postlens.session import materialise

EDGES = "at long, other long, distance double"
#: Candidates that one neighbourhood gives to each of its members in a round, the nearest first.
INTRODUCED = 10
#: A team has up to 2 ** TEAM_BITS rows; of as many as PIVOTS rows, the nearest one decides the order of numbers.
TEAM_BITS, PIVOTS = 12, 1024
#: Proposals of one team that are held before they are cut to the best of each row.
HELD = 1 << 21


#: Vectors up to which all pairs are compared, rows of a tile at most, and what is compared at once of two tiles.
EXACT_ROWS, TILE_ROWS, TILE_PART = 1 << 20, 1 << 16, (256, 2048)


def _edges(at: np.ndarray, other: np.ndarray, distance: np.ndarray) -> dict[str, pa.Array]:
    return {"at": pa.array(at, pa.int64()), "other": pa.array(other, pa.int64()), "distance": pa.array(distance, pa.float64())}


def _nearest(dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` least finite entries of each row."""
    if dist.shape[1] > most:
        beyond = np.argpartition(dist, most, axis=1)[:, most:]
        np.put_along_axis(dist, beyond, np.inf, axis=1)
    return np.nonzero(np.isfinite(dist))


def coded(rows: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """Each row once for every tree, with the sides of ``bits`` random hyperplanes on which its vector lies."""
    shape = "tree int, code long, at long, own long, vector array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = matrix_of(batch.column(2))
            for tree in range(trees):
                planes = np.random.default_rng(seed + tree).standard_normal((vectors.shape[1], bits))
                code = ((vectors @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                columns = [pa.array(np.full(len(code), tree), pa.int32()), pa.array(code, pa.int64()), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "code", "at", "own", "vector"])

    return rows.select("at", "own", "vector").mapInArrow(run, shape)


def first_graph(rows: DataFrame, count: int, width: int, metric: str, trees: int, block_rows: int, seed: int) -> DataFrame:
    """The nearest rows of each row within its blocks; a crowded side of the hyperplanes is dealt into several blocks."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / block_rows))))
    placed = materialise(coded(rows, trees, bits, seed), "sides")
    sizes = placed.groupBy("tree", "code").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = placed.join(sizes, ["tree", "code"]).withColumn("block", F.pmod(F.xxhash64("at", "tree"), F.col("blocks")))

    def meet(block: pa.Table) -> pa.Table:
        at, own, vectors = (block.column(c) for c in ("at", "own", "vector"))
        at, own, vectors = at.to_numpy(), own.to_numpy(), matrix_of(vectors)
        dist = distances(vectors, vectors, metric)
        dist[own[:, None] == own[None, :]] = np.inf
        row, column = _nearest(dist, width)
        return pa.table(_edges(at[row], at[column], dist[row, column]))

    return dealt.groupBy("tree", "code", "block").applyInArrow(meet, EDGES)


class Nearest:
    """The ``most`` nearest others of each of ``n`` rows, offered by parts; cut to them whenever many have gathered."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.limit, self.kept, self.gathered = n, most, np.full(n, np.inf), [], 0

    def offer(self, dist: np.ndarray, by_column: bool, at: np.ndarray, other: np.ndarray) -> None:
        """Distances of these rows, which are the columns of ``dist`` if ``by_column``, to ``other``, each there once."""
        if not self.kept:
            row, place = _nearest(dist.T.copy() if by_column else dist.copy(), self.most)
            row, place = (place, row) if by_column else (row, place)
        else:
            limit = self.limit[at]
            row, place = np.divmod(np.flatnonzero(dist < (limit if by_column else limit[:, None])), dist.shape[1])
        found = dist[row, place]
        row, place = (place, row) if by_column else (row, place)
        self.kept.append((at[row], other[place], found))
        self.gathered += len(row)
        if len(self.kept) == 1 or self.gathered > 2 * self.n * self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, other, distance = _best(*(np.concatenate(parts) for parts in zip(*self.kept)), self.most)
        count = np.bincount(at, minlength=self.n)
        last = np.cumsum(count) - 1
        full = count >= self.most
        self.limit[full] = distance[last[full]]
        self.kept, self.gathered = [(at, other, distance)], 0
        return self.kept[0]


def _factors(vectors: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices; the product of one's row and another's transposed row is smaller the nearer two vectors are."""
    if metric == "cosine":
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(lengths > 0, lengths, 1.0)
    if metric != "euclidean":
        return -vectors, vectors
    squares, ones = (vectors**2).sum(axis=1, keepdims=True), np.ones((len(vectors), 1))
    return np.hstack([-2 * vectors, squares, ones]), np.hstack([vectors, ones, squares])


def _runs(keys: np.ndarray, at_once: int) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """Parts of sorted keys: where each is, the starts of its runs of one key, and the numbers of those keys."""
    number = np.cumsum(np.r_[0, np.diff(keys) != 0])
    cuts = [slice(a, a + at_once) for a in range(0, len(keys), at_once)]
    return [(part, np.flatnonzero(np.r_[True, np.diff(number[part]) != 0]), np.unique(number[part])) for part in cuts]


def compare_tiles(left_keys: np.ndarray, left: np.ndarray, right_keys: np.ndarray | None, right: np.ndarray | None, most: int, metric: str):
    """The ``most`` nearest keys of one tile for each of the other, both ways; without a second tile, of the first for itself.

    Keys are sorted. Two keys are as near as the nearest of their vectors.
    """
    itself = right_keys is None
    right_keys, right = (left_keys, left) if itself else (right_keys, right)
    rows, columns = _factors(left, metric)[0], _factors(right, metric)[1]
    of_rows, of_columns = np.unique(left_keys), np.unique(right_keys)
    column_parts, found = _runs(right_keys, TILE_PART[1]), []
    backward = [Nearest(len(numbers), most) for _, _, numbers in column_parts]
    for part, starts, at in _runs(left_keys, TILE_PART[0]):
        forward = Nearest(len(at), most)
        for (other_part, other_starts, other), back in zip(column_parts, backward):
            dist = rows[part] @ columns[other_part].T
            if len(other) < dist.shape[1]:
                dist = np.minimum.reduceat(dist, other_starts, axis=1)
            if len(at) < dist.shape[0]:
                dist = np.minimum.reduceat(dist, starts, axis=0)
            _, row, column = np.intersect1d(of_rows[at], of_columns[other], assume_unique=True, return_indices=True)
            dist[row, column] = np.inf
            forward.offer(dist, False, np.arange(len(at)), other)
            if not itself:
                back.offer(dist, True, np.arange(len(other)), at)
        row, column, distance = forward.cut()
        found.append((of_rows[at[row]], of_columns[column], distance))
    if not itself:
        for (_, _, other), back in zip(column_parts, backward):
            column, row, distance = back.cut()
            found.append((of_columns[other[column]], of_rows[row], distance))
    at, other, distance = (np.concatenate(parts) for parts in zip(*found))
    if metric == "cosine":
        distance = 1.0 + distance
    distance = np.round(distance, 10)
    return at, other, np.sqrt(np.maximum(distance, 0.0)) if metric == "euclidean" else distance


def all_pairs(rows: DataFrame, count: int, most: int, metric: str) -> DataFrame:
    """The ``most`` nearest other keys of each key ``own``, exactly, by comparing every two tiles in a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, min(int(np.ceil(np.sqrt(6 * cores))), count // 256), -(-count // TILE_ROWS))
    tile = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = rows.select("own", "vector", tile.alias("tile")).select("*", other.alias("other"))
    pair = F.least("tile", "other") * tiles + F.greatest("tile", "other")

    def meet(pair: pa.Table) -> pa.Table:
        tile, own, vectors = pair.column("tile").to_numpy(), pair.column("own").to_numpy(), matrix_of(pair.column("vector"))
        sides = []
        for side in np.unique(tile):
            places = np.flatnonzero(tile == side)
            places = places[np.argsort(own[places], kind="stable")]
            sides += [own[places], vectors[places]]
        return pa.table(_edges(*compare_tiles(*(sides if len(sides) == 4 else [*sides, None, None]), most, metric)))

    tasks = 4 * tiles * (tiles + 1) // 2  # more than pairs, so that few of them meet in one
    found = dealt.select(pair.alias("pair"), "tile", "own", "vector").repartition(tasks, "pair").groupBy("pair").applyInArrow(meet, EDGES)
    each = found.repartition("at").groupBy("at", "other").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("at").orderBy("distance", "other")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def numbered(rows: DataFrame, count: int, metric: str, bits: int) -> DataFrame:
    """Rows with a number ``at``, those of one nearest pivot in sequence. Pivots are rows drawn by hash, a bounded number.

    The order only decides which rows share a team, and a range of numbers has several tasks however many rows a pivot has.
    """
    teams = max(1, count >> bits)
    drawn = rows.orderBy(F.xxhash64("own", "vector")).limit(min(teams, PIVOTS)).collect()
    pivots = np.array([r["vector"] for r in drawn], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivot = distances(matrix_of(batch.column(batch.schema.get_field_index("vector"))), pivots, metric).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32())], names=[*batch.schema.names, "pivot"])

    near = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType())]))
    dealt = near.repartitionByRange(max(1, teams >> 2), "pivot", "own", F.xxhash64("vector")).sortWithinPartitions("pivot", "own")
    return dealt.select(F.monotonically_increasing_id().alias("at"), *rows.columns)


def _best(at: np.ndarray, other: np.ndarray, distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and the ``most`` nearest others of each."""
    _, once = np.unique(at * (other.max(initial=0) + 1) + other, return_index=True)
    order = once[np.lexsort((other[once], distance[once], at[once]))]
    starts = np.searchsorted(at[order], at[order])
    order = order[np.arange(len(order)) - starts < most]
    return at[order], other[order], distance[order]


def _introduce(metric: str, width: int) -> Callable:
    """For one team: each neighbourhood gives its members those of the others that improve on what they have.

    ``members`` has the rows of all neighbourhoods, ``known`` each of them once with its vector. Only the ``width`` nearest
    that a team finds for a row are told, since no row holds more.
    """

    def of(members: pa.Table, known: pa.Table) -> pa.Table:
        ids = known.column("member").to_numpy()
        order = np.argsort(ids)
        ids, own, limit = (known.column(c).to_numpy()[order] for c in ("member", "own", "limit"))
        vectors = matrix_of(known.column("vector"))[order] if len(ids) else np.empty((0, 1), np.float32)
        hub, member, fresh = (members.column(c).to_numpy() for c in ("hub", "member", "fresh"))
        order = np.lexsort((~fresh, member, hub))
        hub, member, fresh = hub[order], np.searchsorted(ids, member[order]), fresh[order]
        once = np.r_[True, (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])][: len(hub)]
        hub, member, fresh = hub[once], member[once], fresh[once]
        cuts = [0, *(np.nonzero(np.diff(hub))[0] + 1).tolist(), len(hub)]
        found, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
        for a, b in zip(cuts, cuts[1:]):
            new, at = fresh[a:b], member[a:b]
            if b - a < 2 or not new.any():
                continue
            dist = distances(vectors[at], vectors[at], metric)
            skipped = ~(new[:, None] | new[None, :]) | (own[at, None] == own[None, at]) | (dist >= limit[at, None])
            dist[skipped] = np.inf
            row, column = _nearest(dist, INTRODUCED)
            found.append((at[row], at[column], dist[row, column]))
            held += len(row)
            if held > HELD:
                found = [_best(*(np.concatenate(parts) for parts in zip(*found)), width)]
                held = len(found[0][0]) // 2
        at, other, distance = _best(*(np.concatenate(parts) for parts in zip(*found)), width)
        return pa.table(_edges(ids[at], ids[other], distance))

    return of


def nearest_edges(edges: DataFrame, width: int, bits: int) -> DataFrame:
    """The ``width`` nearest others of each row; an edge found before stays known. Edges of a team are stored together."""
    teamed = edges.withColumn("team", F.shiftright("at", bits)).repartition("team")
    each = teamed.groupBy("team", "at", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("team", "at").orderBy("distance", "other")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).drop("place", "team")


def introductions(graph: DataFrame, rows: DataFrame, width: int, metric: str, seed: int, bits: int) -> DataFrame:
    """Edges that one round of local joins proposes. A row that is near to very many takes ``width`` of them, by a seeded hash."""
    forward = graph.select(F.col("at").alias("hub"), F.col("other").alias("member"), "fresh")
    backward = graph.select(F.col("other").alias("hub"), F.col("at").alias("member"), "fresh")
    drawn = Window.partitionBy("hub").orderBy(F.xxhash64("member", F.lit(seed)), "member")
    backward = backward.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= width).drop("place")
    members = forward.unionByName(backward).select(F.shiftright("hub", bits).alias("team"), "hub", "member", "fresh")
    full = F.when(F.count("*") >= width, F.max("distance")).otherwise(float("inf"))
    limits = graph.groupBy("at").agg(full.alias("limit"))
    known = rows.join(limits, "at", "left").select(F.col("at").alias("member"), "own", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    sent = members.select("team", "member").distinct().join(known, "member")
    sent = sent.toDF(*sent.columns)  # columns of its own, which the two sides of a cogroup need
    return members.groupBy("team").cogroup(sent.groupBy("team")).applyInArrow(_introduce(metric, width), EDGES)


def joined_graph(
    rows: DataFrame, count: int, width: int, metric: str, rounds: int, settle: float, trees: int, block_rows: int, seed: int, bits: int
) -> DataFrame:
    """The ``width`` nearest rows of each row, nearly, by rounds of local joins."""
    first = first_graph(rows, count, width, metric, trees, block_rows, seed).withColumn("fresh", F.lit(True))
    graph = materialise(nearest_edges(first, width, bits), "graph")
    for turn in range(rounds):
        proposed = introductions(graph, rows, width, metric, seed + turn, bits).withColumn("fresh", F.lit(True))
        graph = materialise(nearest_edges(graph.withColumn("fresh", F.lit(False)).unionByName(proposed), width, bits), "graph")
        if graph.where("fresh").count() <= settle * count * width:
            break
    return graph


def neighbour_graph(
    corpus: DataFrame,
    k: int = 10,
    id_col: str | list[str] = "vec_id",
    vec: str = "embedding",
    metric: str = "cosine",
    width: int = 64,
    rounds: int = 8,
    settle: float = 0.002,
    trees: int = 4,
    block_rows: int = 1024,
    seed: int = 42,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """The ``k`` nearest other keys of every key: (reference_<id>, <id>, distance, rank).

    They are exact up to ``exact_rows`` vectors, and nearly so beyond. There, ``width`` neighbours are held for each row while
    the graph is made, and rounds end when fewer than ``settle`` of all edges are new, or after ``rounds``. An id may consist of several columns. A key may have several vectors: its distance
    to another key is the least of any two, and its own are no neighbours. Null vectors have none, zero vectors are at
    distance 1 from all; of vectors at equal distance any may be found. Other columns of ``corpus`` are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    keyed = with_key(corpus.where(F.col(vec).isNotNull()), ids, "key")
    plain = materialise(keyed.select(F.xxhash64("key").alias("own"), "key", F.col(vec).cast("array<float>").alias("vector")), "plain")
    count, cores = plain.count(), corpus.sparkSession.sparkContext.defaultParallelism
    if count <= exact_rows:
        graph, names = materialise(all_pairs(plain, count, k, metric), "graph"), plain.select(F.col("own").alias("at"), "key").dropDuplicates(["at"])
    else:
        bits = min(TEAM_BITS, max(4, (count // (4 * cores)).bit_length() - 1))
        stored = materialise(numbered(plain, count, metric, bits), "vectors")
        graph, names = joined_graph(stored.drop("key"), count, max(width, k), metric, rounds, settle, trees, block_rows, seed, bits), stored.select("at", "key")
    named = graph.join(names.withColumnRenamed("key", "reference"), "at").drop("at").withColumnRenamed("other", "at").join(names, "at")
    pairs = named.groupBy("reference", "key").agg(F.min("distance").alias("distance"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("reference").orderBy("distance", "key"))).where(F.col("rank") <= k)
    return ranked.select(*[F.col(f"reference.{c}").alias(f"reference_{c}") for c in ids], "key.*", "distance", "rank")
