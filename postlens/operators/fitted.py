"""An embedding fitted to the corpus: TF-IDF weights and the leading right singular vectors, by a randomised sketch.

Words are hashed to ``features`` buckets, so the model has a fixed size (features x dim floats) whatever the corpus, and
that is all that the driver or a broadcast holds. The corpus is read whole, once per pass of the subspace iteration; each
task adds up its rows and sends one row per bucket. A pass has no more tasks than there are cores, whatever the number of
files or splits, so that what it shuffles is bounded by cores x model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import materialise

FEATURES = 1 << 14
#: Weighted words of documents that are multiplied at once.
SLICE = 50_000


def word_buckets(text: str, features: int) -> Column:
    """Bucket of every word of a text, in lower case; none for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def weighted(texts: pd.Series, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (places of texts, row within them, bucket, weight) of unit TF-IDF rows, sorted by row; empty texts are left out."""
    sizes = texts.map(len).to_numpy()
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
    for places in np.split(np.arange(len(texts)), ends):
        places = places[sizes[places] > 0]
        if not len(places):
            continue
        flat = np.concatenate([np.asarray(texts.iloc[p], dtype=np.int64) for p in places])
        pairs, counts = np.unique(np.repeat(np.arange(len(places)), sizes[places]) * len(idf) + flat, return_counts=True)
        row, bucket = np.divmod(pairs, len(idf))
        weight = counts * idf[bucket]
        length = np.sqrt(np.bincount(row, weight * weight, len(places)))
        yield places, row, bucket, weight / length[row]


def _summed(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by group, and the groups; ``groups`` is sorted."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.add.reduceat(rows, starts, axis=0), groups[starts]


def projected(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return _summed(weight[:, None] * basis[bucket], row)[0]


def _pass(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, back: bool) -> np.ndarray:
    """A'(A basis) of the TF-IDF matrix A, or (A basis)'(A basis) unless ``back``."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, basis))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = shared.value
        total = np.zeros((len(idf) if back else basis.shape[1], basis.shape[1]))
        for frame in frames:
            for _, row, bucket, weight in weighted(frame["ids"], idf):
                image = projected(row, bucket, weight, basis)
                if back:
                    order = np.argsort(bucket, kind="stable")
                    sums, at = _summed(weight[order, None] * image[row[order]], bucket[order])
                    total[at] += sums
                else:
                    total += image.T @ image
        used = np.flatnonzero(total.any(axis=1))
        if not len(used):
            return  # a task without rows; an empty list of sums would be taken for a column of numbers
        for part in np.array_split(used, max(1, len(used) // 1000)):
            yield pd.DataFrame({"at": part.astype(np.int32), "sums": list(total[part])})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    partial = rows.coalesce(cores).mapInPandas(add, "at int, sums array<double>")
    summed = partial.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    total = np.zeros((len(idf) if back else basis.shape[1], basis.shape[1]))
    for r in summed.collect():
        total[r["at"]] = r["sums"]
    return total


@dataclass
class FittedEmbedding:
    """Weights of the buckets and their vectors, (features x dim)."""

    idf: np.ndarray
    vectors: np.ndarray

    def embedder(self, spark: SparkSession) -> Callable[[DataFrame, str, str], DataFrame]:
        """The embedding as the other jobs take it, in batch, stream or for queries: unit vectors, zeros without known words."""
        shared, features = spark.sparkContext.broadcast((self.idf, self.vectors)), len(self.idf)

        @F.pandas_udf("array<float>")
        def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            idf, vectors = shared.value
            for ids in parts:
                found = np.zeros((len(ids), vectors.shape[1]))
                for places, row, bucket, weight in weighted(ids, idf):
                    found[places] = projected(row, bucket, weight, vectors)
                length = np.linalg.norm(found, axis=1, keepdims=True)
                yield pd.Series(list((found / np.where(length > 0, length, 1.0)).astype(np.float32)))

        return lambda df, text, out: df.withColumn(out, vector(word_buckets(text, features)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a table of its buckets; a model of that name must not exist."""
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.idf, self.vectors, strict=True))]
        spark.createDataFrame(rows, "bucket int, idf double, vector array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> FittedEmbedding:
    rows = sorted(spark.read.parquet(path).collect())
    return FittedEmbedding(np.array([r["idf"] for r in rows]), np.array([r["vector"] for r in rows]))


def fit_embedding(df: DataFrame, text: str, dim: int = 64, features: int = FEATURES, extra: int = 16, passes: int = 2, seed: int = 7) -> FittedEmbedding:
    """Fit to all texts of ``df``; null texts have no words, and without any word all vectors are zeros.

    ``extra`` directions beside the ``dim`` wanted and ``passes`` of subspace iteration set how near the sketch comes to
    the exact singular vectors. Each vector's largest entry is positive, so refitting keeps signs.
    """
    rows = materialise(df.select(word_buckets(text, features).alias("ids")).filter(F.size("ids") > 0), "word-buckets")
    held = rows.select(F.explode(F.array_distinct("ids")).alias("at")).groupBy("at").count().collect()
    n, seen = rows.count(), np.zeros(features)
    for r in held:
        seen[r["at"]] = r["count"]
    idf = np.log((n + 1) / (seen + 1)) + 1
    if not n:
        return FittedEmbedding(idf, np.zeros((features, dim)))
    width = min(dim + extra, features)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_pass(rows, idf, basis, True))[0]
    strength, turn = np.linalg.eigh(_pass(rows, idf, basis, False))
    vectors = basis @ turn[:, np.argsort(-strength)[:dim]]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return FittedEmbedding(idf, vectors * np.where(signs == 0, 1, signs))
