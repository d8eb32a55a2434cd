"""Language identification by a model of character trigrams, trained on labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams share so many counters; a model has that many numbers for each language, whatever it was trained on.
BUCKETS = 1 << 16

#: Multipliers of the three code points of a trigram in its bucket.
FACTORS = (7919, 263, 1)

#: Log-likelihoods are kept as whole thousandths, so that sums do not depend on their order.
SCALE = 1000

#: Characters of a text that are counted at once.
BLOCK = 1 << 20


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all trigrams of a text, block by block."""
    for start in range(0, len(text), BLOCK):
        points = np.frombuffer(text[start : start + BLOCK + 2].encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(points) > 2:
            yield (points[:-2] * FACTORS[0] + points[1:-1] * FACTORS[1] + points[2:] * FACTORS[2]) % BUCKETS


def train_language_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, score): the log-likelihood of each bucket, in thousandths, with add-one smoothing.

    Buckets that a language never showed have no row; their score is that of row ``bucket`` -1. Rows without text or
    language are left out. Tasks count in one table of fixed size for each language before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = tables.setdefault(name, np.zeros(BUCKETS, np.int64))
                for found in buckets(value.as_py()):
                    table += np.bincount(found, minlength=BUCKETS)
        for name, table in tables.items():
            seen = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(seen)), "bucket": pa.array(seen, pa.int32()), "n": pa.array(table[seen])})

    told = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counts = told.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    score = lambda n: F.round(SCALE * F.log((n + 1) / (F.col("total") + BUCKETS))).cast("int").alias("score")
    summed = counts.withColumn("total", total)
    unseen = summed.groupBy("lang").agg(F.max("total").alias("total")).select("lang", F.lit(-1).alias("bucket"), score(F.lit(0)))
    return summed.select("lang", "bucket", score(F.col("n"))).unionByName(unseen)


def read_language_model(model: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their scores by bucket: at most ``BUCKETS`` numbers for each language."""
    held = model.toArrow()
    names = sorted(set(held["lang"].to_pylist()))
    place = np.searchsorted(np.array(names, dtype=object), held["lang"].to_numpy(zero_copy_only=False)) if names else np.zeros(0, int)
    bucket, score = held["bucket"].to_numpy(), held["score"].to_numpy()
    scores = np.zeros((BUCKETS, len(names)), np.int32)
    scores[:, place[bucket < 0]] = score[bucket < 0]
    scores[bucket[bucket >= 0], place[bucket >= 0]] = score[bucket >= 0]
    return names, scores


def with_model_language(df: DataFrame, model: DataFrame, text: str = "text", out: str = "language") -> DataFrame:
    """Add the language under which all trigrams of the text are most likely; of equals, the first by code.

    'unknown' for nulls, for texts of under three characters, and where the model has no language. The model, of
    bounded size, is broadcast once and texts are read in blocks.
    """
    names, scores = read_language_model(model)
    held = df.sparkSession.sparkContext.broadcast(scores)

    def best(value: str | None) -> str:
        sums = np.zeros(len(names), np.int64)
        known = False
        for found in buckets(value or ""):
            sums += held.value[found].sum(axis=0, dtype=np.int64)
            known = True
        return names[int(sums.argmax())] if known and names else "unknown"

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((best(t.as_py()) for t in texts), pa.string())

    return df.withColumn(out, of(F.col(text).cast("string")))
