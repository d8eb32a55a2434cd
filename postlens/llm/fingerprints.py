"""Document fingerprints by one-permutation MinHash: each shingle is hashed and binned once, empty bins are densified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.simhash import word_blocks
from postlens.llm.worker import rest_of, worker_state
from postlens.session import materialise

#: Bins of a fingerprint (a power of two), bits kept of each bin's least hash, and words of a shingle.
BINS, BITS, WIDTH = 512, 4, 5

#: Words whose hashes a Python worker keeps; at so many the table is emptied.
WORDS = 300_000

#: Bytes of text after which a worker sends its rows on.
SEND_BYTES = 8 << 20

BIN_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
FACTOR, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)

_random = np.random.default_rng(11)
#: For each bin the order in which others are asked for a value, and the place of each other bin in that order.
ORDER = _random.permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)
PLACE = np.argsort(ORDER, axis=1).astype(np.int16)
#: What a value is mixed with in each bin, so that one value in many bins gives each of them bits of its own.
SALT = _random.integers(0, 1 << 63, BINS, dtype=np.uint64)


class WordHashes(dict):
    """The 64-bit hash of a word in bytes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word, 11)
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * FINAL
    return values ^ (values >> np.uint64(29))


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` word hashes."""
    count = len(hashes) - width + 1
    found = hashes[:count].copy()
    for j in range(1, width):
        found = mixed(found) * FACTOR + hashes[j : j + count]
    return mixed(found)


def fill(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin takes the value of the first filled bin in its own random order."""
    empty = np.flatnonzero(~filled)
    if len(empty):
        full = np.flatnonzero(filled)
        if len(full) <= 32:
            donors = full[PLACE[np.ix_(empty, full)].argmin(axis=1)]
        else:
            some = filled[ORDER[empty, :32]]
            donors = ORDER[empty, some.argmax(axis=1)]
            rest = np.flatnonzero(~some.any(axis=1))
            if len(rest):
                donors[rest] = ORDER[empty[rest], filled[ORDER[empty[rest]]].argmax(axis=1)]
        least[empty] = least[donors]
    return least


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    """The packed fingerprint of a text: ``BINS`` times ``BITS`` bits, or no bytes for a text without words.

    Words are runs of other than ASCII white space, A-Z in lower case; a text of fewer words than a shingle has is one
    shingle. Texts of any length are read in blocks, so memory does not grow with them.
    """
    table = worker_state("word hashes", WordHashes)
    least, filled = np.full(BINS, np.iinfo(np.uint64).max, np.uint64), np.zeros(BINS, bool)
    carried = np.empty(0, np.uint64)

    def add(found: np.ndarray) -> None:
        bins = (found >> BIN_SHIFT).astype(np.int64)
        np.minimum.at(least, bins, found)
        filled[bins] = True

    long_enough = False
    for words in word_blocks((text or "").encode().lower()):
        hashes = np.concatenate((carried, np.fromiter(map(table.__getitem__, words), np.uint64, len(words))))
        if len(hashes) >= width:
            add(shingles_of(hashes, width))
            long_enough = True
        carried = hashes[len(hashes) - width + 1 :] if len(hashes) >= width else hashes
    if not long_enough:
        if not len(carried):
            return b""
        add(shingles_of(carried, len(carried)))
    kept = (mixed(fill(least, filled) ^ SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(kept[:, None], axis=1, bitorder="little", count=BITS)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two fingerprinted texts.

    Two bins of unlike texts agree in ``BITS`` bits by chance once in 2**BITS, which is taken off the share of equal
    bins. Texts without words are like each other and unlike all others.
    """
    if not a or not b:
        return float(a == b)
    unlike = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8), bitorder="little").reshape(BINS, BITS).any(axis=1)
    chance = 0.5**BITS
    return float(min(1.0, max(0.0, (1 - unlike.mean() - chance) / (1 - chance))))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (binary) of each row's text; null texts count as empty. Repeated rows each get theirs."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py()) for t in texts), pa.binary())

    return docs.select(*rest_of(docs.columns, out), of(F.col(text_col).cast("string")).alias(out))


def with_likeness(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """Add the estimated similarity (double) of two fingerprint columns; null where one of them is null."""

    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array((None if x is None or y is None else likeness(x, y) for x, y in sides), pa.float64())

    return pairs.select(*rest_of(pairs.columns, out), of(a, b).alias(out))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``following``, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def judged(text: str, mark: bytes, following: str, next_mark: bytes) -> dict[str, object]:
    changed = edited(text, following)
    changed_mark = mark if changed == text else fingerprint(changed)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": mark,
        "edited_fingerprint": changed_mark,
        "near_edited": likeness(mark, changed_mark),
        "near_next": likeness(mark, next_mark),
    }


MADE = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
MADE_DDL = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def against_edits(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprint each text and its edited text, whose end comes from the next document by descending id.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), the fingerprints in
    binary. After the last document comes the first. Rows without id come last; rows that share an id are ordered by a
    hash of their text, then by their place in the table. Null texts count as empty. A table of one row has itself as
    next; an empty table gives no rows. Other columns are left out.

    The rows are dealt out by ranges of that order and streamed, so each text is shuffled once, and a task holds two
    texts and a batch. What meets at the ends of the ranges, one row for each, is joined after the first write.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("_llm_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_llm_text"))
    keyed = chosen.withColumns({"_llm_hash": F.xxhash64("_llm_text"), "_llm_at": F.monotonically_increasing_id()})
    order = [F.col("_llm_id").desc_nulls_last(), F.col("_llm_hash"), F.col("_llm_at")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_llm_id", "_llm_text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, rows, size = TaskContext.get().partitionId(), [], [], 0
        names = [*[name for name, _ in MADE], "part", "head", "tail"]
        schema = pa.schema([*MADE, ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict.fromkeys(names) | row for row in rows], schema)
            id_array = pa.array(ids, id_kind)
            return pa.RecordBatch.from_arrays([id_array, *made.columns], names=["_llm_id", *names])

        last, id_kind = None, None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                mark = fingerprint(text)
                if last:
                    ids.append(last[0])
                    rows.append(judged(last[1], last[2], text, mark) | {"part": part, "head": last[3]})
                    size += 4 * BINS * BITS // 8 + len(last[3] or "")
                last = (key, text, mark, None if last else text)
                if size >= SEND_BYTES:
                    yield sent()
                    ids, rows, size = [], [], 0
        if last:
            ids.append(last[0])
            rows.append({"fingerprint": last[2], "part": part, "head": last[3], "tail": last[1]})
            yield sent()

    schema = f"_llm_id {id_type}, {MADE_DDL}, part int, head string, tail string"
    table = materialise(ranged.mapInArrow(follow, schema), "fingerprints")
    ends = table.where("head IS NOT NULL OR tail IS NOT NULL").select("part", "head", "tail", "fingerprint", "_llm_id")
    parts = sorted(r["part"] for r in ends.where("tail IS NOT NULL").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = ends.where("head IS NOT NULL").select(F.col("part").alias("next_part"), "head", F.col("fingerprint").alias("next_mark"))
    tails = ends.where("tail IS NOT NULL").drop("head").join(after, "part").join(heads, "next_part")

    @F.arrow_udf(f"struct<{MADE_DDL.replace(' ', ':').replace(',:', ',')}>")
    def of(text: pa.Array, mark: pa.Array, following: pa.Array, next_mark: pa.Array) -> pa.Array:
        return pa.array((judged(*(x.as_py() for x in row)) for row in zip(text, mark, following, next_mark, strict=True)), pa.struct(MADE))

    closed = tails.select("_llm_id", of("tail", "fingerprint", "head", "next_mark").alias("made")).select("_llm_id", "made.*")
    whole = table.where("tail IS NULL").select(*closed.columns).unionByName(closed)
    return whole.select(F.col("_llm_id").alias(id_col), *[name for name, _ in MADE])
