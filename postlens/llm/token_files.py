"""Token ids as Parquet list columns: ordered, dictionary-encoded, with row groups and page indexes for selective reads."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from postlens.llm.worker import Pieces, worker_state

#: How the files are written: a dictionary for the ids, deltas for the metadata, bounded row groups and pages. The writer
#: adds column and offset indexes, by which a reader skips pages outside a range of documents.
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#place": "false",
}

#: Bytes of texts that are encoded at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20

#: Bits of ``place`` below the number of the part.
ROW_BITS = 33


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of batches of texts by a byte-level tokenizer file, without special tokens added.

    The texts of a slice are split at single spaces, which always begin a new match of the splitting pattern, and each
    distinct piece is encoded once. ``known`` keeps the pieces of earlier slices, ``limit`` of them at most.

    The strings of special tokens are ordinary text; with ``special`` they become their own ids, as the library has it by
    default, and texts that hold an added token are encoded whole.
    """

    def __init__(self, path: str, limit: int = 600_000, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.limit, self.known = limit, {}
        self.blocks = Pieces(self.whole, 0).blocks
        self.starts, self.newline = {}, self.whole("\n")
        self.marks = {mark: self.whole(mark) for mark in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def lettered(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def tokenized(self, letters: str) -> bytes:
        return array("i", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes | None:
        """The ids of a piece and the space before it, or none if white space at its ends may belong to its neighbours."""
        if piece.isalpha():
            return self.tokenized(self.letters[32] + self.lettered(piece))
        if piece[-1:] in self.marks and piece[:-1].isalpha():
            return (self.known.get(piece[:-1]) or self.piece(piece[:-1])) + self.marks[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        lines = piece.split("\n")
        if len(lines) > 1 and not any(not line or line[0].isspace() or line[-1].isspace() for line in lines):
            return self.known_piece(lines[0]) + b"".join(self.newline + self.started(line) for line in lines[1:])
        return self.whole(" " + piece)

    def known_piece(self, piece: str) -> bytes:
        code = self.known.get(piece)
        if code is None:
            code = self.known[piece] = self.piece(piece)
        return code

    def started(self, line: str) -> bytes:
        """The ids of what follows a line feed that stands alone: such a line feed is a match of the pattern by itself."""
        code = self.starts.get(line)
        if code is None:
            if len(self.starts) > self.limit // 4:
                self.starts.clear()
            if line.isalpha():
                code = self.tokenized(self.lettered(line))
            elif line[-1:] in self.marks and line[:-1].isalpha():
                code = self.started(line[:-1]) + self.marks[line[-1]]
            else:
                code = self.whole(line)
            self.starts[line] = code
        return code

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, ``end_id`` included, and all ids."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self.known.clear()
        codes = list(map(self.known.get, pieces))
        odd = np.zeros(len(pieces), bool)
        for i in [i for i, code in enumerate(codes) if code is None]:
            code = self.piece(pieces[i])
            if code is None:
                odd[i], codes[i] = True, b""
            else:
                codes[i] = self.known[pieces[i]] = code
        firsts, counts = offsets[:-1], np.diff(offsets)
        irregular = np.add.reduceat(odd[index], firsts) > 0
        holds, held = np.zeros(len(texts), bool), texts.buffers()[2]
        for token in self.added:
            if held is not None and token.encode() in held.to_pybytes():
                holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for row in range(len(texts)):
            first = pieces[index[firsts[row]]]
            if holds[row]:
                irregular[row] = True
                codes.append(self.whole(texts[row].as_py()))
                continue
            alone = bool(irregular[row]) or not first or first[0].isspace() or first[-1].isspace()
            irregular[row] = alone
            codes.append(b"".join(self.blocks(texts[row].as_py())) if alone else self.started(first))
        codes += [b"", np.int32(end_id).tobytes()]
        index[np.repeat(irregular, counts)] = len(codes) - 2
        index[firsts] = len(pieces) + np.arange(len(texts))
        index = np.insert(index, offsets[1:], len(codes) - 1)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        taken = sizes[index]
        total = int(taken.sum())
        kind = np.int32 if total + int(sizes.sum()) < 1 << 31 else np.int64
        moved = (np.cumsum(sizes) - sizes)[index] - np.cumsum(taken) + taken
        place = np.repeat(moved.astype(kind), taken)
        place += np.arange(total, dtype=kind)
        of_text = np.add.reduceat(taken, firsts + np.arange(len(texts)))
        return of_text.astype(np.int32), np.frombuffer(b"".join(codes), np.int32)[place]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0, special: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text), in the order of the rows; ``end_id`` closes each document. See ``Encoder`` for ``special``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"tokens {tokenizer_path} {special}", lambda: Encoder(tokenizer_path, special=special))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            filled = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(batch)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first < last:
                    lengths, values = encoder.encode(texts.slice(first, last - first), end_id)
                    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                    columns = [batch.column(0).slice(first, last - first), pa.array(lengths), pa.ListArray.from_arrays(offsets, pa.array(values))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", special: bool = False) -> None:
    """Write the ids of all documents below ``path``, in ascending order of their ids over the files and within them.

    Rows without id come first; rows of one id are ordered by a hash of their texts. Null and empty texts have the end
    id alone, and an empty table gives an empty one. The texts are dealt out by ranges of ids, and encoded after that,
    so that each is encoded once. ``place`` orders the rows: the part's number, then the row in the part. With
    ``special``, the strings of special tokens in texts become those tokens.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = tokenize(ordered, tokenizer_path, end_id, special).withColumn("place", F.monotonically_increasing_id())
    placed.write.options(**OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, tokens: bool = True) -> DataFrame:
    """The files' rows; a range of ids skips row groups and pages, and ``tokens=False`` leaves the ids unread."""
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows if tokens else rows.drop("ids")


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids in all documents before, from the lengths alone.

    One sum for each part comes before the running sum within the parts, so that no task sees more than a part's lengths.
    """
    part = F.shiftright("place", ROW_BITS)
    lengths = read_token_files(spark, path, tokens=False)
    sums = lengths.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("place"))), F.lit(0))
    inner = rows.withColumn("part", part).withColumn("within", within)
    return inner.join(parts, "part").withColumn("start", F.col("before") + F.col("within")).drop("part", "before", "within")


def crc32_of_ids(ids):
    """The unsigned CRC-32 of an array of integers as little-endian 32-bit values."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        offsets = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        return pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())

    return crc(ids)
