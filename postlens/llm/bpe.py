"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush
from math import isqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.worker import Pieces, add_binary, rest_of, worker_state


#: Ids that are decoded at once.
BLOCK_IDS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a file with one ``base64 rank`` pair on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes texts to packed ids (little-endian, unsigned, 32 bits) and decodes those.

    ``cached`` bounds the number of pre-tokens whose ids are kept; at that number the table is emptied.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 700_000):
        size = max(ranks.values(), default=0) + 1
        self.ranks, self.cached = ranks, cached
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.pieces = Pieces(self.encode_block)
        self.pairs = {tuple(token): rank for token, rank in ranks.items() if len(token) == 2}
        self.width = isqrt(size) + 1
        self.bitmap = [0] * self.width
        self.word_of = [rank // self.width for rank in range(size)]
        self.bit_of = [1 << rank % self.width for rank in range(size)]
        by_rank = [b""] * size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.sizes = np.array([len(token) for token in by_rank], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(by_rank), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: always the lowest rank is merged, the leftmost pair first among equals.

        The queue has a bucket for each rank that is waiting, with the places in the linked list of parts where such a
        pair begins, as a heap. A bitmap of two levels says which buckets hold any: ``top`` has a bit for each word of
        ``bitmap``, and a word one for each rank. Two find-first-set steps give the lowest rank, however many wait, so
        that a pre-token of n bytes takes n queue steps whatever its length. Entries that have gone stale stay and are
        skipped. The bitmap is empty again at the end.
        """
        ranks, get, word_of, bit_of, bitmap, width = self.ranks, self.ranks.get, self.word_of, self.bit_of, self.bitmap, self.width
        if word in ranks:
            return [ranks[word]]
        n, top = len(word), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [*map(self.pairs.get, zip(word, word[1:])), None]
        buckets: dict[int, list[int]] = {}
        for i, rank in enumerate(rank_at):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    bitmap[word_of[rank]] |= bit_of[rank]
                    top |= 1 << word_of[rank]
        while top:
            w = (top & -top).bit_length() - 1
            bits = bitmap[w]
            rank = w * width + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bitmap[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if rank_at[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            rank_at[gone] = rank_at[i] = None
            if end < n:
                before[end] = i
            left = before[i]
            for place, stop in ((i, after[end] if end < n else 0), (left, end if left >= 0 else 0)):
                if stop:
                    rank_at[place] = joined = get(word[place:stop])
                    if joined is not None:
                        if joined in buckets:
                            heappush(buckets[joined], place)
                        else:
                            buckets[joined] = [place]
                            bitmap[word_of[joined]] |= bit_of[joined]
                            top |= 1 << word_of[joined]
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(ranks[word[i:end]])
            i = end
        return ids

    def encode_block(self, text: str) -> bytes:
        packed = []
        for word in self.split(text):
            ids = self.words.get(word)
            if ids is None:
                merged = self.merge(word.encode())
                ids = struct.pack(f"<{len(merged)}I", *merged)
                if len(word) <= 64:
                    if len(self.words) >= self.cached:
                        self.words.clear()
                    self.words[word] = ids
            packed.append(ids)
        return b"".join(packed)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces.blocks(text)) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        """The tokens' bytes, gathered from one table of all, a block of ids at a time."""
        codes, found = np.frombuffer(ids or b"", "<u4"), []
        for k in range(0, len(codes), BLOCK_IDS):
            block = codes[k : k + BLOCK_IDS]
            sizes = self.sizes[block]
            ends = np.cumsum(sizes)
            found.append(self.letters[np.repeat(self.starts[block] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(found)


def codec(ranks_path: str, pattern: str) -> Codec:
    return worker_state(f"bpe {ranks_path} {pattern}", lambda: Codec(read_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """Replace the texts by their ids, packed as little-endian unsigned 32-bit integers.

    ``ranks_path`` is readable on every executor. Each match of ``pattern`` is encoded by itself; there are no special
    tokens. With ``bytes_col`` the same worker decodes the ids again, into that column. Null and empty texts give empty
    ids. Other columns are passed on; those named like a result are replaced. Repeated rows stay. Memory is bounded by
    one block of text, the tables of pieces seen before, and one pre-token.
    """
    made = [ids_col] if bytes_col is None else [ids_col, bytes_col]
    kept = rest_of(docs.columns, text_col, *made)
    source = docs.select(*kept, F.col(text_col).cast("string").alias("_llm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = codec(ranks_path, pattern)

        def both(text: str | None) -> tuple[bytes, ...]:
            ids = used.encode(text)
            return (ids,) if bytes_col is None else (ids, used.decode(ids))

        return add_binary(batches, "_llm_text", made, both)

    schema = source.select(*kept).schema
    for name in made:
        schema = schema.add(name, "binary")
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for, empty for null and empty ids. An id beyond the vocabulary is an error."""
    kept = rest_of(encoded.columns, bytes_col)
    source = encoded.select(*kept, F.col(ids_col).alias("_llm_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = codec(ranks_path, pattern)
        return add_binary(batches, "_llm_ids", [bytes_col], lambda ids: (used.decode(ids),))

    return source.mapInArrow(run, source.select(*kept).schema.add(bytes_col, "binary"))


def ids_as_array(ids_col: str = "ids"):
    """Packed ids as an array of integers, for consumers that want a list column."""
    count = (F.octet_length(ids_col) / 4).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def number(i):
        four = F.hex(F.substring(ids_col, i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(four, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    return F.transform(places, number)
