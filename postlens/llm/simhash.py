"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import roots
from postlens.llm.worker import rest_of, worker_state
from postlens.session import materialise

#: Fingerprints expected in a bucket of leading bits, and the range of the number of those bits.
BUCKET, FEWEST_BITS, MOST_BITS = 1000, 10, 24

#: Variants that a worker sorts at once.
VARIANTS = 1 << 20

#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(text):
        cut = SPACE.search(text, start + BLOCK_BYTES)
        end = cut.end() if cut else len(text)
        yield text[start:end].split()
        start = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, last = xxhash.xxh64_intdigest, len(words) - width + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, last)


def simhash(text: str | None, width: int) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):
        carried += words
        if len(carried) >= width:
            hashes = shingle_hashes(carried, width)
            for k in range(0, len(hashes), 1 << 16):
                bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
            carried = carried[len(carried) - width + 1 :]
    if not total and carried:
        value = xxhash.xxh64_intdigest(b" ".join(carried), 42)
    else:
        value = int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 4, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (long) of the texts' shingles of ``width`` words in lower case; of all words if there are fewer.

    Null texts and texts without words get zero.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(t.as_py(), width) for t in texts), pa.int64())

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def flips(bits: int, most: int) -> list[int]:
    """All masks over ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def colliding(values: np.ndarray, owners: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of owners that share a variant, where a value of ``bits`` bits has all variants within ``left`` flips.

    Owners of one variant are linked to one of them. Large sets are split by further leading bits, which keeps the
    number of variants held at once within ``VARIANTS``.
    """
    sizes = [sum(math.comb(bits, k) for k in range(n + 1)) for n in range(int(left.max(initial=0)) + 1)]
    if bits and len(values) > 1 and sum(size * int((left == n).sum()) for n, size in enumerate(sizes)) > VARIANTS:
        head = min(bits, 4)
        low, top = values & np.uint64((1 << (bits - head)) - 1), values >> np.uint64(bits - head)
        for key in range(1 << head):
            rest = left - np.bitwise_count(top ^ np.uint64(key)).astype(np.int64)
            near = rest >= 0
            yield from colliding(low[near], owners[near], rest[near], bits - head)
        return
    made, by = [], []
    for n in range(len(sizes)):
        mine = left == n
        masks = worker_state(f"flips {bits} {n}", lambda: np.array(flips(bits, n), np.uint64))
        made.append((values[mine][:, None] ^ masks).ravel())
        by.append(np.repeat(owners[mine], len(masks)))
    variants, who = np.concatenate(made), np.concatenate(by)
    order = np.argsort(variants, kind="stable")
    variants, who = variants[order], who[order]
    same = np.flatnonzero(variants[1:] == variants[:-1]) + 1
    if len(same):
        heads = np.concatenate(([0], np.flatnonzero(variants[1:] != variants[:-1]) + 1))
        yield who[heads[np.searchsorted(heads, same, "right") - 1]], who[same]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes a smallest connected node, given the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def ball_links(classes: DataFrame, radius: int = 4, column: str = "fingerprint") -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at ``radius`` or fewer differing bits, directly or in steps.

    Two fingerprints differ in at most ``radius`` bits exactly if they have a variant in common among those within half
    of it, so that all owners of a variant are within the radius of each other, and links to one of them connect them.
    The variants are dealt out by their leading bits; a fingerprint goes once to each bucket where it has any, and the
    bucket makes them. Thus the shuffle carries tens of copies instead of thousands. The number of leading bits follows
    the number of fingerprints. Each bucket returns a forest instead of all pairs.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    half, count = radius // 2, classes.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(count, 1) / BUCKET)) if count else 0))
    masks = F.array(*[F.lit(m) for m in flips(bits, half)])
    head = F.shiftrightunsigned(F.col(column), 64 - bits)
    dealt = classes.select(F.col(column).alias("fp"), F.explode(F.transform(masks, lambda m: head.bitwiseXOR(m))).alias("bucket"))

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        values = np.unique(group["fp"].to_numpy().astype(np.int64)).view(np.uint64)
        left = half - np.bitwise_count((values >> np.uint64(64 - bits)) ^ np.uint64(key[0].as_py())).astype(np.int64)
        low = values & np.uint64((1 << (64 - bits)) - 1)
        label = np.arange(len(values))
        for a, b in colliding(low, np.arange(len(values), dtype=np.int32), left, 64 - bits):
            near = (label[a] != label[b]) & (np.bitwise_count(values[a] ^ values[b]) <= radius)
            pairs = np.unique(label[a[near]] * len(values) + label[b[near]])
            label = forest(len(values), pairs // len(values), pairs % len(values))[label]
        linked = np.flatnonzero(label != np.arange(len(values)))
        found = values.view(np.int64)
        return pa.table({"a": found[linked], "b": found[label[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def component_ids(marked: DataFrame, radius: int = 4, id_col: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """(fingerprint, root, component_id): the component's smallest fingerprint, and the smallest id of its documents.

    ``component_id`` is null if no document of the component has an id.
    """
    classes = materialise(marked.groupBy(column).agg(F.min(id_col).alias("low")), "classes")
    linked = roots(ball_links(classes.select(column), radius, column))
    named = classes.join(linked.withColumnRenamed("a", column), column, "left").withColumn("root", F.coalesce("root", column))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(least, "root").select(column, "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id) for each row; see ``fingerprints`` and ``component_ids``.

    Repeated rows each get theirs; ids may be null or occur more than once. An empty table gives no rows. Exact copies
    count once in the search for links, so a large group of them costs no more than one document.
    """
    texts = docs.select(F.col(id_col).alias("_llm_id"), F.col(text_col).alias("_llm_text"))
    marked = materialise(fingerprints(texts, width, "_llm_text").drop("_llm_text"), "fingerprints")
    found = component_ids(marked, radius, "_llm_id").drop("root")
    return marked.join(found, "fingerprint").select(F.col("_llm_id").alias(id_col), "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep one document of each component, with all its columns: the one of smallest id (no id comes last).

    Rows that share that id are told apart by a hash of all columns, and of equal rows any one stays. Null and empty
    texts have fingerprint zero and are copies of each other. The fingerprints are written once with a number for each
    row, so that the choice holds even if a lost task deals rows in another order.
    """
    kept = rest_of(docs.columns)
    hashed = fingerprints(docs.select(*kept), width, text_col, "_llm_fp").withColumn("_llm_row", F.xxhash64(*kept))
    marked = materialise(hashed.withColumn("_llm_at", F.monotonically_increasing_id()), "marked")
    keys = marked.select(F.col("_llm_fp").alias("fingerprint"), F.col(id_col).alias("_llm_id"), "_llm_row", "_llm_at")
    found = component_ids(keys, radius, "_llm_id").select("fingerprint", "root")
    first = F.min(F.struct(F.col("_llm_id").isNull(), "_llm_id", "_llm_row", "_llm_at"))["_llm_at"]
    chosen = keys.join(found, "fingerprint").groupBy("root").agg(first.alias("_llm_at")).select("_llm_at")
    return marked.join(chosen, "_llm_at", "left_semi").select(*kept)
