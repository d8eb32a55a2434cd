"""Near copies by the Jaccard similarity of their shingles: candidates from SimHash balls and MinHash bands, each verified.

Pairs at a similarity of 0.8 differ in some 8 of 64 SimHash bits, so balls of radius 4 alone find one in twenty of them;
MinHash bands bring the others in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import fingerprints
from postlens.llm.components import roots
from postlens.llm.simhash import ball_links, shingle_hashes, word_blocks
from postlens.llm.worker import rest_of
from postlens.session import materialise

#: Similarity from which two texts are copies, and the MinHash bands: a pair at 0.8 shares one of them with probability 0.9993.
SIMILARITY, BANDS, ROWS = 0.8, 24, 6

#: Of BANDS * ROWS MinHashes compared by four bits, a pair at the similarity differs in 27 +- 5; pairs with more than so
#: many are no candidates (one in 1400 of those at 0.8, far fewer of closer ones).
DIFFER = 42

#: What the likeness of two prints may lack: their estimate has a standard error of 0.023 at 0.8.
SLACK = 0.08

#: Shingles of the texts that are held against one other text in one go.
STRETCH = 200_000

#: Shingles that are hashed for all bands at once.
BLOCK = 1 << 12

_random = np.random.default_rng(42)
SEEDS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``width`` words in lower case, sorted; of all words if there are fewer."""
    parts, carried = [], []
    for words in word_blocks((text or "").encode().lower()):
        carried += words
        if len(carried) >= width:
            parts.append(shingle_hashes(carried, width))
            carried = carried[len(carried) - width + 1 :]
    if not parts and carried:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), 42)], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signature(text: str | None, width: int) -> dict[str, object]:
    """A hash of the whole set, its size, its SimHash, a hash for each band of MinHashes, and four bits of each MinHash."""
    found = shingles(text, width)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), BLOCK):
        some = found[k : k + BLOCK]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((some ^ SEEDS) * FACTORS).min(axis=1))
    bands = [signed(xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]
    fingerprint = int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])
    nibbles = (least & np.uint64(15)).astype(np.uint8)
    sketch = (nibbles[::2] | nibbles[1::2] << 4).view(np.int64).tolist()
    return {"whole": signed(xxhash.xxh64_intdigest(found.tobytes())), "size": len(found), "fp": signed(fingerprint), "bands": bands, "sketch": sketch}


def signatures(width: int):
    made = pa.struct([("whole", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<whole:long,size:long,fp:long,bands:array<long>,sketch:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((signature(t.as_py(), width) for t in texts), made)

    return of


WORDS = BANDS * ROWS // 16


def unlike_nibbles(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """How many of the four-bit parts of some pairs of longs differ."""
    count = F.lit(0)
    for x, y in pairs:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        count += F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return count


def candidate(x: str, y: str, least: float) -> Column:
    """Whether two cards (at, size, m0, m1, ...) may be of texts of similarity ``least``: their sizes allow it, and their sketches."""
    unlike = unlike_nibbles((F.col(f"{x}.m{k}"), F.col(f"{y}.m{k}")) for k in range(WORDS))
    sizes = F.least(f"{x}.size", f"{y}.size") >= least * F.greatest(f"{x}.size", f"{y}.size")
    return sizes & (unlike <= DIFFER)


def prints(width: int):
    """The lowest bit of each bin of the one-permutation fingerprint of a text."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        none = bytes(fingerprints.BINS * fingerprints.BITS // 8)
        bits = (np.unpackbits(np.frombuffer(fingerprints.fingerprint(t.as_py(), width) or none, np.uint8), bitorder="little") for t in texts)
        return pa.array((np.packbits(x[:: fingerprints.BITS], bitorder="little").view(np.int64) for x in bits), pa.list_(pa.int64()))

    return of


def folded() -> list[Column]:
    """The lowest bit of each MinHash of a card, 64 to a long."""
    low = [F.col(f"card.m{k}").bitwiseAND(F.lit(0x1111111111111111)) for k in range(WORDS)]
    longs = []
    for k in range(0, WORDS, 4):
        part = low[k]
        for i, more in enumerate(low[k + 1 : k + 4], 1):
            part = part.bitwiseOR(F.shiftleft(more, i))
        longs.append(part)
    return longs


def alike(x: str, y: str, longs: int, least: float) -> Column:
    """Whether the likeness of two such prints is within ``SLACK`` of ``least``, or above; half of unlike bits agree."""
    unlike = F.lit(0)
    for k in range(longs):
        unlike += F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}")))
    sizes = F.least(f"{x}.size", f"{y}.size") >= least * F.greatest(f"{x}.size", f"{y}.size")
    return sizes & (unlike <= int((fingerprints.BINS + BANDS * ROWS) * (1 - least + SLACK) / 2))


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of (a, b, size) whose texts, from (at, text), have a similarity of ``least`` or more.

    All texts that are held against one are streamed past it, in stretches of about ``STRETCH`` shingles, each a task's
    own; a text travels once for each pair in which it is ``b``, and once for each stretch in which it is ``a``.
    """
    loads = pairs.groupBy("a").agg((F.sum("size") / STRETCH).cast("long").alias("more")).where("more > 0")
    dealt = pairs.join(loads, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("more", F.lit(0)) + 1).alias("stretch"), "b")
    members = dealt.join(texts.withColumnRenamed("at", "b"), "b").select("a", "stretch", "b", "text")
    heads = dealt.select("a", "stretch").distinct().join(texts.withColumnRenamed("at", "a"), "a")
    stream = members.unionByName(heads.select("a", "stretch", F.lit(None).cast("long").alias("b"), "text"))
    order = ["a", "stretch", F.col("b").asc_nulls_first()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = shingles(text.as_py(), width)
                if b is None:
                    head = own
                elif similarity(head, own) >= least:
                    found.append((a, b))
            columns = [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return stream.repartition("a", "stretch").sortWithinPartitions(*order).select("a", "b", "text").mapInArrow(of, "a long, b long")


def linked(classes: DataFrame, marked: DataFrame, width: int, least: float) -> DataFrame:
    """(at, root) for each of the classes (at, size, fp, bands, sketch) of texts in ``marked`` (at, text): the member that its component goes by.

    A bucket holds the classes of an equal band hash or fingerprint. First all of a bucket are held against its hub, the
    member that meets most others, and the links of SimHash balls are verified; a group around one text is found by as many
    comparisons as it has members. What these links connect is contracted. Then, in buckets of more than one component,
    all pairs of different components are compared by size and by bits of both sketches inside a join, and those left are verified. Pairs
    within a component are never verified, others all are, so no link between components is lost. A pair counts in the
    first bucket that its members share; where one of them is its hub, the pair was settled before.
    """
    keys = classes.select("at", F.explode(F.concat("bands", F.array("fp"))).alias("key")).distinct()
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, "key"), "buckets")
    degrees = shared.groupBy("at").agg(F.sum("n").alias("degree"))
    card = F.struct(F.col("at"), F.col("size"), *[F.col("sketch")[k].alias(f"m{k}") for k in range(WORDS)])
    cards = classes.join(degrees, "at").select("at", "degree", card.alias("card"))
    dealt = materialise(shared.select("key", "at").join(cards, "at").select("key", "degree", "card"), "dealt")
    hubs = dealt.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("less"), "card")).alias("hub")).select("key", F.col("hub.card").alias("hub"))
    spokes = dealt.join(hubs, "key").where(F.col("card.at") != F.col("hub.at"))
    stars = spokes.where(candidate("hub", "card", least)).select(F.col("hub.at").alias("a"), F.col("card.at").alias("b"), "card.size")

    first = classes.groupBy("fp").agg(F.min(F.struct("at", "size")).alias("one"))
    balls = ball_links(first.select(F.col("fp").alias("fingerprint")))
    for side in "ab":
        balls = balls.join(first.select(F.col("fp").alias(side), F.col("one").alias(f"one_{side}")), side).drop(side)
    balls = balls.select(F.col("one_a.at").alias("a"), F.col("one_b.at").alias("b"), "one_b.size")

    asked = dealt.select("card.at").union(balls.select(F.explode(F.array("a", "b")))).distinct()
    texts = materialise(marked.join(asked, "at", "left_semi"), "asked")
    near = materialise(similar(materialise(stars.union(balls).distinct(), "stars"), texts, width, least), "near")
    joined = roots(near).withColumnRenamed("a", "at")
    component = F.coalesce("root", F.col("card.at"))
    rest = spokes.drop("hub").withColumn("at", F.col("card.at")).join(joined, "at", "left").select("key", component.alias("component"), "card")
    mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = materialise(rest.join(mixed, "key"), "mixed")
    asked = texts.join(rest.select("card.at").distinct(), "at", "left_semi")
    printed = materialise(asked.select("at", prints(width)("text").alias("bits")), "prints")
    longs = [*(F.col("bits")[k] for k in range(fingerprints.BINS // 64)), *folded()]
    print_ = F.struct("at", "card.size", *[long.alias(f"p{k}") for k, long in enumerate(longs)]).alias("print")
    met = F.concat("bands", F.array("fp"))
    own = classes.select("at", F.struct(*[met[k].alias(f"k{k}") for k in range(BANDS + 1)]).alias("keys"))
    rest = rest.withColumn("at", F.col("card.at")).join(printed, "at").join(own, "at").select("key", "component", print_, "keys")
    rest = materialise(rest, "mixed")
    one, two = (rest.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("component", "print", "keys")]) for k in (1, 2))
    first_met = F.coalesce(*[F.when(F.col(f"keys_1.k{k}") == F.col(f"keys_2.k{k}"), F.col(f"keys_1.k{k}")) for k in range(BANDS + 1)])
    unlike = (one["key"] == two["key"]) & (F.col("print_1.at") < F.col("print_2.at")) & (F.col("component_1") != F.col("component_2"))
    cross = one.join(two, unlike & alike("print_1", "print_2", len(longs), least) & (one["key"] == first_met)).select(F.col("print_1.at").alias("a"), F.col("print_2.at").alias("b"), "print_2.size")
    more = similar(materialise(cross.distinct(), "cross"), texts, width, least)
    for side in "ab":
        more = more.join(joined.select(F.col("at").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(side, F.coalesce(f"root_{side}", side))
    above = roots(more.select("a", "b")).select(F.col("a").alias("root"), F.col("root").alias("top"))
    known = classes.select("at").join(joined, "at", "left").withColumn("root", F.coalesce("root", "at"))
    return known.join(above, "root", "left").select("at", F.coalesce("top", "root").alias("root"))


def drop_near_copies(docs: DataFrame, width: int = 5, least: float = SIMILARITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep one document of each component of texts of similarity ``least`` or more: that of smallest id (no id comes last).

    Rows that share that id are told apart by a hash of all columns, and of equal rows any one stays. Texts with equal
    sets of shingles are one class in the search; null texts and texts without words are copies of each other. Rows are
    numbered in a written table, so that the choice holds even if a lost task deals them in another order.
    """
    kept = rest_of(docs.columns)
    hashed = docs.select(*kept, signatures(width)(F.col(text_col).cast("string")).alias("_llm_sig"), F.xxhash64(*kept).alias("_llm_row"))
    marked = materialise(hashed.withColumn("_llm_at", F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("_llm_id"), "_llm_row", "_llm_at")
    by_set = marked.groupBy(F.col("_llm_sig.whole").alias("whole")).agg(
        F.min("_llm_at").alias("at"), F.min(order).alias("best"), F.min("_llm_sig.fp").alias("fp"), F.min("_llm_sig.bands").alias("bands"), F.min("_llm_sig.size").alias("size"), F.min("_llm_sig.sketch").alias("sketch")
    )
    classes = materialise(by_set.drop("whole"), "classes")
    texts = marked.select(F.col("_llm_at").alias("at"), F.col(text_col).cast("string").alias("text"))
    named = classes.select("at", "best").join(linked(classes.drop("best"), texts, width, least), "at")
    chosen = named.groupBy("root").agg(F.min("best")["_llm_at"].alias("_llm_at")).select("_llm_at")
    return marked.join(chosen, "_llm_at", "left_semi").select(*kept)
