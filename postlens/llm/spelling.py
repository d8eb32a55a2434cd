"""Spelling variants by an index of variable-length grams.

Grams of two to ``LONGEST`` characters are counted over the vocabulary. A gram joins the dictionary if the one that it
extends is frequent, so that rare grams stay short and frequent ones grow. A word, padded at both ends, is decomposed into
the longest dictionary gram at each place, without those that lie inside another. How many of its grams any single edit
can change, be it by hitting them or by letting a neighbour grow over them, is worked out for each word. Two words at one
edit share all others, so the rarest (bound + 1) grams of each have one in common: only these are listed. Words of one
list, at the same distance from the start or from the end, are verified.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.worker import worker_state
from postlens.session import materialise, spread

#: Lengths of grams, and the share of all gram places from which a gram is frequent and is extended. The dictionary then
#: has at most (LONGEST - 2) / SHARE frequent grams and their extensions by one letter, whatever the corpus.
SHORTEST, LONGEST, SHARE = 2, 4, 5e-5

#: What words are padded with, on both sides.
LEFT, RIGHT = "\ue000" * (LONGEST - 1), "\ue001" * (LONGEST - 1)

#: Entries that a worker counts before it sends them on.
COUNTED = 400_000


def count_words(docs: DataFrame, pattern: str, damage: int = 0, text_col: str = "text", id_col: str = "doc_id", least_chars: int = 1, least: int = 1) -> DataFrame:
    """(word, n): how often each match of ``pattern`` occurs, A-Z in lower case, of ``least_chars`` characters and ``least`` uses or more.

    With ``damage``, a word of a document loses a character where ``damage`` divides the crc32 of ``<id>:<word>``: the one
    at that number modulo its length. Missing ids are empty there. Null texts have no words. Workers add up before the
    shuffle, in tables of bounded size.
    """
    ids, texts = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
    found = re.compile(pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32, total = zlib.crc32, defaultdict(int)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words: dict[str, int] = defaultdict(int)
                for word in found.findall(value.as_py().encode().lower().decode()):
                    words[word] += 1
                if damage:
                    start = crc32(f"{key}:".encode())
                    for word, n in words.items():
                        if len(word) >= least_chars:
                            h = crc32(word.encode(), start)
                            if not h % damage:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_chars:
                                    continue
                            total[word] += n
                else:
                    for word, n in words.items():
                        if len(word) >= least_chars:
                            total[word] += n
                if len(total) >= COUNTED:
                    yield sent()
                    total.clear()
        if total:
            yield sent()

    counted = spread(docs.where(texts.isNotNull()).select(ids.alias("id"), texts.alias("text"))).mapInArrow(of, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def padded(word: Column) -> Column:
    return F.concat(F.lit(LEFT), word, F.lit(RIGHT))


def dictionary(words: DataFrame) -> dict[str, int]:
    """The grams of the index and how often they occur in distinct words; see ``SHARE`` for the bound of its size."""
    whole = words.select(padded(F.col("word")).alias("w"))
    each = lambda q: F.transform(F.sequence(F.lit(1), F.char_length("w") - (q - 1)), lambda i: F.substring(F.col("w"), i, F.lit(q)))
    grams = whole.select(F.explode(F.flatten(F.array(*map(each, range(SHORTEST, LONGEST + 1))))).alias("gram"))
    counts = materialise(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    places = counts.where(F.char_length("gram") == SHORTEST).agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.char_length("gram") < LONGEST) & (F.col("n") > max(1, SHARE * places))).select(F.col("gram").alias("stem"))
    longer = counts.where(F.char_length("gram") > SHORTEST).withColumn("stem", F.expr("left(gram, char_length(gram) - 1)"))
    chosen = longer.join(frequent, "stem", "left_semi").select("gram", "n").unionByName(counts.where(F.char_length("gram") == SHORTEST))
    return {r["gram"]: r["n"] for r in chosen.toLocalIterator()}


class Index:
    """Decomposes words by a dictionary of grams."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        longer = [g for g in grams if len(g) > SHORTEST]
        self.heads = {g[:k] for g in longer for k in range(SHORTEST, len(g))}
        self.tails = {g[-k:] for g in longer for k in range(SHORTEST, len(g))}

    def decompose(self, s: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the grams of a padded word; both ascend."""
        starts, ends, reach = [], [], 0
        for p in range(len(s) - SHORTEST + 1):
            for n in range(min(LONGEST, len(s) - p), SHORTEST - 1, -1):
                if n == SHORTEST or s[p : p + n] in self.grams:
                    break
            if p + n > reach:
                starts.append(p)
                ends.append(p + n)
                reach = p + n
        return starts, ends

    def bound(self, s: str, starts: list[int], ends: list[int]) -> int:
        """The most grams that one edit between the paddings can change.

        Left of the edit, a gram may go if some start at or before its own could now begin a longer gram that reaches the
        edit; right of it, likewise for ends. The changed grams are neighbours, so their number is a difference of places.
        """
        most = 0
        for i in range(len(LEFT), len(s) - len(RIGHT) + 1):
            first = next((j for j in range(max(0, i - LONGEST + 1), i - SHORTEST + 1) if s[j:i] in self.heads), None)
            low = bisect_right(ends, i)
            if first is not None:
                low = min(low, bisect_left(starts, first))
            # an insertion before place i, then a change of the character at i
            for after, high in ((i, bisect_left(starts, i)), (i + 1, bisect_right(starts, i))):
                last = next((f for f in range(min(len(s), after + LONGEST - 1), after + SHORTEST - 1, -1) if s[after:f] in self.tails), None)
                if last is not None:
                    high = max(high, bisect_right(ends, last))
                most = max(most, high - low)
        return most

    def listed(self, word: str) -> list[tuple[str, int, int]]:
        """(gram, distance from the start, distance from the end) for the grams under which a word is listed."""
        s = LEFT + word + RIGHT
        starts, ends = self.decompose(s)
        ranked = sorted((self.grams.get(s[p:e], 0), s[p:e], p, len(s) - e) for p, e in zip(starts, ends, strict=True))
        return [x[1:] for x in ranked[: self.bound(s, starts, ends) + 1]]


def near_words(words: DataFrame) -> DataFrame:
    """Links (a, b, n_a, n_b), a < b, between all of the distinct words (word, n) at exactly one edit of each other.

    Each link comes once. Words that share a list are compared by the letters they have, then by their edit distance,
    within the join; only verified pairs leave it. Long lists are split by the planner's skew join.
    """
    grams = dictionary(words)
    index, state = words.sparkSession.sparkContext.broadcast(grams), f"grams {uuid.uuid4().hex}"

    @F.arrow_udf("array<struct<gram:string,start:int,end:int>>")
    def lists(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("gram", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        own = worker_state(state, lambda: Index(index.value))
        return pa.array(([dict(zip(("gram", "start", "end"), x, strict=True)) for x in own.listed(v.as_py())] for v in values), kind)

    letters = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))
    known = words.select("word", "n", F.char_length("word").alias("size"), letters.alias("letters"), F.explode(lists("word")).alias("at"))
    keys = F.array(F.xxhash64(F.lit("start"), "at.gram", "at.start"), F.xxhash64(F.lit("end"), "at.gram", "at.end"))
    # words of one character may share no gram, and all are at one edit of each other
    keys = F.when(F.col("size") == 1, F.array_append(keys, F.xxhash64(F.lit("one")))).otherwise(keys)
    listed = materialise(known.select(F.explode(keys).alias("key"), "word", "n", "size", "letters"), "lists")
    a, b = (listed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "size", "letters")]) for side in "ab")
    close = (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2)
    near = (a["key"] == b["key"]) & (F.col("word_a") < F.col("word_b")) & close & (F.levenshtein("word_a", "word_b", 1) == 1)
    return a.join(b, near).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b").distinct()


def variant_forms(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table of distinct words and their counts.

    ``form`` is the near word of largest count, the first in code-point order among equals, if its count is at least
    ``times`` that of the word. ``root`` follows the forms to the last, which is the word itself if it has none; counts
    grow along that way, so its length is bounded by a logarithm of the largest count. Empty tables give no rows.
    """
    words = materialise(words.select("word", "n"), "words")
    links = near_words(words)
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("less"), F.col(y).alias("other")).alias("near"))
    best = links.select(F.inline(F.array(way("a", "b"), way("b", "a")))).groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    is_form = -F.col("near.less") >= times * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near.other")).alias("form"), F.when(is_form, -F.col("near.less")).alias("form_n")
    )
    known = materialise(known, "forms")
    # each round, a way to the root is twice as long
    ways = materialise(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return known.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))
