"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned for in every window of the documents."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.staging import pin
from postlens.llm.worker import rest_of
from postlens.session import materialise

NGRAM = 10

#: Bytes of the n-gram table that are broadcast at once. A larger table is taken in several parts.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text (null: none) in their normal form, with capitals A-Z lowered."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD + "+"), "")


def gram_hash(words: Column, start: Column, size: Column, n: int) -> Column:
    """A hash of up to n words from ``start``, counted from 0. Missing places leave it as it is."""
    return F.xxhash64(*[F.when(size > k, F.get(words, start + k)) for k in range(n)])


def benchmark_grams(benchmark: DataFrame, n: int = NGRAM, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(hash, size, gram, items): each distinct window of n words, or whole item of fewer, and the items that have it.

    Items without words have none. Ids that are null name no item, but their windows count.
    """
    items = pin(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), words=words_of(F.col("text")))
    n_words = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n_words - (n - 1), F.lit(1)))
    windows = items.where(n_words > 0).select("item", "words", F.least(n_words, F.lit(n)).alias("size"), F.explode(starts).alias("start"))
    taken = windows.select("item", "size", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("gram"))
    grams = taken.groupBy("gram").agg(F.first("size").alias("size"), F.collect_set("item").alias("items"))
    return grams.select(gram_hash(F.split("gram", " "), F.lit(0), F.col("size"), n).alias("hash"), "size", "gram", "items")


def _windows(docs: DataFrame, sizes: list[int], n: int, text_col: str, id_col: str) -> DataFrame:
    """(id, text hash, words, number of words, hash, start, size) of each window, and one row for each document with no hash.

    The rows are made, hashed and looked up within one generated stage, where all windows of a document share one array.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = pin(keyed.select("id", "text", F.xxhash64("text").alias("text_hash")), words=words_of(F.col("text")))
    split = split.select("id", "text_hash", "words", F.size("words").alias("n_words"))
    windows = [F.greatest(F.col("n_words") - (size - 1), F.lit(0)) for size in sizes]
    total = sum(windows, F.lit(0))
    dealt = split.select("id", "text_hash", "words", "n_words", F.explode_outer(F.sequence(F.lit(0), total)).alias("place"))
    start, size, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for one, count in zip(sizes, windows, strict=True):
        here = (F.col("place") >= before) & (F.col("place") < before + count)
        start, size = F.when(here, F.col("place") - before).otherwise(start), F.when(here, one).otherwise(size)
        before = before + count
    placed = dealt.select("id", "text_hash", "words", "n_words", start.alias("start"), size.alias("size"))
    hashed = F.when(F.col("start").isNotNull(), gram_hash(F.col("words"), F.col("start"), F.col("size"), n))
    return placed.withColumn("hash", hashed)


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, id_col: str, with_all: bool, limit: int) -> DataFrame:
    """Verified hits (id, text_hash, n_words, start, size, items); ``with_all`` adds a row with no start for each document.

    A window is looked up by its hash in the broadcast table, and counts if its normal form is the entry's. The table
    is measured; beyond ``limit`` bytes it is broadcast in parts, each against all windows.
    """
    grams = materialise(benchmark_grams(benchmark, n), "grams")
    size_of = F.octet_length("gram") + 16 * F.size("items") + 64
    total, sizes = grams.agg(F.coalesce(F.sum(size_of), F.lit(0)), F.sort_array(F.collect_set("size"))).first()
    windows = _windows(docs, list(sizes), n, text_col, id_col)
    parts = max(1, math.ceil(total / limit))

    def look_up(part: int) -> DataFrame:
        entries = grams if parts == 1 else grams.where(F.pmod("hash", F.lit(parts)) == part)
        entries = entries.select(F.col("hash").alias("entry"), "gram", "items")
        met = windows.join(F.broadcast(entries), F.col("hash") == F.col("entry"), "left")
        # Verified behind the outer join: as part of its condition the words of every window would be joined for a key.
        hit = F.col("entry").isNotNull() & (F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ") == F.col("gram"))
        found = met.where(hit | F.col("hash").isNull())
        start = F.when(F.col("entry").isNotNull(), F.col("start")).alias("start")
        rows = found.select("id", "text_hash", "n_words", start, "size", "items")
        return rows if with_all and part == 0 else rows.where("start IS NOT NULL")

    return reduce(DataFrame.union, map(look_up, range(parts)))


def union_size(spans: Column) -> Column:
    """The number of places that sorted (start, size) spans cover."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("total"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["at"], s["start"] + s["size"])
        return F.struct(end.alias("at"), (acc["total"] + end - F.greatest(acc["at"], s["start"])).alias("total"))

    return F.aggregate(spans, begin, step, lambda acc: acc["total"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text", id_col: str = "doc_id", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(id, text_hash, n_words, hit_spans, n_hit, items): one row for each document row.

    ``hit_spans`` are the matching windows as (first word from 0, number of words), ``n_hit`` the words in any of them,
    ``items`` the sorted ids of the items they belong to. Null and empty texts have no words. Repeated rows come out as
    often as they went in. Only windows that match are shuffled, and one row for each document.
    """
    hits = _hits(docs, benchmark, n, text_col, id_col, True, limit)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "size"))
    by_doc = hits.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("start").isNull(), 1)).cast("int").alias("rows"),
        F.sort_array(F.collect_set(span)).alias("hit_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    each = by_doc.select("*", F.explode(F.sequence(F.lit(1), "rows")).alias("copy"))
    return each.select(F.col("id").alias(id_col), "text_hash", "n_words", "hit_spans", union_size(F.col("hit_spans")).alias("n_hit"), "items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, text_col: str = "text", id_col: str = "doc_id", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns. Null and empty texts stay."""
    hits = _hits(docs, benchmark, n, text_col, id_col, False, limit).select(F.col("id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_llm_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_llm_hash"))
    return docs.select(*rest_of(docs.columns)).join(hits, same, "left_anti")


def remove_spans(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with their hit words taken out, given ``contamination(docs, ...)``. What stands between words stays."""
    spans = found.where("n_hit > 0").select(F.col(id_col).alias("_llm_id"), F.col("text_hash").alias("_llm_hash"), F.col("hit_spans").alias("_llm_spans")).dropDuplicates(["_llm_id", "_llm_hash"])
    same = F.col(id_col).eqNullSafe(F.col("_llm_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_llm_hash"))
    kept = rest_of(docs.columns)
    df = docs.select(*kept).join(spans, same, "left")
    hit, text = F.col("_llm_spans").isNotNull(), F.col(text_col)
    df = pin(df, _llm_words=F.when(hit, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), _llm_gaps=F.when(hit, F.split(text, WORD)))
    gone = lambda i: F.exists("_llm_spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["size"]))
    left = F.transform("_llm_words", lambda w, i: F.concat(F.get("_llm_gaps", i), F.when(gone(i), "").otherwise(w)))
    rebuilt = F.concat(F.array_join(left, ""), F.element_at("_llm_gaps", -1))
    return df.withColumn(text_col, F.when(hit, rebuilt).otherwise(text)).select(*kept)
