"""Quotation linking: conversations in reply order, rebuilt from the passages that messages quote."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.worker import BATCH_BYTES, rest_of
from postlens.session import materialise

MARK = re.compile(r"(?:>[ \t]?)+")

#: Words that a single line needs to be looked up by itself; whole passages are looked up whatever their length.
LINE_WORDS = 5

PARTS = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))


def parse(text: str | None) -> tuple[str, list[dict]]:
    """What a message says itself, and the passages it quotes: runs of lines of one level, without their marks."""
    own: list[str] = []
    parts: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        mark = MARK.match(line)
        if not mark:
            own.append(line)
            parts.append((0, []))
            continue
        level, rest = mark[0].count(">"), line[mark.end() :]
        if not parts or parts[-1][0] != level:
            parts.append((level, []))
        parts[-1][1].append(rest)
    quoted = [{"level": level, "text": "\n".join(lines)} for level, lines in parts if level]
    return "\n".join(own).strip("\n"), quoted


def split_quotes(messages: DataFrame, text_col: str) -> DataFrame:
    """Replace ``text_col`` by ``own`` and ``quoted``, an array of (level, text)."""
    kept = [name for name in messages.columns if name != text_col]
    source = messages.select(*kept, F.col(text_col).cast("string").alias("_llm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size, own, quoted = batch.column(len(kept)), 0, 0, [], []
            for row in range(len(batch)):
                said, parts = parse(texts[row].as_py())
                own.append(said)
                quoted.append(parts)
                size += len(said) + sum(len(part["text"]) for part in parts)
                if size >= BATCH_BYTES or row == len(batch) - 1:
                    columns = [batch.column(i).slice(first, len(own)) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string()), pa.array(quoted, PARTS)], names=[*kept, "own", "quoted"])
                    first, size, own, quoted = row + 1, 0, [], []

    quoted = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))
    return source.mapInArrow(run, source.select(*kept).schema.add("own", "string").add("quoted", quoted))


def normal(text: Column) -> Column:
    """Lower case, white space and quotation marks at the ends folded."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def units(text: Column) -> Column:
    """(hash, weight) of a passage as a whole and of each of its longer lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), normal), lambda line: F.size(F.split(line, " ")) >= LINE_WORDS)
    every = F.array_distinct(F.concat(F.array(normal(text)), lines))
    hashed = lambda unit: F.struct(F.sha2(unit, 256).alias("hash"), F.char_length(unit).alias("weight"))
    return F.transform(F.filter(every, lambda unit: unit != ""), hashed)


def _threads(links: DataFrame) -> DataFrame:
    """(grp, ord, root, depth) from (grp, ord, parent), one row for each message, parents before their replies.

    Each round doubles the length of the ways that have not met a first message yet, and is written to the shared folder;
    messages that have met theirs take no part in later rounds.
    """
    first = F.col("parent").isNull()
    ways = links.select("grp", "ord", F.coalesce("parent", "ord").alias("root"), F.when(first, 0).otherwise(1).cast("long").alias("depth"), (~first).alias("open"))
    ways = materialise(ways, "ways")
    done, left = ways.where("NOT open"), ways.where("open")
    while left.limit(1).count():
        known = done.unionByName(left).select(
            F.col("grp").alias("g"), F.col("ord").alias("at"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("open").alias("further")
        )
        same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("root") == F.col("at"))
        longer = left.join(known, same).select("grp", "ord", F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("further").alias("open"))
        longer = materialise(longer, "ways")
        done, left = done.unionByName(longer.where("NOT open")), longer.where("open")
    return done.drop("open")


def link_quotes(messages: DataFrame, group_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Conversations in reply order, without quotes.

    Adds ``parent`` (order of the message replied to, null for none found), ``root`` and ``depth`` of the reply tree,
    and ``n_quotes`` and ``n_linked``, the passages quoted and those whose text was found; the text becomes what the
    message says itself. A passage belongs to the first message of its group, earlier than the quoting one, that says
    the passage or a line of it of five words or more, white space and case aside. The parent is the message with the
    outermost quote, then the most quoted characters, then the later one. Rows come sorted by group, root and order.

    Null and empty texts quote nothing. Rows of one group and order count as one message for links and each stay. Rows
    without order are linked to nothing. Columns with the names of the results are replaced. All joins are on single
    messages or first sayings, so that a passage which everybody quotes gives one link for each quote.
    """
    made = ("parent", "root", "depth", "n_quotes", "n_linked", "own", "quoted", "grp", "ord")
    kept = rest_of(messages.columns, *made, group_col, order_col, text_col)
    keyed = messages.select(F.col(group_col).alias("grp"), F.col(order_col).cast("long").alias("ord"), *kept, F.col(text_col).alias("_llm_said"))
    said = materialise(split_quotes(keyed, "_llm_said"), "said")
    there = said.where("ord IS NOT NULL")
    spoken = there.select("grp", "ord", F.explode(units(F.col("own"))).alias("u")).groupBy(F.col("grp").alias("g"), F.col("u.hash").alias("said_hash")).agg(F.min("ord").alias("first"))
    quotes = there.select("grp", "ord", F.posexplode("quoted").alias("place", "q")).select("grp", "ord", "place", "q.level", F.explode(units(F.col("q.text"))).alias("u"))
    quotes = quotes.select("grp", "ord", "place", "level", "u.hash", "u.weight").distinct()
    same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("hash") == F.col("said_hash")) & (F.col("first") < F.col("ord"))
    found = quotes.join(spoken, same).select("grp", "ord", "place", "level", "weight", "first")
    by_source = found.groupBy("grp", "ord", "level", "first").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct((-F.col("level")).alias("near"), F.col("weight"), F.col("first")))["first"]
    parents = by_source.groupBy("grp", "ord").agg(best.alias("parent"))
    linked = found.groupBy("grp", "ord").agg(F.countDistinct("place").alias("n_linked"))
    on_key = lambda other: F.col("grp").eqNullSafe(F.col(f"{other}g")) & (F.col("ord") == F.col(f"{other}o"))
    renamed = lambda df, other: df.withColumnsRenamed({"grp": f"{other}g", "ord": f"{other}o"})
    links = there.select("grp", "ord").distinct().join(renamed(parents, "p_"), on_key("p_"), "left").join(renamed(linked, "l_"), on_key("l_"), "left")
    links = materialise(links.select("grp", "ord", "parent", F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "links")
    threads = links.join(renamed(_threads(links.select("grp", "ord", "parent")), "t_"), on_key("t_")).drop("t_g", "t_o")
    rows = said.withColumn("n_quotes", F.size("quoted").cast("long")).join(renamed(threads, "r_"), on_key("r_"), "left")
    return rows.select(
        F.col("grp").alias(group_col),
        F.col("ord").alias(order_col),
        *kept,
        F.col("own").alias(text_col),
        "parent",
        "root",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    ).orderBy(group_col, "root", order_col)
