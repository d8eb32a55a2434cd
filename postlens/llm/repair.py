"""Repair of conversations by weighted CYK interval parsing.

The roles of a repaired conversation are an optional system turn followed by user and assistant in turn. Its grammar has
a nonterminal ``pq`` for all that leads from state p to state q, with the rules ``pq -> pr rq`` and ``pq -> turn``; that
is Chomsky normal form. A cell holds, for a span of turns and each nonterminal, the least (cost, audit), closed under
insertions at its ends. Since ``pr rq`` derives a span at every split, or at none, one split of each span is enough: the
halves. Cells are combined bottom-up by span length, neighbours first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import materialise

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; the last and the first may end.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

#: What edits cost: a role changed, a turn deleted, an empty turn inserted; and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: First faults of a turn.
FINE, BLANK, DUPLICATE, CUT = range(4)

Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, key: tuple[int, int], cost: int, audit: str) -> None:
    if key not in cell or (cost, audit) < cell[key]:
        cell[key] = (cost, audit)


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    made: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                better(made, (p, q), cost + more, audit + rest)
    return made


def closure() -> Cell:
    """What insertions alone lead to: the cell of an empty span."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one: Cell = {move: (INSERT, "I") for role in NAMES for move in MOVES[role]}
    while True:
        more = combine(cell, one)
        grown = dict(cell)
        for key, value in more.items():
            better(grown, key, *value)
        if grown == cell:
            return cell
        cell = grown


EMPTY = closure()


def turn_cell(initial: str, fault: int) -> Cell:
    """The cell of one turn: kept, given another role, or deleted, with insertions before and after it."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        for role in NAMES:
            for move in MOVES[role]:
                better(cell, move, REROLE + extra, "R")
        for move in MOVES.get(initial, ()):
            better(cell, move, extra, "K")
    return combine(combine(EMPTY, cell), EMPTY)


CELLS = {(initial, fault): turn_cell(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)}


def parse(cells: list[Cell]) -> Cell:
    """The cell of the whole span of some neighbouring cells."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    """The least cost and its audit for a whole conversation."""
    return min(cell[START, q] for q in FINAL if (START, q) in cell)


def path(cells: list[Cell]) -> list[tuple[int, int]]:
    """The nonterminal of each of some neighbouring spans in the cheapest whole parse."""
    levels = [cells]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([combine(*low[i : i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    top = levels[-1][0]
    chosen = [min(((START, q) for q in FINAL if (START, q) in top), key=top.__getitem__)]
    for low in reversed(levels[:-1]):
        finer = []
        for i, (p, q) in enumerate(chosen):
            pair = low[2 * i : 2 * i + 2]
            if len(pair) == 1:
                finer.append((p, q))
                continue
            x, y = pair
            r = min((r for r in range(4) if (p, r) in x and (r, q) in y), key=lambda r: (x[p, r][0] + y[r, q][0], x[p, r][1] + y[r, q][1]))
            finer += [(p, r), (r, q)]
        chosen = finer
    return chosen


def applied(initials: list[str], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """For each turn: the roles inserted before it, its own new role ('' if deleted, '=' if kept), and those after the last."""
    i, before = 0, ""
    rows: list[list[str]] = []
    for edit in audit:
        if edit == "D":
            rows.append([before, "", ""])
            before, i = "", i + 1
            continue
        role = initials[i] if edit == "K" else "a" if state == USER else "u"
        state = next(q for p, q in MOVES[role] if p == state)
        if edit == "I":
            before += role
        else:
            rows.append([before, "=" if edit == "K" else role, ""])
            before, i = "", i + 1
    if rows:
        rows[-1][2] = before
    return map(tuple, rows)


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): the turns in order, written; ``at`` grows along conversations and their turns.

    Turns without number come first; turns of one number are ordered by role and a hash of the text. Null roles and texts
    are one space. The order is by ranges, so that a long conversation is spread over tasks.
    """
    one = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", one("role", "string"), one("text", "string"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, fault) of prepared rows: blank, then said before, then cut off.

    Equal turns are met by a hash of role and text of 256 bits; the first of each is found by partial minima.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # whether the last character that is no white space closes a sentence
    closed = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1).isin(".", "!", "?")
    light = rows.select("at", "conv_id", "turn", initial(F.col("role")).alias("initial"), F.sha2(F.concat("role", F.lit("\x00"), "text"), 256).alias("said"), blank.alias("blank"), closed.alias("closed"))
    firsts = light.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("closed"), CUT).otherwise(FINE)
    return light.join(firsts, "at", "left").select("at", "conv_id", "turn", "initial", fault.alias("fault"))


SEGMENT = "part long, conv_id {id}, ats array<long>, initials array<string>, p array<int>, q array<int>, cost array<long>, audit array<string>, faults array<long>, illegal long, low long, high long, n_turns long"


def segments(marked: DataFrame) -> DataFrame:
    """One row for each stretch of a conversation within a range of the order: its cell and its counts.

    A conversation has at most as many stretches as there are ranges.
    """
    id_type = marked.schema["conv_id"].dataType.simpleString()
    ranged = marked.select("conv_id", "at", F.col("turn").cast("long").alias("turn"), "initial", "fault").repartitionByRange("at").sortWithinPartitions("at")

    def stretch(key: object, rows: list[tuple]) -> dict[str, object]:
        initials = [r[2] for r in rows]
        cell = parse([CELLS[r[2] if r[2] in MOVES else "", r[3]] for r in rows])
        turns = [r[1] for r in rows if r[1] is not None]
        return {
            "part": rows[0][0], "conv_id": key, "ats": [r[0] for r in rows], "initials": initials, "p": [k[0] for k in cell], "q": [k[1] for k in cell],
            "cost": [v[0] for v in cell.values()], "audit": [v[1] for v in cell.values()], "faults": [sum(r[3] == f for r in rows) for f in (BLANK, DUPLICATE, CUT)],
            "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
            "low": min(turns, default=None), "high": max(turns, default=None), "n_turns": len(set(turns)),
        }

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rows, made, size, kind = object(), [], [], 0, None
        current: object = whole
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, *row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if key != current or current is whole:
                    if rows:
                        made.append(stretch(current, rows))
                        size += len(rows)
                    current, rows = key, []
                    if size >= 20_000:
                        yield pa.RecordBatch.from_pylist(made, schema(kind))
                        made, size = [], 0
                rows.append(tuple(row))
        if rows:
            made.append(stretch(current, rows))
            yield pa.RecordBatch.from_pylist(made, schema(kind))

    def schema(kind: pa.DataType) -> pa.Schema:
        ints, longs, texts = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [pa.int64(), kind, longs, texts, ints, ints, longs, texts, longs, *[pa.int64()] * 4]
        return pa.schema(list(zip(["part", "conv_id", "ats", "initials", "p", "q", "cost", "audit", "faults", "illegal", "low", "high", "n_turns"], kinds, strict=True)))

    return materialise(ranged.mapInArrow(of, SEGMENT.format(id=id_type)), "stretches")


JOINED = "struct<cost:long,audit:string,blank:long,duplicate:long,truncated:long,illegal:long,gaps:long,parts:array<struct<part:long,p:int,q:int>>>"


def parsed(stretches: DataFrame) -> DataFrame:
    """(conv_id, counts, cost, audit, parts) of each conversation, its stretches combined in order."""

    part = pa.struct([("part", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])
    counts = [(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal", "gaps")]
    kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), *counts, ("parts", pa.list_(part))])

    @F.arrow_udf(JOINED)
    def of(lists: pa.Array) -> pa.Array:
        return pa.array((joined(x.as_py()) for x in lists), kind)

    def joined(rows: list[dict]) -> dict[str, object]:
        cells = [{(p, q): (c, a) for p, q, c, a in zip(r["p"], r["q"], r["cost"], r["audit"], strict=True)} for r in rows]
        ways = path(cells)
        cost = sum(cell[way][0] for cell, way in zip(cells, ways, strict=True))
        audit = "".join(cell[way][1] for cell, way in zip(cells, ways, strict=True))
        ends = [(r["first"], r["last"]) for r in rows]
        illegal = sum(r["illegal"] for r in rows) + sum(x[1] + y[0] not in ("su", "ua", "au") for x, y in zip(ends, ends[1:]))
        # a turn number on both sides of a boundary counts once; numbers ascend
        n_turns, high = 0, None
        for r in rows:
            if r["low"] is not None:
                n_turns += r["n_turns"] - (r["low"] == high)
                high = r["high"]
        low = next((r["low"] for r in rows if r["low"] is not None), None)
        gaps = high - low + 1 - n_turns if high is not None else 0
        blank, duplicate, cut = (sum(r["faults"][k] for r in rows) for k in range(3))
        parts = [{"part": r["part"], "p": p, "q": q} for r, (p, q) in zip(rows, ways, strict=True)]
        return {"cost": cost, "audit": audit, "blank": blank, "duplicate": duplicate, "truncated": cut, "illegal": illegal, "gaps": gaps, "parts": parts}

    fields = ["part", "p", "q", "cost", "audit", "faults", "illegal", "low", "high", "n_turns"]
    one = F.struct(*fields, F.col("initials")[0].alias("first"), F.element_at("initials", -1).alias("last"))
    gathered = stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return gathered.select("conv_id", of("rows").alias("made")).select("conv_id", "made.*")


def edits(stretches: DataFrame, whole: DataFrame) -> DataFrame:
    """(at, before, role, after) for each turn, from the nonterminal that its stretch has in the cheapest parse."""
    chosen = whole.select(F.inline("parts"))
    way = F.filter(F.arrays_zip("p", "q", "audit"), lambda x: (x["p"] == F.col("from")) & (x["q"] == F.col("to")))[0]["audit"]
    known = stretches.join(chosen.select("part", F.col("p").alias("from"), F.col("q").alias("to")), "part").select("ats", "initials", "from", way.alias("audit"))

    @F.arrow_udf("array<struct<before:string,role:string,after:string>>")
    def of(initials: pa.Array, audits: pa.Array, states: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("before", pa.string()), ("role", pa.string()), ("after", pa.string())]))
        rows = zip(initials.to_pylist(), audits.to_pylist(), states.to_pylist(), strict=True)
        return pa.array(([dict(zip(("before", "role", "after"), x, strict=True)) for x in applied(*row)] for row in rows), kind)

    return known.select(F.inline(F.arrays_zip("ats", of("initials", "audit", "from").alias("made")))).select(F.col("ats").alias("at"), "made.*")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find the cheapest edits of each conversation of (conv_id, turn, role, text).

    Returns the conversations (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired turns
    (conv_id, at, place, role, text), which ``at`` and ``place`` put in order. Conversations without id are one
    conversation. Nulls in roles and texts count as one space. Empty tables give empty results; other columns are left out.

    Long conversations are spread: turns are sorted by ranges, each range is parsed by itself, and a conversation's
    stretches, at most one for each range, are combined at the end.
    """
    rows = prepared(turns)
    stretches = segments(faults(rows))
    whole = materialise(parsed(stretches), "parsed")
    put = lambda names: F.transform(F.filter(F.split(F.col(names), ""), lambda c: c != ""), lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.struct(F.when(F.col("edit") == "=", F.col("role")).when(F.col("edit") == "u", "user").otherwise("assistant").alias("role"), F.col("text").alias("text"))
    edited = rows.join(edits(stretches, whole).withColumnRenamed("role", "edit"), "at")
    lists = F.concat(put("before"), F.when(F.col("edit") == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(own)), put("after"))
    repaired = edited.select("conv_id", "at", F.posexplode(lists).alias("place", "turn")).select("conv_id", "at", "place", "turn.*")
    return whole.drop("parts"), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256): the hash of the repaired turns of each conversation as ``role:text`` lines, streamed in order."""
    id_type = repaired.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("at"), F.col("place")]
    lines = repaired.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, kind = None, None, None
        for batch in batches:
            kind, keys, made = batch.schema.field(0).type, [], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if state is None or key != current:
                    if state is not None:
                        keys.append(current)
                        made.append(state.hexdigest())
                    state, current = hashlib.sha256(), key
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(made, pa.string())], names=["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return lines.mapInArrow(of, f"conv_id {id_type}, sha256 string")
