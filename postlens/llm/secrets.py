"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.staging import pin
from postlens.llm.worker import rest_of

#: Fixed patterns. A match of the first needs a value of 8 characters or more.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: What a random string may be made of, and the shortest run that is scored.
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
SHORTEST = 20
LOWEST, SPAN = ord("+"), ord("z") - ord("+") + 1
MASK = "[secret]"

#: What rules, blanks, table borders and other repeats consist of, as examples of ordinary text.
REPEATS = [c for c in ALPHABET] + 5 * list("+-/=_") + ["+---", "+===", "+___", "-=", "-_", "=_", "+=", "-/", "_/", "=/", "+-"]

#: Texts that a model is trained on at most, and the log-likelihood ratio in hundredths of a bit that makes a secret.
SAMPLE_DOCS = 400
THRESHOLD = 2000

SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios, in hundredths of a bit, of the steps from one character to the next."""

    ratios: tuple[int, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<int>")


def labelled_sample(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SAMPLE_DOCS, separators: bool = False) -> DataFrame:
    """(value, random): ordinary identifiers of the ``size`` documents of the smallest ids, and digests of those.

    What the fixed patterns match is left out, so that secrets are no examples of ordinary text. Each word also counts
    in capitals and joined by ``_`` and ``-``; its digest in base 64 and in hexadecimal digits is the random example.
    Only the ids are read to find the sample, and files without those ids are skipped.

    Those random examples have no ``-`` and ``_``, so that rules, blanks and identifiers of digits and dashes look random.
    ``separators`` adds digests in the base 64 of addresses, whole and joined, to the random examples, and rules, table
    borders, repeated characters, paths, dates and UUIDs to the ordinary ones.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL")
    last = ids.orderBy("id").limit(size).agg(F.max("id")).first()[0]
    chosen = docs.where(F.col(id_col) <= F.lit(last)) if last is not None else docs.limit(0)
    plain = reduce(lambda text, p: F.regexp_replace(text, p, " "), (ASSIGN, ACCESS, HEX), F.col(text_col))
    words = chosen.select(F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("w"))
    w, digest = F.col("w"), F.sha2("w", 256)
    examples = [(w, False), (F.upper(w), False), (F.concat_ws("-", F.concat_ws("_", w, w), w), False)]
    examples += [(F.base64(F.unhex(digest)), True), (digest, True)]
    if separators:
        key = F.rtrim(F.translate(F.base64(F.unhex(digest)), "+/=", "-_"))
        examples += [(key, True), (F.concat_ws("-", F.substring(key, 1, 20), F.substring(key, 21, 23)), True), (F.concat_ws("_", F.substring(key, 24, 20), F.substring(key, 1, 20)), True)]
        examples += [(F.repeat(F.get(F.array(*map(F.lit, REPEATS)), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(REPEATS)).cast("int")), 20), False)]
        digits = F.translate(digest, "abcdef", "012345")
        stamp = F.concat_ws("_", *[F.concat_ws("-", *[F.substring(digits, at, n) for at, n in part]) for part in (((1, 4), (5, 2), (7, 2)), ((9, 2), (11, 2), (13, 2)))])
        examples += [(F.concat_ws("_", stamp, w), False), (F.concat_ws("/", w, w), False)]
        uuid = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        examples += [(uuid, False), (F.upper(uuid), False)]
    return words.select(F.inline(F.array(*[F.struct(v.alias("value"), F.lit(r).alias("random")) for v, r in examples])))


def train(labelled: DataFrame) -> Model:
    """Count the steps between characters in random and in ordinary examples, with one added to each count.

    ``labelled`` has value and random; null values, single characters and steps outside the alphabet do not count.
    The counts come to the driver: two for each pair of characters of the alphabet, however many rows are given.
    """
    chars = labelled.select("random", F.split("value", "").alias("c"))
    steps = chars.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.expr("slice(c, 2, size(c))").alias("b"))).alias("s"))
    rows = steps.where(F.col("s.b").isNotNull()).groupBy("random", "s.a", "s.b").count().collect()
    n = {(bool(r[0]), r[1], r[2]): r[3] for r in rows if r[1] in ALPHABET and r[2] in ALPHABET}
    total = {(kind, a): sum(n.get((kind, a, b), 0) for b in ALPHABET) for kind in (True, False) for a in ALPHABET}
    size, table = len(ALPHABET), [0] * (SPAN * SPAN)
    for a in ALPHABET:
        for b in ALPHABET:
            up = (n.get((True, a, b), 0) + 1) * (total[False, a] + size)
            down = (total[True, a] + size) * (n.get((False, a, b), 0) + 1)
            table[(ord(a) - LOWEST) * SPAN + ord(b) - LOWEST] = round(100 * math.log2(up / down))
    return Model(tuple(table))


def score(value: Column, ratios: Column) -> Column:
    """The log-likelihood ratio of a string of the alphabet."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char) - LOWEST
        more = F.when(acc["last"] < 0, 0).otherwise(F.get(ratios, acc["last"] * SPAN + code))
        return F.struct(code.alias("last"), (acc["total"] + more).alias("total"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["total"])


def places(steps: Column) -> Column:
    """Start and end of each match, in code points, from (gap before it, its length).

    The running sum goes block by block, so that a text with very many matches costs no square of their number.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def one(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + s["size"]).alias("end")))).alias("out"))

    def block(done: Column, k: Column) -> Column:
        begin = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0)).alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(steps, k * BLOCK + 1, BLOCK), begin, one)))

    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
    begin = F.array().cast("array<struct<at:int,out:array<struct<start:int,end:int>>>>")
    found = F.flatten(F.transform(F.aggregate(blocks, begin, block), lambda b: b["out"]))
    return F.when(F.size(steps) > 0, found).otherwise(none)


def add_matches(df: DataFrame, name: str, pattern: str, text: Column, group: int | None = None) -> DataFrame:
    """Add ``name``: the matches of ``pattern`` as (start, end, value), where value is the match or one of its groups."""
    p, matches = F.lit(pattern), F.col("_llm_matches")
    df = pin(df, _llm_matches=F.regexp_extract_all(text, p, F.lit(0)))
    gaps = F.slice(F.split(text, pattern), 1, F.size(matches))
    steps = F.zip_with(gaps, matches, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size")))
    df = pin(df, _llm_steps=F.when(F.size(matches) > 0, steps).otherwise(F.array().cast("array<struct<gap:int,size:int>>")))
    values = matches if group is None else F.regexp_extract_all(text, p, F.lit(group))
    joined = F.zip_with(places(F.col("_llm_steps")), values, lambda at, v: F.struct(at["start"].alias("start"), at["end"].alias("end"), v.alias("value")))
    found = F.when(F.size(matches) > 0, joined).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return pin(df, **{name: found}).drop("_llm_matches", "_llm_steps")


def parts_of(run: Column, spans: Column) -> Column:
    """What of a run (start, end, value) lies outside the sorted ``spans``, cut into such runs of 20 or more characters."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def piece(start: Column, end: Column) -> Column:
        value = F.substring(run["value"], start - run["start"] + 1, end - start)
        return F.when(end - start >= SHORTEST, F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))).otherwise(none)

    def step(acc: Column, s: Column) -> Column:
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"))

    touching = F.filter(spans, lambda s: (s["start"] < run["end"]) & (run["start"] < s["end"]))
    begin = F.struct(run["start"].alias("at"), none.alias("out"))
    return F.aggregate(touching, begin, step, lambda acc: F.concat(acc["out"], piece(acc["at"], run["end"])))


def find_secrets(docs: DataFrame, model: Model | None = None, text_col: str = "text", spans_col: str = "secret_spans", threshold: int = THRESHOLD, parts: bool = False) -> DataFrame:
    """Add ``spans_col``: array of (start, kind, end) by start, then kind; code points from 0, end exclusive.

    ``kind`` is a place in ``KINDS``. The first three are the fixed patterns, leftmost and non-overlapping for each; with
    a ``model``, runs of 20 or more characters of its alphabet that touch none of those are added where their ratio
    reaches ``threshold``. With ``parts``, a run that touches some is cut there and its parts of 20 or more characters
    are scored instead, so that a key joined to another secret is found. Null and empty texts have no spans. Repeated rows each get theirs. An input column named like
    ``spans_col`` is replaced.
    """
    inner = [f"_llm_{kind}" for kind in KINDS]
    df = docs.select(*rest_of(docs.columns, spans_col), F.coalesce(F.col(text_col), F.lit("")).alias("_llm_text"))
    text = F.col("_llm_text")
    for name, pattern, group in ((inner[0], ASSIGN, 2), (inner[1], ACCESS, None), (inner[2], HEX, None)):
        df = add_matches(df, name, pattern, text, group)
    as_spans = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    long_enough = F.filter(F.col(inner[0]), lambda m: F.char_length(m["value"]) >= 8)
    base = F.concat(as_spans(long_enough, 0), as_spans(F.col(inner[1]), 1), as_spans(F.col(inner[2]), 2))
    df = pin(df, _llm_base=F.sort_array(base)).drop(*inner[:3])
    if model is None:
        return df.drop("_llm_text").withColumnRenamed("_llm_base", spans_col)
    df = add_matches(df, inner[3], CANDIDATE, text)
    ratios, spans = model.column(), F.col("_llm_base")
    clear = lambda m: ~F.exists(spans, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    if parts:
        df = pin(df, _llm_parts=F.flatten(F.transform(F.col(inner[3]), lambda m: parts_of(m, spans)))).drop(inner[3]).withColumnRenamed("_llm_parts", inner[3])
    random = F.filter(F.col(inner[3]), lambda m: (score(m["value"], ratios) >= threshold) & clear(m))
    both = F.sort_array(F.concat(spans, as_spans(random, 3))).cast(SPAN_TYPE)
    return pin(df, **{spans_col: both}).drop("_llm_text", "_llm_base", inner[3])


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", mask: str = MASK) -> DataFrame:
    """Replace what any span covers by ``mask``, once for spans that touch or overlap. Null texts stay null."""
    spans, text = F.col(spans_col), F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        out = F.when((s["start"] > acc["at"]) | (F.size(acc["out"]) == 0), F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
