"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.staging import pin
from postlens.llm.worker import rest_of

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Columns that the operator works with; input columns of these names are replaced.
WORDS, TEXT, FAILED = "_llm_words", "_llm_text", "failed_rule"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Step = tuple[str, Callable[[], Column]]


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than the six ASCII spaces."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def symbols_of(text: Column) -> Column:
    return F.size(F.split(text, r"[#*$%&|<>]")) - 1


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A hash of each run of ``window`` words, in order."""
    last = F.size(words) - (window - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))


def hash_pairs(hashes: Column) -> Column:
    """(hash, position) in order, for texts in which some window repeats; empty otherwise."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs).otherwise(F.slice(pairs, 1, 0))


def repeated_places(pairs: Column) -> Column:
    """Positions whose hash an adjacent pair has too, ascending."""
    same = lambda pair, k: F.coalesce(F.get(pairs, k)["h"] == pair["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(pairs, lambda pair, k: same(pair, k - 1) | same(pair, k + 1)), lambda pair: pair["i"]))


def covered(places: Column, window: int = WINDOW) -> Column:
    """The number of words in windows that begin at ``places``."""
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(window), p - acc["last"])).alias("total"))
    return F.aggregate(places, start, step, lambda acc: acc["total"])


#: What n_repeat_words takes; each step reads the one before.
REPEAT_STEPS: tuple[Step, ...] = (
    ("_llm_hashes", lambda: window_hashes(F.col(WORDS))),
    ("_llm_pairs", lambda: hash_pairs(F.col("_llm_hashes"))),
    ("_llm_places", lambda: repeated_places(F.col("_llm_pairs"))),
    ("n_repeat_words", lambda: covered(F.col("_llm_places"))),
)


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for texts that the rule turns away. ``steps`` are computed one after the other before it."""

    name: str
    reject: Callable[[], Column]
    steps: tuple[Step, ...] = field(default=())


def _count() -> Column:
    return F.size(WORDS)


def _stutter() -> Column:
    return F.size(F.filter(WORDS, lambda w, i: F.coalesce(F.get(F.col(WORDS), i - 1) == w, F.lit(False))))


FEW_WORDS = Rule("few_words", lambda: _count() < 20)
REPEATED = Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * _count(), REPEAT_STEPS)

#: The base rules are fixed; the others keep all that a reader would call prose. All compare whole numbers.
BASE = (FEW_WORDS, REPEATED)
RULES = (
    Rule("symbols", lambda: 10 * symbols_of(F.col(TEXT)) > _count()),
    Rule("short_or_long_words", lambda: ~F.char_length(F.array_join(WORDS, "")).between(3 * _count(), 10 * _count())),
    Rule("duplicate_lines", lambda: 2 * duplicate_lines(F.col(TEXT)) > F.size(F.split(TEXT, "\n"))),
    Rule("few_letters", lambda: 10 * F.size(F.filter(WORDS, lambda w: F.rlike(w, F.lit(r"\p{L}")))) < 6 * _count()),
    Rule("stutter", lambda: 10 * _stutter() > 3 * _count()),
)


def prepare(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the text (null as empty) and its words."""
    docs = docs.select(*rest_of(docs.columns, FAILED, "base_failed", *METRICS), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT))
    return pin(docs, **{WORDS: words_of(F.col(TEXT))})


def run_cascade(prepared: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Add ``failed_rule``, the first rule that rejects a text, or null. Later rules, and their steps, are skipped for it."""
    df = prepared if FAILED in prepared.columns else prepared.withColumn(FAILED, F.lit(None).cast("string"))
    pending: list[Rule] = []

    def settle(df: DataFrame) -> DataFrame:
        verdict = F.when(F.col(FAILED).isNotNull(), F.col(FAILED))
        for rule in pending:
            verdict = verdict.when(rule.reject(), rule.name)
        pending.clear()
        kept = [name for name in df.columns if name != FAILED and name not in {step for step, _ in REPEAT_STEPS}]
        return pin(df, _llm_verdict=verdict).select(*kept, F.col("_llm_verdict").alias(FAILED))

    for rule in rules:
        if rule.steps and pending:
            df = settle(df)
        for name, make in rule.steps:
            df = pin(df, **{name: F.when(F.col(FAILED).isNull(), make())})
        pending.append(rule)
    return settle(df) if pending else df


def order_rules(prepared: DataFrame, rules: tuple[Rule, ...], rows: int = 500, fraction: float = 0.2, seed: int = 7) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of at most ``rows`` texts, best first.

    Each rule runs alone over the sample; only its yes or no for each text comes to the driver. The order decides
    the cost of a cascade, never which texts pass it.
    """
    sample = prepared.sample(fraction, seed)

    def run(rule: Rule) -> tuple[float, int]:
        df, start = sample, time.perf_counter()
        for name, make in rule.steps:
            df = pin(df, **{name: make()})
        found = df.select(rule.reject().alias("no")).take(rows)
        return time.perf_counter() - start, sum(bool(row["no"]) for row in found)

    idle = Rule("none", lambda: _count() < 0)
    run(idle)
    floor = min(run(idle)[0], run(idle)[0])
    scores = {}
    for rule in rules:
        run(rule)
        seconds, rejected = run(rule)
        scores[rule.name] = rejected / max(seconds - floor, 1e-3)
    return tuple(sorted(rules, key=lambda rule: -scores[rule.name]))


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text", ordered: bool = False) -> DataFrame:
    """Add ``failed_rule``: the first rule in the order found on a sample that rejects the text, null if none does.

    Null and empty texts have no words and fail ``few_words``. Repeated rows each get their verdict. Whether a text
    passes does not depend on the order; ``ordered`` takes the rules as given. A column named ``failed_rule`` or
    ``n_repeat_words`` and the like is replaced. A window counts as repeated if its 64-bit hash occurs twice in the text.
    """
    prepared = prepare(docs, text_col)
    best = rules if ordered else order_rules(prepared, rules)
    return run_cascade(prepared, best).drop(TEXT, WORDS)


def quality_metrics(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the base counts, ``base_failed``, and ``failed_rule`` of the cascade for texts that pass the base rules."""
    prepared = prepare(docs, text_col)
    best = order_rules(prepared, rules)
    df = pin(
        prepared,
        n_words=F.size(WORDS).cast("long"),
        word_chars=F.char_length(F.array_join(WORDS, "")).cast("long"),
        n_symbols=symbols_of(F.col(TEXT)).cast("long"),
        n_dup_lines=duplicate_lines(F.col(TEXT)).cast("long"),
        _llm_hashes=REPEAT_STEPS[0][1](),
    )
    for name, make in REPEAT_STEPS[1:]:
        df = pin(df, **{name: make()})
    n, repeat = F.col("n_words"), F.col("n_repeat_words").cast("long")
    df = df.select(
        *[name for name in df.columns if not name.startswith(("_llm_hash", "_llm_pair", "_llm_place")) and name != "n_repeat_words"],
        repeat.alias("_llm_repeat"),
    )
    base = (n < 20) | (100 * F.col("_llm_repeat") > 30 * n)
    df = df.withColumn("base_failed", base).withColumn(FAILED, F.when(F.col("base_failed"), "base"))
    return run_cascade(df, best).withColumnRenamed("_llm_repeat", "n_repeat_words").drop(TEXT, WORDS)
