"""From a table of questions to answer inputs: retrieve, grade, route, assemble."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.fixed import NO_RESULT_ADVICE
from postlens.operators.grading import MAX_REWRITES, context_block, grade_jobs, route_queries
from postlens.operators.search import hybrid_search
from postlens.session import materialise


def keyword_grade() -> Column:
    """Default grade where no model is plugged in: ten times the keyword score."""
    return F.col("keyword_score") * 10.0


def answer_inputs(
    queries: DataFrame,
    corpus: DataFrame,
    jobs: DataFrame,
    columns: dict[str, str],
    rewrites: str,
    top_k: int = 10,
    score: Column | None = None,
    threshold: float = 5.0,
    qid: str = "query_id",
    **search,
) -> DataFrame:
    """Per query: counts, average score, decision and the context text; fixed advice where nothing passed."""
    retrieved = hybrid_search(queries, corpus, jobs, top_k, qid=qid, **search)
    graded = materialise(grade_jobs(retrieved, qid, keyword_grade() if score is None else score, threshold), "graded")
    routed = route_queries(queries, graded, qid, rewrites)
    context = context_block(graded, qid, columns)
    return routed.join(context, qid, "left").select(
        qid,
        "retrieved",
        "passed",
        "average_score",
        "decision",
        F.coalesce("context_jobs", F.lit(0)).alias("context_jobs"),
        "context",
        F.when(F.col("context").isNull(), NO_RESULT_ADVICE).alias("answer"),
    )


def half_question(asked: DataFrame) -> DataFrame:
    """Default rewriting: a question that found too little keeps the first half of its terms, one at least."""
    terms = F.filter(F.split("text", "(?U)\\s+"), lambda w: w != "")
    shorter = F.array_join(F.slice(terms, 1, F.greatest(F.lit(1), F.ceil(F.size(terms) / 2).cast("int"))), " ")
    return asked.withColumn("rewritten", shorter)


def answer_rounds(
    queries: DataFrame,
    corpus: DataFrame,
    jobs: DataFrame,
    columns: dict[str, str],
    rewrite: Callable[[DataFrame], DataFrame] = half_question,
    embed_fn: Callable[[DataFrame], DataFrame] | None = None,
    rewrites: str = "rewrite_count",
    top_k: int = 10,
    score: Column | None = None,
    threshold: float = 5.0,
    qid: str = "query_id",
    **search,
) -> DataFrame:
    """``answer_inputs`` in rounds: a question whose results are weak is rewritten and asked again, twice at most.

    Each round retrieves and grades only the questions that are still undecided; the others keep what their own last
    round found. ``rewrite`` gets (qid, text, embedding, count of rewrites, average_score, passed, reasons) and adds
    ``rewritten``; null or blank leaves the text as it was, and counts as a try. ``embed_fn`` gets the rewritten
    questions and replaces ``embedding``; without it the vectors stay. Questions may come with some rewrites behind them
    (null: none). Ids are unique. A question without vector or of under three characters finds nothing, is rewritten as
    long as tries are left, and gets the fixed advice. The number of rounds is bounded by ``MAX_REWRITES``, and what each
    settles is written, so lineage does not grow with them.

    Returns (qid, text, rewrites, retrieved, passed, average_score, decision, reasons, context_jobs, context, answer).
    """
    waiting = queries.select(qid, "text", "embedding", F.coalesce(rewrites, F.lit(0)).cast("int").alias(rewrites))
    settled, kept = [], []
    for _ in range(MAX_REWRITES + 1):
        waiting = materialise(waiting, "waiting")
        retrieved = hybrid_search(waiting, corpus, jobs, top_k, qid=qid, **search)
        graded = materialise(grade_jobs(retrieved, qid, keyword_grade() if score is None else score, threshold), "graded")
        routed = route_queries(waiting, graded, qid, rewrites).drop(rewrites)
        routed = materialise(waiting.join(routed, qid), "routed")
        decided = routed.where("decision = 'generate'")
        settled.append(decided.drop("embedding"))
        kept.append(graded.join(decided.select(qid), qid, "left_semi"))
        again = rewrite(routed.where("decision = 'rewrite'").select(*waiting.columns, "average_score", "passed", "reasons"))
        text = F.when(F.trim("rewritten") != "", F.col("rewritten")).otherwise(F.col("text"))
        again = again.select(qid, text.alias("text"), "embedding", (F.col(rewrites) + 1).alias(rewrites))
        waiting = again if embed_fn is None else embed_fn(again).select(*again.columns)
        if routed.where("decision = 'rewrite'").isEmpty():
            break
    graded, routed = reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, settled)
    done = routed.join(context_block(graded, qid, columns), qid, "left")
    return done.select(
        qid,
        "text",
        F.col(rewrites).alias("rewrites"),
        "retrieved",
        "passed",
        "average_score",
        "decision",
        "reasons",
        F.coalesce("context_jobs", F.lit(0)).alias("context_jobs"),
        "context",
        F.when(F.col("context").isNull(), NO_RESULT_ADVICE).alias("answer"),
    )
