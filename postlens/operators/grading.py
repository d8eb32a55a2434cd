"""Grading of retrieved jobs, routing of queries, and context for answers, over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postlens.functions.guard import output_verdict
from postlens.functions.staging import pin
from postlens.functions.text import strip_ws
from postlens.functions.variants import is_object, part

PASS_SCORE = 5.0
GOOD_AVERAGE = 6.0
ENOUGH_JOBS = 3
MAX_REWRITES = 2
CONTEXT_JOBS = 5


def _json_body(reply: Column) -> Column:
    """The part of a model reply that should be JSON: no lead-in lines, no code fence."""
    text = strip_ws(reply)
    led = F.regexp_extract(text, "(?s)\\n([ \\t]*\\{.*)$", 1)
    text = F.when(F.startswith(text, F.lit("Here is")) & (led != ""), led).otherwise(text)
    tagged = strip_ws(F.get(F.split(F.get(F.split(text, "```json", 2), F.lit(1)), "```"), F.lit(0)))
    plain = strip_ws(F.get(F.split(text, "```"), F.lit(1)))
    return F.when(F.contains(text, F.lit("```json")), tagged).when(F.contains(text, F.lit("```")), plain).otherwise(text)


def model_replies(df: DataFrame, prompt: str, make_model: Callable, out: str = "reply", batch: int = 16) -> DataFrame:
    """Add the replies of a pluggable model to a prompt column; ``make_model`` runs once per Python worker."""
    return df.withColumn(out, predict_batch_udf(make_model, return_type=StringType(), batch_size=batch)(prompt))


def judge_answers(answers: DataFrame, cited: DataFrame, context: DataFrame, keys: list[str], context_keys: list[str], has_context: Column | None = None) -> DataFrame:
    """Verdict per answer from tables: answers (keys, answer), cited (keys, job_id, position), context (context_keys, job_id).

    Citations are checked by an anti join, so a context of any size is never gathered in one place; only an answer's own
    citations are, in the order of ``position``. Every answer is held against its context, also an empty one, unless
    ``has_context``, a condition on the answers, says that none was given.
    """
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("position", "job_id"))), lambda c: c["job_id"]).alias(name)
    unknown = cited.join(context, [*context_keys, "job_id"], "left_anti")
    own = cited.groupBy(*keys).agg(in_order("_cited"))
    bad = unknown.groupBy(*keys).agg(in_order("_unknown"))
    given = F.lit(True) if has_context is None else F.coalesce(has_context, F.lit(False))
    joined = answers.withColumn("_given", given).join(own, keys, "left").join(bad, keys, "left")
    none = F.array().cast("array<string>")
    all_cited, all_bad = F.coalesce("_cited", none), F.coalesce("_unknown", none)
    known = F.when(F.col("_given"), F.array_except(all_cited, all_bad))
    return joined.withColumn("verdict", output_verdict(F.col("answer"), all_cited, known)).drop("_cited", "_unknown", "_given")


def parse_grades(df: DataFrame, reply: str) -> DataFrame:
    """Add ``score`` (0 to 10), ``explanation`` and ``counted`` read from model replies.

    Text that is no JSON gives the score a pattern finds, else 5. JSON without a usable score, and a missing
    reply, give 6 and do not count towards the average.
    """
    body, v = F.col("_body"), F.col("_v")
    raw = part(v, "$.score")
    kind = F.schema_of_variant(raw)
    number = F.when(raw.isNull(), 5.0).when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).otherwise(
        F.expr("try_cast(try_variant_get(_v, '$.score', 'string') AS double)")
    )
    matched = F.regexp_extract(body, '"score"\\s*:\\s*(\\d+\\.?\\d*)', 1)
    problem = (
        F.when(F.col(reply).isNull(), "Grading error: no reply")
        .when(v.isNotNull() & ~is_object(v), "Grading error: reply is no object")
        .when(v.isNotNull() & F.col("_number").isNull(), "Grading error: score is no number")
    )
    score = F.when(v.isNotNull(), F.col("_number")).when(matched != "", matched.cast("double")).otherwise(5.0)
    explanation = (
        F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit("No explanation provided")))
        .when(matched != "", "Incomplete response (JSON parse error)")
        .otherwise(F.concat(F.lit("Failed to parse response: "), F.substring(body, 1, 100)))
    )
    staged = pin(df, _body=_json_body(F.col(reply)))
    staged = pin(staged, _v=F.try_parse_json("_body"))
    staged = pin(staged, _number=number)
    staged = pin(staged, _problem=problem)
    failed = F.col("_problem").isNotNull()
    return staged.select(
        *df.columns,
        F.when(failed, 6.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))).alias("score"),
        F.when(failed, F.col("_problem")).otherwise(explanation).alias("explanation"),
        (~failed).alias("counted"),
    )


def grade_jobs(retrieved: DataFrame, qid: str, score: Column, threshold: float = PASS_SCORE, counted: Column | None = None) -> DataFrame:
    """Add ``relevance_score``, ``passed``, ``average_score`` of the query and ``grade_rank`` among the passed.

    Equal scores keep their retrieval order (``rank``). The average covers all counted rows of a query.
    """
    scored = retrieved.withColumn("relevance_score", score)
    scored = scored.withColumn("passed", F.col("relevance_score") >= threshold)
    of_query = Window.partitionBy(qid)
    valid = F.col("relevance_score") if counted is None else F.when(counted, F.col("relevance_score"))
    order = of_query.orderBy(F.desc("passed"), F.desc("relevance_score"), "rank")
    return scored.withColumn("average_score", F.coalesce(F.avg(valid).over(of_query), F.lit(0.0))).withColumn(
        "grade_rank", F.when(F.col("passed"), F.row_number().over(order))
    )


def route_queries(queries: DataFrame, graded: DataFrame, qid: str, rewrites: str) -> DataFrame:
    """Per query: rewrite while results are weak and tries are left, else generate; with the reasons."""
    totals = graded.groupBy(qid).agg(
        F.max("average_score").alias("average_score"), F.count_if(F.col("passed")).alias("passed"), F.count("*").alias("retrieved")
    )
    joined = queries.select(qid, rewrites).join(totals, qid, "left").fillna({"average_score": 0.0, "passed": 0, "retrieved": 0})
    return joined.select("*", *routing(F.col("average_score"), F.col("passed"), F.col(rewrites)))


def routing(average: Column, passed: Column, rewrites: Column) -> list[Column]:
    low, few = average < GOOD_AVERAGE, passed < ENOUGH_JOBS
    decision = F.when((low | few) & (rewrites < MAX_REWRITES), "rewrite").otherwise("generate")
    reasons = F.concat_ws(
        ", ",
        F.when(low, F.concat(F.lit("low avg score ("), F.format_number(average, 2), F.lit("/10)"))),
        F.when(few, F.concat(F.lit("only "), passed.cast("string"), F.lit(" jobs passed"))),
    )
    return [decision.alias("decision"), reasons.alias("reasons")]


def pay_phrase(low: Column, high: Column) -> Column:
    """The pay of a job in words; zero counts as not given."""
    has_low, has_high = F.coalesce(low != 0, F.lit(False)), F.coalesce(high != 0, F.lit(False))
    low_text, high_text = F.concat(F.lit("SGD $"), F.format_number(low, 0)), F.format_number(high, 0)
    return (
        F.when(has_low & has_high, F.concat(low_text, F.lit(" - $"), high_text, F.lit("/month")))
        .when(has_low, F.concat(F.lit("From "), low_text, F.lit("/month")))
        .when(has_high, F.concat(F.lit("Up to SGD $"), high_text, F.lit("/month")))
        .otherwise("Not disclosed")
    )


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def job_entry(number: Column, c: dict[str, str]) -> Column:
    """One numbered block of the answer context. ``c`` maps field roles to column names."""
    text = F.coalesce(F.col(c["description"]), F.lit(""))
    snippet = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("..."))).otherwise(text)
    score = F.col(c["relevance"])
    relevance = F.when(score != 0, F.concat(F.lit(" (Relevance: "), F.format_number(score, 1), F.lit("/10)"))).otherwise("")
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] **"), _shown(c["title"]), F.lit("**"), relevance,
        F.lit("\n   Company: "), _shown(c["company"]),
        F.lit("\n   Location: "), _shown(c["location"]),
        F.lit("\n   Type: "), _shown(c["work_type"]), F.lit(" | "), _shown(c["classification"]),
        F.lit("\n   Salary: "), pay_phrase(F.col(c["low"]), F.col(c["high"])),
        F.lit("\n   Description: "), snippet, F.lit("\n"),
    )


def context_block(graded: DataFrame, qid: str, columns: dict[str, str], top: int = CONTEXT_JOBS) -> DataFrame:
    """Per query: the context text of its best passed jobs and their number."""
    best = graded.filter(F.col("passed") & (F.col("grade_rank") <= top))
    entries = best.select(qid, F.struct(F.col("grade_rank").alias("n"), job_entry(F.col("grade_rank"), columns).alias("entry")).alias("e"))
    return entries.groupBy(qid).agg(
        F.count("*").alias("context_jobs"),
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n").alias("context"),
    )


def citations(graded: DataFrame, qid: str, id_col: str, title: str, company: str, url: str, top: int = CONTEXT_JOBS) -> DataFrame:
    """One row per job used as context, numbered as in the context text."""
    best = graded.filter(F.col("passed") & (F.col("grade_rank") <= top))
    return best.select(
        qid, F.col("grade_rank").cast("string").alias("number"), id_col, F.col(title).alias("job_title"), F.col(company).alias("company_name"), F.col(url).alias("job_url")
    )
