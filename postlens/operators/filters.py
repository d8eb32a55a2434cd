"""Row selection, request checks and embedding input."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import is_blank, strip_ws

# Limits of the request fields.
SEARCH_RULES = {
    "query": ("length", 2, 500),
    "min_salary": ("range", 0, 100000),
    "max_salary": ("range", 0, 100000),
    "max_results": ("range", 1, 50),
}
CHAT_RULES = {"message": ("length", 3, 1000)}
VECTOR_RULES = {"query": ("length", 3, 500), "top_k": ("range", 1, 50)}
SIMILAR_RULES = {
    "job_id": ("length", 1, None),
    "source": ("enum", ["jobstreet", "JobStreet", "mcf", "MCF"]),
    "top_k": ("range", 1, 20),
    "min_similarity": ("range", 0.0, 1.0),
}
STATS_RULES = {"group_by": ("enum", ["classification", "work_type", "location"]), "limit": ("range", 1, 50)}


def select_run(df: DataFrame, source: str, ts: str, name: str, day: dt.date) -> DataFrame:
    """Rows of one source and day. The day is a range on the timestamp, so it reaches the scan."""
    start = dt.datetime.combine(day, dt.time())
    in_day = (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(start + dt.timedelta(days=1)))
    return df.filter((F.lower(source) == name.lower()) & in_day)


def filter_jobs(
    df: DataFrame,
    filters: dict[str, Any],
    columns: dict[str, str],
    like: bool = False,
    skip_falsy: bool = True,
) -> DataFrame:
    """Conjunction of the given filters: location, min_salary, max_salary, work_type, classification.

    Text parts are literal; with ``like`` their % and _ are wildcards. Falsy values are ignored.
    """

    def has(column: str, value: str) -> Column:
        return F.col(column).like(f"%{value}%") if like else F.contains(column, F.lit(value))

    rules = {
        "location": lambda c, v: has(c, v),
        "classification": lambda c, v: has(c, v),
        "min_salary": lambda c, v: F.col(c) >= v,
        "max_salary": lambda c, v: F.col(c) <= v,
        "work_type": lambda c, v: F.col(c) == v,
    }
    for name, rule in rules.items():
        value = filters.get(name)
        if name in filters and value is not None and (value or not skip_falsy):
            df = df.filter(rule(columns[name], value))
    return df


def request_violations(rules: dict[str, tuple], required: list[str]) -> Column:
    """Array of messages for the request fields that break a rule; null optional fields pass."""
    found = []
    for name, (kind, *limits) in rules.items():
        value = F.col(name)
        if name in required:
            found.append(F.when(value.isNull(), F.lit(f"{name}: missing")))
        if kind == "enum":
            found.append(F.when(~value.isin(limits[0]), F.lit(f"{name}: not allowed")))
            continue
        low, high = limits
        measured = F.length(value) if kind == "length" else value
        found.append(F.when(measured < low, F.lit(f"{name}: below {low}")))
        if high is not None:
            found.append(F.when(measured > high, F.lit(f"{name}: above {high}")))
    return F.array_compact(F.array(*found))


def embedding_text(df: DataFrame, title: str, description: str, out: str = "text", read: int | None = 2000, keep: int | None = 1000) -> DataFrame:
    """Text to embed: title (or 'Unknown') and the description, stripped.

    Rows with neither are dropped. Of the description ``read`` characters are looked at and ``keep`` of them used after
    stripping, as models with a short input want it; None takes all.
    """
    name = F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("Unknown"))
    whole = F.coalesce(F.col(description), F.lit(""))
    body = strip_ws(whole if read is None else F.substring(whole, 1, read))
    body = body if keep is None else F.substring(body, 1, keep)
    kept = df.filter(~is_blank(F.col(title)) | ~is_blank(F.col(description)))
    return kept.withColumn("_body", body).withColumn(
        out, F.when(F.col("_body") != "", F.concat(strip_ws(name), F.lit(". "), F.col("_body"))).otherwise(strip_ws(name))
    ).drop("_body")


def embedding_text_always_joined(title: Column, description: Column) -> Column:
    """The single-job form, which keeps the separator even without a description."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
