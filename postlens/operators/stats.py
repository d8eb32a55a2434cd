"""Aggregations: pay statistics, volumes, profiles and data-quality reports."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.fixed import TOKEN_PRICE_INPUT, TOKEN_PRICE_OUTPUT
from postlens.operators.dedup import latest_per_key
from postlens.session import materialise

QUARTILES = [0.25, 0.5, 0.75]


def _rounded(col: Column, digits: int = 2) -> Column:
    """Rounded, with zero read as missing."""
    return F.round(F.nullif(col, F.lit(0.0)), digits)


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, where null equals null."""
    told = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(told, same, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    group: list[str],
    accuracy: int | None = None,
    also: dict[str, Column] | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles per group: one row per group with ``n`` and ``q0``, ``q1``, ... and the aggregates in ``also``.

    They are interpolated between two ranks, or with ``discrete`` the value at rank ceil(p * n). Rows are added up to
    counts of distinct values, which are written in ranges of (group, value). The sums of the ranges tell in which of them
    each wanted rank lies, and only those ranges are ranked, each by itself, so that no group is held or sorted whole. A null group is a group. ``accuracy`` has no effect; callers may still give it.
    """
    also = also or {}
    base = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    counts = base.groupBy(*group, "_v").agg(F.count("*").alias("_count")).repartitionByRange(*group, "_v")
    counts = materialise(counts.withColumn("_part", F.spark_partition_id()), "value-counts")
    keys = [*group, "_part"]
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of_group = Window.partitionBy(*group)
    parts = counts.groupBy(*keys).agg(F.sum("_count").alias("_size")).select(
        *keys, "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"), F.sum("_size").over(of_group).alias("n")
    )
    ranked_at = [F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1 if discrete else F.lit(p) * (F.col("n") - 1) for p in probs]
    ends = [F.struct(F.lit(i).alias("_i"), at.cast("double").alias("_at"), end(at).cast("long").alias("_rank")) for i, at in enumerate(ranked_at) for end in (F.floor, F.ceil)]
    here = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_size"))
    asked = parts.select(*keys, "_size", "_start", "n", F.inline(F.array(*ends))).filter(here).distinct()
    running = Window.partitionBy(*keys).orderBy("_v")
    held = _beside(counts, asked.select(*keys).distinct(), keys, "left_semi").withColumn("_upto", F.sum("_count").over(running))
    inside = F.col("_rank") - F.col("_start")
    met = _beside(held, asked, keys, "inner").filter((F.col("_upto") - F.col("_count") <= inside) & (inside < F.col("_upto")))
    picked = met.groupBy(*group, "n", "_i", "_at").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    found = F.col("low") + (F.col("high") - F.col("low")) * (F.col("_at") - F.floor("_at"))
    quantiles = picked.groupBy(*group, "n").agg(*[F.max(F.when(F.col("_i") == i, found)).alias(f"q{i}") for i in range(len(probs))])
    if not also:
        return quantiles
    valued = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    totals = valued.groupBy(*group).agg(*[c.alias(name) for name, c in also.items()])
    return _beside(totals, quantiles, group, "inner") if group else totals.join(quantiles)


def group_salary_stats(
    df: DataFrame,
    group: str,
    low: str,
    high: str,
    where: Column | None = None,
    limit: int = 10,
    latest: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """Pay statistics per group, largest groups first.

    Counts every version of a job unless ``latest`` = (keys, order) is given. Rows without a lower
    bound are left out; zero results read as missing. Quartiles are exact values of the groups shown.
    """
    if latest is not None:
        df = latest_per_key(df, *latest)
    df = df.filter(F.col(low).isNotNull())
    if where is not None:
        df = df.filter(where)
    lo, hi = F.col(low), F.col(high)
    stats = df.groupBy(F.col(group).alias("group_name")).agg(
        F.count("*").alias("job_count"),
        F.avg(lo).alias("avg_min_salary"),
        F.avg(hi).alias("avg_max_salary"),
        F.avg((lo + hi) / 2).alias("avg_mid_salary"),
        F.min(lo).alias("min_salary"),
        F.max(hi).alias("max_salary"),
    )
    top = materialise(stats.orderBy(F.desc("job_count"), "group_name").limit(limit), "top-groups")
    paid = df.select(F.col(group).alias("group_name"), lo.alias("_low"))
    shown = top.select("group_name").distinct()
    paid = paid.join(shown.withColumnRenamed("group_name", "_shown"), F.col("group_name").eqNullSafe(F.col("_shown")), "left_semi")
    named = F.struct(F.col("group_name").isNull().alias("none"), F.coalesce(F.col("group_name").cast("string"), F.lit("")).alias("name"))
    quartiles = exact_quantiles(paid.withColumn("_name", named), "_low", QUARTILES, ["_name"], discrete=True).drop("n")
    top = top.withColumn("_name", named).join(quartiles, "_name")
    figures = ["avg_min_salary", "avg_max_salary", "avg_mid_salary", "min_salary", "max_salary"]
    return top.select(
        "group_name",
        "job_count",
        *[_rounded(F.col(c)).alias(c) for c in figures],
        *[_rounded(F.col(f"q{i}")).alias(c) for i, c in enumerate(["p25_salary", "median_salary", "p75_salary"])],
    )


def stats_summary(stats: DataFrame) -> DataFrame:
    """One row over ``group_salary_stats``: totals, mean of the group means, overall range."""
    return stats.agg(
        F.count("*").alias("total_groups"),
        F.coalesce(F.sum("job_count"), F.lit(0)).alias("total_jobs"),
        F.round(F.avg("avg_mid_salary"), 2).alias("overall_avg_salary"),
        F.min("min_salary").alias("range_min"),
        F.max("max_salary").alias("range_max"),
    )


def source_summary(df: DataFrame, source: str, ts: str) -> DataFrame:
    return df.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def daily_volume(df: DataFrame, source: str, ts: str, job_id: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(job_id) if approximate else F.count_distinct(F.col(job_id))
    return df.groupBy(F.col(source).alias("source"), F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n_rows"), distinct.alias("n_jobs")
    )


def embedding_coverage(jobs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embeddings per hundred jobs; both sides are counted in one aggregate over their union."""
    flags = jobs.select(F.lit(1).alias("j"), F.lit(0).alias("e")).unionAll(
        embeddings.select(F.lit(0).alias("j"), F.lit(1).alias("e"))
    )
    totals = flags.agg(F.sum("j").alias("jobs"), F.sum("e").alias("embeddings"))
    return totals.withColumn("coverage_pct", F.round(F.try_divide(F.col("embeddings") * 100.0, F.col("jobs")), 2))


def with_token_cost(df: DataFrame, prompt: str, reply: str, paid: Column) -> DataFrame:
    """Add estimated tokens (four characters each) and their cost; unpaid providers cost nothing."""
    return (
        df.withColumn("tokens_input", F.floor(F.coalesce(F.length(prompt), F.lit(0)) / 4))
        .withColumn("tokens_output", F.floor(F.coalesce(F.length(reply), F.lit(0)) / 4))
        .withColumn(
            "cost",
            F.when(
                paid,
                F.col("tokens_input") / 1_000_000 * TOKEN_PRICE_INPUT + F.col("tokens_output") / 1_000_000 * TOKEN_PRICE_OUTPUT,
            ).otherwise(0.0),
        )
    )


def usage_rollup(calls: DataFrame, provider: str, model: str) -> DataFrame:
    """Requests, tokens and cost per provider and model, per provider, and in total ('all')."""
    rolled = calls.rollup(provider, model).agg(
        F.count("*").alias("requests"),
        F.sum("tokens_input").alias("tokens_input"),
        F.sum("tokens_output").alias("tokens_output"),
        F.sum("cost").alias("cost"),
        F.avg("cost").alias("avg_cost"),
        F.grouping_id().alias("_level"),
    )
    return rolled.select(
        F.when(F.col("_level") == 3, "all").otherwise(F.col(provider)).alias("provider"),
        F.when(F.col("_level") >= 1, "all").otherwise(F.col(model)).alias("model"),
        "requests",
        "tokens_input",
        "tokens_output",
        F.round("cost", 9).alias("cost_usd"),
        F.round("avg_cost", 9).alias("avg_cost_usd"),
    )


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows, nulls not counted as a value."""
    total = df.count()
    counts = df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    return top.withColumn("pct", F.round(F.col("n") * 100.0 / F.lit(total), 1))


def _melted(row: DataFrame, cols: list[str], measures: list[str]) -> DataFrame:
    """One wide row with columns ``measure__col`` to one row per column."""
    parts = [F.struct(F.lit(c).alias("field"), *[F.col(f"{m}__{c}").alias(m) for m in measures]) for c in cols]
    return row.select(F.inline(F.array(*parts)))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and share, all columns counted in one pass."""
    cols = df.columns
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"missing_count__{c}") for c in cols])
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"missing_count__{c}").alias("missing_count"), F.col("_n")) for c in cols]
    return (
        counted.select(F.inline(F.array(*parts)))
        .filter("missing_count > 0")
        .select("field", "missing_count", F.round(F.col("missing_count") * 100.0 / F.col("_n"), 2).alias("missing_pct"))
    )


def infinite_report(df: DataFrame) -> DataFrame:
    """Number of infinite values per numeric column that has any."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    counted = df.agg(*[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"infinite_count__{c}") for c in cols])
    return _melted(counted, cols, ["infinite_count"]).filter("infinite_count > 0")


def distribution_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, max and exact quartiles per column."""
    parts = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in cols]
    long = df.select(F.inline(F.array(*parts))).filter("v IS NOT NULL")
    moments = {"mean": F.avg("v"), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")}
    return exact_quantiles(long, "v", QUARTILES, ["field"], also=moments).select(
        "field",
        F.col("n").alias("count"),
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")],
        F.round("q0", 4).alias("p25"),
        F.round("q1", 4).alias("median"),
        F.round("q2", 4).alias("p75"),
    )


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows complete in all columns, in one aggregate."""
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    complete = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    row = complete.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs]
    cells += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs if a != b]
    return row.select(F.inline(F.array(*cells))).withColumn("corr", F.round("corr", 6))


def success_rate(rows: DataFrame, source: str, ok: Column) -> DataFrame:
    """Share of rows that passed a transformation, per source, in one pass."""
    return rows.groupBy(F.col(source).alias("source")).agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.round(F.avg(ok.cast("int")) * 100, 1).alias("success_pct"),
    )


def posting_trends(df: DataFrame, ts: str, pay: str, unit: str = "month", by: list[str] | None = None) -> DataFrame:
    """Postings and mean pay per period, optionally per group."""
    keys = [F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("period"), *[F.col(c) for c in by or []]]
    return df.groupBy(*keys).agg(F.count("*").alias("postings"), F.round(F.avg(pay), 2).alias("avg_pay"))
