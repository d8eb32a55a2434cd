"""Row validation and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.staging import pin
from postlens.functions.text import strip_ws
from postlens.functions.variants import is_object, text_at

# Source names the row check accepts.
VALID_SOURCES = ["JobStreet", "MyCareersFuture"]


def _shorter(col: Column, size: int) -> Column:
    return F.coalesce(F.length(strip_ws(col)) < size, F.lit(True))


def validate_raw(raw: DataFrame, payload: str = "payload", sources: list[str] | None = None) -> DataFrame:
    """Add ``is_valid`` and ``message``: the first rule a raw job breaks, or 'Valid'."""
    v = F.col("_v")
    url = text_at(v, "$.url")
    message = (
        F.when(_shorter(F.col("job_id"), 2), "Job ID missing or too short")
        .when(
            ~F.coalesce(F.col("source").isin(sources or VALID_SOURCES), F.lit(False)),
            F.concat(F.lit("Invalid source: "), F.coalesce("source", F.lit("None"))),
        )
        .when(F.col("scrape_timestamp").isNull(), "Scrape timestamp missing")
        .when(v.isNull() | ~is_object(v), "Payload must be a dictionary")
        .when(_shorter(text_at(v, "$.title"), 2), "Title in payload too short or empty")
        .when(_shorter(text_at(v, "$.company"), 2), "Company in payload too short or empty")
        .when(~F.coalesce(F.startswith(url, F.lit("http")), F.lit(False)), "Invalid or missing URL in payload")
        .otherwise("Valid")
    )
    checked = pin(pin(raw, _v=F.try_parse_json(payload)), message=message).drop("_v")
    return checked.withColumn("is_valid", F.col("message") == "Valid")


def metric_counters(log: DataFrame, labels: list[str], sums: list[str] | None = None) -> DataFrame:
    """Counter per label set: number of records and the sum of each given column."""
    return log.groupBy(*labels).agg(F.count("*").alias("total"), *[F.sum(c).alias(f"{c}_total") for c in sums or []])


def latency_histogram(log: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """Cumulative bucket counts with sum and count per label set; the last bucket is '+Inf'.

    All buckets are counted in one aggregate, without multiplying rows.
    """
    counted = log.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("observations"),
        F.sum(value).alias("total"),
    )
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("cumulative")))
    return counted.select(*labels, "observations", "total", F.inline(F.array(*buckets)))


def rate_breaches(log: DataFrame, client: str, ts: str, limit: int, span: str = "1 minute") -> DataFrame:
    """Clients with more than ``limit`` requests in a time slot."""
    counted = log.groupBy(F.window(ts, span).alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > limit).select("client", F.col("w.start").alias("slot_start"), "requests")


def error_bursts(log: DataFrame, ts: str, is_error: Column, more_than: int = 2, span: str = "10 minutes") -> DataFrame:
    """Time slots with more than ``more_than`` errors."""
    counted = log.filter(is_error).groupBy(F.window(ts, span).alias("w")).agg(F.count("*").alias("errors"))
    return counted.filter(F.col("errors") > more_than).select(
        F.col("w.start").alias("slot_start"), F.col("w.end").alias("slot_end"), "errors"
    )


def silence_gaps(log: DataFrame, key: str, ts: str, hours: int = 25) -> DataFrame:
    """Gaps of at least ``hours`` between consecutive records of a key.

    No such gap fits into one clock hour, so records are first folded to (key, hour); what is ordered per
    key then grows with its time span and not with its number of records.
    """
    folded = log.groupBy(key, F.date_trunc("hour", ts).alias("_hour")).agg(F.min(ts).alias("_first"), F.max(ts).alias("silent_from"))
    following = F.lead("_first").over(Window.partitionBy(key).orderBy("_hour"))
    gaps = folded.select(key, "silent_from", following.alias("silent_to"))
    return gaps.filter(F.col("silent_to") >= F.col("silent_from") + F.make_dt_interval(hours=F.lit(hours)))
