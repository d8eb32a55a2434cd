"""URL filters by dated lists: entries as validity intervals, captures judged by those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.worker import rest_of


def host_of(url: Column) -> Column:
    """The host of an http(s) address in lower case, without user, port and ``www.``; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.|\.$", "")


def keys_of(host: Column, fewest: int = 1) -> Column:
    """The host and all domains above it of ``fewest`` labels or more."""
    parts = F.split(host, r"\.")
    last = F.size(parts)
    lengths = F.when(last >= fewest, F.sequence(F.lit(fewest), last)).otherwise(F.array().cast("array<int>"))
    tails = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(tails, F.array(host))))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, list, since, until) from dated (entry, list, listed, day): from each listing to the next delisting.

    Of several changes of one entry on one day, delisting wins; repeated changes are one, and listings in a row are one
    interval. ``until`` is the first day on which the entry is no longer active, null if it still is. Rows without
    entry, list or day count for nothing. The window holds one row for each entry and day at most.
    """
    known = entries.where("entry IS NOT NULL AND list IS NOT NULL AND day IS NOT NULL").withColumn("entry", F.lower("entry"))
    daily = known.groupBy("entry", "list", "day").agg(F.min(F.coalesce("listed", F.lit(False))).alias("listed"))
    by_entry = Window.partitionBy("entry", "list").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("listed").over(by_entry), F.lit(False))).where("listed <> was")
    return changes.withColumn("until", F.lead("day").over(by_entry)).where("listed").select("entry", "list", F.col("day").alias("since"), "until")


def month_of(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """Add ``host``, ``active`` (the entries that list the host or a domain above it on the day of the fetch, as
    ``list:entry``, sorted) and ``blocked``, true if there is any.

    Intervals and captures meet on the entry and the month, so that a host with very many captures is spread over
    months, further split where a month's share is still large, and a capture is only compared with the intervals of
    its month. Null or malformed addresses have no host, and captures without a day no active entries. Repeated rows
    each come out. Columns named like the results are replaced.
    """
    kept = rest_of(captures.columns, "host", "active", "blocked")
    day = F.to_date(F.col(day_col))
    rows = captures.select(F.struct(*kept).alias("_llm_row"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), day.alias("_llm_day"))
    keys = F.concat(keys_of(F.col("host")), F.array(F.lit(None).cast("string")))
    asked = rows.select("_llm_row", "host", "_llm_day", month_of(F.col("_llm_day")).alias("_llm_month"), F.explode(keys).alias("_llm_key"))
    last = captures.agg(F.max(day)).first()[0]
    end = F.least(F.date_sub(F.coalesce("until", F.lit(last).cast("date")), F.when(F.col("until").isNull(), 0).otherwise(1)), F.lit(last).cast("date"))
    spans = intervals(entries).withColumn("end", end).where("since <= end")
    months = spans.select("*", F.explode(F.sequence(month_of(F.col("since")), month_of(F.col("end")))).alias("month"))
    same = (F.col("_llm_key") == F.col("entry")) & (F.col("_llm_month") == F.col("month")) & F.col("_llm_day").between(F.col("since"), F.col("end"))
    met = asked.join(months, same, "left")
    hit = F.when(F.col("entry").isNotNull(), F.concat_ws(":", "list", "entry"))
    found = met.where("entry IS NOT NULL OR _llm_key IS NULL").groupBy("_llm_row", "host").agg(
        F.count(F.when(F.col("_llm_key").isNull(), 1)).cast("int").alias("copies"), F.sort_array(F.collect_set(hit)).alias("active")
    )
    each = found.select("_llm_row.*", "host", "active", (F.size("active") > 0).alias("blocked"), F.explode(F.sequence(F.lit(1), "copies")).alias("_llm_copy"))
    return each.drop("_llm_copy")
