"""JSON-lines dumps: reading, parsing with reject reasons, run tags, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.staging import pin
from postlens.functions.text import is_blank, strip_ws
from postlens.functions.variants import is_object, is_present, json_text, part, text_at
from postlens.session import materialise

# Sources a dump folder may name.
RUN_SOURCES = ["jobstreet", "mcf"]
RUN_FORMAT = "yyyy-MM-dd_HHmmss"

# A dump is a file or, when Spark wrote it, a folder of that name.
DUMP_GLOB = "raw/*/*/dump.jsonl*"
DUMP_PATH = "(raw/[^/]+/[^/]+/dump\\.jsonl[^/]*)"

# Fields every dump line and its payload must have.
LINE_FIELDS = ["job_id", "source", "scrape_timestamp", "payload"]
PAYLOAD_FIELDS = ["title", "company", "url"]

# JSON texts that count as an empty value.
EMPTY_JSON = ["null", "false", "0", "0.0", '""', "[]", "{}"]

# Verdicts on whole dumps.
EMPTY_DUMP = "File is empty"
NO_VALID_JOBS = "No valid jobs found"

TIMESTAMP_FIELDS = ["scrape_timestamp", "bq_timestamp", "job_posted_timestamp"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzipped text with the file and split they come from."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line``, counted from 1 within each file.

    Lines of one split are consecutive in one task, so a line's number is its position in the split plus
    the number of lines in the splits before; only the per-split counts are ordered.
    """
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(splits, ["file", "block"])
    return joined.withColumn("line", F.col("_offset") + F.col("_id") - F.col("_first") + 1).drop("_id", "_first", "_offset")


def is_empty_json(v: Column) -> Column:
    """Missing, null, false, zero or an empty string, list or object."""
    return v.isNull() | json_text(v).isin(EMPTY_JSON)


def parse_raw_lines(lines: DataFrame, source: Column, scraped: Column, col: str = "value") -> DataFrame:
    """Add ``status`` and the raw-job fields; each line is parsed once, as a variant.

    ``status`` is valid, blank, bad_json, not_object, missing_job_id or bad_payload. ``source`` and
    ``scraped`` stand in only where the line lacks the key, not where its value is null.
    """
    v, job_id, payload = F.col("_v"), F.col("_job_id"), F.col("_payload")
    as_text = F.try_variant_get(job_id, "$", "string")
    boolean = F.try_variant_get(job_id, "$", "boolean")
    status = (
        F.when(is_blank(F.col(col)), "blank")
        .when(v.isNull(), "bad_json")
        .when(~is_object(v), "not_object")
        .when(is_empty_json(job_id), "missing_job_id")
        .when(~is_object(payload), "bad_payload")
        .otherwise("valid")
    )
    valid = F.col("status") == "valid"

    def field(name: str, fallback: Column) -> Column:
        return F.when(valid & is_present(v, f"$.{name}"), text_at(v, f"$.{name}")).when(valid, fallback)

    parsed = pin(lines, _v=F.try_parse_json(strip_ws(F.col(col))))
    parsed = pin(parsed, _job_id=part(v, "$.job_id"), _payload=part(v, "$.payload"))
    return (
        pin(parsed, status=status)
        .withColumns(
            {
                "job_id": F.when(valid, F.when(json_text(job_id).isin("true", "false"), F.initcap(boolean.cast("string"))).otherwise(as_text)),
                "source": field("source", source),
                "scrape_timestamp": field("scrape_timestamp", scraped),
                "payload": F.when(valid, json_text(payload)),
            }
        )
        .drop("_v", "_job_id", "_payload")
    )


def read_raw_jsonl(spark: SparkSession, path: str, source: str, scraped: str) -> DataFrame:
    """All lines of a dump with status and raw-job fields; filter on ``status`` for rows or rejects."""
    return parse_raw_lines(read_lines(spark, path), F.lit(source), F.lit(scraped))


def raw_jobs(parsed: DataFrame) -> DataFrame:
    """The valid rows as raw jobs, scrape time as an instant."""
    return parsed.filter("status = 'valid'").select(
        "job_id", "source", F.try_to_timestamp("scrape_timestamp").alias("scrape_timestamp"), "payload"
    )


def ingest_report(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines read, valid, invalid and blank; blank lines count as lines but not as invalid."""
    return parsed.groupBy(*(by or [])).agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("status") == "valid").alias("valid_rows"),
        F.count_if(~F.col("status").isin("valid", "blank")).alias("invalid_rows"),
        F.count_if(F.col("status") == "blank").alias("blank_lines"),
    )


def tag_run(df: DataFrame, path: str, created: str) -> DataFrame:
    """Add ``run_status`` (ok, skip or an error), ``run_source`` and ``run_ts`` read from a dump path."""
    parts = F.split(F.col(path), "/")
    source = F.get(parts, F.lit(1))
    status = (
        F.when((F.size(parts) < 3) | (parts[0] != "raw"), "invalid_path")
        .when(~F.startswith(F.element_at(parts, -1), F.lit("dump.jsonl")), "skip")
        .when(~source.isin(RUN_SOURCES), "unsupported_source")
        .otherwise("ok")
    )
    named = F.try_to_timestamp(F.get(parts, F.lit(2)), F.lit(RUN_FORMAT)).cast("timestamp_ntz")
    ok = F.col("run_status") == "ok"
    return df.withColumn("run_status", status).withColumns(
        {
            "run_source": F.when(ok, source),
            "run_ts": F.when(ok, F.coalesce(named, F.col(created).cast("timestamp_ntz"))),
        }
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All dumps below ``root``/raw, parsed with source and time of their folder as fallbacks."""
    lines = read_lines(spark, f"{root}/{DUMP_GLOB}")
    tagged = tag_run(lines.withColumn("path", F.regexp_extract("file", DUMP_PATH, 1)), "path", "modified")
    tagged = tagged.filter("run_status = 'ok'")
    return parse_raw_lines(tagged, F.col("run_source"), F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss"))


def load_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    transform_fn: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Generic load with a schema. Bad lines keep their text in ``_corrupt``; nested payloads stay JSON text.

    The known timestamp fields, declared as strings, become instants; unreadable ones keep their text in
    ``<field>_text``.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    for name in TIMESTAMP_FIELDS:
        if name in schema.names and schema[name].dataType == T.StringType():
            rows = rows.withColumn(f"{name}_text", F.col(name)).withColumn(name, F.try_to_timestamp(name))
            rows = rows.withColumn(f"{name}_text", F.when(F.col(name).isNull(), F.col(f"{name}_text")))
    return rows if transform_fn is None else rows.transform(transform_fn)


def _quoted_list(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def dump_errors(lines: DataFrame, col: str = "value") -> DataFrame:
    """Add ``error`` per line: null where the line is a valid job."""
    v = F.col("_v")
    missing = F.array_compact(F.array(*[F.when(~is_present(v, f"$.{f}"), F.lit(f)) for f in LINE_FIELDS]))
    empty = F.array_compact(
        F.array(*[F.when(is_empty_json(part(v, f"$.payload.{f}")), F.lit(f)) for f in PAYLOAD_FIELDS])
    )
    error = (
        F.when(is_blank(F.col(col)), "Empty line")
        .when(v.isNull(), "Invalid JSON")
        .when(F.size("_missing") > 0, F.concat(F.lit("Missing RawJob fields: "), _quoted_list(F.col("_missing"))))
        .when(~is_object(v, "$.payload"), "Payload must be a dictionary")
        .when(F.size("_empty") > 0, F.concat(F.lit("Missing payload fields: "), _quoted_list(F.col("_empty"))))
    )
    return (
        pin(pin(lines, _v=F.try_parse_json(F.col(col))), _missing=missing, _empty=empty)
        .withColumn("error", error)
        .drop("_v", "_missing", "_empty")
    )


def dump_error_rows(numbered: DataFrame, by: str = "file") -> DataFrame:
    """(by, line, error) of all lines that are no valid job."""
    return dump_errors(numbered).filter("error IS NOT NULL").select(by, "line", "error")


def validate_dump(numbered: DataFrame, by: str = "file", first: int = 10, files: DataFrame | None = None) -> DataFrame:
    """Verdict per file with its first errors in line order, or with all if no line is valid.

    ``files`` lists the dumps expected, in a column named ``by``; those without a line are reported as empty. Every line
    is parsed once. ``dump_error_rows`` has all errors as rows.
    """
    checked = materialise(dump_errors(numbered).select(by, "line", "error"), "dump-errors")
    totals = checked.groupBy(by).agg(F.count("*").alias("line_count"), F.count_if(F.col("error").isNull()).alias("valid_jobs"))
    bad = checked.filter("error IS NOT NULL")
    few = bad.join(totals.filter("valid_jobs > 0").select(by), by, "left_semi")
    ranked = few.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("line"))).filter(F.col("_rn") <= first).drop("_rn")
    hopeless = bad.join(totals.filter("valid_jobs = 0").select(by), by, "left_semi")
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("line", "error"))),
        lambda e: F.concat(F.lit("Line "), e["line"].cast("string"), F.lit(": "), e["error"]),
    )
    shown = ranked.unionByName(hopeless).groupBy(by).agg(texts.alias("errors"))
    if files is not None:
        totals = files.select(by).distinct().join(totals, by, "left").fillna(0, ["line_count", "valid_jobs"])
    success = F.concat(F.lit("✓ Valid: "), "valid_jobs", F.lit("/"), "line_count", F.lit(" jobs"))
    messages = (
        F.when(F.col("line_count") == 0, F.array(F.lit(EMPTY_DUMP)))
        .when(F.col("valid_jobs") == 0, F.array_append("errors", F.lit(NO_VALID_JOBS)))
        .when(F.col("errors").isNull(), F.array(success))
        .otherwise(F.col("errors"))
    )
    is_valid = (F.col("line_count") > 0) & F.col("errors").isNull()
    return totals.join(shown, by, "left").select(by, "line_count", "valid_jobs", is_valid.alias("is_valid"), messages.alias("messages"))
