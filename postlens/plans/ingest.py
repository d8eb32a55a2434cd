"""From dump files to the cleaned table, in one lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.extract import clean_jobs
from postlens.sources.jsonl import raw_jobs, read_raw_jsonl, read_runs
from postlens.sources.tables import append_rows


def dump_to_clean(spark: SparkSession, path: str, source: str, scraped: str, ingested: Column | None = None) -> DataFrame:
    """One dump: read, parse, validate, extract, clean. Nothing is written."""
    return clean_jobs(raw_jobs(read_raw_jsonl(spark, path, source, scraped)), ingested)


def ingest_runs(spark: SparkSession, root: str, raw_path: str, cleaned_path: str) -> dict[str, dict[str, int]]:
    """All dumps below ``root``/raw into the raw and the cleaned table; both reports are returned.

    The cleaned table is derived from the dump again rather than read back, so no step waits for the other.
    """
    raw = raw_jobs(read_runs(spark, root))
    stage1 = append_rows(raw, raw_path, "scrape_timestamp", ["source", "job_id"], ["job_id", "source"])
    cleaned = clean_jobs(raw, F.current_timestamp())
    stage2 = append_rows(cleaned, cleaned_path, "scrape_timestamp", ["source", "job_id"], ["job_id", "job_title"])
    return {"raw": stage1, "cleaned": stage2}
