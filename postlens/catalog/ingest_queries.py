"""Source, sink, table, extraction and validation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.catalog import fixtures as fx
from postlens.catalog.registry import query
from postlens.functions import fixed
from postlens.operators import extract, filters, quality, stats
from postlens.schemas import RAW_CONTRACT, struct_from_contract
from postlens.session import scratch_dir
from postlens.sources import jsonl, tables


def _written_dump(t) -> str:
    path = scratch_dir(t.spark, "dump")
    fx.dump_lines(t).select("value").write.option("compression", "gzip").text(path)
    return path


_status = (
    "CASE event_id % 10 WHEN 1 THEN 'missing_job_id' WHEN 2 THEN 'missing_job_id' WHEN 4 THEN 'bad_json' "
    "WHEN 5 THEN 'bad_payload' WHEN 6 THEN 'blank' ELSE 'valid' END"
)


@query(
    "read_raw_jsonl",
    f"SELECT CASE WHEN event_id % 10 = 7 THEN CASE WHEN user_id = 0 THEN NULL ELSE user_id::VARCHAR END ELSE 'u' || user_id END AS job_id, "
    "CASE WHEN event_id % 10 = 7 THEN 'fallback' ELSE event_type END AS source, "
    "CASE WHEN event_id % 10 = 7 THEN '2024-03-01T00:00:00' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS scrape_timestamp, "
    "'Job ' || event_id AS title, (props->>'$.k')::INTEGER AS k "
    f"FROM events WHERE {_status} = 'valid' AND NOT (event_id % 10 = 7 AND user_id = 0)",
)
def _(t):
    parsed = jsonl.read_raw_jsonl(t.spark, _written_dump(t), "fallback", "2024-03-01T00:00:00")
    return parsed.filter("status = 'valid'").select(
        "job_id",
        "source",
        "scrape_timestamp",
        F.get_json_object("payload", "$.title").alias("title"),
        F.get_json_object("payload", "$.k").cast("int").alias("k"),
    )


@query(
    "raw_rejects",
    f"SELECT CASE WHEN event_id % 10 = 7 AND user_id = 0 THEN 'missing_job_id' ELSE {_status} END AS status, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    parsed = jsonl.read_raw_jsonl(t.spark, _written_dump(t), "fallback", "2024-03-01T00:00:00")
    return parsed.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "ingest_report",
    "SELECT count(*) AS total_lines, count(*) FILTER (s = 'valid') AS valid_rows, count(*) FILTER (s NOT IN ('valid', 'blank')) AS invalid_rows, "
    f"count(*) FILTER (s = 'blank') AS blank_lines FROM (SELECT CASE WHEN event_id % 10 = 7 AND user_id = 0 THEN 'missing_job_id' ELSE {_status} END AS s FROM events)",
)
def _(t):
    return jsonl.ingest_report(jsonl.parse_raw_lines(fx.dump_lines(t), F.lit("a"), F.lit("b")))


_run_dir = "CASE event_id % 7 WHEN 0 THEN 'latest' ELSE strftime(ts, '%Y-%m-%d_%H%M%S') END"
_run_source = "CASE event_type WHEN 'view' THEN 'jobstreet' WHEN 'click' THEN 'mcf' WHEN 'error' THEN 'indeed' ELSE 'jobstreet' END"
_run_path = (
    f"CASE WHEN event_id % 11 = 0 THEN 'raw/dump.jsonl' WHEN event_id % 11 = 1 THEN 'tmp/' || {_run_source} || '/x/dump.jsonl' "
    f"ELSE 'raw/' || {_run_source} || '/' || {_run_dir} || CASE WHEN event_id % 5 = 0 THEN '/notes.txt' ELSE '/dump.jsonl.gz' END END"
)
_run_status = (
    "CASE WHEN event_id % 11 IN (0, 1) THEN 'invalid_path' WHEN event_id % 5 = 0 THEN 'skip' "
    "WHEN event_type = 'error' THEN 'unsupported_source' ELSE 'ok' END"
)


@query(
    "tag_run_from_path",
    f"SELECT event_id, path, run_status, CASE WHEN run_status = 'ok' THEN src END AS run_source, "
    "CASE WHEN run_status = 'ok' THEN CASE WHEN event_id % 7 = 0 THEN created ELSE date_trunc('second', ts) END END AS run_ts "
    f"FROM (SELECT event_id, ts, {_run_path} AS path, {_run_status} AS run_status, {_run_source} AS src, date_trunc('day', ts)::TIMESTAMP AS created FROM events)",
)
def _(t):
    source = F.when(F.col("event_type") == "click", "mcf").when(F.col("event_type") == "error", "indeed").otherwise("jobstreet")
    folder = F.when(F.col("event_id") % 7 == 0, "latest").otherwise(F.date_format("ts", jsonl.RUN_FORMAT))
    name = F.when(F.col("event_id") % 5 == 0, "/notes.txt").otherwise("/dump.jsonl.gz")
    path = (
        F.when(F.col("event_id") % 11 == 0, "raw/dump.jsonl")
        .when(F.col("event_id") % 11 == 1, F.concat(F.lit("tmp/"), source, F.lit("/x/dump.jsonl")))
        .otherwise(F.concat(F.lit("raw/"), source, F.lit("/"), folder, name))
    )
    created = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return jsonl.tag_run(t.events.select("event_id", path.alias("path"), created.alias("created")), "path", "created").drop("created")


@query(
    "list_run_files",
    "SELECT event_type AS folder, sum(length(event_id::VARCHAR) + 1)::BIGINT AS bytes FROM events GROUP BY 1",
)
def _(t):
    """Bytes of the files below each folder: one id and a line end for each event."""
    path = scratch_dir(t.spark, "listing")
    t.events.select(F.col("event_id").cast("string"), "event_type").write.partitionBy("event_type").text(path)
    folder = F.regexp_extract("path", "event_type=([a-z]+)/", 1).alias("folder")
    return tables.list_run_files(t.spark, path, "*.txt").groupBy(folder).agg(F.sum("size").alias("bytes"))


@query(
    "load_jsonl",
    "SELECT CASE WHEN event_id % 10 IN (1, 4) THEN NULL WHEN event_id % 10 = 2 THEN '' WHEN event_id % 10 = 7 THEN user_id::VARCHAR "
    "ELSE 'u' || user_id END AS job_id, CASE WHEN event_id % 10 IN (4, 7) THEN NULL ELSE upper(event_type) END AS source, "
    "CASE WHEN event_id % 10 IN (4, 7) THEN NULL ELSE date_trunc('second', ts) END AS scrape_timestamp, event_id % 10 = 4 AS is_corrupt "
    "FROM events WHERE event_id % 10 <> 6",
)
def _(t):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in RAW_CONTRACT])
    rows = jsonl.load_jsonl(t.spark, _written_dump(t), schema, lambda df: df.withColumn("source", F.upper("source")))
    bad = F.col("_corrupt").isNotNull()
    return rows.select(
        F.when(~bad, F.col("job_id")).alias("job_id"),
        F.when(~bad, F.col("source")).alias("source"),
        F.when(~bad, F.to_utc_timestamp("scrape_timestamp", F.current_timezone()).cast("timestamp_ntz")).alias("scrape_timestamp"),
        bad.alias("is_corrupt"),
    )


@query(
    "append_rows",
    "SELECT ts::DATE AS date, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id % 10 <> 1 GROUP BY ALL",
)
def _(t):
    path = scratch_dir(t.spark, "append")
    keyed = t.events.withColumn("job_id", F.when(F.col("event_id") % 10 != 1, F.col("user_id")))
    for part in ("click", "view", None):
        chosen = F.col("event_type") == part if part else ~F.col("event_type").isin("click", "view")
        tables.append_rows(keyed.filter(chosen), path, "ts", ["event_type", "job_id"], ["job_id"])
    stored = t.spark.read.parquet(path)
    return stored.groupBy("date", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "append_report",
    "SELECT count(*) AS total_rows, count(*) FILTER (event_id % 10 <> 1) AS successful_rows, count(*) FILTER (event_id % 10 = 1) AS failed_rows FROM events",
)
def _(t):
    keyed = t.events.withColumn("job_id", F.when(F.col("event_id") % 10 != 1, F.col("user_id")))
    counts = tables.append_rows(keyed, scratch_dir(t.spark, "append"), "ts", ["event_type", "job_id"], ["job_id"])
    names = ["total_rows", "successful_rows", "failed_rows"]
    return t.spark.createDataFrame([tuple(int(counts[n]) for n in names)], ", ".join(f"{n} bigint" for n in names))


@query(
    "ensure_table",
    "SELECT ts::DATE AS date, event_type AS source, count(*) AS n, count(DISTINCT user_id) AS jobs FROM events GROUP BY ALL",
)
def _(t):
    spark = t.spark
    database = scratch_dir(spark, "db")
    name = "db_" + database.rsplit("-", 1)[1]
    for _again in range(2):
        tables.ensure_database(spark, name, database)
        tables.ensure_table(spark, f"{name}.raw_jobs", struct_from_contract(RAW_CONTRACT), comment="raw postings")
    rows = t.events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("scrape_timestamp"), F.col("props").alias("payload")
    )
    tables.append_to_table(rows, f"{name}.raw_jobs", "scrape_timestamp", ["source", "job_id"])
    return spark.table(f"{name}.raw_jobs").groupBy("date", "source").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))


@query(
    "recreate_tables",
    "WITH m AS (SELECT count(*) FILTER (user_id = 0) AS missing, count(*) AS n FROM events), "
    "c AS (SELECT * FROM (VALUES ('job_id', 'string', NULL), ('source', 'string', 'where it''s from'), ('scrape_timestamp', 'timestamp', NULL), "
    "('payload', 'string', NULL), ('crawl', 'string', NULL), ('date', 'date', NULL)) AS v(field, type, comment)) "
    "SELECT field, type, comment, CASE WHEN field = 'job_id' AND missing > 0 THEN missing END AS missing_count, "
    "CASE WHEN field = 'job_id' AND missing > 0 THEN round(missing * 100.0::DOUBLE / n, 2) END AS missing_pct FROM c, m",
)
def _(t):
    spark = t.spark
    database = scratch_dir(spark, "db")
    name = "db_" + database.rsplit("-", 1)[1]
    tables.ensure_database(spark, name, database)
    schema = struct_from_contract(RAW_CONTRACT)
    tables.drop_table(spark, f"{name}.raw_jobs")
    tables.recreate_tables(spark, {f"{name}.raw_jobs": schema})
    tables.add_table_columns(spark, f"{name}.raw_jobs", {"crawl": "string", "source": "string"})
    tables.set_table_column_comment(spark, f"{name}.raw_jobs", "source", "where it's from")
    rows = t.events.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("scrape_timestamp"), F.col("props").alias("payload"), F.lit("c1").alias("crawl")
    )
    tables.append_to_table(rows, f"{name}.raw_jobs", "scrape_timestamp", ["source", "job_id"])
    filled = stats.missing_report(spark.table(f"{name}.raw_jobs").withColumn("job_id", F.nullif("job_id", F.lit("0"))))
    described = [(c.name, c.dataType, c.description) for c in spark.catalog.listColumns(f"{name}.raw_jobs")]
    return spark.createDataFrame(described, "field string, type string, comment string").join(filled, "field", "left")


@query(
    "schema_diff",
    "SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'same'), ('o_custkey', 'bigint', 'string', 'type'), ('o_orderstatus', 'string', 'string', 'same'), "
    "('o_totalprice', 'double', 'double', 'position'), ('o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'position'), ('o_orderpriority', 'string', NULL, 'missing_right'), "
    "('o_clerk', NULL, 'string', 'missing_left')) AS v(field, left_type, right_type, status) LEFT JOIN "
    "(SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS field, "
    "unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]) AS distinct_values FROM orders) USING (field)",
)
def _(t):
    orders = t.orders
    contract = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_custkey", T.StringType()),
            T.StructField("o_orderstatus", T.StringType()),
            T.StructField("o_orderdate", T.TimestampNTZType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_clerk", T.StringType()),
        ]
    )
    used = stats.distinct_counts(orders, orders.columns)
    long = used.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("distinct_values")) for c in orders.columns])))
    return tables.schema_diff(t.spark, orders.schema, contract).join(long, "field", "left")


@query(
    "add_columns",
    "SELECT o_orderkey, o_orderstatus, NULL::DOUBLE AS bonus, NULL::VARCHAR AS note FROM orders",
)
def _(t):
    added = tables.add_columns(t.orders, {"bonus": "double", "note": "string", "o_orderstatus": "int"})
    return added.select("o_orderkey", "o_orderstatus", "bonus", "note")


@query(
    "rename_by_copy",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE o_orderpriority END AS priority FROM orders",
)
def _(t):
    partly = t.orders.withColumn("priority", F.when(F.col("o_orderstatus") == "F", "kept"))
    return tables.rename_by_copy(partly, "o_orderpriority", "priority").select("o_orderkey", "o_orderpriority", "priority")


@query(
    "backfill_column",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, "
    "(SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS affected FROM orders",
)
def _(t):
    where = "o_orderstatus = 'F'"
    affected = tables.backfill_count(t.orders, where)
    filled = tables.backfill_column(t.orders, "o_totalprice", "o_totalprice * 2", where)
    return filled.select("o_orderkey", "o_totalprice", F.lit(affected).cast("bigint").alias("affected"))


@query("set_column_comment", "SELECT 'gross value' AS comment, count(*) AS n FROM orders")
def _(t):
    commented = tables.set_column_comment(t.orders, "o_totalprice", "gross value")
    text = commented.schema["o_totalprice"].metadata["comment"]
    return commented.agg(F.count("o_totalprice").alias("n")).select(F.lit(text).alias("comment"), "n")


@query(
    "expired_runs",
    "WITH r AS (SELECT event_type AS source, CASE WHEN day(ts) % 9 = 0 THEN 'tmp-' || day(ts) ELSE strftime(min(ts), '%Y-%m-%d_%H%M%S') END AS run, count(*) AS rows_in_run "
    "FROM events GROUP BY event_type, ts::DATE, day(ts)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS rn, "
    "try_strptime(run, '%Y-%m-%d_%H%M%S') AS started FROM r) SELECT source, run, rows_in_run, started FROM k "
    "WHERE rn > 10 AND (started IS NULL OR started < TIMESTAMP '2024-01-22' - INTERVAL 7 DAY)",
)
def _(t):
    day = F.dayofmonth("ts")
    runs = t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("d"), day.alias("n")).agg(
        F.min("ts").alias("first"), F.count("*").alias("rows_in_run")
    )
    name = F.when(F.col("n") % 9 == 0, F.concat(F.lit("tmp-"), "n")).otherwise(F.date_format("first", jsonl.RUN_FORMAT))
    as_of = F.lit(dt.datetime(2024, 1, 22)).cast("timestamp_ntz")
    return tables.expired_runs(runs.select("source", name.alias("run"), "rows_in_run"), "source", "run", as_of, keep=10, days=7)


@query(
    "write_processed",
    "SELECT DATE '2024-05-01' + (doc_id % 4)::INTEGER AS date, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
)
def _(t):
    path = scratch_dir(t.spark, "processed")
    day = F.date_add(F.lit(dt.date(2024, 5, 1)), (F.col("doc_id") % 4).cast("int"))
    tables.write_processed(t.documents, path, day)
    return t.spark.read.parquet(path).groupBy("date", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "explode_batch_response",
    "SELECT o_orderkey::VARCHAR AS job_id, o_orderkey // 8 AS batch, 'Post ' || o_orderkey AS title, 'Firm ' || o_custkey AS company, "
    "CASE WHEN o_orderkey % 8 = 1 THEN o_orderpriority ELSE 'Text ' || o_custkey END AS description, "
    "CASE WHEN o_orderkey % 8 = 2 THEN 'https://www.jobstreet.com.sg/job/' ELSE 'https://s.example.org/' END || o_orderkey AS url, "
    "CASE WHEN o_orderkey % 8 <> 3 THEN '$5000' END AS salary_text, CASE WHEN o_orderkey % 8 <> 4 THEN 'Full time' END AS work_type, "
    "'[\"' || o_orderstatus || '\",\"\"]' AS classification, o_orderkey::VARCHAR AS raw_id FROM orders WHERE o_orderkey % 8 < 5",
)
def _(t):
    rows = extract.explode_batch_response(fx.batch_responses(t), "response", ["batch"])
    names = ["title", "company", "description", "url", "salary_text", "work_type", "classification"]
    return rows.select(
        "job_id", "batch", *[F.get_json_object("payload", f"$.{n}").alias(n) for n in names], F.get_json_object("payload", "$.raw.job.id").alias("raw_id")
    )


@query(
    "response_errors",
    "WITH b AS (SELECT o_orderkey // 8 AS batch, max(CASE WHEN o_orderkey % 8 = 2 THEN o_orderkey END) AS third FROM orders GROUP BY 1) "
    "SELECT batch, 1 AS error_number, coalesce(third::VARCHAR, 'unknown') AS job_id, CASE WHEN batch % 3 = 1 THEN 'Too many requests, slow down' ELSE 'Field failed' END AS message FROM b WHERE batch % 2 = 0 "
    "UNION ALL SELECT batch, 2, 'unknown', 'Unknown' FROM b WHERE batch % 2 = 0 UNION ALL SELECT batch, 3, 'unknown', 'no path' FROM b WHERE batch % 2 = 0",
)
def _(t):
    return extract.response_errors(fx.batch_responses(t), "response", ["batch"])


@query(
    "rate_limited_batches",
    "SELECT DISTINCT o_orderkey // 8 AS batch, (o_orderkey // 8) % 2 = 0 AND (o_orderkey // 8) % 3 IN (0, 1) AS limited FROM orders",
)
def _(t):
    return fx.batch_responses(t).select("batch", extract.is_rate_limited(F.col("response")).alias("limited"))


_mcf_pay = (
    "CASE k WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 11 THEN NULL WHEN 9 THEN '20 - 30 Hourly' "
    "ELSE price || ' - ' || (price + 100) || ' Monthly' END"
)


@query(
    "wrap_single_response",
    "SELECT 'm' || o_orderkey AS job_id, 'MCF' AS source, CASE WHEN k = 5 THEN '' ELSE '  Role ' || o_orderkey || ' ' END AS title, "
    f"CASE WHEN k = 8 THEN '' ELSE upper(c_name) || ' PRIVATE LIMITED' END AS company, 'Singapore' AS location, {_mcf_pay} AS salary_text, "
    "'https://mcf.example.org/' || o_orderkey AS url FROM (SELECT *, o_orderkey % 12 AS k, floor(o_totalprice)::BIGINT AS price FROM orders JOIN customer ON o_custkey = c_custkey)",
)
def _(t):
    responses = fx.ordered(t).select(fx.item_b().alias("response"))
    rows = extract.wrap_single_response(responses, "response", [])
    names = ["title", "company", "location", "salary_text", "url"]
    return rows.select("job_id", "source", *[F.get_json_object("payload", f"$.{n}").alias(n) for n in names])


_postings = (
    "p AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'JobStreet' WHEN o_orderstatus = 'P' THEN 'mcf' WHEN o_orderpriority = '1-URGENT' THEN 'Indeed' ELSE 'JOBSTREET' END AS source, "
    "floor(o_totalprice)::BIGINT AS price, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 12 ELSE o_orderkey % 10 END AS k, o_orderstatus = 'P' AS b "
    "FROM orders JOIN customer ON o_custkey = c_custkey), "
    "q AS (SELECT *, CASE WHEN source = 'Indeed' THEN 'unknown_source' WHEN NOT b AND k = 3 THEN 'bad_structure' WHEN NOT b AND k IN (1, 2) THEN 'missing_required' "
    "WHEN b AND k IN (1, 8, 10) THEN 'bad_structure' WHEN b AND k = 5 THEN 'missing_required' END AS reject FROM p)"
)
_fields = {
    "job_id": "CASE WHEN b THEN 'm' || o_orderkey ELSE o_orderkey::VARCHAR END",
    "job_url": "CASE WHEN b THEN 'https://mcf.example.org/' ELSE 'https://jobs.example.org/' END || o_orderkey",
    "job_title": "CASE WHEN b THEN '  Role ' || o_orderkey || ' ' ELSE c_mktsegment || ' post ' || o_orderkey END",
    "job_location": "CASE WHEN NOT b THEN 'nation ' || c_nationkey WHEN k = 2 THEN '' ELSE 'cbd' END",
    "job_classification": "CASE WHEN b THEN CASE WHEN k = 7 THEN '' ELSE c_mktsegment END WHEN k = 5 THEN c_mktsegment ELSE c_mktsegment || ' - ' || o_orderpriority END",
    "job_work_type": "CASE WHEN b THEN 'Permanent' ELSE 'Full time' END",
    "job_salary_text": "CASE WHEN NOT b THEN CASE WHEN k = 6 THEN '' ELSE '$' || price || ' - $' || (price + 900) || ' per month' END "
    "WHEN k IN (4, 11) THEN '' WHEN k = 3 THEN '$' || price || ' Monthly' WHEN k = 9 THEN '$20 - $30 Hourly' ELSE '$' || price || ' - $' || (price + 100) || ' Monthly' END",
    "job_posted_timestamp": "CASE WHEN NOT b AND k = 7 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN b THEN '.000Z' ELSE 'Z' END END",
    "company_id": "CASE WHEN b THEN 'U' || o_custkey WHEN k = 4 THEN '' ELSE o_custkey::VARCHAR END",
    "company_url": "CASE WHEN b THEN 'https://c.example.org' ELSE 'https://companies.example.org/' || o_custkey END",
    "company_name": "CASE WHEN b THEN upper(c_name) || ' PRIVATE LIMITED' ELSE c_name || ' Pte Ltd' END",
    "company_description": "CASE WHEN b THEN '<p>plain</p>' WHEN k = 4 THEN '' ELSE 'About ' || c_name || chr(10) || chr(10) || 'Second &lt;part&gt;' END",
    "company_industry": "CASE WHEN b OR k = 4 THEN '' ELSE c_mktsegment END",
    "company_size": "CASE WHEN b THEN CASE WHEN k = 6 OR o_custkey = 0 THEN '' ELSE o_custkey::VARCHAR END WHEN k = 4 THEN '' ELSE '11-50' END",
}


@query(
    "extract_fields",
    f"WITH {_postings} SELECT source, " + ", ".join(f"{e} AS {n}" for n, e in _fields.items()) + " FROM q WHERE reject IS NULL",
)
def _(t):
    rows = extract.extract_fields(fx.raw_postings(t)).filter("reject IS NULL")
    return rows.select("source", *[n for n in extract.FIELDS if n != "job_description"])


@query("rejected_jobs", f"WITH {_postings} SELECT source, 'r' || o_orderkey AS job_id, reject FROM q WHERE reject IS NOT NULL")
def _(t):
    return extract.rejected_jobs(fx.raw_postings(t))


_cleaned_sql = (
    f"WITH {_postings}, f AS (SELECT source, b, k, price, o_orderkey, c_name, c_mktsegment, c_nationkey, o_orderstatus, o_orderdate, "
    + ", ".join(f"{e} AS {n}" for n, e in _fields.items())
    + " FROM q WHERE reject IS NULL), "
    "m AS (SELECT *, CASE WHEN job_salary_text = '' THEN NULL WHEN b AND k = 9 THEN 20 ELSE price END::DOUBLE AS lo, "
    "CASE WHEN job_salary_text = '' THEN NULL WHEN b AND k = 9 THEN 30 WHEN b AND k = 3 THEN price WHEN b THEN price + 100 ELSE price + 900 END::DOUBLE AS hi, "
    "CASE WHEN b AND k = 9 THEN 160 ELSE 1 END AS factor FROM f) "
)


@query(
    "clean_jobs",
    _cleaned_sql + "SELECT source, TIMESTAMP '2024-02-01' AS scrape_timestamp, TIMESTAMP '2024-02-02' AS bq_timestamp, job_id, job_url, trim(job_title) AS job_title, "
    "CASE WHEN b THEN 'Work in ' || c_mktsegment ELSE 'Order ' || o_orderkey || ' for ' || c_name || ' & co' || chr(10) || 'status ' || o_orderstatus END AS job_description, "
    "CASE WHEN NOT b THEN 'Nation ' || c_nationkey WHEN k = 2 THEN '' ELSE 'Central' END AS job_location, job_classification, job_work_type, "
    "lo AS job_salary_min_sgd_raw, hi AS job_salary_max_sgd_raw, CASE WHEN lo IS NULL THEN '' WHEN b AND k = 9 THEN 'hourly' ELSE 'monthly' END AS job_salary_type, "
    "lo * factor AS job_salary_min_sgd_monthly, hi * factor AS job_salary_max_sgd_monthly, 'SGD' AS job_currency, "
    "CASE WHEN NOT b AND k = 7 THEN TIMESTAMP '2024-02-01' ELSE o_orderdate END AS job_posted_timestamp, company_id, company_url, "
    "CASE WHEN b THEN upper(c_name) ELSE c_name END AS company_name, "
    "CASE WHEN b THEN 'plain' WHEN k = 4 THEN '' ELSE 'About ' || c_name || chr(10) || 'Second <part>' END AS company_description, company_industry, company_size FROM m",
)
def _(t):
    cleaned = extract.clean_jobs(fx.raw_postings(t), F.to_timestamp(F.lit("2024-02-02T00:00:00Z")))
    instants = ["scrape_timestamp", "bq_timestamp", "job_posted_timestamp"]
    return cleaned.withColumns({c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz") for c in instants})


@query(
    "transform_success_rate",
    f"WITH {_postings} SELECT source, count(*) FILTER (reject IS NULL) AS succeeded, count(*) FILTER (reject IS NOT NULL) AS failed, "
    "round(count(*) FILTER (reject IS NULL) * 100.0::DOUBLE / count(*), 1) AS success_pct FROM q GROUP BY 1",
)
def _(t):
    return stats.success_rate(extract.extract_fields(fx.raw_postings(t), fields=[]), "source", F.col("reject").isNull())


@query(
    "select_run",
    "SELECT event_id, user_id, ts FROM events WHERE lower(event_type) = 'click' AND ts::DATE = DATE '2024-01-10' ORDER BY user_id, event_id",
)
def _(t):
    return filters.select_run(t.events, "event_type", "ts", "CLICK", dt.date(2024, 1, 10)).select("event_id", "user_id", "ts").orderBy("user_id", "event_id")


@query(
    "filter_jobs",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_totalprice >= 50000 AND o_totalprice <= 400000 AND o_orderstatus = 'O'",
)
def _(t):
    columns = {"classification": "o_orderpriority", "location": "o_orderpriority", "min_salary": "o_totalprice", "max_salary": "o_totalprice", "work_type": "o_orderstatus"}
    wanted = {"classification": "HIGH", "location": "", "min_salary": 50000, "max_salary": 400000, "work_type": "O"}
    return filters.filter_jobs(t.orders, wanted, columns).select("o_orderkey")


@query(
    "validate_requests",
    "SELECT event_id, concat_ws('; ', CASE WHEN length(props) < 9 THEN 'query: below 9' END, CASE WHEN value > 50 THEN 'min_salary: above 50' END, "
    "CASE WHEN user_id < 1 THEN 'max_results: below 1' END, CASE WHEN user_id > 50 THEN 'max_results: above 50' END, "
    "CASE WHEN event_type = 'error' THEN 'group_by: missing' END, CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN 'group_by: not allowed' END) AS violations FROM events",
)
def _(t):
    rules = {
        "query": ("length", 9, 500),
        "min_salary": ("range", 0, 50),
        "max_results": filters.SEARCH_RULES["max_results"],
        "group_by": ("enum", ["view", "click"]),
    }
    requests = t.events.select(
        "event_id",
        F.col("props").alias("query"),
        F.col("value").alias("min_salary"),
        F.col("user_id").alias("max_results"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("group_by"),
    )
    found = filters.request_violations(rules, ["group_by"])
    return requests.select("event_id", F.array_join(found, "; ").alias("violations"))


@query(
    "validate_search_requests",
    "SELECT item_id, length(text) AS size, concat_ws('; ', CASE WHEN length(text) > 500 THEN 'query: above 500' END, CASE WHEN item_id * 3 > 50 THEN 'top_k: above 50' END, "
    "CASE WHEN item_id < 1 THEN 'top_k: below 1' END) AS violations FROM benchmark",
)
def _(t):
    requests = t.benchmark.select("item_id", F.col("text").alias("query"), (F.col("item_id") * 3).alias("top_k"))
    checked = filters.request_violations({"query": filters.VECTOR_RULES["query"], "top_k": ("range", 1, 50)}, ["query"])
    parts = F.array_sort(checked, lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0))
    return requests.select("item_id", F.length("query").cast("bigint").alias("size"), F.array_join(parts, "; ").alias("violations"))


@query(
    "embedding_text",
    f"WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE source || ' ' END AS title, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 10 = 1 THEN '  ' ELSE '  ' || text END AS body FROM documents), "
    "p AS (SELECT *, trim(body, chr(32) || chr(10)) AS cut FROM s WHERE trim(coalesce(title, '')) <> '' OR trim(body) <> '') "
    "SELECT doc_id, trim(coalesce(title, 'Unknown')) || CASE WHEN cut <> '' THEN '. ' || cut ELSE '' END AS text FROM p",
)
def _(t):
    kind = F.col("doc_id") % 5
    title = F.when(kind == 0, F.lit(None)).when(kind == 1, " ").otherwise(F.concat("source", F.lit(" ")))
    body = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 10 == 1, "  ").otherwise(F.concat(F.lit("  "), "text"))
    docs = t.documents.select("doc_id", title.alias("title"), body.alias("body"))
    return filters.embedding_text(docs, "title", "body", read=None, keep=None).select("doc_id", "text")


@query(
    "payload_profile",
    "WITH n AS (SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS extra FROM events) "
    "SELECT 'k' AS key, total AS present, 0::BIGINT AS missing, true AS is_critical FROM n UNION ALL SELECT 'title', extra, total - extra, true FROM n UNION ALL "
    "SELECT 'note', total - extra, extra, false FROM n UNION ALL SELECT 'company', 0, total, true FROM n",
)
def _(t):
    extra = F.when(F.col("event_id") % 3 == 0, ', "title": "t"}').otherwise(', "note": 1}')
    raw = t.events.select(F.concat(F.expr("substring(props, 1, length(props) - 1)"), extra).alias("payload"))
    return extract.payload_profile(raw, ["k", "title", "company"])


@query(
    "validate_dump",
    "WITH e AS (SELECT event_type, event_id % 10 AS k, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line FROM events), "
    "v AS (SELECT *, CASE k WHEN 1 THEN 'Missing RawJob fields: [''job_id'']' WHEN 3 THEN 'Missing payload fields: [''company'']' WHEN 4 THEN 'Invalid JSON' "
    "WHEN 5 THEN 'Payload must be a dictionary' WHEN 6 THEN 'Empty line' WHEN 7 THEN 'Missing RawJob fields: [''source'', ''scrape_timestamp'']' END AS error FROM e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY line) AS rn FROM v WHERE error IS NOT NULL) "
    "SELECT event_type, count(*) AS line_count, count(*) FILTER (error IS NULL) AS valid_jobs, false AS is_valid, "
    "(SELECT string_agg('Line ' || line || ': ' || error, ' | ' ORDER BY line) FROM r WHERE r.event_type = v.event_type AND rn <= 10) AS messages FROM v GROUP BY event_type "
    "UNION ALL SELECT 'hopeless', 25, 0, false, string_agg('Line ' || i || ': Invalid JSON', ' | ' ORDER BY i) || ' | No valid jobs found' FROM range(1, 26) g(i) "
    "UNION ALL SELECT 'void', 0, 0, false, 'File is empty'",
)
def _(t):
    path = scratch_dir(t.spark, "dumps")
    lines = fx.dump_lines(t).select("event_type", "event_id", "value")
    # One file per source: a dump is one file, written in line order. Two more dumps: nothing valid, and no line at all.
    broken = t.spark.range(1, 26).select(F.lit("hopeless").alias("event_type"), F.col("id").alias("event_id"), F.lit("{bad").alias("value"))
    lines = lines.unionByName(broken)
    lines.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    numbered = jsonl.with_line_numbers(jsonl.read_lines(t.spark, f"{path}/*/*.txt"))
    numbered = numbered.withColumn("dump", F.regexp_extract("file", "event_type=([a-z]+)/", 1))
    expected = lines.select(F.col("event_type").alias("dump")).union(t.spark.createDataFrame([("void",)], "dump string"))
    verdict = jsonl.validate_dump(numbered, "dump", files=expected).withColumnRenamed("dump", "event_type")
    return verdict.withColumn("messages", F.array_join("messages", " | "))


@query(
    "dump_error_counts",
    "SELECT CASE event_id % 10 WHEN 1 THEN 'Missing RawJob fields: [''job_id'']' WHEN 3 THEN 'Missing payload fields: [''company'']' WHEN 4 THEN 'Invalid JSON' "
    "WHEN 5 THEN 'Payload must be a dictionary' WHEN 6 THEN 'Empty line' WHEN 7 THEN 'Missing RawJob fields: [''source'', ''scrape_timestamp'']' ELSE 'none' END AS error, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    return jsonl.dump_errors(fx.dump_lines(t)).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query(
    "validate_raw",
    "SELECT event_id, message = 'Valid' AS is_valid, message FROM (SELECT event_id, CASE WHEN user_id < 10 THEN 'Job ID missing or too short' "
    "WHEN event_type NOT IN ('click', 'view') THEN 'Invalid source: ' || event_type WHEN value > 100 THEN 'Scrape timestamp missing' "
    "WHEN event_id % 4 = 0 THEN 'Payload must be a dictionary' WHEN event_id % 4 = 1 THEN 'Title in payload too short or empty' "
    "WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 8 = 2 THEN 'Company in payload too short or empty' ELSE 'Invalid or missing URL in payload' END ELSE 'Valid' END AS message FROM events)",
)
def _(t):
    key = F.col("event_id") % 8
    payload = (
        F.when(key % 4 == 0, F.lit("[1]"))
        .when(key % 4 == 1, F.lit('{"title":" x ","company":"Acme","url":"http://a"}'))
        .when(key == 2, F.lit('{"title":"Chef","company":null,"url":"http://a"}'))
        .when(key == 6, F.lit('{"title":"Chef","company":"Acme","url":"ftp://a"}'))
        .otherwise('{"title":"Chef","company":"Acme","url":"https://a"}')
    )
    raw = t.events.select(
        "event_id",
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_type").alias("source"),
        F.when(F.col("value") <= 100, F.col("ts")).alias("scrape_timestamp"),
        payload.alias("payload"),
    )
    return quality.validate_raw(raw, sources=["click", "view"]).select("event_id", "is_valid", "message")


@query(
    "metric_counters",
    "SELECT event_type AS endpoint, CASE WHEN value > 100 THEN '500' ELSE '200' END AS status_code, count(*) AS total, round(sum(value), 4) AS value_total FROM events GROUP BY ALL",
)
def _(t):
    log = t.events.select(F.col("event_type").alias("endpoint"), F.when(F.col("value") > 100, "500").otherwise("200").alias("status_code"), "value")
    return quality.metric_counters(log, ["endpoint", "status_code"], ["value"]).withColumn("value_total", F.round("value_total", 4))


_bounds = ", ".join(f"('{b}', {b})" for b in fixed.REQUEST_BOUNDS)


@query(
    "latency_histogram",
    f"WITH b AS (SELECT * FROM (VALUES {_bounds}, ('+Inf', 'Infinity'::DOUBLE)) AS v(le, bound)) SELECT event_type, le, count(*) FILTER (value <= bound) AS cumulative, "
    "count(*) AS observations, round(sum(value), 4) AS total FROM events, b GROUP BY event_type, le",
)
def _(t):
    return quality.latency_histogram(t.events, "value", fixed.REQUEST_BOUNDS, ["event_type"]).withColumn("total", F.round("total", 4))


@query(
    "rate_breaches",
    "SELECT user_id AS client, time_bucket(INTERVAL '6 hours', ts) AS slot_start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 2",
)
def _(t):
    return quality.rate_breaches(t.events, "user_id", "ts", 2, "6 hours")


@query(
    "error_burst",
    "SELECT time_bucket(INTERVAL '10 minutes', ts) AS slot_start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL 10 MINUTE AS slot_end, count(*) AS errors "
    "FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 2",
)
def _(t):
    return quality.error_bursts(t.events, "ts", F.col("event_type") == "error")


@query(
    "silence_gap",
    "SELECT user_id, silent_from, silent_to FROM (SELECT user_id, ts AS silent_to, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS silent_from FROM events) "
    "WHERE silent_to - silent_from >= INTERVAL 25 HOUR",
)
def _(t):
    return quality.silence_gaps(t.events, "user_id", "ts")
