"""Streaming queries: each runs over all rows that are there, and its sink table is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.catalog import fixtures as fx
from postlens.catalog.ingest_queries import _cleaned_sql, _status
from postlens.catalog.registry import query
from postlens.functions import fixed
from postlens.functions.vectors import norm
from postlens.operators import embed
from postlens.plans import ingest
from postlens.session import scratch_dir
from postlens.sources.jsonl import raw_jobs
from postlens.streaming import jobs, keyed


def _written_runs(t) -> str:
    """Dumps under raw/{source}/{run}/, one run per source, all events."""
    root = scratch_dir(t.spark, "runs")
    lines = fx.dump_lines(t)
    first = F.col("event_type").isin("view", "click", "signup")
    for source, chosen in (("jobstreet", first), ("mcf", ~first)):
        lines.filter(chosen).select("value").write.option("compression", "gzip").text(f"{root}/raw/{source}/2024-02-03_040506/dump.jsonl.gz")
    return root


def _event_stream(t):
    """The event table as a stream, its time as an instant."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_to_table(t, df, label):
    path = scratch_dir(t.spark, label)
    jobs.start_table(df, path, scratch_dir(t.spark, f"{label}-state")).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


def _wall(name):
    return F.to_utc_timestamp(name, F.current_timezone()).cast("timestamp_ntz").alias(name)


_runs_sql = (
    "SELECT CASE WHEN event_id % 10 = 7 THEN user_id::VARCHAR ELSE 'u' || user_id END AS job_id, "
    "CASE WHEN event_id % 10 = 7 THEN CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'jobstreet' ELSE 'mcf' END ELSE event_type END AS source, "
    "CASE WHEN event_id % 10 = 7 THEN TIMESTAMP '2024-02-03 04:05:06' ELSE date_trunc('second', ts) END AS scrape_timestamp, "
    f"'Job ' || event_id AS title FROM events WHERE {_status} = 'valid' AND NOT (event_id % 10 = 7 AND user_id = 0)"
)


@query("stream_ingest", _runs_sql)
def _(t):
    spark, root = t.spark, _written_runs(t)
    path = scratch_dir(spark, "raw-table")
    jobs.stream_ingest(spark, root, path, scratch_dir(spark, "ingest-state"), files_per_batch=1).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.select("job_id", "source", _wall("scrape_timestamp"), F.get_json_object("payload", "$.title").alias("title"))


@query("read_runs", _runs_sql)
def _(t):
    from postlens.sources.jsonl import read_runs

    rows = raw_jobs(read_runs(t.spark, _written_runs(t)))
    return rows.select("job_id", "source", _wall("scrape_timestamp"), F.get_json_object("payload", "$.title").alias("title"))


def _written_raw(t) -> str:
    path = scratch_dir(t.spark, "raw-postings")
    fx.raw_postings(t).select("job_id", "source", "scrape_timestamp", "payload").write.parquet(path)
    return path


_clean_cols = "source, job_id, trim(job_title) AS job_title, CASE WHEN b THEN upper(c_name) ELSE c_name END AS company_name, lo * factor AS low, hi * factor AS high FROM m"


@query("stream_clean", _cleaned_sql + f"SELECT {_clean_cols}")
def _(t):
    path = scratch_dir(t.spark, "cleaned")
    jobs.stream_clean(t.spark, _written_raw(t), path, scratch_dir(t.spark, "clean-state")).awaitTermination()
    stored = t.spark.read.parquet(path)
    return stored.select(
        "source", "job_id", "job_title", "company_name", F.col("job_salary_min_sgd_monthly").alias("low"), F.col("job_salary_max_sgd_monthly").alias("high")
    )


@query("dump_to_clean", _cleaned_sql + f"SELECT {_clean_cols}")
def _(t):
    path = scratch_dir(t.spark, "postings-dump")
    line = fx.obj(
        job_id=fx.js(F.col("job_id")), source=fx.js(F.col("source")), scrape_timestamp=F.lit('"2024-02-01T00:00:00Z"'), payload=F.col("payload")
    )
    fx.raw_postings(t).select(line.alias("value")).write.option("compression", "gzip").text(path)
    cleaned = ingest.dump_to_clean(t.spark, path, "none", "2024-02-01T00:00:00Z")
    return cleaned.select(
        "source", "job_id", "job_title", "company_name", F.col("job_salary_min_sgd_monthly").alias("low"), F.col("job_salary_max_sgd_monthly").alias("high")
    )


@query("stream_embed_new", "SELECT 'hashing-384' AS model_name, count(*) AS n, count(DISTINCT doc_id) AS jobs FROM documents")
def _(t):
    spark, target = t.spark, scratch_dir(t.spark, "embedded")
    docs = spark.readStream.schema(t.documents.schema).parquet(f"{t.folder}/documents.parquet*")
    embedder = embed.hashing_embedder()

    def embed_batch(batch, known):
        keyed = batch.select("doc_id", F.col("source").alias("title"), "text")
        return embed.embed_table(keyed, known, ["doc_id"], "doc_id", [], "title", "text", embedder, "hashing-384")

    schema = "doc_id bigint, model_name string, embedding array<float>, created_at timestamp"
    jobs.stream_embed_new(docs, embed_batch, target, schema, scratch_dir(spark, "embed-state")).awaitTermination()
    stored = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    return stored.groupBy("model_name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("jobs"))


@query(
    "stream_embed_unseen",
    "SELECT doc_id, 'hashing-384' AS model_name, 384 AS dims, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length "
    "FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def _(t):
    """Documents come as a stream, and so do the keys that have a vector already."""
    target, doc = scratch_dir(t.spark, "unseen"), t.documents.schema
    docs = t.spark.readStream.schema(doc).parquet(f"{t.folder}/documents.parquet*")
    stored = t.spark.readStream.schema(t.embeddings.schema).parquet(f"{t.folder}/embeddings.parquet*").select(F.col("vec_id").alias("doc_id"))
    keyed.stream_embed_unseen(
        docs, ["doc_id"], ["n_chars"], "text", embed.hashing_embedder(), "hashing-384", target, scratch_dir(t.spark, "unseen-state"), stored
    ).awaitTermination()
    rows = t.spark.read.schema("doc_id bigint, model_name string, embedding array<float>, created_at timestamp").parquet(target)
    return rows.select("doc_id", "model_name", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 4).alias("length"))


@query("stream_silence_timer", "SELECT user_id, max(ts) AS silent_from, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    """All events arrive, then nothing does: every user is reported two seconds later."""
    path = scratch_dir(t.spark, "timers")
    alerts = keyed.silence_timers(_event_stream(t), ["user_id"], "ts", 2000)
    keyed.stop_when_silent(jobs.start_table(alerts, path, scratch_dir(t.spark, "timers-state"), "1 second"), 3600)
    stored = t.spark.read.schema(alerts.schema).parquet(path)
    return stored.select("user_id", F.col("silent_from").cast("timestamp_ntz").alias("silent_from"), "n")


@query("stream_dedup", "SELECT event_type, user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(t):
    twice = _event_stream(t).unionByName(_event_stream(t))
    unique = jobs.dedup_versions(twice, ["event_type", "user_id", "ts"], "ts")
    return _run_to_table(t, unique, "dedup").select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query(
    "stream_error_burst",
    "WITH s AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS slot_start, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) "
    "SELECT slot_start, slot_start + INTERVAL 10 MINUTE AS slot_end, errors FROM s "
    "WHERE errors > 1 AND slot_start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE",
)
def _(t):
    bursts = jobs.error_burst_stream(_event_stream(t), "ts", F.col("event_type") == "error", more_than=1)
    stored = _run_to_table(t, bursts, "bursts")
    return stored.select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), F.col("slot_end").cast("timestamp_ntz").alias("slot_end"), "errors")


@query(
    "stream_silence_gap",
    "WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), "
    "s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 25 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM g), "
    "a AS (SELECT user_id, part, max(ts) AS silent_from, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, silent_from, silent_from + INTERVAL 25 HOUR AS alert_at, n FROM a "
    "WHERE silent_from + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def _(t):
    stored = _run_to_table(t, jobs.silence_stream(_event_stream(t), "user_id", "ts"), "silence")
    return stored.select("user_id", F.col("silent_from").cast("timestamp_ntz").alias("silent_from"), F.col("alert_at").cast("timestamp_ntz").alias("alert_at"), "n")


@query(
    "stream_metrics",
    "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {b})" for b in fixed.REQUEST_BOUNDS) + ", ('+Inf', 'Infinity'::DOUBLE)) AS v(le, bound)), "
    "w AS (SELECT *, time_bucket(INTERVAL '1 minute', ts) AS slot_start FROM events) SELECT slot_start, event_type, le, count(*) FILTER (value <= bound) AS cumulative, "
    "count(*) AS observations, round(sum(value), 4) AS total FROM w, b WHERE slot_start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY slot_start, event_type, le",
)
def _(t):
    metrics = jobs.metrics_stream(_event_stream(t), "ts", "value", fixed.REQUEST_BOUNDS, ["event_type"])
    stored = _run_to_table(t, metrics, "metrics")
    return stored.withColumns({"slot_start": F.col("slot_start").cast("timestamp_ntz"), "total": F.round("total", 4)})
