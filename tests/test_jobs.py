"""Sources, extraction, tables and streams on small written data."""

import datetime as dt
import gzip
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postlens import schemas
from postlens.operators import extract
from postlens.plans import ingest
from postlens.session import scratch_base, scratch_dir
from postlens.sources import jsonl, tables
from postlens.streaming import jobs

POSTED = "2024-05-01T00:00:00Z"


def payload_b(**changes):
    item = {
        "uuid": "m1",
        "title": " Chef ",
        "description": "<p>Cook &amp; serve</p>",
        "metadata": {"jobDetailsUrl": "https://x", "updatedAt": "2024-04-01T10:00:00.000Z"},
        "address": {"districts": [{"location": "cbd"}]},
        "categories": [{"category": "Food"}],
        "employmentTypes": [{"employmentType": "Full Time"}],
        "salary": {"minimum": 3150, "maximum": 4725, "type": {"salaryType": "Monthly"}},
        "postedCompany": {"uen": "U1", "name": "ACME PTE LTD", "description": "d", "employeeCount": 212, "_links": {"self": {"href": "https://c"}}},
    }
    item.update(changes)
    return {"raw": {k: v for k, v in item.items() if v != "absent"}}


def raw(spark, *payloads, source="mcf"):
    rows = [(f"r{i}", source, dt.datetime(2024, 5, 1), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, schemas.RAW_SCHEMA)


def test_source_b_row(spark):
    got = extract.clean_jobs(raw(spark, payload_b())).first()
    assert (got.job_id, got.job_title, got.job_description, got.job_location) == ("m1", "Chef", "Cook & serve", "Central")
    assert (got.job_salary_min_sgd_monthly, got.job_salary_max_sgd_monthly, got.company_name, got.company_size) == (3150.0, 4725.0, "ACME", "212")
    assert [f.name for f in extract.clean_jobs(raw(spark, payload_b())).schema.fields] == list(schemas.CLEANED_CONTRACT)


@pytest.mark.parametrize(
    "changes, reject",
    [
        ({"address": None}, "bad_structure"),
        ({"address": "absent"}, None),
        ({"address": {"districts": None}}, None),
        ({"address": {"districts": ["x"]}}, "bad_structure"),
        ({"metadata": None}, "bad_structure"),
        ({"postedCompany": {"name": "x", "_links": None}}, "bad_structure"),
        ({"salary": None}, None),
        ({"salary": {"minimum": 1, "type": None}}, "bad_structure"),
        ({"title": ""}, "missing_required"),
        ({"title": None}, "missing_required"),
        ({"categories": [None]}, "bad_structure"),
    ],
)
def test_source_b_shapes(spark, changes, reject):
    assert extract.extract_fields(raw(spark, payload_b(**changes))).first()["reject"] == reject


def job_a(**changes):
    job = {
        "id": "7",
        "title": "Clerk",
        "content": "c",
        "shareLink": "https://s",
        "tracking": {"classificationInfo": {"classification": "Admin", "subClassification": "Office"}, "locationInfo": {"location": "North"}},
        "workTypes": {"label": "Full time"},
        "salary": None,
        "listedAt": {"dateTimeUtc": POSTED},
        "advertiser": {"name": "Firm"},
    }
    job.update(changes)
    return {"job": job, "companyProfile": None}


@pytest.mark.parametrize(
    "payload, reject, classification",
    [
        ({"raw": job_a()}, None, "Admin - Office"),
        (job_a(), None, "Admin - Office"),
        ({"raw": "text", **job_a()}, None, "Admin - Office"),
        (job_a(tracking=None), None, ""),
        (job_a(tracking={"classificationInfo": {"subClassification": "Office"}}), None, "Office"),
        (job_a(workTypes=["x"]), "bad_structure", None),
        ({"raw": {"job": None}}, "missing_required", None),
        ("[1]", "bad_payload", None),
        ("{broken", "bad_payload", None),
    ],
)
def test_source_a_shapes(spark, payload, reject, classification):
    got = extract.extract_fields(raw(spark, payload, source="JobStreet")).first()
    assert got["reject"] == reject
    if reject is None:
        assert got["job_classification"] == classification


def test_unknown_source(spark):
    assert extract.rejected_jobs(raw(spark, payload_b(), source="other")).first()["reject"] == "unknown_source"


def test_dump_lines_and_verdicts(spark, tmp_path):
    good = {"job_id": 5, "source": "s", "scrape_timestamp": "t", "payload": {"title": "a", "company": "b", "url": "c"}}
    lines = [json.dumps(good), "", "{bad", json.dumps({**good, "job_id": 0}), json.dumps({**good, "job_id": "0", "payload": "{x"}), json.dumps({"job_id": "9", "payload": {}})]
    path = tmp_path / "dump.jsonl.gz"
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")
    parsed = jsonl.read_raw_jsonl(spark, str(path), "fallback", "2024-01-01T00:00:00")
    assert [r["status"] for r in parsed.collect()] == ["valid", "blank", "bad_json", "missing_job_id", "bad_payload", "valid"]
    valid = parsed.filter("status = 'valid'").select("job_id", "source", "scrape_timestamp").collect()
    assert [tuple(r) for r in valid] == [("5", "s", "t"), ("9", "fallback", "2024-01-01T00:00:00")]
    assert tuple(jsonl.ingest_report(parsed).first()) == (6, 2, 3, 1)
    verdict = jsonl.validate_dump(jsonl.with_line_numbers(jsonl.read_lines(spark, str(path)))).first()
    assert verdict["messages"][0] == "Line 2: Empty line" and verdict["valid_jobs"] == 2 and not verdict["is_valid"]


def test_explicit_null_is_not_the_fallback(spark):
    line = json.dumps({"job_id": "1", "source": None, "payload": {"a": 1}})
    parsed = jsonl.parse_raw_lines(spark.createDataFrame([(line,)], "value string"), F.lit("x"), F.lit("y"))
    assert tuple(parsed.select("source", "scrape_timestamp").first()) == (None, "y")


def test_line_numbers_over_many_splits(spark, tmp_path):
    with open(tmp_path / "big.txt", "w") as out:
        out.writelines(f"{i}\n" for i in range(1, 50001))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        numbered = jsonl.with_line_numbers(jsonl.read_lines(spark, str(tmp_path / "big.txt")))
        assert numbered.select("block").distinct().count() > 3
        assert numbered.filter(F.col("value").cast("int") != F.col("line")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_valid_dump(spark):
    good = json.dumps({"job_id": 5, "source": "s", "scrape_timestamp": "t", "payload": {"title": "a", "company": "b", "url": "c"}})
    df = spark.createDataFrame([("f", 1, good), ("f", 2, good)], "file string, line int, value string")
    assert jsonl.validate_dump(df).first()["messages"] == ["✓ Valid: 2/2 jobs"]


@pytest.mark.parametrize(
    "path, status, ts",
    [
        ("raw/jobstreet/2025-12-18_210000/dump.jsonl.gz", "ok", dt.datetime(2025, 12, 18, 21)),
        ("raw/x/2025-12-18_210000/dump.jsonl", "unsupported_source", None),
        ("raw/mcf/bad/dump.jsonl", "ok", dt.datetime(2020, 1, 1)),
        ("raw/mcf/2025-12-18_210000/notes.txt", "skip", None),
        ("tmp/mcf/2025-12-18_210000/dump.jsonl", "invalid_path", None),
        ("raw/dump.jsonl", "invalid_path", None),
    ],
)
def test_tag_run(spark, path, status, ts):
    df = spark.createDataFrame([(path, dt.datetime(2020, 1, 1))], "path string, created timestamp_ntz")
    got = jsonl.tag_run(df, "path", "created").first()
    assert (got["run_status"], got["run_ts"]) == (status, ts)


def test_batch_response(spark):
    response = json.dumps(
        {
            "data": {
                "jobDetails2": {"job": {"id": "2", "title": "b", "advertiser": {"name": "x"}}},
                "jobDetails1": {"job": {"id": "1", "title": "a", "classifications": [{"label": "c"}, "n"], "workTypes": [{"label": "w"}]}},
                "jobDetails3": None,
                "jobDetails4": {"job": {"id": "4", "isExpired": True}},
                "jobDetails5": {"job": {"id": "5", "advertiser": "text"}},
                "other": {"job": {"id": "6"}},
            },
            "errors": [{"message": "Rate limit hit", "path": ["jobDetails1"]}],
        }
    )
    df = spark.createDataFrame([(response,)], "r string")
    got = extract.explode_batch_response(df, "r", []).orderBy("position").collect()
    assert [r["job_id"] for r in got] == ["1", "2"]
    first = json.loads(got[0]["payload"])
    assert first["classification"] == ["c"] and first["url"].endswith("/job/1") and first["salary_text"] is None and first["raw"]["job"]["id"] == "1"
    assert [tuple(r) for r in extract.response_errors(df, "r", []).collect()] == [(1, "1", "Rate limit hit")]
    assert df.select(extract.is_rate_limited(F.col("r"))).first()[0]


def test_schema_rules(spark):
    schema = schemas.struct_from_contract({"a": "str", "b": "list[float]", "c": "something"})
    assert schema.simpleString() == "struct<a:string,b:array<float>,c:string>" and all(f.nullable for f in schema.fields)
    assert len(schemas.CLEANED_SCHEMA) == 23
    df = spark.createDataFrame([(1, None)], "old int, new int")
    assert tables.rename_by_copy(df, "old", "new").first()["new"] == 1
    with pytest.raises(ValueError):
        tables.rename_by_copy(df, "gone", "new")
    with pytest.raises(ValueError):
        tables.set_column_comment(df, "gone", "x")


def test_append_counts_and_partitions(spark):
    path = scratch_dir(spark, "t")
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], "k string, ts timestamp")
    assert tables.append_rows(df, path, "ts", ["k"], ["k"]) == {"total_rows": 3, "failed_rows": 1, "successful_rows": 2}
    tables.append_rows(df, path, "ts", ["k"], ["k"])
    assert spark.read.parquet(path).groupBy("date").count().count() == 2 and spark.read.parquet(path).count() == 4


class _Session:
    def __init__(self, setting, master, context=None):
        settings = {"spark.checkpoint.dir": setting}
        self.conf = SimpleNamespace(get=lambda key, default=None: settings[key] or default, set=settings.__setitem__)
        self.sparkContext = SimpleNamespace(getCheckpointDir=lambda: context, master=master, applicationId="app")


def test_scratch_follows_the_session():
    assert scratch_dir(_Session("hdfs://shared/tmp/", "yarn"), "x").startswith("hdfs://shared/tmp/x-")
    assert scratch_base(_Session(None, "yarn", "hdfs://ctx")) == "hdfs://ctx"
    with pytest.raises(RuntimeError):
        scratch_base(_Session(None, "yarn"))
    local = _Session(None, "local[2]")
    assert scratch_base(local) == scratch_base(local)


def _write_run(root, source, run, ids):
    folder = os.path.join(root, "raw", source, run)
    os.makedirs(folder)
    with open(os.path.join(folder, "dump.jsonl"), "w") as out:
        for i in ids:
            out.write(json.dumps({"job_id": f"j{i}", "source": "mcf", "payload": payload_b(uuid=f"j{i}")}) + "\n")


def test_runs_in_batch_and_as_stream(spark, tmp_path, rows):
    root = str(tmp_path / "lake")
    _write_run(root, "mcf", "2024-05-01_100000", range(5))
    _write_run(root, "indeed", "2024-05-01_100000", range(5))
    raw_path, state = str(tmp_path / "raw"), str(tmp_path / "state")
    jobs.stream_ingest(spark, root, raw_path, state).awaitTermination()
    assert spark.read.parquet(raw_path).count() == 5
    _write_run(root, "mcf", "2024-05-02_100000", range(5, 8))
    jobs.stream_ingest(spark, root, raw_path, state).awaitTermination()
    cleaned = str(tmp_path / "cleaned")
    for _ in range(2):
        jobs.stream_clean(spark, raw_path, cleaned, str(tmp_path / "clean-state")).awaitTermination()
    batch = ingest.ingest_runs(spark, root, str(tmp_path / "b-raw"), str(tmp_path / "b-clean"))
    assert batch["raw"]["successful_rows"] == batch["cleaned"]["successful_rows"] == 8
    columns = ["job_id", "scrape_timestamp", "job_title", "job_salary_min_sgd_monthly"]
    assert rows(spark.read.parquet(cleaned).select(*columns)) == rows(spark.read.parquet(str(tmp_path / "b-clean")).select(*columns))
