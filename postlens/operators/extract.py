"""Postings out of raw payloads: batch responses, field extraction, cleaning with reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.salary import with_salary
from postlens.functions.staging import pin
from postlens.functions.text import normalize_company, normalize_location, strip_ws, with_clean_descriptions
from postlens.functions.variants import is_filled_object, is_object, not_object, null_or_not_object, part, text_at
from postlens.schemas import CLEANED_SCHEMA
from postlens.sources.jsonl import is_empty_json

KEEP_NULLS = {"ignoreNullFields": "false"}

FIELDS = [
    "job_id", "job_url", "job_title", "job_description", "job_location", "job_classification", "job_work_type",
    "job_salary_text", "job_posted_timestamp", "company_id", "company_url", "company_name", "company_description",
    "company_industry", "company_size",
]

# Objects of a source-A payload that may be missing or null but not of another kind.
A_OBJECTS = [
    "$.job", "$.companyProfile", "$.companyProfile.overview", "$.companyProfile.overview.size", "$.job.tracking",
    "$.job.tracking.classificationInfo", "$.job.tracking.locationInfo", "$.job.workTypes", "$.job.salary",
    "$.job.listedAt", "$.job.advertiser",
]

# Objects of a source-B payload that may be missing but neither null nor of another kind.
B_OBJECTS = ["$.metadata", "$.address", "$.postedCompany", "$.postedCompany._links"]
B_LISTS = ["$.address.districts", "$.categories", "$.employmentTypes"]

#: Fields without which a posting is of no use.
REQUIRED = ["job_id", "job_title"]

#: Fields that one generated method reads; the JVM leaves methods of over 8000 bytes to its interpreter.
FIELDS_AT_ONCE = 4


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def explode_batch_response(df: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """One raw row per live job of a batch response, in key order.

    A response holds ``data.jobDetails1..n``; null, empty and expired jobs are dropped, as are jobs whose
    nested objects are of another kind. ``keep`` names columns carried over.
    """
    data = F.from_json(F.col(response), "data map<string,string>")["data"]
    wanted = F.map_filter(data, lambda k, _: F.startswith(k, F.lit("jobDetails")))
    entries = df.select(
        *keep, F.posexplode(F.array_sort(F.map_entries(wanted))).alias("position", "entry")
    ).select(*keep, "position", F.col("entry.key").alias("key"), F.col("entry.value").alias("_text"))
    entries = pin(entries, _full=F.try_parse_json("_text"))
    job = F.col("_job")
    shaped = F.lit(True)
    for path in ("$.advertiser", "$.location", "$.listedAt", "$.salary"):
        shaped = shaped & (is_object(job, path) | is_empty_json(part(job, path)))
    live = (
        pin(entries, _job=part(F.col("_full"), "$.job"))
        .filter(is_filled_object(job) & is_empty_json(part(job, "$.isExpired")))
        .filter(shaped)
    )
    job_id = or_empty(text_at(job, "$.id"))
    labels = F.transform(
        F.filter(F.try_variant_get(job, "$.classifications", "array<variant>"), lambda c: is_object(c)),
        lambda c: or_empty(text_at(c, "$.label")),
    )
    payload = F.struct(
        or_empty(text_at(job, "$.title")).alias("title"),
        or_empty(text_at(job, "$.advertiser.name")).alias("company"),
        or_empty(text_at(job, "$.location.label")).alias("location"),
        F.coalesce(F.nullif(text_at(job, "$.content"), F.lit("")), or_empty(text_at(job, "$.abstract"))).alias("description"),
        or_empty(text_at(job, "$.listedAt.dateTimeUtc")).alias("date_posted"),
        F.coalesce(
            F.nullif(text_at(job, "$.shareLink"), F.lit("")), F.concat(F.lit("https://www.jobstreet.com.sg/job/"), job_id)
        ).alias("url"),
        text_at(job, "$.salary.label").alias("salary_text"),
        text_at(job, "$.workTypes[0].label").alias("work_type"),
        F.try_variant_get(job, "$.advertiser.isVerified", "boolean").alias("is_verified"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("classification"),
        F.col("_full").alias("raw"),
    )
    return live.select(
        *keep, "position", "key", job_id.alias("job_id"), F.lit("JobStreet").alias("source"), F.to_json(payload, KEEP_NULLS).alias("payload")
    )


def response_errors(df: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """One row per reported error: its number, the id of the job its path names, and the message."""
    v = F.try_parse_json(response)
    errors = pin(df.select(*keep, response), _v=v).select(
        *keep, "_v", F.posexplode(F.try_variant_get("_v", "$.errors", "array<variant>")).alias("_pos", "_e")
    )
    key = text_at(F.col("_e"), "$.path[0]")
    details = F.try_element_at(F.try_variant_get("_v", "$.data", "map<string,variant>"), F.col("_key"))
    by_job = F.when(is_object(F.col("_d"), "$.job"), F.coalesce(text_at(F.col("_d"), "$.job.id"), F.lit("unknown")))
    return (
        errors.withColumn("_key", F.when(F.startswith(key, F.lit("jobDetails")), key))
        .withColumn("_d", details)
        .select(
            *keep,
            (F.col("_pos") + 1).alias("error_number"),
            F.coalesce(by_job, text_at(F.col("_d"), "$.id"), F.lit("unknown")).alias("job_id"),
            F.coalesce(text_at(F.col("_e"), "$.message"), F.lit("Unknown")).alias("message"),
        )
    )


def is_rate_limited(response: Column) -> Column:
    """Whether any error of the response reports a rate limit."""
    shape = "errors array<struct<message:string,extensions:struct<code:string>>>"

    def limited(e: Column) -> Column:
        message = or_empty(F.lower(e["message"]))
        code = or_empty(e["extensions"]["code"])
        return (code == "RATE_LIMITED") | F.contains(message, F.lit("rate limit")) | F.contains(message, F.lit("too many requests"))

    return F.coalesce(F.exists(F.from_json(response, shape)["errors"], limited), F.lit(False))


def wrap_single_response(df: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """A single-object response as one raw row; the pay text needs both bounds."""
    item = F.col("_item")
    both = ~is_empty_json(part(item, "$.salary.minimum")) & ~is_empty_json(part(item, "$.salary.maximum"))
    pay = F.concat(
        text_at(item, "$.salary.minimum"),
        F.lit(" - "),
        text_at(item, "$.salary.maximum"),
        F.lit(" "),
        F.coalesce(text_at(item, "$.salary.type.salaryType"), F.lit("None")),
    )
    payload = F.struct(
        or_empty(text_at(item, "$.title")).alias("title"),
        or_empty(text_at(item, "$.postedCompany.name")).alias("company"),
        F.lit("Singapore").alias("location"),
        or_empty(text_at(item, "$.description")).alias("description"),
        or_empty(text_at(item, "$.metadata.updatedAt")).alias("date_posted"),
        or_empty(text_at(item, "$.jobDetailsUrl")).alias("url"),
        F.when(both, pay).alias("salary_text"),
        item.alias("raw"),
    )
    return (
        pin(df.select(*keep, response), _item=F.try_parse_json(response))
        .filter(is_object(item))
        .select(
            *keep,
            or_empty(text_at(item, "$.uuid")).alias("job_id"),
            F.lit("MCF").alias("source"),
            F.to_json(payload, KEEP_NULLS).alias("payload"),
        )
    )


def _fields_a(d: Column) -> dict[str, Column]:
    def get(path: str) -> Column:
        return or_empty(text_at(d, path))

    main, sub = get("$.job.tracking.classificationInfo.classification"), get("$.job.tracking.classificationInfo.subClassification")
    paragraphs = F.try_variant_get(d, "$.companyProfile.overview.description.paragraphs", "array<string>")
    return {
        "job_id": get("$.job.id"),
        "job_url": get("$.job.shareLink"),
        "job_title": get("$.job.title"),
        "job_description": get("$.job.content"),
        "job_location": get("$.job.tracking.locationInfo.location"),
        "job_classification": F.when((main != "") & (sub != ""), F.concat(main, F.lit(" - "), sub)).otherwise(F.concat(main, sub)),
        "job_work_type": get("$.job.workTypes.label"),
        "job_salary_text": get("$.job.salary.label"),
        "job_posted_timestamp": text_at(d, "$.job.listedAt.dateTimeUtc"),
        "company_id": get("$.companyProfile.id"),
        "company_url": get("$.companySearchUrl"),
        "company_name": get("$.job.advertiser.name"),
        "company_description": or_empty(F.array_join(paragraphs, "\n\n")),
        "company_industry": get("$.companyProfile.overview.industry"),
        "company_size": get("$.companyProfile.overview.size.description"),
    }


def _fields_b(d: Column) -> dict[str, Column]:
    def get(path: str) -> Column:
        """'' where the key is missing, null where it is null."""
        return F.coalesce(text_at(d, path), F.when(part(d, path).isNull(), F.lit("")))

    low, high = part(d, "$.salary.minimum"), part(d, "$.salary.maximum")
    kind = F.when(part(d, "$.salary.type.salaryType").isNull(), "Monthly").otherwise(
        F.coalesce(text_at(d, "$.salary.type.salaryType"), F.lit("None"))
    )
    low_text = F.concat(F.lit("$"), text_at(d, "$.salary.minimum"))
    pay = (
        F.when(
            ~is_empty_json(low) & ~is_empty_json(high),
            F.concat(low_text, F.lit(" - $"), text_at(d, "$.salary.maximum"), F.lit(" "), kind),
        )
        .when(~is_empty_json(low), F.concat(low_text, F.lit(" "), kind))
        .otherwise("")
    )
    return {
        "job_id": get("$.uuid"),
        "job_url": get("$.metadata.jobDetailsUrl"),
        "job_title": get("$.title"),
        "job_description": get("$.description"),
        "job_location": get("$.address.districts[0].location"),
        "job_classification": get("$.categories[0].category"),
        "job_work_type": get("$.employmentTypes[0].employmentType"),
        "job_salary_text": pay,
        "job_posted_timestamp": get("$.metadata.updatedAt"),
        "company_id": get("$.postedCompany.uen"),
        "company_url": get("$.postedCompany._links.self.href"),
        "company_name": get("$.postedCompany.name"),
        "company_description": get("$.postedCompany.description"),
        "company_industry": F.lit(""),
        "company_size": F.when(is_empty_json(part(d, "$.postedCompany.employeeCount")), "").otherwise(
            text_at(d, "$.postedCompany.employeeCount")
        ),
    }


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def _bad_structure(d: Column, is_a: Column) -> Column:
    first_not_object = [~is_object(d, f"{p}[0]") & ~is_empty_json(part(d, p)) for p in B_LISTS]
    pay_type = is_object(d, "$.salary") & null_or_not_object(d, "$.salary.type")
    in_b = ~is_object(d) | _any([null_or_not_object(d, p) for p in B_OBJECTS]) | _any(first_not_object) | pay_type
    return F.when(is_a, _any([not_object(d, p) for p in A_OBJECTS])).otherwise(in_b)


def extract_fields(raw: DataFrame, payload: str = "payload", fields: list[str] | None = None) -> DataFrame:
    """Add the 15 fields of a posting, or those named, and ``reject``, the reason a row cannot be used (null if it can).

    Both sources are read in one pass. Source A unwraps ``raw`` when it is an object, source B whenever
    the key is there. Shapes on which the fields cannot be read reject the row.
    """
    source = F.lower("source")
    is_a, is_b = source == "jobstreet", source == "mcf"
    v, d = F.col("_v"), F.col("_data")
    inner = part(v, "$.raw")
    data = F.when(F.when(is_a, is_object(v, "$.raw")).otherwise(inner.isNotNull()), inner).otherwise(v)
    reject = (
        F.when(~(is_a | is_b) | source.isNull(), "unknown_source")
        .when(v.isNull() | ~is_object(v), "bad_payload")
        .when(_bad_structure(d, is_a), "bad_structure")
    )
    staged = pin(pin(pin(raw, _v=F.try_parse_json(payload)), _data=data), reject=reject).drop("_v")
    from_a, from_b = _fields_a(d), _fields_b(d)
    usable = F.col("reject").isNull()
    wanted = FIELDS if fields is None else [f for f in FIELDS if f in {*fields, *REQUIRED}]
    for i in range(0, len(wanted), FIELDS_AT_ONCE):
        some = wanted[i : i + FIELDS_AT_ONCE]
        staged = pin(staged, **{f"_{name}": F.when(usable, F.when(is_a, from_a[name]).otherwise(from_b[name])) for name in some})
    missing = (or_empty(F.col("_job_id")) == "") | (or_empty(F.col("_job_title")) == "")
    carried = [F.col(c) for c in raw.columns if c not in FIELDS]
    return staged.select(
        *carried,
        F.coalesce(F.col("reject"), F.when(missing, "missing_required")).alias("reject"),
        *[F.col(f"_{name}").alias(name) for name in FIELDS if fields is None or name in fields],
    )


def clean_with_reason(raw: DataFrame, ingested: Column | None = None) -> DataFrame:
    """All raw rows with the cleaned columns and ``reject``; rejected rows keep source, job_id and times only."""
    return _cleaned(extract_fields(raw.withColumn("_raw_job_id", F.col("job_id"))), ingested)


def _cleaned(fields: DataFrame, ingested: Column | None) -> DataFrame:
    ok = F.col("reject").isNull()
    posted = F.try_to_timestamp(F.replace("job_posted_timestamp", F.lit("Z"), F.lit("+00:00")))
    staged = with_clean_descriptions(fields, {"job_description": "_description", "company_description": "_company_text"})
    staged = with_salary(staged, "job_salary_text", prefix="_pay_")
    return staged.select(
        "reject",
        "source",
        "scrape_timestamp",
        (F.current_timestamp() if ingested is None else ingested).alias("bq_timestamp"),
        F.when(ok, F.col("job_id")).otherwise(F.col("_raw_job_id")).alias("job_id"),
        "job_url",
        strip_ws(F.col("job_title")).alias("job_title"),
        F.when(ok, F.col("_description")).alias("job_description"),
        F.when(ok, normalize_location(F.col("job_location"))).alias("job_location"),
        "job_classification",
        "job_work_type",
        F.col("_pay_min_raw").alias("job_salary_min_sgd_raw"),
        F.col("_pay_max_raw").alias("job_salary_max_sgd_raw"),
        F.when(ok, F.col("_pay_period")).alias("job_salary_type"),
        F.col("_pay_min_monthly").alias("job_salary_min_sgd_monthly"),
        F.col("_pay_max_monthly").alias("job_salary_max_sgd_monthly"),
        F.when(ok, F.col("_pay_currency")).alias("job_currency"),
        F.when(ok, F.coalesce(posted, F.col("scrape_timestamp"))).alias("job_posted_timestamp"),
        "company_id",
        "company_url",
        F.when(ok, normalize_company(F.col("company_name"))).alias("company_name"),
        F.when(ok, F.col("_company_text")).alias("company_description"),
        "company_industry",
        "company_size",
    )


def clean_jobs(raw: DataFrame, ingested: Column | None = None) -> DataFrame:
    """Raw jobs to cleaned jobs, unusable rows left out before anything is cleaned."""
    fields = extract_fields(raw.withColumn("_raw_job_id", F.col("job_id"))).filter("reject IS NULL")
    return _cleaned(fields, ingested).select(*CLEANED_SCHEMA.names)


def rejected_jobs(raw: DataFrame) -> DataFrame:
    """The rows ``clean_jobs`` leaves out, with the reason."""
    return extract_fields(raw.withColumn("_raw_job_id", F.col("job_id")), fields=[]).filter("reject IS NOT NULL").select(
        "source", F.col("_raw_job_id").alias("job_id"), "reject"
    )


def payload_profile(raw: DataFrame, critical: list[str], payload: str = "payload") -> DataFrame:
    """Per top-level key: how many payloads have it, and whether it is a critical key with gaps."""
    total = raw.count()
    keys = raw.select(F.explode(F.json_object_keys(payload)).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    named = raw.sparkSession.createDataFrame([(c,) for c in critical], "key string").withColumn("is_critical", F.lit(True))
    joined = counts.join(named, "key", "full")
    return joined.select(
        "key",
        F.coalesce("n", F.lit(0)).alias("present"),
        (F.lit(total) - F.coalesce("n", F.lit(0))).alias("missing"),
        F.coalesce("is_critical", F.lit(False)).alias("is_critical"),
    )
