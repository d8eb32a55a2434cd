"""Raw postings, dumps and logs derived by Spark from whole tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def dump_lines(t) -> DataFrame:
    """One JSON line per event, some broken in every way a dump line can be."""
    kind = F.col("event_id") % 10
    job_id = F.when(kind == 1, F.lit(None)).when(kind == 2, "").otherwise(F.concat(F.lit("u"), F.col("user_id")))
    payload = F.struct(
        F.concat(F.lit("Job "), "event_id").alias("title"),
        F.when(kind != 3, F.concat(F.lit("Company "), "user_id")).alias("company"),
        F.concat(F.lit("https://example.org/"), "event_id").alias("url"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    stamp = F.date_format("ts", TS_FORMAT)
    full = F.to_json(F.struct(job_id.alias("job_id"), F.col("event_type").alias("source"), stamp.alias("scrape_timestamp"), payload.alias("payload")))
    line = (
        F.when(kind == 4, F.substring(full, 1, 30))
        .when(kind == 5, F.to_json(F.struct(job_id.alias("job_id"), F.col("event_type").alias("source"), stamp.alias("scrape_timestamp"), F.lit("text").alias("payload"))))
        .when(kind == 6, F.lit("  "))
        .when(kind == 7, F.to_json(F.struct(F.col("user_id").alias("job_id"), payload.alias("payload"))))
        .otherwise(full)
    )
    return t.spread("events").select("event_id", "event_type", line.alias("value"))


def js(col: Column) -> Column:
    """A JSON string literal."""
    return F.concat(F.lit('"'), F.replace(col.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def obj(**fields: Column | str) -> Column:
    """A JSON object from JSON texts; null parts are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), F.lit(v) if isinstance(v, str) else v) for name, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _job_a(kind: Column) -> Column:
    title = F.concat("c_mktsegment", F.lit(" post "), "o_orderkey")
    body = F.concat(
        F.lit("<p>Order <b>"), "o_orderkey", F.lit("</b> for "), "c_name", F.lit(" &amp; co</p><ul><li>status "), "o_orderstatus", F.lit("</li></ul>")
    )
    return obj(
        id=js(F.col("o_orderkey")),
        title=F.when(kind != 2, js(title)),
        content=js(body),
        shareLink=js(F.concat(F.lit("https://jobs.example.org/"), "o_orderkey")),
        isExpired=F.when(kind == 9, F.lit("true")).otherwise("false"),
        tracking=obj(
            classificationInfo=obj(classification=js(F.col("c_mktsegment")), subClassification=F.when(kind != 5, js(F.col("o_orderpriority")))),
            locationInfo=obj(location=js(F.concat(F.lit("nation "), "c_nationkey"))),
        ),
        workTypes=F.when(kind == 3, F.lit('["Full time"]')).otherwise('{"label":"Full time"}'),
        salary=F.when(kind == 6, F.lit("null")).otherwise(
            obj(label=js(F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"), F.lit(" - $"), (F.floor("o_totalprice") + 900).cast("string"), F.lit(" per month"))))
        ),
        listedAt=obj(dateTimeUtc=F.when(kind == 7, F.lit('"soon"')).otherwise(js(F.concat(F.date_format("o_orderdate", TS_FORMAT), F.lit("Z"))))),
        advertiser=obj(name=js(F.concat("c_name", F.lit(" Pte Ltd")))),
    )


def payload_a() -> Column:
    kind = F.col("o_orderkey") % 10
    profile = F.when(kind == 4, F.lit("null")).otherwise(
        obj(
            id=js(F.col("o_custkey")),
            overview=obj(
                industry=js(F.col("c_mktsegment")),
                size=obj(description=F.lit('"11-50"')),
                description=obj(paragraphs=F.concat(F.lit("["), js(F.concat(F.lit("About "), "c_name")), F.lit(',"Second &lt;part&gt;"]'))),
            ),
        )
    )
    inner = obj(
        job=F.when(kind == 1, F.lit("null")).otherwise(_job_a(kind)),
        companyProfile=profile,
        companySearchUrl=js(F.concat(F.lit("https://companies.example.org/"), "o_custkey")),
    )
    return F.when(kind == 0, inner).otherwise(obj(title=F.lit('"outer"'), raw=inner))


def item_b() -> Column:
    kind = F.col("o_orderkey") % 12
    price = F.floor("o_totalprice").cast("string")
    salary = (
        F.when(kind == 3, obj(minimum=price, type='{"salaryType":"Monthly"}'))
        .when(kind == 4, obj(maximum=price, type='{"salaryType":"Monthly"}'))
        .when(kind == 9, obj(minimum="20", maximum="30", type='{"salaryType":"Hourly"}'))
        .when(kind == 11, F.lit('"n/a"'))
        .otherwise(obj(minimum=price, maximum=(F.floor("o_totalprice") + 100).cast("string"), type='{"salaryType":"Monthly"}'))
    )
    return obj(
        uuid=js(F.concat(F.lit("m"), "o_orderkey")),
        title=F.when(kind == 5, F.lit('""')).otherwise(js(F.concat(F.lit("  Role "), "o_orderkey", F.lit(" ")))),
        description=js(F.concat(F.lit("<div>Work&nbsp;in "), "c_mktsegment", F.lit("</div>"))),
        jobDetailsUrl=js(F.concat(F.lit("https://mcf.example.org/"), "o_orderkey")),
        metadata=obj(
            jobDetailsUrl=js(F.concat(F.lit("https://mcf.example.org/"), "o_orderkey")),
            updatedAt=js(F.concat(F.date_format("o_orderdate", TS_FORMAT), F.lit(".000Z"))),
        ),
        address=F.when(kind == 1, F.lit("null")).when(kind != 2, F.lit('{"districts":[{"location":"cbd"},{"location":"East"}]}')),
        categories=F.when(kind == 7, F.lit("[]")).otherwise(F.concat(F.lit("["), obj(category=js(F.col("c_mktsegment"))), F.lit("]"))),
        employmentTypes=F.lit('[{"employmentType":"Permanent"}]'),
        salary=salary,
        postedCompany=F.when(kind == 8, F.lit("null")).otherwise(
            obj(
                uen=js(F.concat(F.lit("U"), "o_custkey")),
                name=js(F.concat(F.upper("c_name"), F.lit(" PRIVATE LIMITED"))),
                description=F.lit('"<p>plain</p>"'),
                employeeCount=F.when(kind == 6, F.lit("0")).otherwise(F.col("o_custkey").cast("string")),
                _links='{"self":{"href":"https://c.example.org"}}',
            )
        ),
    )


def payload_b() -> Column:
    kind = F.col("o_orderkey") % 12
    return F.when(kind == 0, item_b()).when(kind == 10, F.lit('{"title":"x","raw":null}')).otherwise(
        obj(title=F.lit('"outer"'), location=F.lit('"Singapore"'), raw=item_b())
    )


def ordered(t) -> DataFrame:
    """Orders with their customer."""
    customers = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return t.spread("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def raw_postings(t) -> DataFrame:
    """One raw posting per order: source A for status O, source B for P, and both plus an unknown one for F."""
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    source = (
        F.when(status == "O", "JobStreet").when(status == "P", "mcf").when(urgent, "Indeed").otherwise("JOBSTREET")
    )
    return ordered(t).select(
        F.concat(F.lit("r"), "o_orderkey").alias("job_id"),
        source.alias("source"),
        F.to_timestamp(F.lit("2024-02-01T00:00:00Z")).alias("scrape_timestamp"),
        F.when(status == "P", payload_b()).otherwise(payload_a()).alias("payload"),
        F.col("o_orderkey"),
    )


def batch_responses(t) -> DataFrame:
    """Batch responses of up to eight jobs each, with null and expired entries and error lists."""
    slot = F.col("o_orderkey") % 8
    batch = F.floor(F.col("o_orderkey") / 8).alias("batch")
    entry = F.when(slot == 7, F.lit("null")).otherwise(
        obj(
            job=F.when(
                slot == 6, F.lit("{}")
            ).otherwise(
                obj(
                    id=js(F.col("o_orderkey")),
                    title=js(F.concat(F.lit("Post "), "o_orderkey")),
                    abstract=js(F.col("o_orderpriority")),
                    content=F.when(slot != 1, js(F.concat(F.lit("Text "), "o_custkey"))),
                    shareLink=F.when(slot != 2, js(F.concat(F.lit("https://s.example.org/"), "o_orderkey"))),
                    isExpired=F.when(slot == 5, F.lit("true")).otherwise("false"),
                    advertiser=obj(name=js(F.concat(F.lit("Firm "), "o_custkey")), isVerified="true"),
                    location='{"label":"Singapore"}',
                    listedAt=obj(dateTimeUtc=js(F.date_format("o_orderdate", TS_FORMAT))),
                    salary=F.when(slot == 3, F.lit("null")).otherwise('{"label":"$5000"}'),
                    workTypes=F.when(slot == 4, F.lit('{"label":"x"}')).otherwise('[{"label":"Full time"}]'),
                    classifications=F.concat(F.lit("["), obj(label=js(F.col("o_orderstatus"))), F.lit(',"skip",{"id":1}]')),
                )
            )
        )
    )
    member = F.concat(F.lit('"jobDetails'), (slot + 1).cast("string"), F.lit('":'), entry)
    grouped = t.orders.groupBy(batch).agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))
    code = F.when(F.col("batch") % 3 == 0, F.lit("RATE_LIMITED")).otherwise("OTHER")
    message = F.when(F.col("batch") % 3 == 1, F.lit("Too many requests, slow down")).otherwise("Field failed")
    errors = F.concat(
        F.lit("["),
        obj(message=js(message), path='["jobDetails3","job","salary"]', extensions=obj(code=js(code))),
        F.lit(',{"path":["jobDetails8"]},{"message":"no path"}]'),
    )
    with_errors = F.concat(F.lit(',"errors":'), errors)
    return grouped.select(
        "batch",
        F.concat(
            F.lit('{"data":{'), "members", F.lit(',"other":1}'), F.when(F.col("batch") % 2 == 0, with_errors).otherwise(""), F.lit("}")
        ).alias("response"),
    )
