"""Dedup, window, join and aggregation queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postlens.catalog.registry import query
from postlens.operators import dedup, joins, stats


@query(
    "latest_per_key",
    "SELECT event_type, user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id "
    "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(t):
    latest = dedup.latest_per_key(t.events, ["event_type", "user_id"], ["ts", "event_id"])
    return latest.select("event_type", "user_id", "event_id", "ts", "value")


@query(
    "latest_line_version",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn "
    "FROM lineitem) WHERE rn = 1",
)
def _(t):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return dedup.latest_per_key(t.lineitem.select("l_orderkey", "l_linenumber", *order), ["l_orderkey", "l_linenumber"], order)


@query(
    "dedup_by_content",
    "SELECT doc_id, n_chars, content_hash, copies FROM (SELECT *, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, "
    "count(*) OVER (PARTITION BY content_hash) AS copies FROM (SELECT *, sha256(lang || chr(31) || text) AS content_hash FROM documents)) "
    "WHERE doc_id = first_id",
)
def _(t):
    groups = dedup.content_groups(t.documents, "doc_id", ["lang", "text"])
    kept = dedup.dedup_by_content(t.documents, "doc_id", ["lang", "text"]).select("doc_id", "n_chars")
    return kept.join(groups, "doc_id")


@query(
    "duplicate_report",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 "
    "ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 20",
)
def _(t):
    return dedup.duplicate_report(t.lineitem, ["l_orderkey", "l_linenumber"], 20)


@query(
    "duplicate_keys_all",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return dedup.duplicate_report(t.lineitem, ["l_orderkey", "l_linenumber"], None)


@query(
    "top_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def _(t):
    return dedup.top_n(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query(
    "top_n_per_group",
    "SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rank FROM orders) WHERE rank <= 10",
)
def _(t):
    orders = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return dedup.top_n(orders, "o_totalprice", 10, ["o_orderkey"], ["o_orderpriority"])


@query(
    "time_split",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, md5(o_orderkey::VARCHAR)) <= "
    "floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'test' END AS split FROM orders",
)
def _(t):
    return dedup.time_split(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query(
    "recent_sample",
    "SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' "
    "ORDER BY ts DESC, event_id LIMIT 50",
)
def _(t):
    sample = dedup.recent_sample(t.events, "ts", dt.datetime(2024, 1, 15, 12), dt.timedelta(hours=1), 50, ["event_id"])
    return sample.select("event_id", "event_type", "ts")


@query(
    "drop_reingested",
    "SELECT event_type, user_id, ts, ts + to_minutes(10 * (user_id % 3)) AS bq_timestamp FROM events",
)
def _(t):
    copies = t.events.select("event_type", "user_id", "ts", F.explode(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))).alias("delivery"))
    delivered = copies.withColumn("bq_timestamp", F.col("ts") + F.make_dt_interval(mins=F.col("delivery") * 10))
    return dedup.drop_reingested(delivered, ["event_type", "user_id", "ts"], "bq_timestamp").drop("delivery")


@query(
    "pending_keys",
    "SELECT d.doc_id, d.source FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL",
)
def _(t):
    embedded = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    docs = t.documents.select("doc_id", "source")
    return joins.pending_keys(docs, embedded, ["doc_id"], "doc_id", []).select("doc_id", "source")


@query(
    "pending_keys_of_day",
    "WITH day AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM day) "
    "SELECT event_type, user_id, event_id, ts FROM l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM embeddings e "
    "WHERE e.vec_id = l.user_id AND e.label <= 4)",
)
def _(t):
    embedded = t.embeddings.filter("label <= 4").select(F.col("vec_id").alias("user_id"))
    events = t.events.select("event_type", "user_id", "event_id", "ts")
    day = dt.date(2024, 1, 20)
    pending = joins.pending_keys(events, embedded, ["event_type", "user_id"], "ts", ["event_id"], day, join_on=["user_id"])
    return pending.select("event_type", "user_id", "event_id", "ts")


@query(
    "feature_join",
    "SELECT d.doc_id, d.lang, e.vec_id IS NOT NULL AS has_embedding, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id",
)
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("hit"))
    joined = joins.feature_join(t.documents.select("doc_id", "lang"), vectors, ["doc_id"])
    return joined.select("doc_id", "lang", F.coalesce("hit", F.lit(False)).alias("has_embedding"), "label")


@query("join_latest", "SELECT e.vec_id AS doc_id, e.label, d.source, d.n_chars FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def _(t):
    hits = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return joins.join_latest(hits, t.documents.select("doc_id", "source", "n_chars"), ["doc_id"])


@query(
    "reference_lookup",
    "SELECT d.doc_id, d.lang, d.source, round(e.embedding[1]::DOUBLE, 6) AS first_value, len(e.embedding)::INTEGER AS dims "
    "FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN documents d ON d.doc_id = b.item_id",
)
def _(t):
    wanted = t.benchmark.select(F.col("item_id").alias("doc_id"))
    embeddings = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    found = joins.reference_lookup(embeddings, t.documents.select("doc_id", "lang", "source"), ["doc_id"], wanted)
    return found.select(
        "doc_id", "lang", "source", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"), F.size("embedding").alias("dims")
    )


@query(
    "uncited_sources",
    "WITH cited AS (SELECT DISTINCT conv_id, unnest([turn - 1, turn, turn + 1]) AS job_id FROM conversations WHERE role = 'assistant'), "
    "ctx AS (SELECT conv_id, turn AS job_id FROM conversations WHERE role = 'user') "
    "SELECT conv_id, job_id FROM cited ANTI JOIN ctx USING (conv_id, job_id)",
)
def _(t):
    conv = t.conversations
    around = F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1))
    cited = conv.filter("role = 'assistant'").select("conv_id", around.alias("job_id"))
    context = conv.filter("role = 'user'").select("conv_id", F.col("turn").alias("job_id"))
    return joins.uncited_sources(cited, context, ["conv_id", "job_id"])


@query(
    "map_lookup",
    "SELECT c_custkey, coalesce(r_name, 'Elsewhere') AS region FROM customer LEFT JOIN region ON c_nationkey = r_regionkey",
)
def _(t):
    mapped = joins.map_lookup(t.customer, "c_nationkey", t.region, "r_regionkey", "r_name", F.lit("Elsewhere"), "region")
    return mapped.select("c_custkey", "region")


@query(
    "job_details",
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, "
    "l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_orderkey IN (SELECT item_id FROM benchmark)) "
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM l WHERE rn = 1",
)
def _(t):
    lines = t.lineitem
    order = ["l_partkey", "l_suppkey", "l_extendedprice"]
    wanted = t.benchmark.select(F.col("item_id").alias("l_orderkey"))
    semi = lines.join(wanted, "l_orderkey", "left_semi")
    keys = semi.select("l_orderkey", "l_linenumber")
    found = joins.job_details(semi, ["l_orderkey", "l_linenumber"], keys, "l_shipdate", order)
    return found.select("l_orderkey", "l_linenumber", "l_shipdate", *order, "l_returnflag")


def _pay(t):
    return t.orders.select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        F.col("o_totalprice").alias("low"),
        (F.col("o_totalprice") * 1.25).alias("high"),
    )


def _salary_sql(group: str, where: str = "TRUE", limit: int = 10) -> str:
    r = lambda e, a: f"round(nullif({e}, 0), 2) AS {a}"
    return (
        f"SELECT {group} AS group_name, count(*) AS job_count, {r('avg(low)', 'avg_min_salary')}, {r('avg(high)', 'avg_max_salary')}, "
        f"{r('avg((low + high) / 2)', 'avg_mid_salary')}, {r('min(low)', 'min_salary')}, {r('max(high)', 'max_salary')}, "
        f"{r('quantile_disc(low, 0.25)', 'p25_salary')}, {r('quantile_disc(low, 0.5)', 'median_salary')}, {r('quantile_disc(low, 0.75)', 'p75_salary')} "
        f"FROM (SELECT *, o_totalprice AS low, o_totalprice * 1.25 AS high FROM orders) WHERE low IS NOT NULL AND {where} GROUP BY 1 "
        f"ORDER BY job_count DESC, group_name LIMIT {limit}"
    )


@query("group_salary_stats", _salary_sql("o_orderpriority"))
def _(t):
    return stats.group_salary_stats(_pay(t), "o_orderpriority", "low", "high")


@query("group_salary_stats_filtered", _salary_sql("o_orderstatus", "o_orderpriority LIKE '%HIGH%' AND o_orderstatus <> 'P'", 2))
def _(t):
    where = F.contains("o_orderpriority", F.lit("HIGH")) & (F.col("o_orderstatus") != "P")
    return stats.group_salary_stats(_pay(t), "o_orderstatus", "low", "high", where, 2)


@query(
    "group_salary_stats_latest",
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) "
    + _salary_sql("o_orderpriority").replace("FROM orders)", "FROM l WHERE rn = 1)"),
)
def _(t):
    orders = t.orders.withColumns({"low": F.col("o_totalprice"), "high": F.col("o_totalprice") * 1.25})
    return stats.group_salary_stats(orders, "o_orderpriority", "low", "high", latest=(["o_custkey"], ["o_orderdate", "o_orderkey"]))


@query(
    "exact_quantiles",
    "SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, "
    "round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1",
)
def _(t):
    found = stats.exact_quantiles(t.spread("orders", "o_orderpriority", "o_totalprice"), "o_totalprice", [0.1, 0.5, 0.99], ["o_orderpriority"])
    return found.select("o_orderpriority", "n", *[F.round(q, 4).alias(a) for q, a in (("q0", "p10"), ("q1", "p50"), ("q2", "p99"))])


@query(
    "stats_summary",
    f"SELECT count(*) AS total_groups, sum(job_count)::BIGINT AS total_jobs, round(avg(avg_mid_salary), 2) AS overall_avg_salary, "
    f"min(min_salary) AS range_min, max(max_salary) AS range_max FROM ({_salary_sql('o_orderpriority')})",
)
def _(t):
    return stats.stats_summary(stats.group_salary_stats(_pay(t), "o_orderpriority", "low", "high"))


@query("source_summary", "SELECT event_type AS source, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(t):
    return stats.source_summary(t.events, "event_type", "ts")


@query(
    "daily_volume",
    "SELECT event_type AS source, ts::DATE AS day, count(*) AS n_rows, count(DISTINCT user_id) AS n_jobs FROM events GROUP BY ALL",
)
def _(t):
    return stats.daily_volume(t.events, "event_type", "ts", "user_id")


@query(
    "embedding_coverage",
    "SELECT (SELECT count(*) FROM documents) AS jobs, (SELECT count(*) FROM embeddings) AS embeddings, "
    "round((SELECT count(*) FROM embeddings) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS coverage_pct",
)
def _(t):
    return stats.embedding_coverage(t.documents.select("doc_id"), t.embeddings.select("vec_id"))


_calls_sql = (
    "WITH calls AS (SELECT CASE WHEN u.conv_id % 3 = 0 THEN 'local' ELSE 'hosted' END AS provider, "
    "CASE WHEN u.conv_id % 3 = 0 THEN 'local-model' ELSE 'hosted-model' END AS model, "
    "length(u.text) // 4 AS tin, length(a.text) // 4 AS tout FROM conversations u JOIN conversations a "
    "ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'), "
    "c AS (SELECT *, CASE WHEN provider = 'hosted' THEN tin / 1e6 * 0.075 + tout / 1e6 * 0.30 ELSE 0.0 END::DOUBLE AS cost FROM calls) "
)


@query(
    "usage_rollup",
    _calls_sql + "SELECT CASE WHEN grouping(provider) = 1 THEN 'all' ELSE provider END AS provider, CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, "
    "count(*) AS requests, sum(tin)::BIGINT AS tokens_input, sum(tout)::BIGINT AS tokens_output, round(sum(cost), 9) AS cost_usd, "
    "round(avg(cost), 9) AS avg_cost_usd FROM c GROUP BY ROLLUP (provider, model)",
)
def _(t):
    conv = t.conversations
    asked = conv.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    replied = conv.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    local = F.col("conv_id") % 3 == 0
    calls = asked.join(replied, ["conv_id", "turn"]).select(
        F.when(local, "local").otherwise("hosted").alias("provider"),
        F.when(local, "local-model").otherwise("hosted-model").alias("model"),
        "prompt",
        "reply",
    )
    priced = stats.with_token_cost(calls, "prompt", "reply", F.col("provider") == "hosted")
    return stats.usage_rollup(priced, "provider", "model")


@query(
    "distinct_counts",
    "SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source, count(DISTINCT n_chars) AS n_chars FROM documents",
)
def _(t):
    return stats.distinct_counts(t.documents, ["lang", "source", "n_chars"])


@query(
    "category_profile",
    "SELECT lower(p_name) AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 1) AS pct FROM part "
    "GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
)
def _(t):
    return stats.top_values(t.part, F.lower("p_name"), 10)


@query(
    "missing_report",
    "WITH j AS (SELECT d.doc_id, d.lang, l.quality, nullif(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
    "c AS (SELECT 'quality' AS field, count(*) FILTER (quality IS NULL) AS missing_count, count(*) AS n FROM j UNION ALL "
    "SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM j) "
    "SELECT field, missing_count, round(missing_count * 100.0::DOUBLE / n, 2) AS missing_pct FROM c WHERE missing_count > 0",
)
def _(t):
    labelled = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return stats.missing_report(labelled.withColumn("toxic", F.nullif("toxic", F.lit(0))))


@query(
    "infinite_report",
    "SELECT 'up' AS field, count(*) AS infinite_count FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT 'both', count(*) FROM orders WHERE o_orderstatus <> 'O'",
)
def _(t):
    inf = float("inf")
    status = F.col("o_orderstatus")
    marked = t.orders.select(
        "o_totalprice",
        F.when(status == "F", inf).otherwise(F.col("o_totalprice")).alias("up"),
        F.when(status == "F", inf).when(status == "P", -inf).otherwise(F.col("o_totalprice")).alias("both"),
    )
    return stats.infinite_report(marked)


_dist = lambda c: (
    f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
    f"round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem"
)


@query("distribution_report", " UNION ALL ".join(_dist(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    return stats.distribution_report(t.spread("lineitem", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])


_corr_cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _corr_cols for b in _corr_cols
    ),
)
def _(t):
    return stats.correlation_matrix(t.lineitem, _corr_cols)


@query(
    "posting_trends",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_orderpriority, count(*) AS postings, round(avg(o_totalprice), 2) AS avg_pay "
    "FROM orders GROUP BY ALL",
)
def _(t):
    return stats.posting_trends(t.orders, "o_orderdate", "o_totalprice", "month", ["o_orderpriority"])
