"""Hosts of many labels and entries of one."""

from pyspark.sql import functions as F

from postlens.llm import urls


def test_all_domains_above_a_host_count(spark, shared):
    names = ["c.d.e.f.g.h.bad.example", "zip", "j.example"]
    listed = spark.createDataFrame([(n, "spam", True, "2024-01-01") for n in names], "entry string, list string, listed boolean, day string")
    pages = [("http://a.b.c.d.e.f.g.h.bad.example/x", "spam:c.d.e.f.g.h.bad.example"), ("http://deep.er.host.zip/", "spam:zip"), ("http://" + "x." * 120 + "j.example", "spam:j.example"), ("http://e.f.g.h.bad.example", "")]
    captures = spark.createDataFrame([(u, "2024-02-01") for u, _ in pages], "url string, fetched string")
    found = urls.judge(captures, listed.withColumn("day", F.to_date("day")))
    assert {r["url"]: ",".join(r["active"]) for r in found.collect()} == dict(pages)
