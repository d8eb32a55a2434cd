"""What keeps the cost of a row down on large tables: read off plans and compared with the plain form."""

import gzip
import time

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.operators import extract, models
from postlens.plans import training
from postlens.streaming import jobs


def longest_method(df):
    """Bytes of the longest method that Spark generates for a plan; the JVM does not compile those over 8000."""
    execution = df.sparkSession._jvm.org.apache.spark.sql.execution
    stages = getattr(getattr(execution.debug, "package$"), "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def raw_rows(spark):
    rows = [(1, "JobStreet", '{"job": {"id": "a", "title": "Chef"}}'), (2, "mcf", '{"uuid": "b", "title": "Cook"}'), (3, "mcf", "[1]"), (4, "Indeed", "{}")]
    made = spark.createDataFrame(rows, "n int, source string, payload string")
    return made.select(F.col("n").cast("string").alias("job_id"), "source", F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("scrape_timestamp"), "payload")


def test_extraction_is_compiled(spark):
    assert longest_method(extract.extract_fields(raw_rows(spark))) <= 8000


def test_odd_characters_are_found_fast(spark):
    """The same texts as by one pattern over all ranges, in a fraction of its time."""
    plain = f"{tx._OTHER_ENTITY}|[^{tx._STABLE_TEXT}]"
    kinds = ["", "a & b", "a &amp; b", "a &eacute;", "é", "é", "中", "\U0001f600", "​", "x" * 50 + "́"]
    few = spark.createDataFrame([(t,) for t in kinds], "t string")
    assert few.filter(tx._is_odd(F.col("t")) != F.col("t").rlike(plain)).count() == 0
    many = spark.range(3000).select(F.repeat(F.concat(F.lit("word é "), F.col("id").cast("string")), 300).alias("t")).localCheckpoint()

    def seconds(found):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            assert many.filter(found).count() == 0
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(tx._is_odd(F.col("t"))) < seconds(F.col("t").rlike(plain)) / 2


def test_rejected_rows_read_two_fields(spark):
    raw = raw_rows(spark)
    plan = extract.rejected_jobs(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "$.job.title" in plan and "$.job.content" not in plan
    assert sorted(r["job_id"] for r in extract.rejected_jobs(raw).collect()) == ["3", "4"]
    every = extract.extract_fields(raw).select("reject", "job_title").collect()
    assert extract.extract_fields(raw, fields=["job_title"]).select("reject", "job_title").collect() == every


def test_words_of_clusters_are_counted_by_hash(spark):
    """Equal counts go to the word seen first, also below zero and without a row number."""
    rows = [(0, 5, "beta alpha"), (0, -3, "gamma delta gamma"), (0, 7, "alpha beta delta"), (1, None, "omega sigma"), (1, -(2**63), "sigma omega"), (1, 2**63 - 1, "kappa")]
    titled = spark.createDataFrame(rows, "c int, n long, title string")
    labels = models.cluster_labels(titled, "c", "title", "n", 2)
    assert "SortAggregate" not in labels.select("cluster_name")._jdf.queryExecution().sparkPlan().toString()
    named = sorted((r["c"], r["cluster_name"]) for r in labels.collect())
    assert named == [(0, "Gamma / Delta / Beta"), (1, "Omega / Sigma / Kappa")]
    by_text = titled.withColumn("n", F.col("n").cast("string"))
    assert models.cluster_labels(by_text, "c", "title", "n", 2).count() == 2


def test_one_dump_is_parsed_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "raw" / "mcf" / "2024-02-03_040506"
    folder.mkdir(parents=True)
    with gzip.open(folder / "dump.jsonl.gz", "wt") as dump:
        dump.writelines(f'{{"job_id": "{i}", "payload": {{"title": "Chef {i}"}}}}\n' for i in range(500))
    jobs.stream_ingest(spark, str(tmp_path), str(tmp_path / "table"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    assert len(list((tmp_path / "table" / "date=2024-02-03").glob("part-*"))) > 1
    stored = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(int(r["job_id"]) for r in stored.collect()) == list(range(500))


def test_a_part_of_a_fit_is_bounded(spark, monkeypatch):
    """Rows that one task holds in memory do not grow with the table, and none is lost, also if the input is one part."""
    monkeypatch.setattr(models, "TASK_NUMBERS", 18 * 100)
    rows = spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("label"), array_to_vector(F.array(F.lit(1.0), F.col("id").cast("double"))).alias("features"))
    dealt = models.in_small_parts(rows)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 200 and sum(sizes) == 3000
    assert dealt.select("label").distinct().count() == 3000 and dealt.schema["features"] == rows.schema["features"]
    assert models.in_small_parts(rows.limit(0)).count() == 0


def test_trees_are_fitted_on_bounded_parts(spark, monkeypatch):
    """The learner gets the dealt rows, of training and validation, and no more of the table than it uses."""
    seen = []
    monkeypatch.setattr(models.GBTRegressor, "_fit", lambda self, rows: seen.append(rows))
    monkeypatch.setattr(models, "TASK_NUMBERS", 17 * 50)
    rows = spark.range(0, 1000, numPartitions=2).select(F.col("id").cast("double").alias("label"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), F.lit("x").alias("other"))
    models.train_pay_model(rows.where("label % 5 > 0"), ["n"], validation=rows.where("label % 5 = 0"))
    assert seen[0].rdd.getNumPartitions() >= 20 and seen[0].where("is_validation").count() == 200 and seen[0].count() == 1000
    assert set(seen[0].columns) == {"features", "label", "is_validation"}


def test_training_makes_its_rows_once(spark, tmp_path, monkeypatch):
    """Neither table is computed again for a split, a pass of a learner or the metrics."""
    made = {"pay": spark.sparkContext.accumulator(0), "roles": spark.sparkContext.accumulator(0)}

    def counted(name, n):
        rows = spark.range(0, n, numPartitions=2).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
        seen = F.udf(lambda x, of=made[name]: of.add(1) or x, "double")
        return rows.select(array_to_vector(F.array(seen("x"), F.lit(1.0))).alias("features"), "label")

    fitted, plain = [], training.train_pay_model
    monkeypatch.setattr(training, "train_pay_model", lambda rows, names, validation, **more: fitted.extend([rows.count(), validation.count()]) or plain(rows, names, validation=validation, **more))
    vectors = spark.createDataFrame([([float(i), float(i % 3)],) for i in range(30)], "embedding array<double>")
    done = training.train_all(spark, counted("pay", 400), ["x", "one"], counted("roles", 60), vectors, "embedding", str(tmp_path / "models"), trees=2, clusters=2, tries=1)
    assert {r["model"] for r in done.collect()} == {"pay", "roles", "clusters"}
    assert made["pay"].value == 400 and made["roles"].value == 60
    assert sum(fitted) == 400 and 40 < fitted[1] < 120
