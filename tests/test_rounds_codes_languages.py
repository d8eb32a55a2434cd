"""Rewriting rounds, compressed vector search, trigram languages."""

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import ivf, language, pq, search
from postlens.plans.answers import answer_rounds

COLUMNS = {"title": "title", "company": "lang", "location": "title", "work_type": "lang", "classification": "title", "low": "low", "high": "high", "description": "text", "relevance": "relevance_score"}


def vectors(spark, n, dims, seed, name="vec_id"):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    rows = centres[rng.integers(0, 20, n)] + rng.normal(scale=0.6, size=(n, dims))
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{name} long, embedding array<float>")


def jobs_of(spark):
    rows = [(i, f"job {i}", "spark scala" if i < 8 else "bread", "en", 1000.0, 2000.0) for i in range(20)]
    corpus = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(20)], "doc_id long, embedding array<float>")
    return spark.createDataFrame(rows, "doc_id long, title string, text string, lang string, low double, high double"), corpus


def test_only_undecided_questions_go_round(spark):
    jobs, corpus = jobs_of(spark)
    asked = [(1, "spark scala", 0), (2, "zzz yyy spark xxx", 0), (3, "qqq", None), (4, "qqq", 1), (5, "qqq", 2), (6, "ab", 0)]
    queries = spark.createDataFrame([(q, t, [1.0, 0.0], r) for q, t, r in asked], "query_id long, text string, embedding array<float>, tries int")
    seen, embedded = [], []

    def rewrite(df):
        seen.append(sorted(r["query_id"] for r in df.collect()))
        better = F.when(F.col("query_id") == 2, "scala").when(F.col("query_id") == 3, " ").when(F.col("query_id") == 4, F.lit(None).cast("string")).otherwise("spark")
        return df.withColumn("rewritten", better)

    def embed(df):
        embedded.append(df.count())
        return df.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))

    done = {r["query_id"]: r for r in answer_rounds(queries, corpus, jobs, COLUMNS, rewrite, embed, "tries", 5).collect()}
    assert len(done) == 6 and all(r["decision"] == "generate" for r in done.values())
    assert seen[0] == [2, 3, 4, 6] and seen[1] == [3] and len(seen) <= 3
    assert {q: r["rewrites"] for q, r in done.items()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 1}
    assert {q: r["text"] for q, r in done.items()} == {1: "spark scala", 2: "scala", 3: "qqq", 4: "qqq", 5: "qqq", 6: "spark"}
    assert done[2]["passed"] == 5 and done[2]["context_jobs"] == 5 and done[2]["answer"] is None
    assert done[5]["passed"] == 0 and done[5]["context"] is None and done[5]["answer"]
    assert answer_rounds(queries.limit(0), corpus, jobs, COLUMNS, rewrites="tries").count() == 0


def test_compressed_search_finds_nine_in_ten(spark):
    stored = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    for corpus in (vectors(spark, 3000, 48, 1), stored):
        asked = corpus.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
        truth = search.knn_search(corpus, asked, 10)
        found = pq.pq_search(pq.pq_build(corpus), asked, 10, nprobe=10)
        assert ivf.recall_of(found, truth, "query_id", "vec_id").first()["recall"] >= 0.9


def test_compressed_search_in_parts_and_on_odd_tables(spark):
    corpus = vectors(spark, 300, 10, 2).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 10), (902, [0.0] * 10)], "vec_id long, embedding array<float>"))
    corpus = corpus.withColumn("code", F.lit("x")).withColumn("list_id", F.lit("y"))
    asked = corpus.where("vec_id < 40 OR vec_id >= 900").select(F.col("vec_id").alias("query_id"), "embedding")
    index = pq.pq_build(corpus, num_lists=8, parts=5, spill=8)
    whole = {tuple(r) for r in pq.pq_search(index, asked, 5, nprobe=8, rerank=80).collect()}
    assert whole == {tuple(r) for r in pq.pq_search(index, asked, 5, nprobe=8, rerank=80, max_query_bytes=1000).collect()}
    assert whole == {tuple(r) for r in search.knn_search(corpus, asked, 5).collect()}
    assert {r[0] for r in whole} == {*range(40), 901, 902} and all(d == 1.0 for q, _, d, _ in whole if q > 900)
    nothing = pq.pq_build(corpus.limit(0))
    assert pq.pq_search(nothing, asked, 5).count() == 0 and pq.pq_search(index, asked.limit(0), 5).count() == 0
    empty = ivf.ivf_build(corpus.where("vec_id = 900"))
    assert ivf.ivf_search(empty, asked, 5, 3).count() == 0 and ivf.ivf_health(empty).count() == 0


def test_compressed_search_past_copies_and_denser_rows(spark):
    """Copies take up no places of others; more candidates are compared where rows are denser; ``exact`` leaves no row out."""
    corpus = vectors(spark, 3000, 48, 1)
    copied = corpus.where("vec_id = 17").select(F.explode(F.sequence(F.lit(100_001).cast("long"), F.lit(101_000).cast("long"))).alias("vec_id"), "embedding")
    many = corpus.unionByName(copied)
    asked = many.where("vec_id % 100 = 0 AND vec_id < 100000").withColumnRenamed("vec_id", "query_id")
    found = pq.pq_search(pq.pq_build(many), asked, 10, nprobe=10)
    assert ivf.recall_of(found, search.knn_search(many, asked, 10), "query_id", "vec_id").first()["recall"] >= 0.9
    index = pq.pq_build(corpus.unionByName(spark.createDataFrame([(90000, [0.0] * 48)], corpus.schema)), spill=1)
    asked = asked.unionByName(spark.createDataFrame([(90001, [0.0] * 48)], asked.schema))
    want = {tuple(r) for r in search.knn_search(index.vectors, asked, 10).collect()}
    assert {tuple(r) for r in pq.pq_search(index, asked, 10, nprobe=1, rerank=1).collect()} != want
    assert {tuple(r) for r in pq.pq_search(index, asked, 10, nprobe=1, rerank=1, exact=True).collect()} == want
    assert {tuple(r) for r in pq.pq_search(index, asked, 10, nprobe=1, rerank=1, exact=True, max_query_bytes=2000).collect()} == want


def test_candidates_of_some_queries_at_a_time(spark, monkeypatch):
    """Few candidates to a task, parts of rows and repeated queries change no result, and the tasks are many."""
    corpus = vectors(spark, 1500, 16, 4)
    asked = corpus.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = pq.pq_build(corpus, num_lists=10, parts=4, spill=2)
    whole = {tuple(r) for r in pq.pq_search(index, asked, 5, nprobe=3, rerank=3).collect()}
    twice = pq.pq_search(index, asked.unionByName(asked), 5, nprobe=3, rerank=30)
    assert {(r["query_id"], r["vec_id"]) for r in twice.where("rank = 1").collect()} == {(i, i) for i in range(0, 1500, 25)}
    for name, value in (("CANDIDATES", 100), ("TASK_ROWS", 200), ("ESTIMATES_AT_ONCE", 500), ("CODED_AT_ONCE", 64), ("PAIRS_AT_ONCE", 9)):
        monkeypatch.setattr(pq, name, value)
    few = pq.pq_build(corpus, num_lists=10, parts=4, spill=2)
    block = search.query_block(asked, "query_id", "embedding", 1 << 20)
    plan = pq.candidates(few, few.codes, block, 15, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 9  # 60 queries of 15 candidates each
    assert {tuple(r) for r in pq.pq_search(index, asked, 5, nprobe=3, rerank=3).collect()} == whole


def test_gathered_rows_are_cut_as_they_double():
    """Held rows stay below twice what is wanted and one addition; the result is that of one whole sort, ties by id."""
    rng = np.random.default_rng(6)
    estimates, ids = rng.integers(0, 40, (4000, 5)) / 10.0, rng.permutation(4000)
    estimates[rng.random((4000, 5)) < 0.3] = np.nan
    for kind in (np.int64, object):
        deepest = pq.Deepest(30, 5)
        for part in np.array_split(np.arange(4000), 80):
            deepest.add(ids[part].astype(kind), estimates[part])
            assert deepest.gathered <= 2 * 30 * 5 + 50 * 5
        query, found, distance = deepest.cut()
        for q in range(5):
            order = np.lexsort((ids, np.where(np.isnan(estimates[:, q]), np.inf, estimates[:, q])))[:30]
            assert found[query == q].tolist() == ids[order].tolist() and distance[query == q].tolist() == estimates[order, q].tolist()


def test_languages_of_texts_not_trained_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    parts = docs.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    model = language.train_language_model(parts.where("half = 0"))
    judged = language.with_model_language(parts.where("half = 1"), model)
    right = judged.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97


def test_trigrams_plainly_counted(spark):
    rows = [("abab", "x"), ("zzzz é", "y"), ("ab", "y"), (None, "x"), ("nolang", None), ("", "x")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("bucket", F.lit(1))
    names, scores = language.read_language_model(language.train_language_model(df))
    assert names == ["x", "y"]
    bucket = lambda s: sum(ord(c) * f for c, f in zip(s, language.FACTORS)) % language.BUCKETS
    want = lambda n, total: round(1000 * np.log((n + 1) / (total + language.BUCKETS)))
    assert scores[bucket("aba"), 0] == want(1, 2) and scores[bucket("zzz"), 1] == want(2, 4) and scores[bucket("aba"), 1] == want(0, 4)
    found = {r["text"]: r["language"] for r in language.with_model_language(df, language.train_language_model(df)).collect()}
    assert found["abab"] == "x" and found["zzzz é"] == "y" and found["ab"] == found[None] == found[""] == "unknown"
    assert language.with_model_language(df, language.train_language_model(df.limit(0))).where("language = 'unknown'").count() == 6
    long_text = "abcdefg" * 10
    whole = np.concatenate(list(language.buckets(long_text)))
    small, language.BLOCK = language.BLOCK, 7
    try:
        assert (np.concatenate(list(language.buckets(long_text))) == whole).all()
    finally:
        language.BLOCK = small
