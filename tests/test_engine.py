"""Search paths, retrievers, streams and injected models."""

import pytest
from pyspark.sql import functions as F

from textstrata.functions import output
from textstrata.operators import conversation, evaluation, retrievers, search
from textstrata.sources import files
from textstrata.streaming import jobs

ROWS = [(1, "用人单位拖欠 工资的处理", "effective"), (2, "社会保险费的缴纳", "effective"), (3, "社会保险 待遇", "not_yet_effective"), (4, "住房公积金", "repealed")]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, legal_status string")


def test_one_search_takes_one_path(spark, corpus):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "doc_id long, embedding array<double>")
    ids = lambda q, **k: (lambda r: ([x.doc_id for x in r[0].collect()], r[1]))(search.search_one(corpus, q, **k))
    assert ids(search.Query()) == ([1, 2, 4], "exact")
    assert ids(search.Query(keyword="拖欠工资")) == ([1], "keyword")
    assert ids(search.Query(semantic="社保怎么缴纳？")) == ([2], "keyword")
    assert ids(search.Query(semantic="毫不相干")) == ([], "none")
    assert ids(search.Query(semantic="公积金怎么办")) == ([4], "keyword")
    assert ids(search.Query(semantic="毫不相干"), vectors=vectors, encode=lambda q: [0.1, 1.0]) == ([2], "vector")
    assert ids(search.Query(keyword="社会保险", include_not_yet_effective=True, limit=1)) == ([3, 2], "keyword")


def test_retriever_matrix_and_metrics(spark, corpus):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.1, 1.0]), (4, [-1.0, 0.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "社会保险怎么算", [0.0, 1.0]), (2, "没有这个词", [1.0, 0.0])], "query_id int, q string, query array<double>")
    edges = spark.createDataFrame([(2, 4), (3, 2), (3, 1), (3, 3)], "source long, target long")
    got = retrievers.matrix(corpus, asked, 2, vectors, edges, lambda pairs: [float(len(t)) for _, t in pairs])
    keyword = {f"keyword:{s}" for s in ("substring_raw", "substring_flat", "all_terms_flat", "trigram", "word_trigram", "all_terms_flat+norm", "all_terms_flat+strip", "all_terms_flat+expand")}
    assert set(got) == keyword | {"vector", "hybrid", "cascade", "graph", "hybrid+rerank", "cascade+rerank"}
    pairs = lambda name: [(r.query_id, r.doc_id) for r in got[name].orderBy("query_id", "rank").collect()]
    assert pairs("keyword:all_terms_flat") == [] and sorted(pairs("keyword:all_terms_flat+strip")) == [(1, 2), (1, 3)]
    assert sorted(pairs("cascade")) == [(1, 2), (1, 3), (2, 1)]
    assert all(r["rank"] <= 2 for name in got for r in got[name].collect())
    text = {r.doc_id: r.text for r in corpus.collect()}
    assert [i for q, i in pairs("cascade+rerank") if q == 1] == sorted((2, 3), key=lambda i: -len(text[i]))
    wanted = spark.createDataFrame([(1, 3), (1, 4), (2, 1)], "query_id int, doc_id long")
    m = evaluation.retrieval_metrics(evaluation.query_scores(got["cascade"], wanted)).first()
    assert (m.n_scored, round(m.recall, 4), round(m.mrr, 4)) == (2, 0.6667, 1.0) and m.recall_at_1 == 0.75
    seeds = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], "query_id int, doc_id long, rank int")
    assert [r.doc_id for r in retrievers.with_neighbours(seeds, edges, 4, "doc_id").orderBy("rank").collect()] == [3, 2, 1, 4]

    def retrieve(i, q):
        if i == 9:
            raise ValueError
        return corpus.filter(F.contains("text", F.lit(q))).orderBy("doc_id")

    hits, runs = retrievers.measured(retrieve, [(1, "社会"), (9, "x")], 5)
    m = evaluation.retrieval_metrics(evaluation.query_scores(spark.createDataFrame(hits, "query_id int, doc_id long, rank int"), wanted), spark.createDataFrame(runs, "query_id int, elapsed_ms double, error boolean")).first()
    assert (m.queries, m.errors, m.n_scored) == (2, 1, 2) and m.avg_ms > 0 and {h[0] for h in hits} == {1}


def test_generator_may_be_away(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    assert [r.output for r in output.generated(df, lambda ps: [p.upper() for p in ps]).collect()] == ["A", "B"]

    def away(ps):
        raise OSError("no model")

    assert [r.output for r in output.generated(df, away).collect()] == [None, None]


def test_options_and_prompts(spark):
    r = spark.range(1).select(output.options_of(F.array(F.lit("甲"), F.lit("乙"))).alias("o"), output.prompt(F.lit("i"), F.lit(None).cast("string"), F.lit("q")).alias("p")).first()
    assert r.o.endswith("1. 甲\n2. 乙") and r.p == "i\n\nq"
    assert files.markdown([{"a": 1, "b": None}], "T") == "# T\n\n| a | b |\n| --- | --- |\n| 1 |  |\n" and files.markdown([], "T") == "# T\n"


def test_resume_and_errors(spark):
    runs = spark.createDataFrame([(1, "q", "CLARIFYING"), (2, "q", "ANSWERED"), (3, "q", "CLARIFYING")], "run_id int, question string, state string")
    more = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s")], "run_id int, supplement string")
    got = {r.run_id: (r.outcome, r.question) for r in conversation.resumed(runs, more, spark.createDataFrame([(3,)], "run_id int")).collect()}
    assert got == {1: ("resumed", "q\ns"), 2: ("not_suspended", None), 3: ("in_flight", None), 4: ("not_suspended", None)}
    codes = spark.createDataFrame([(404,), (503,), (500,)], "s int").select(conversation.error_class(F.col("s")).alias("e")).collect()
    assert [(r.e.code, r.e.retry) for r in codes] == [("document_missing", False), ("document_unavailable", True), ("internal_error", True)]


def test_job_stream_equals_its_batch(spark, tmp_path):
    rows = [(1, 1, "claim"), (1, 2, "fail"), (1, 3, "claim"), (1, 4, "complete"), (2, 5, "claim"), (3, 6, "cancel"), (4, 7, "claim"), (4, 8, "fail_final")]
    schema = "job_id int, seq int, event string"
    for i in range(4):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    jobs.job_states(spark, stream, f"{tmp_path}/table", f"{tmp_path}/progress").awaitTermination()
    want = {r.job_id: (r.attempts, r.status) for r in conversation.job_fold(spark.createDataFrame(rows, schema)).collect()}
    assert {r.job_id: (r.attempts, r.status) for r in jobs.job_table(spark, f"{tmp_path}/table").collect()} == want
    assert want == {1: (2, "succeeded"), 2: (1, "running"), 3: (0, "cancelled"), 4: (1, "failed")}


def test_memory_stream_keeps_the_last_turns(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, t, f"t{t}") for t in range(7)] + [(2, 0, "x")], schema).write.parquet(f"{tmp_path}/in")
    out = jobs.drained(jobs.conversation_memory(jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), keep=5), "memory", idle_batches=False)
    assert {r.conv_id: r.texts for r in out.collect()} == {1: ["t2", "t3", "t4", "t5", "t6"], 2: ["x"]}


def test_session_stream(spark, tmp_path):
    rows = [(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:20:00"), (1, "2020-01-01 02:00:00"), (2, "2020-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "cast(t AS timestamp) AS ts")
    df.write.parquet(f"{tmp_path}/in")
    out = jobs.drained(jobs.session_stream(jobs.event_stream(spark, f"{tmp_path}/in", df.schema)), "sessions")
    assert sorted((r.user_id, r.n) for r in out.collect()) == [(1, 1), (1, 2)]
