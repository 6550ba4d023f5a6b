"""Feeds, judged reviews, concurrency, and the data sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textstrata.operators import evaluation, judging
from textstrata.sources import formats
from textstrata.streaming import jobs, timed
from textstrata.streaming.leases import Feed

RULES = Feed(("ANSWERED", "FAILED"), ("CLARIFYING",), wait=600)


def told(rows, until=None):
    made = [(int(m * 60_000), i, {"state": s, "detail": f"d{i}"}) for i, (m, s) in enumerate(rows)]
    return [(r["n"], r["event"], r["state"], r["detail"]) for r in timed.advance(RULES, RULES.start(), made, float("inf") if until is None else until * 60_000)]


def test_feed_rules():
    assert told([(0, "A"), (1, "A"), (2, "B"), (3, "ANSWERED"), (4, "B")]) == [(1, "state", "A", None), (2, "state", "B", None), (3, "state", "ANSWERED", None), (4, "answer", "ANSWERED", "d3"), (5, "done", "ANSWERED", None)]
    assert told([(0, "CLARIFYING"), (1, "ANSWERED")]) == [(1, "state", "CLARIFYING", None), (2, "clarify", "CLARIFYING", "d0"), (3, "done", "CLARIFYING", None)]
    # at the very end of the wait an event still counts; after it nothing does
    assert [x[1] for x in told([(0, "A"), (10, "FAILED")])] == ["state", "state", "answer", "done"]
    assert [x[1] for x in told([(0, "A"), (10.1, "FAILED")])] == ["state", "timeout"]
    assert [x[1] for x in told([(0, "A")], until=10)] == ["state"] and [x[1] for x in told([(0, "A")], until=11)] == ["state", "timeout"]
    assert [x[1] for x in told([(0, None), (1, "A")], until=2)] == ["state"]


def made_judge(poison):
    calls = []

    # a closure, which workers get by value
    def judge(claims):
        calls.append(len(claims))
        if "broken" in claims:
            return "{" if poison == "text" else json.dumps({"reviews": [{"index": 1, "supported": True}]}) if poison == "short" and len(claims) > 1 else None
        if poison == "raises" and "bad" in claims:
            raise RuntimeError
        return "```json\n" + json.dumps({"reviews": [{"index": i, "supported": c != "no", "evidence_quote": c} for i, c in reversed(list(enumerate(claims, 1)))]}) + "\n```"

    return judge, calls


@pytest.mark.parametrize("poison", ["text", "short", "raises"])
def test_a_bad_claim_is_lost_alone(spark, poison):
    judge, _ = made_judge(poison)
    bad = "bad" if poison == "raises" else "broken"
    rows = [(i, bad if i == 21 else "no" if i % 4 == 0 else f"c{i}") for i in range(50)]
    got = {r.claim_id: r for r in judging.reviewed(spark.createDataFrame(rows, "claim_id long, claim string").coalesce(1), judge).collect()}
    assert len(got) == 50
    assert {i for i, r in got.items() if r.supported is None} == {21} and got[21].calls == 5
    assert all(r.supported == (i % 4 != 0) and r.evidence_quote == rows[i][1] for i, r in got.items() if i != 21)
    assert got[0].calls == 1 and got[40].calls == 1 and got[20].calls == 5


def test_reviews_of_odd_rows(spark):
    judge, calls = made_judge("raises")
    rows = [(None, "c"), (1, None), (1, "bad"), (1, "bad")]
    got = judging.reviewed(spark.createDataFrame(rows, "claim_id long, claim string").coalesce(1), judge).collect()
    assert sorted(str(r.supported) for r in got) == ["None", "None", "True", "True"]
    assert judging.reviewed(spark.createDataFrame([], "claim_id long, claim string"), judge).count() == 0
    assert judging.read_batch('{"reviews": [{"index": 1, "supported": "yes"}]}', 1) is None and judging.read_batch("[]", 0) is None and judging.read_batch('{"reviews": []}', 0) == []


def test_concurrency_tells_each_level(spark):
    df = spark.range(100)

    def request(text):
        if text == "fails":
            raise ValueError
        return df.filter(F.col("id") < int(text))

    out = evaluation.concurrency(spark, request, ["10", "20", "fails"], [1, 3], rounds=2)
    assert [(o["level"], o["n"], o["errors"], o["rows"]) for o in out] == [(1, 2, 0, 30), (3, 6, 2, 60)]
    assert all(0 < o["p50_ms"] <= o["p95_ms"] and o["mean_ms"] > 0 and o["per_second"] > 0 for o in out)


def test_gold_sets_are_a_source(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "question": "问?", "category": "x", "expect": ["甲"]}]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"queries": [{"id": "q", "query": "two", "n": 3}, {}]}), encoding="utf-8")
    rows = spark.read.format("goldset").load(str(tmp_path)).orderBy("file", F.col("id").desc()).collect()
    assert [(r.file, r.id, r.question, r.category) for r in rows] == [("a.json", "1", "问?", "x"), ("b.json", "q", "two", None), ("b.json", None, None, None)]
    assert json.loads(rows[0].fields) == {"expect": ["甲"]} and json.loads(rows[1].fields) == {"n": 3}
    assert spark.read.format("goldset").load(str(tmp_path / "a.json")).count() == 1
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("goldset").load("hdfs://x/y").count()


def test_reports_are_whole_or_absent(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "r.md")
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int").coalesce(1)
    df.write.format("report").mode("append").option("title", "T").save(path)
    assert open(path, encoding="utf-8").read() == "# T\n\n| name | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(Exception, match="more than 5 rows"):
        spark.range(60).write.format("report").mode("append").option("most", 5).save(f"{path}2")
    assert os.listdir(tmp_path) == ["r.md"]
    with pytest.raises(Exception, match="r.md"):
        df.write.format("report").mode("append").save(path)
    df.write.format("report").mode("overwrite").save(path)
    assert open(path, encoding="utf-8").read().startswith("# Report")


def test_feed_of_a_stream_is_written_as_events(spark, tmp_path):
    formats.register(spark)
    schema = "run_id long, ts timestamp, seq long, state string, detail string"
    rows = [(1, 0, "A"), (1, 60, "ANSWERED"), (2, 0, "A"), (3, 0, "CLARIFYING"), (9, 30_000, "A")]
    spark.createDataFrame([(k, s, i, st, f"d{i}") for i, (k, s, st) in enumerate(rows)], "run_id long, s long, seq long, state string, detail string").select("run_id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "seq", "state", "detail").write.parquet(f"{tmp_path}/in")
    stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    feed = timed.timed_stream(stream, RULES, "run_id")
    feed.writeStream.format("eventfeed").option("path", f"{tmp_path}/feed").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    text = "".join(open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(f"{tmp_path}/feed") for f in names)
    frames = [x.split("\n") for x in text.strip().split("\n\n")]
    got = sorted((json.loads(data[6:])["run_id"], json.loads(data[6:])["n"], event[7:]) for event, data in frames)
    assert got == [(1, 1, "state"), (1, 2, "state"), (1, 3, "answer"), (1, 4, "done"), (2, 1, "state"), (2, 2, "timeout"), (3, 1, "state"), (3, 2, "clarify"), (3, 3, "done")]
    writer = formats._FeedWriter(f"{tmp_path}/again")
    message = writer.write(iter([spark.createDataFrame([("state", 1)], "event string, n int").first()]))
    writer.commit([message, None], 4)
    writer.commit([writer.write(iter([spark.createDataFrame([("done", 2)], "event string, n int").first()]))], 4)
    assert os.listdir(f"{tmp_path}/again/batch=4") == ["part-00000.sse"] and open(f"{tmp_path}/again/batch=4/part-00000.sse").read() == 'event: done\ndata: {"n": 2}\n\n'
