import json
import os
import time

from pyspark.sql import functions as F

from quizmill.streaming import jobs

BASE = "https://e.com"


def record(ident, created, title="t", content="c"):
    return {"contentType": 250, "contentId": ident, "momentData": {"id": "m", "title": title, "content": content, "createdAt": created}}


def test_ingest_stream_flattens_dedups_and_merges(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        path = tmp_path / "in" / name
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (time.time() - 100 + int(name[0]), time.time() - 100 + int(name[0])))

    def run():
        query = jobs.ingest_stream(spark, src, out, check, BASE, buckets=8)
        query.awaitTermination()
        return [p for p in query.recentProgress if p.get("stateOperators")]

    def stored():
        return sorted((r.detail_url.rsplit("/", 1)[1], r.created_at_ms) for r in jobs.stored_posts(spark, out).collect())

    arrive("1.json", [record("a", 2), record("a", 1), record("a", 1), record("b", 5, title=""), {"contentType": 250, "momentData": {"title": "no id"}}])
    run()
    assert stored() == [("a", 1)]
    arrive("2.json", [record("a", 1), record("a", 0), record("c", 5), record("c", 4)])  # sent again; an older row of a known URL
    arrive("3.json", [record("c", 1), record("d", 7), record("d", 7)])
    progress = run()
    assert stored() == [("a", 1), ("c", 4), ("d", 7)]
    state = [s for p in progress for s in p["stateOperators"]]
    assert any("dedupe" in s["operatorName"] for s in state)
    assert sum(s.get("customMetrics", {}).get("numDroppedDuplicateRows", 0) for s in state) >= 2  # the row sent again, and d's
    run()
    assert stored() == [("a", 1), ("c", 4), ("d", 7)]


def test_merge_reads_touched_partitions_and_may_run_again(spark, tmp_path, capsys):
    out = str(tmp_path / "store")
    spark.createDataFrame([], jobs.STORE).write.partitionBy("bucket", "batch").parquet(out)
    schema = "title string, detail_url string, created_at_ms long, content_id string"

    def batch(*rows):
        df = spark.createDataFrame(rows, schema)
        for f in spark.createDataFrame([], jobs.STORE).drop("bucket", "batch").schema:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        return df

    jobs.merge_posts(batch(*(("t", f"u{i}", i, str(i)) for i in range(200))), out, 0, 32)
    for _ in range(2):  # a batch that is run again replaces what it wrote
        known = jobs.merge_posts(batch(("t", "u7", 9, "x"), ("t", "v", 1, "y"), ("t", "v", 0, "z")), out, 1, 32)
        assert sorted(r.content_id for r in jobs.stored_posts(spark, out).filter("batch = 1").collect()) == ["z"]
    assert jobs.stored_posts(spark, out).count() == 201
    known.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    assert known.select("bucket").distinct().count() <= 2


def test_counters_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 7) AS ts", "concat('s', id % 3) AS stage", "CAST(id AS DOUBLE) / 4 AS ms")
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, stage string, ms double").option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.final_state(jobs.counters_stream(stream), str(tmp_path / "counters"), str(tmp_path / "c1"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.counters_stream(df).collect()))


def test_throughput_stream_drops_late_rows_and_closes_minutes(spark, tmp_path):
    path = str(tmp_path / "events")
    minute = 1_700_000_040
    files = [[0, 10, 70], [30, 1200], [700, 1300], [5, 2500]]  # seconds; 5 comes when the watermark is past 600 and minute 0 is given
    for seconds in files:
        spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds(F.col("s") + minute).alias("ts")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.appended(jobs.throughput_stream(stream), str(tmp_path / "minutes"), str(tmp_path / "c"))
    got = {r.m - minute: r.n for r in got.select(F.unix_timestamp("minute").alias("m"), "n").collect()}
    assert got == {0: 3, 60: 1, 660: 1, 1200: 1, 1260: 1}  # 2,460 stays open


def test_daily_run_writes_changed_buckets_once(spark):
    posts = spark.createDataFrame(
        [(1, "u1", "t", None, "x", None, None, "done", None, 40, 1), (2, "u2", "t", None, "x", None, None, "pending", None, None, 0), (3, "u3", "t", None, "x", None, None, "done", None, 50, 1)],
        "id long, source_url string, title string, raw_html string, cleaned_text string, posted_at timestamp, fetched_at timestamp, extract_status string, extract_error string, quality_score int, extract_version int")
    links = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)], "post_id long, company_id long, position_id long")
    questions = spark.createDataFrame([(10, 1, "one", "c", "a", 2), (11, 2, "two", None, None, None), (12, 2, "two", None, None, None), (13, 3, "x", None, None, None)], "id long, post_id long, content string, category string, answer_ai string, answer_ai_version int")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 1.0]), (13, [1.0, 0.0])], "question_id long, embedding array<double>")
    none = spark.createDataFrame([], "company_id long, position_id long, period string, content_md string, sample_count int, candidate_count int, updated_at timestamp, fingerprint string")
    batch = spark.createDataFrame([("u1", "t", "x", "", 1), ("u9", "n", "x", "", 2)], "detail_url string, title string, content string, created_at string, line long")
    outcomes = spark.createDataFrame([(2, "done", 60), (2, "done", 60)], "post_id long, outcome string, quality_score int")
    run = lambda p, s, q=questions: jobs.daily_run(p, links, q, vectors, s, batch, outcomes, 2, "2024-01-01 00:00:00")
    first = run(posts, none)
    written = {(r.company_id, r.position_id): (r.candidate_count, r.sample_count) for r in first["summaries"].collect()}
    assert written == {(1, 1): (3, 2), (2, 1): (2, 1)}  # the pair of post 3 was not touched
    assert {r.step: r.n for r in first["counts"].collect()} == {"imported": 1, "to_process": 2, "buckets": 2, "changed_buckets": 2, "answer_targets": 3}
    assert [(r.id, r.extract_status) for r in first["posts"].filter("source_url = 'u9'").collect()] == [(4, "pending")] and first["posts"].columns == posts.columns
    second = run(first["posts"], first["summaries"])
    assert {r.step: r.n for r in second["counts"].collect()} == {"imported": 0, "to_process": 1, "buckets": 2, "changed_buckets": 0, "answer_targets": 3}
    assert sorted(map(tuple, second["summaries"].collect())) == sorted(map(tuple, first["summaries"].collect()))
    replaced = questions.withColumn("content", F.when(F.col("id") == 10, "other").otherwise(F.col("content")))  # as many questions
    assert [(r.company_id, r.position_id) for r in run(first["posts"], first["summaries"], replaced)["changed"].collect()] == [(1, 1)]


def test_daily_update_counts_after_processing(spark):
    posts = spark.createDataFrame(
        [(1, "u1", "t", "x", None, "done", 40), (2, "u2", "t", "x", None, "pending", None), (3, "u3", "t", "x", None, "failed", None)],
        "id long, source_url string, title string, cleaned_text string, posted_at timestamp, extract_status string, quality_score int")
    links = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)], "post_id long, company_id long, position_id long")
    questions = spark.createDataFrame([(10, 1, [1.0], "a", 2), (11, 2, [1.0], None, None), (12, 3, [1.0], None, None)], "id long, post_id long, embedding array<double>, answer_ai string, answer_ai_version int")
    batch = spark.createDataFrame([("u1", "t", "x", "", 1), ("u9", "t", "x", "", 2), ("u9", "t", "y", "", 3)], "detail_url string, title string, content string, created_at string, line long")
    plain = {r.step: r.n for r in jobs.daily_update(posts, links, questions, batch, 2).collect()}
    assert plain == {"imported": 1, "to_process": 3, "buckets": 1, "answer_targets": 0}
    outcomes = spark.createDataFrame([(2, "done", 60)], "post_id long, outcome string, quality_score int")
    old = spark.createDataFrame([(1, 1, "all", 1, 1), (2, 1, "all", 1, 1)], "company_id long, position_id long, period string, sample_count long, candidate_count long")
    got = {r.step: r.n for r in jobs.daily_update(posts, links, questions, batch, 2, outcomes=outcomes, summaries=old).collect()}
    assert got == {"imported": 1, "to_process": 3, "buckets": 2, "changed_buckets": 1, "answer_targets": 1}
