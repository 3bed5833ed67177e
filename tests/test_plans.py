"""Plans that matter at scale: limits before shuffles, pruned scans, no cross products of tables."""

import os

import pytest
from pyspark.sql import functions as F

from quizmill import session
from quizmill.operators import aggregate, catalog, score
from quizmill.plans import serving  # noqa: F401  it registers its queries
from quizmill.plans.registry import QUERIES, Inputs
from quizmill.sources.adapters import domain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_are_limited_before_the_shuffle(spark):
    out = aggregate.bucket_candidates(domain(spark, SF, "posts"), domain(spark, SF, "links"), domain(spark, SF, "questions"), vector="vec_id")
    text = plan(out)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text and "CartesianProduct" not in text


def test_posts_of_buckets_are_dealt_to_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    t = {n: domain(spark, SF, n) for n in ("posts", "links", "questions")}
    for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(c, "-1")
    try:
        want = sorted(map(tuple, aggregate.bucket_candidates(t["posts"], t["links"], t["questions"], vector="vec_id").collect()))
        monkeypatch.setattr(aggregate, "POSTS_A_TASK", 50)
        n = t["posts"].filter("extract_status = 'done' AND coalesce(quality_score, 0) >= 30").count()
        out = aggregate.bucket_candidates(t["posts"], t["links"], t["questions"], vector="vec_id")
        text = plan(out)
        assert sorted(map(tuple, out.collect())) == want
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
    dealt = [x for x in text.splitlines() if f", {-(-n // 50)})" in x or f", {-(-n // 50)}), " in x]
    assert n > 100 and any("REPARTITION_BY_NUM" in x for x in dealt) and text.count("WindowGroupLimit") == 2


def test_texts_are_filtered_by_the_candidates_before_a_shuffle(spark):
    t = {n: domain(spark, SF, n) for n in ("posts", "links", "questions")}
    found = aggregate.bucket_candidates(t["posts"], t["links"].filter("company_id = 3"), t["questions"], top_n=5, vector="vec_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = aggregate.fingerprints(found, t["questions"])
        text = plan(out)
        few = {r.question_id for r in found.collect()}
        assert sum(r.candidate_count for r in out.collect()) == found.count() > len({r.period for r in out.collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in text and "BroadcastHashJoin" in text
    assert {r.question_id for r in aggregate.of_candidates(t["questions"].withColumnRenamed("id", "question_id"), found).collect()} == few


@pytest.mark.parametrize("name", ["r52_question_block", "r53_summarise_buckets"])
def test_only_candidates_meet_their_vectors(spark, monkeypatch, name):
    seen, cluster = [], aggregate.cluster_questions

    def spy(candidates, vectors, threshold):
        seen.extend(r.question_id for r in vectors.collect())
        return cluster(candidates, vectors, threshold)

    monkeypatch.setattr(aggregate, "cluster_questions", spy)
    assert QUERIES[name](spark, SF).count() > 100
    assert sorted(seen) == sorted({r.question_id for r in QUERIES["r50_bucket_candidates"](spark, SF).collect()})


@pytest.mark.parametrize("sent", [True, False])
def test_questions_of_some_posts_are_numbered_as_among_all(spark, monkeypatch, sent):
    t = Inputs(spark, SF)
    posts = t.posts.filter("id % 7 = 0").select(F.col("id").alias("post_id"))
    want = sorted(map(tuple, t.questions.filter("post_id % 7 = 0").collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 12_000_000 if sent else 16)
        out = t.of_posts("questions", posts)
        text = plan(out)
        assert sorted(map(tuple, out.collect()), key=repr) == want and len(want) > 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = text.index("BroadcastHashJoin" if sent else "SortMergeJoin [l_orderkey")
    assert text.index("Window [row_number()") < joined and "LeftSemi" in text and ("BroadcastHashJoin" in text) == sent


def test_scans_are_pruned_and_filters_pushed(spark, tmp_path):
    domain(spark, SF, "posts").write.parquet(str(tmp_path / "posts"))
    posts = spark.read.parquet(str(tmp_path / "posts"))
    text = plan(score.thin_posts(posts).select("id", "quality_score"))
    assert "EqualTo(extract_status,done)" in text and "LessThan(qual" in text and "cleaned_text" not in text.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in text


def test_statistics_join_names_after_grouping(spark):
    t = {n: domain(spark, SF, n) for n in ("posts", "links", "companies", "positions")}
    out = aggregate.company_position_stats(t["posts"], t["links"], t["companies"], t["positions"])
    assert "CartesianProduct" not in plan(out) and "BroadcastNestedLoopJoin" not in plan(out)


def test_feed_takes_its_page_before_details(spark):
    t = {n: domain(spark, SF, n) for n in ("posts", "links", "questions", "companies", "positions")}
    page = catalog.feed(t["posts"], t["links"], t["questions"], t["companies"], t["positions"])
    assert "TakeOrderedAndProject" in plan(page)
    assert page.select(F.size("companies")).count() == 20


def test_partitioned_tables_skip_folders(spark, tmp_path):
    from quizmill.sources.tables import write_table

    write_table(domain(spark, SF, "posts"), str(tmp_path), "posts")
    text = plan(spark.read.parquet(str(tmp_path / "posts")).filter("extract_status = 'done'").select("id"))
    assert "PartitionFilters: [isnotnull(extract_status" in text
