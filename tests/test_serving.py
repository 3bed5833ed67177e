import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizmill.functions.domains import excerpt, importance
from quizmill.functions.times import local_minute, parse_local, period_label
from quizmill.operators import aggregate, answers, catalog, score, search, telemetry
from quizmill.sources.schemas import EXTRACTION

NOW = "2026-06-02 00:00:00"


def scored(spark, rounds, posted):
    """``rounds``: list of lists of answers."""
    record = ([], [], None, None, [(i + 1, None, [(f"q{j}", None, a) for j, a in enumerate(r)]) for i, r in enumerate(rounds)]) if rounds is not None else None
    df = spark.createDataFrame([(1, record, posted)], f"post_id long, record struct<{EXTRACTION}>, posted string").withColumn("posted_at", F.col("posted").cast("timestamp"))
    r = score.score_extracted(df, NOW).first()
    return r.quantity, r.answers, r.rounds, r.recency, r.total


def test_score_cases(spark):
    assert scored(spark, [[None, None]], None) == (6, 0, 7, 0, 13)
    assert scored(spark, [["a"] * 3] * 4, "2026-05-03 00:00:00") == (30, 20, 20, 30, 100)
    assert scored(spark, [], "2026-04-03 00:00:00")[3] == 30 and scored(spark, [], "2025-04-28 00:00:00")[3] == 8
    assert scored(spark, [], "2023-12-15 00:00:00")[3] == 0 and scored(spark, [], "2027-01-01 00:00:00")[3] == 30
    assert scored(spark, [["a"] * 450], NOW)[4] == 87 and scored(spark, None, NOW) == (0, 0, 0, 30, 30)
    assert scored(spark, [["  ", None], []], None) == (6, 0, 14, 0, 20)


@pytest.mark.parametrize("days,points", [(90, 30), (91, 25), (180, 25), (181, 15), (360, 15), (361, 8), (720, 8), (721, 0)])
def test_recency_cutoffs(spark, days, points):
    w = score.Weights()
    end = F.lit(NOW).cast("timestamp")
    assert spark.range(1).select(score.recency(end - F.expr(f"INTERVAL {days} DAYS 23 HOURS"), end, w)).first()[0] == points


def test_rescore_counts_round_zero_as_one(spark):
    posts = spark.createDataFrame([(1, "done", None), (2, "done", None), (3, "failed", None)], "id long, extract_status string, posted_at timestamp")
    q = spark.createDataFrame([(1, None, "a"), (1, 0, " "), (1, 1, None), (1, 2, "b"), (3, 1, "x")], "post_id long, round_no int, answer_brief string")
    got = {r.post_id: (r.quantity, r.answers, r.rounds, r.total) for r in score.rescore_from_questions(posts, q, NOW).collect()}
    assert got == {1: (12, 8, 14, 34), 2: (0, 0, 0, 0)}


def clusters(spark, vectors, threshold, scores=None):
    rows = [(1, 1, "all", i + 1, 100 - i, (scores or [50] * len(vectors))[i]) for i in range(len(vectors))]
    c = spark.createDataFrame(rows, "company_id long, position_id long, period string, rank int, question_id long, quality_score int")
    v = spark.createDataFrame([(100 - i, x) for i, x in enumerate(vectors) if x is not None], "question_id long, embedding array<float>")
    return [(r.question_id, r.freq) for r in aggregate.cluster_questions(c, v, threshold).orderBy("place").collect()]


def test_cluster_cases(spark):
    a, near, b = [1.0, 0.0], [0.999, 0.0447], [0.0, 1.0]
    assert clusters(spark, [a, near, b], 0.92) == [(100, 2), (98, 1)]
    assert clusters(spark, [a, b], 0.92) == [(100, 1), (99, 1)]
    assert clusters(spark, [b, None, a, near], 0.92) == [(98, 2), (100, 1), (99, 1)]
    assert clusters(spark, [None, b, b, a], 0.92, [None, 9, 9, 10]) == [(99, 2), (97, 1), (100, 1)]


def test_cluster_rows_against_a_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(20):
        vs = [None if rng.random() < 0.2 else v / np.linalg.norm(v) for v in rng.normal(size=(25, 3))]
        kept, freq = [], []
        for i, v in enumerate(vs):
            sims = [(vs[k] @ v, -n) for n, k in enumerate(kept) if v is not None and vs[k] is not None]
            if sims and max(sims)[0] >= 0.8:
                freq[-max(sims)[1]] += 1
            else:
                kept.append(i)
                freq.append(1)
        assert aggregate.cluster_rows(vs, 0.8) == (kept, freq)


def test_candidates_ignore_partitions_and_order(spark):
    rng = random.Random(2)
    posts = [(i, rng.choice(["done", "failed"]), rng.choice([None, 10, 40, 90]), None) for i in range(60)]
    links = [(i, c, p) for i in range(60) for c in (1, 2) for p in (1,) if rng.random() < 0.8]
    questions = [(i * 10 + j, i, [1.0] if rng.random() < 0.9 else None) for i in range(60) for j in range(3)]
    want = []
    for c in (1, 2):
        rows = [(s, q) for q, i, v in questions for pid, st, s, _ in posts if pid == i and st == "done" and (s or 0) >= 30 and v and (i, c, 1) in links]
        want += [(c, n + 1, q) for n, (s, q) in enumerate(sorted(rows, key=lambda x: (-x[0], -x[1]))[:7])]
    for k in (1, 6):
        rng.shuffle(questions)
        out = aggregate.bucket_candidates(
            spark.createDataFrame(posts, "id long, extract_status string, quality_score int, posted_at timestamp").repartition(k), spark.createDataFrame(links, "post_id long, company_id long, position_id long"),
            spark.createDataFrame(questions, "id long, post_id long, embedding array<double>").repartition(k), top_n=7,
        )
        assert sorted((r.company_id, r.rank, r.question_id) for r in out.collect()) == sorted(want)


def test_summary_text(spark):
    topic = [("DP", 3, ["q1", "q2"])]
    df = spark.createDataFrame([(1, topic, ["algo"], [("rare", ["q9"])], ["read"]), (2, [], [], [], []), (3, [], ["x"], None, None)], "id int, high_frequency_topics array<struct<topic:string,frequency:int,sample_questions:array<string>>>, focus_areas array<string>, edge_cases array<struct<topic:string,questions:array<string>>>, prep_advice array<string>")
    out = {r.id: r.content_md for r in aggregate.render_summary(df).collect()}
    h = aggregate.HEADINGS
    lines = [h[0] + "\n", "### DP <sub>×3</sub>\n", "> q1\n", "> q2\n", "", h[1] + "\n", "- algo", "", h[2] + "\n", "### rare\n", "> q9\n", "", h[3] + "\n", "1. read", ""]
    assert out == {1: "\n".join(lines), 2: "", 3: "\n".join([h[1] + "\n", "- x", ""])}


def test_status_upsert_report(spark):
    key = "company_id long, position_id long, period string, "
    old = spark.createDataFrame([(1, 1, "all", "a", 2, 5), (2, 1, "all", "b", 2, 9)], key + "content_md string, sample_count int, candidate_count int").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    counts = spark.createDataFrame([(1, 1, "all", 5), (2, 1, "all", 2), (3, 1, "all", 0)], key + "candidate_count long")
    assert {r.company_id: r.reason for r in aggregate.bucket_status(counts, old).collect()} == {1: "unchanged", 2: "ok", 3: "no_candidates"}
    assert {r.company_id: r.reason for r in aggregate.bucket_status(counts, old, "reference").collect()} == {1: "ok", 2: "unchanged", 3: "no_candidates"}
    new = spark.createDataFrame([(2, 1, "all", "new", 1, 2)], key + "content_md string, sample_count int, candidate_count int")
    once = aggregate.upsert_summaries(old, new, NOW)
    twice = aggregate.upsert_summaries(once, new, NOW)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and {r.company_id: r.content_md for r in once.collect()} == {1: "a", 2: "new"}


def test_nearest_with_a_large_gallery(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    test_vectors(spark)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, embedding array<double>").repartition(3)
    queries = df.filter("id < 9").select(F.col("id").alias("query_id"), "embedding")
    got = search.nearest(queries, df, 2).collect()
    assert len(got) == 18 and all(r.id % 7 == 6 and r.id in (6, 13) for r in got if r.query_id % 7)


def test_vectors(spark):
    q, g = np.array([[1.0, 0], [0, 1.0]]), np.array([[1.0, 0], [0, 1.0], [0.6, 0.8]])
    assert search.cosine_pairs(q, g) == pytest.approx(q @ g.T) and search.cosine_pairs(q, g).shape == (2, 3)
    assert search.cosine_pairs(np.zeros((0, 3)), np.ones((3, 3))).shape == (0, 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(0).normal(size=(300, 8)))], "id long, embedding array<double>").repartition(5)
    m = {r.id: np.array(r.embedding) for r in df.collect()}
    queries = df.filter("id < 3").select(F.col("id").alias("query_id"), "embedding")
    for r in search.nearest(queries, df, 4).collect():
        best = sorted(m, key=lambda i: (-(m[i] @ m[r.query_id]), i))[:4]
        assert best[r.rank - 1] == r.id and r.similarity == pytest.approx(m[r.id] @ m[r.query_id], abs=1e-6)
    assert search.nearest(queries.limit(0), df, 4).count() == 0


def test_backfill_only_fills_gaps(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "abc", [1.0]), (3, None, None), (4, "abc", None)], "id long, content string, embedding array<float>")
    new = search.backfill(df, limit=2)
    assert sorted(r.id for r in new.collect()) == [1, 3]
    full = {r.id: r.embedding for r in search.with_vectors(df, search.backfill(df)).collect()}
    assert full[2] == [1.0] and full[1] == full[4] and len(full[1]) == 64 and sum(x * x for x in full[1]) == pytest.approx(1, abs=1e-5)


def test_search_filters_do_not_repeat_rows(spark):
    q = spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (2, 1, "b", [0.0, 1.0]), (3, 2, "c", [1.0, 0.0]), (4, 1, "d", None)], "id long, post_id long, content string, embedding array<double>")
    posts = spark.createDataFrame([(1, 50), (2, 10)], "id long, quality_score int")
    links = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 6, 1)], "post_id long, company_id long, position_id long")
    assert [(r.id, r.similarity) for r in search.search(q, posts, links, [1.0, 0.0], company_id=5, min_score=20).collect()] == [(1, 1.0), (2, 0.0)]
    assert [r.id for r in search.search(q, posts, links, [1.0, 0.0], limit=2).collect()] == [1, 3]


def test_times(spark):
    row = spark.createDataFrame([(1717286400000, "2024-06-02 08:00", "2024-05-01")], "ms long, s string, d string").select(local_minute(F.col("ms")), parse_local(F.col("s")).cast("string"), parse_local(F.lit("bad")), parse_local(F.lit("")), period_label(F.col("d").cast("timestamp"))).first()
    assert tuple(row) == ("2024-06-02 08:00", "2024-06-02 00:00:00", None, None, "2024Q2")


def test_answers(spark):
    q = spark.createDataFrame([(1, "x" * 81, "c", None, 0), (2, "y", None, "old", 1)], "id long, content string, category string, answer_ai string, answer_ai_version int")
    out, counts = answers.apply_answers(q, spark.createDataFrame([(1, "new"), (2, None)], "id long, answer string"), 3)
    assert {r.id: (r.answer_ai, r.answer_ai_version) for r in out.collect()} == {1: ("new", 3), 2: ("old", 1)} and tuple(counts.first()) == (1, 1)
    cards = {r.id: (r.answer, r.importance, r.error) for r in answers.answer_cards(spark.createDataFrame([(1,), (2,), (9,)], "id long"), q).collect()}
    assert cards == {1: (None, 4, answers.NO_ANSWER), 2: ("old", 3, None), 9: (None, None, answers.NOT_FOUND)}
    assert spark.range(1).select(importance(F.lit("x" * 201)), excerpt(F.lit("x" * 201)), excerpt(F.lit("ab"))).first() == (5, "x" * 200 + "…", "ab")


def test_usage(spark):
    def usage(rows, *prices):
        return telemetry.usage_summary(spark.createDataFrame(rows, "cache_hit boolean, tokens_in long, tokens_out long"), *prices).first()

    r = usage([(True, 100, 40)] * 80 + [(False, 100, 40)] * 20)
    assert (r.hits, r.misses, r.hit_rate, r.tokens_in + r.tokens_out) == (80, 20, 0.8, 14000)
    assert usage([]).hit_rate == 0.0 and usage([(None, 1_000_000, 500_000)]).cost == 2.0 and usage([(None, 2_000_000, 1_000_000)], 0.5, 1.5).cost == 2.5


def test_upper_median_and_dead_letters(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 3)] + [("b", 2.0), ("c", None)], "k string, v double")
    assert {r.k: r.p50 for r in telemetry.upper_median(df, "k", "v").collect()} == {"a": 3.0, "b": 2.0}
    failed = spark.createDataFrame([("t", i, f"u{i}", "boom", 3 if i % 2 else 1) for i in range(10)], "task string, seq long, url string, error string, attempt int")
    dead = telemetry.to_quarantine(failed)
    first, rest = telemetry.drain(dead, 2)
    assert [r.seq for r in first.orderBy("seq").collect()] == [1, 3] and rest.count() == 3 and telemetry.dead_counts(dead).first().n == 5
    assert first.orderBy("seq").first().payload == '{"url":"u1"}' and [r.seq for r in telemetry.list_dead(dead, 1).collect()] == [1]


def test_company_counts_and_feed(spark):
    companies = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", None)], "id long, canonical string, industry string")
    positions = spark.createDataFrame([(1, "P", "c")], "id long, canonical string, category string")
    links = spark.createDataFrame([(i, 1, 1) for i in range(10)] + [(i, 2, 1) for i in range(7)], "post_id long, company_id long, position_id long")
    assert [(r.canonical, r.post_count) for r in catalog.list_companies(companies, links).collect()] == [("A", 10), ("B", 7), ("C", 0)]
    posts = spark.createDataFrame([(i, f"t{i}", f"u{i}", None, 1, "done", "text") for i in range(3)], "id long, title string, source_url string, posted_at timestamp, quality_score int, extract_status string, cleaned_text string")
    q = spark.createDataFrame([(1, 0, None, "r", "q" * 201, "c"), (2, 0, 1, "s", "short", "d"), (3, 2, 1, "r", "z", "c")], "id long, post_id long, round_no int, round_type string, content string, category string")
    page = catalog.feed(posts, links, q, companies, positions)
    assert [(r.post_id, r.question_count, r.companies) for r in page.collect()] == [(2, 1, ["A", "B"]), (0, 2, ["A", "B"])]
    assert [r.companies for r in catalog.feed(posts, links, q, companies, positions, company="B").collect()] == [["B"], ["B"]]
    details = {r.post_id: r for r in catalog.feed_details(page, q, posts).collect()}
    assert details[0].excerpt == "short" and [x.id for x in details[0].questions] == [2, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the given tables are not here")
def test_every_hundredth_vector_is_searched_against_all(spark):
    from quizmill.plans import serving  # noqa: F401  it registers the query
    from quizmill.plans.registry import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = {}
    for i in ids[ids % 100 == 0]:
        sims = m @ m[ids == i][0]
        want[i] = list(ids[np.lexsort((ids, -sims))[:10]])
    got = {}
    for r in QUERIES["r63_search_many"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert len(want) == 20 and got == want


def test_nearest_searches_every_row_of_repeated_and_null_ids(spark, monkeypatch):
    from quizmill.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    vectors = {1: [1.0, 0.0], 2: [0.0, 1.0], 5: [0.6, 0.8], 7: [-1.0, 0.0]}
    queries = [(1, vectors[1]), (2, vectors[2]), (5, vectors[5]), (5, [0.8, 0.6]), (7, vectors[7]), (None, [0.0, -1.0]), (9, None)]
    gallery = [(i, v) for i, v in vectors.items()]
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>").coalesce(1)
    g = spark.createDataFrame(gallery, "id long, embedding array<double>")
    want = []
    for i, v in queries:
        if v:
            best = sorted(gallery, key=lambda x: (-(v[0] * x[1][0] + v[1] * x[1][1]), x[0]))[:2]
            want += [(i, b, round(v[0] * x[0] + v[1] * x[1], 6)) for b, x in best]
    got = [(r.query_id, r.id, r.similarity) for r in search.nearest(q, g, 2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_counters_by_status(spark):
    from quizmill.streaming import jobs

    events = spark.createDataFrame([("a", "ok", 1.5), ("a", "failed", 2.0), ("a", "ok", 0.25)], "stage string, status string, ms double")
    assert sorted(map(tuple, jobs.counters_stream(events, ("stage", "status")).collect())) == [("a", "failed", 1, 200), ("a", "ok", 2, 175)]


def best_of(queries, gallery, k):
    out = {}
    for i, q in queries:
        sims = sorted(((-round(float(np.dot(q, g)), 6), -float(np.dot(q, g)), j) for j, g in gallery), key=lambda x: (x[1], x[2]))[:k]
        out[i] = [(j, -s) for s, _, j in sims]
    return out


def clustered(n, width, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.05
    return [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("width", [1, 3, 24])
def test_search_in_blocks_equals_brute_force_and_spares_work(spark, monkeypatch, width):
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "block_rows", lambda _: 150)
    monkeypatch.setattr(search, "PAIRS", 1000)
    queries, gallery = clustered(60, width, 1), clustered(500, width, 2)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>").repartition(3)
    g = spark.createDataFrame(gallery + [(900, None)], "id long, embedding array<double>").repartition(4)
    work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {}
    for r in search.nearest(q, g, 5, work).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    want = best_of(queries, gallery, 5)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for i in got for a, b in zip(got[i], want[i]))
    assert work[0].value == 60 * 500 and (width < 24 or work[1].value < 0.4 * work[0].value)


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_search_multiplies_few_pairs_at_a_time_and_holds_few(monkeypatch, spread):
    monkeypatch.setattr(search, "PAIRS", 900)
    monkeypatch.setattr(search, "PIECE", 64)
    seen, held = [], []

    class Watched(search._Best):
        def show(self, at, q, ids, g):
            seen.append(len(at) * len(g))
            super().show(at, q, ids, g)
            held.append(self.size + len(self.held[0][0]))

    monkeypatch.setattr(search, "_Best", Watched)
    rng = np.random.default_rng(3)
    g = rng.normal(size=(5, 12))[rng.integers(0, 5, 700)] + spread * rng.normal(size=(700, 12))  # with 0, copies of five rows
    ids, q = rng.permutation(700), g[:90] * 2
    (rows, keys, _), pairs = search._block_best(np.arange(90), q, ids, g, 4)
    for i in range(90):
        want = ids[np.lexsort((ids, -np.round(g @ q[i], 9)))[:4]]
        assert list(keys[rows == i]) == list(want)
    assert max(seen) <= 900 and max(held) < 90 * 4 * 8 and sum(seen) == pairs <= 90 * 700


def test_queries_against_a_long_partition_multiply_few_pairs_at_a_time(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(search, "PAIRS", 200)
    real = search._vectors
    monkeypatch.setattr(search, "_vectors", lambda c: frames.append(len(c)) or real(c))

    class Table:  # a gallery of one partition that runs here
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            return list(f(iter([pd.DataFrame({"id": np.arange(500), "embedding": [np.array([np.cos(i), np.sin(i)]) for i in range(500)]})])))

    out = search._against_queries([(7, [1.0, 0.0]), (8, [0.0, 1.0])], Table(), 3)[0]
    best = lambda x: [int(i) for i in np.argsort(-x, kind="stable")[:3]]
    assert max(frames) <= 100 and list(out["id"]) == best(np.cos(np.arange(500))) + best(np.sin(np.arange(500)))


def test_questions_without_a_vector_are_dealt_to_all_tasks(spark):
    q = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("vec_id"))
    v = spark.range(0, 4000, 8).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    out = search.join_vectors(q, v.hint("merge"))
    sizes = [r[0] for r in out.filter("embedding is null").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 3500 and out.count() == 4000 and out.filter("embedding[0] = id").count() == 500
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[0] for r in out.select("*").filter("embedding is null").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1500


def test_distances_to_pivots():
    g = np.random.default_rng(5).normal(size=(50, 12))
    for count in (1, 7, 50, 80):
        pivots, of, apart = search._pivots(g, count)
        d = np.linalg.norm(g[:, None] - pivots[None], axis=2)
        assert len(pivots) == min(count, 50) and np.allclose(apart, d.min(1)) and np.allclose(d[np.arange(50), of], apart)
    assert len(search._pivots(np.ones((9, 3)), 5)[0]) == 1


def test_encoder_equals_a_plain_loop():
    texts = ["Backend engineer", "", None, "a", "İstanbul Ünï 面试 ☃", " padded  ", "aaaaaaaa" * 50]
    for dim, n in ((64, 3), (16, 2), (8, 5)):
        plain = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            s = f" {t or ''} ".lower()
            s += "\0" * (n - len(s))
            for j in range(len(s) - n + 1):
                h = 0
                for c in s[j : j + n]:
                    h = h * 31 + ord(c)
                h = h * 2654435761 % 2**32
                plain[i, (h >> 20) % dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(plain, axis=1, keepdims=True)
        assert np.allclose(search.hashed_grams(texts, dim, n), plain / np.where(norm == 0, 1, norm), atol=1e-6)
    assert search.hashed_grams([]).shape == (0, 64)
