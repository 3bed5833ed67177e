import random

from pyspark.sql import functions as F

from quizmill.operators import ingest, normalize, numbering
from quizmill.sources import files

POSTS = "id long, source_url string, title string, cleaned_text string, posted_at timestamp, extract_status string, fetched_at timestamp, extract_error string"


def posts(spark, *rows):
    return spark.createDataFrame([(i, u, "t", "old", None, s, None, "e") for i, u, s in rows], POSTS)


def test_flatten_records(spark):
    schema = files.API_RECORD
    rows = [
        (74, "9", ("m1", "u1", " T ", "N", " c ", 1717286400000, None), ("nick", None, None, None), (5, None, 0, 3), ("x",)),
        (74, None, ("m2", None, " ", "N", None, 0, None), None, None, ("x2",)),
        (250, None, ("m3", "u", None, None, "c", None, "ip"), None, (1, 2, 7, 3), None),
    ]
    out = files.flatten_records(spark.createDataFrame(rows, schema), "https://e.com", "joblist").collect()
    assert [r.detail_url for r in out] == ["https://e.com/feed/main/detail/u1", "https://e.com/discuss/x2", "https://e.com/discuss/m3"]
    assert [r.title for r in out] == ["T", "N", ""] and [r.comment_count for r in out] == [3, 0, 7]
    assert [r.created_at for r in out] == ["2024-06-02 08:00", "", ""] and out[1].author == ""


def test_crawl_files_drop_control_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"crawled_at": "x"}\n{"title": "a", "content_id": "1"}\n\n{"total": 1}\n')
    assert [r.title for r in files.read_crawl_jsonl(spark, str(path)).collect()] == ["a"]


def test_import_posts_twice_changes_nothing(spark):
    batch = spark.createDataFrame([("a", "x", "u1", "2024-01-01 08:30", 1), ("b", "y", "u1", "", 2), ("c", "z", "u2", "bad", 3), ("d", "w", " ", "", 4)], "title string, content string, detail_url string, created_at string, line long")
    old = posts(spark, (1, "u2", "done"))
    out, counts = ingest.import_posts(batch, old)
    got = {r.source_url: r for r in out.collect()}
    assert counts.first().asDict() == {"new": 1, "skipped": 1, "updated": 0}
    assert got["u1"].title == "a" and str(got["u1"].posted_at) == "2024-01-01 00:30:00" and got["u2"].cleaned_text == "old"
    assert out.columns == [*old.columns, "outcome"] and got["u1"].id == 2 and got["u2"].extract_error == "e"
    again = out.drop("outcome")
    assert sorted(map(tuple, ingest.import_posts(batch, again)[0].drop("outcome").collect())) == sorted(map(tuple, again.collect()))
    assert ingest.import_posts(batch, again)[1].first().asDict() == {"new": 0, "skipped": 2, "updated": 0}
    forced, counts = ingest.import_posts(batch, old, force=True)
    assert counts.first().updated == 1 and {r.source_url: r.extract_status for r in forced.collect()} == {"u1": "pending", "u2": "pending"}


def test_upsert_raw_keeps_columns_html_and_gives_ids(spark):
    pages = spark.createDataFrame([("u1", "<h>", None), ("u9", "<n>", ""), ("u3", "<n>", "new")], "source_url string, html string, page_title string")
    old = posts(spark, (1, "u1", "failed"), (2, "u2", "failed"), (7, "u7", "done")).withColumn("raw_html", F.concat(F.lit("<"), "source_url")).withColumn("extract_version", F.lit(4))
    new = ingest.upsert_raw(pages, old, "2024-01-01 00:00:00")
    out = {r.source_url: r for r in new.collect()}
    assert new.columns == old.columns and len(out) == 5
    assert (out["u1"].title, out["u1"].extract_status, out["u1"].extract_error, out["u1"].raw_html, out["u1"].extract_version) == ("t", "pending", None, "<h>", 4)
    assert out["u2"].extract_error == "e" and out["u2"].raw_html == "<u2" and out["u7"].raw_html == "<u7" and out["u7"].extract_status == "done"
    assert (out["u3"].id, out["u3"].title, out["u3"].extract_status, out["u3"].extract_version) == (8, "new", "pending", 0) and (out["u9"].id, out["u9"].title) == (9, None)


def test_numbers_run_on_over_ranges(spark):
    rows = [(k, i * 7 % 100) for k, n in (("a", 100), ("b", 3), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = numbering.numbered(df, ["v"], ["k"]).collect()
    for key in ("a", "b", None):
        own = sorted((r.v, r.number) for r in got if r.k == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    every = sorted((r.v, r.nr) for r in numbering.numbered(df, ["v"], name="nr").collect())
    assert [n for _, n in every] == list(range(1, 109))
    assert numbering.numbered(df.filter("v < 0"), ["v"]).collect() == []


def test_order_statistic_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGES", 4)
    rng = random.Random(1)
    values = {"hot": [rng.expovariate(1) ** 5 for _ in range(3000)], "ties": [1.5] * 40 + [2.5] * 41, "one": [7.0], "close": [1.0, 1.0 + 2**-50, 1.0 + 2**-49], "wide": [-1e300, 0.0, 1e300, 5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)], "k string, v double").repartition(4)
    got = {r.k: (r.value, r.n) for r in numbering.order_statistic(df, "k", "v", lambda n: F.floor(n / 2)).collect()}
    assert got == {k: (sorted(vs)[len(vs) // 2], len(vs)) for k, vs in values.items()}


def test_catch_up(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "c"), (4, 1, "a"), (5, 1, "b"), (6, 1, "z")]
    df = spark.createDataFrame(rows, "page long, pos long, content_id string")
    assert {r.page for r in ingest.catch_up(df).collect()} == {1, 2, 3, 4, 5}
    gap = spark.createDataFrame([(1, 1, "a"), (3, 1, "b")], "page long, pos long, content_id string")
    assert {r.page for r in ingest.catch_up(gap).collect()} == {1}
    assert ingest.catch_up(df.filter("page < 0")).collect() == []
    rng = random.Random(2)
    for case in range(6):
        rows = [(p, i, str(rng.randrange(4 + p // 3)), f"u{rng.randrange(60)}") for p in range(40) if rng.random() > 0.01 * case for i in range(3)]
        stored = spark.createDataFrame([(f"u{i}",) for i in range(0, 60, 3)], "source_url string")
        seen, known, run, taken, before = set(), {r[0] for r in stored.collect()}, 0, set(), None
        for page in sorted({r[0] for r in rows}):
            if run == 3 or before is not None and page > before + 1:
                break
            new = 0
            for _, _, key, url in [r for r in rows if r[0] == page]:
                new += key not in seen and url not in known
                seen.add(key)
            run, before = (0 if new else run + 1), page
            taken.add(page)
        df = spark.createDataFrame(rows, "page long, pos long, content_id string, detail_url string")
        assert {r.page for r in ingest.catch_up(df, stored, patience=3).collect()} == taken


def test_filter_usable_and_keywords(spark):
    df = spark.createDataFrame([("1", "c", "t", "2024-01-05"), ("2", " ", "t", None), ("3", "c", "t", None), (None, "c", "t", None), ("4", "c", "t", "2023-01-01")], "content_id string, content string, title string, d string").withColumn("created", F.col("d").cast("timestamp"))
    assert {r.content_id for r in ingest.filter_usable(df, since="2024-01-01").collect()} == {"1", "3"}
    scored = ingest.keyword_score(df, {3: ["c"], -4: ["t"]}, threshold=0)
    assert {r.score for r in scored.filter("content = 'c'").collect()} == {-1}


CANON = "entity_type string, id long, canonical string"


def resolver(spark, aliases, dictionary, canonicals, decisions):
    return normalize.resolve(
        spark.createDataFrame(aliases, "entity_type string, alias string"), spark.createDataFrame(dictionary, "entity_type string, alias string, canonical_id long, confidence double"),
        spark.createDataFrame(canonicals, CANON), spark.createDataFrame(decisions, "entity_type string, alias string, is_match boolean, canonical_id long, confidence double, proposed string"),
    )


def test_resolution_tiers_and_learning(spark):
    dictionary = [("company", "A", 1, 1.0)]
    out = resolver(spark, [("company", x) for x in ("A", "aa", "low", "none", "Bee", "bee")], dictionary, [("company", 1, "A"), ("company", 4, "B")],
                   [("company", "aa", True, 1, 0.9, None), ("company", "low", True, 1, None, None), ("company", "Bee", False, None, None, "B"), ("company", "bee", False, None, None, "Same"), ("company", "none", False, None, None, "Same")])
    got = {r.alias: (r.canonical_id, r.source, r.confidence) for r in out.collect()}
    assert got == {"A": (1, "dictionary", 1.0), "aa": (1, "decision", 0.9), "Bee": (4, "new", 0.5), "bee": (5, "new", 0.5), "none": (5, "new", 0.5), "low": (6, "new", 0.5)}
    d = spark.createDataFrame(dictionary, "entity_type string, alias string, canonical_id long, confidence double")
    learned = {r.alias: (r.canonical_id, r.confidence) for r in normalize.learn_aliases(d, out).collect()}
    assert learned == {"A": (1, 1.0), "aa": (1, 0.9), "Bee": (4, 1.0), "bee": (5, 1.0), "none": (5, 1.0), "low": (6, 1.0), "B": (4, 1.0), "Same": (5, 1.0)}
    again = normalize.learn_aliases(spark.createDataFrame([("company", a, i, c) for a, (i, c) in learned.items()], d.schema), out)
    assert again.count() == len(learned)


def test_empty_dictionary_makes_one_canonical(spark):
    got = resolver(spark, [("company", "X")], [], [], []).collect()
    assert [(r.source, r.canonical_id) for r in got] == [("new", 1)]


def test_vector_tier_and_links(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "alias_id long, embedding array<double>")
    c = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.6, 0.8]), (12, [1.0, 0.0])], "canonical_id long, embedding array<double>")
    ranked = normalize.resolve_vector(a, c, k=2)
    assert {(r.alias_id, r.canonical_id, r.rank, r.matched) for r in ranked.collect()} == {(1, 10, 1, True), (1, 12, 2, False), (2, 11, 1, False), (2, 10, 2, False)}
    assert {r.alias_id: [x.canonical_id for x in r.candidates] for r in normalize.review_candidates(ranked).collect()} == {1: [10, 12], 2: [11]}
    resolved = spark.createDataFrame([(1, "company", 5), (1, "company", 6), (1, "position", 7), (2, "company", 5)], "post_id long, entity_type string, canonical_id long")
    links = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "post_id long, company_id long, position_id long")
    assert sorted(tuple(r) for r in normalize.rebuild_links(resolved, links).collect()) == [(1, 5, 7), (1, 6, 7), (3, 1, 1)]


def test_seed(spark):
    seed = spark.createDataFrame([("company", "B", ["b", "x"]), ("company", "A", ["x"]), ("company", "Old", None)], "entity_type string, canonical string, aliases array<string>")
    canonicals = spark.createDataFrame([("company", 3, "Old")], CANON)
    d = spark.createDataFrame([("company", "Old", 3, 0.5)], "entity_type string, alias string, canonical_id long, confidence double")
    names, aliases = files.seed_aliases(seed, canonicals, d)
    assert {r.canonical: r.id for r in names.collect()} == {"Old": 3, "A": 4, "B": 5}
    assert {r.alias: (r.canonical_id, r.confidence) for r in aliases.collect()} == {"Old": (3, 0.5), "A": (4, 1.0), "B": (5, 1.0), "b": (5, 1.0), "x": (4, 1.0)}


def test_vector_tier_in_the_chain(spark):
    """Near names match, others come under review with their candidates, far ones without any."""
    vectors = {"Acme": [1.0, 0.0], "Bolt": [0.0, 1.0], "acme inc": [0.95, 0.312], "bo": [0.6, 0.8], "zed": [-1.0, 0.0], "dict": [0.0, 0.0]}
    encoder = lambda texts: [vectors[t] for t in texts]
    seen = {}

    def decide(review):
        seen.update({r.alias: [(c.canonical_id, round(c.similarity, 2)) for c in r.candidates] for r in review.collect()})
        rows = [("company", "bo", True, 2, 0.8, None), ("company", "bo", True, 2, 0.9, None), ("company", "zed", False, None, None, "Zed")]
        return spark.createDataFrame(rows, "entity_type string, alias string, is_match boolean, canonical_id long, confidence double, proposed string")

    out = normalize.resolve(
        spark.createDataFrame([("company", x) for x in ("dict", "acme inc", "bo", "zed")], "entity_type string, alias string"),
        spark.createDataFrame([("company", "dict", 1, 1.0)], "entity_type string, alias string, canonical_id long, confidence double"),
        spark.createDataFrame([("company", 1, "Acme"), ("company", 2, "Bolt"), ("position", 9, "Acme")], CANON), decide, encoder=encoder,
    )
    got = {r.alias: (r.canonical_id, r.source, r.confidence) for r in out.collect()}
    assert got == {"dict": (1, "dictionary", 1.0), "acme inc": (1, "vector", 0.95), "bo": (2, "decision", 0.8), "zed": (3, "new", 0.5)}
    assert seen == {"bo": [(2, 0.8), (1, 0.6)], "zed": []}


def test_links_are_rebuilt_from_ids_dealt_once_by_post(spark):
    mentions = spark.createDataFrame([(2, "company", " a "), (2, "company", "a"), (2, "company", "b"), (2, "position", "p"), (2, "position", " "), (4, "company", "a"), (6, "company", "unknown")], "post_id long, entity_type string, alias string")
    resolved = spark.createDataFrame([("company", "a", 1), ("company", "b", 1), ("position", "p", 7), ("position", "a", 9)], "entity_type string, alias string, canonical_id long")
    links = spark.createDataFrame([(2, 5, 5), (4, 5, 5), (6, 5, 5)], "post_id long, company_id long, position_id long")
    ids = normalize.post_canonicals(mentions, resolved)
    assert sorted(tuple(r) for r in ids.distinct().collect()) == [(2, "company", 1), (2, "position", 7), (4, "company", 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # each side, the posts to replace and the links
        out = normalize.rebuild_links(spark.createDataFrame(ids.collect(), ids.schema), links)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 4
        assert sorted(tuple(r) for r in out.collect()) == [(2, 1, 7), (6, 5, 5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_and_decisions_leave_the_mentions_at_once(spark):
    from quizmill.plans import content

    t = content.Inputs(spark, "/root/testdata/sf0.001")
    spelled = content.spellings(t)
    assert spelled.count() == spelled.distinct().count() < t.mentions.count() / 20
    for df in (content.names_of(spelled), content.decisions(t, spelled)):
        assert "l_orderkey" not in df._jdf.queryExecution().analyzed().toString()
    assert sorted(content.names_of(spelled).collect()) == sorted(normalize.post_aliases(t.mentions).select("entity_type", "alias").distinct().collect())
