"""Queries on scoring, buckets, search, catalogue, answers, telemetry and streams (rows 43-88)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.functions.domains import importance
from quizmill.functions.times import period_label
from quizmill.operators import aggregate, answers, catalog, score, search, telemetry
from quizmill.plans.content import encoded_sql, payloads
from quizmill.plans.ingest import BATCH_SQL, FLAT_SQL, batch, nested
from quizmill.plans.registry import Inputs, query
from quizmill.operators.extract import parse_extraction
from quizmill.session import stored, work_folder
from quizmill.sources.adapters import NOW
from quizmill.streaming import jobs

RECENCY_SQL = f"""CASE WHEN posted_at IS NULL THEN 0 ELSE CASE WHEN days <= 90 THEN 30 WHEN days <= 180 THEN 25 WHEN days <= 360 THEN 15 WHEN days <= 720 THEN 8 ELSE 0 END END"""
DAYS_SQL = f"CAST(floor(epoch(TIMESTAMP '{NOW}' - posted_at) / 86400) AS BIGINT)"


@query("r43_score_extracted", f"""
WITH q AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn % 3 = 0) AS a, count(DISTINCT turn // 2) AS r, TIMESTAMP '{NOW}' - INTERVAL 1 DAY * CAST(conv_id % 900 AS INT) AS posted_at FROM {{conversations}} GROUP BY conv_id),
p AS (SELECT conv_id AS post_id, CASE WHEN conv_id % 23 = 3 THEN 0 ELSE n END AS n, CASE WHEN conv_id % 23 = 3 THEN 0 ELSE a END AS a, CASE WHEN conv_id % 23 = 3 THEN 0 ELSE r END AS r, conv_id % 900 AS days, posted_at FROM q)
SELECT post_id, CAST(least(3 * n, 30) AS INT) AS quantity, CAST(least(4 * a, 20) AS INT) AS answers, CAST(least(7 * r, 20) AS INT) AS rounds, CAST({RECENCY_SQL} AS INT) AS recency,
  CAST(least(least(3 * n, 30) + least(4 * a, 20) + least(7 * r, 20) + {RECENCY_SQL}, 100) AS INT) AS total FROM p""")
def _(t):
    rows = parse_extraction(payloads(t)).withColumn("posted_at", F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("post_id") % 900).cast("int")))
    return score.score_extracted(rows, NOW).select("post_id", "quantity", "answers", "rounds", "recency", "total")


@query("r44_rescore_from_questions", f"""
WITH q AS (SELECT post_id, count(*) AS n, count(*) FILTER (WHERE length(trim(answer_brief)) > 0) AS a, count(DISTINCT CASE WHEN coalesce(round_no, 0) = 0 THEN 1 ELSE round_no END) AS r FROM {{questions}} GROUP BY post_id),
p AS (SELECT p.id AS post_id, posted_at, {DAYS_SQL} AS days, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(r, 0) AS r FROM {{posts}} p LEFT JOIN q ON p.id = q.post_id WHERE extract_status = 'done')
SELECT post_id, CAST(least(3 * n, 30) AS INT) AS quantity, CAST(least(4 * a, 20) AS INT) AS answers, CAST(least(7 * r, 20) AS INT) AS rounds, CAST({RECENCY_SQL} AS INT) AS recency,
  CAST(least(least(3 * n, 30) + least(4 * a, 20) + least(7 * r, 20) + {RECENCY_SQL}, 100) AS INT) AS total FROM p""")
def _(t):
    return score.rescore_from_questions(t.posts, t.questions, NOW)


@query("r45_score_histogram", """SELECT CASE WHEN quality_score >= 80 THEN '80-100' WHEN quality_score >= 60 THEN '60-79' WHEN quality_score >= 40 THEN '40-59' WHEN quality_score >= 20 THEN '20-39' ELSE '0-19' END AS band,
  count(*) AS n, min(quality_score) AS low FROM {posts} WHERE quality_score IS NOT NULL GROUP BY 1""")
def _(t):
    return score.score_histogram(t.posts)


@query("r45_score_histogram_four", """SELECT CASE WHEN quality_score >= 75 THEN '75-100' WHEN quality_score >= 50 THEN '50-74' WHEN quality_score >= 25 THEN '25-49' ELSE '0-24' END AS band,
  count(*) AS n, min(quality_score) AS low FROM {posts} WHERE quality_score IS NOT NULL GROUP BY 1""")
def _(t):
    return score.score_histogram(t.posts, score.FOUR_BANDS)


@query("r46_thin_posts", "SELECT id, quality_score FROM {posts} WHERE extract_status = 'done' AND quality_score < 20 ORDER BY quality_score, id LIMIT 20")
def _(t):
    return score.thin_posts(t.posts).select("id", "quality_score")


@query("r47_top_posts", """SELECT id, quality_score, posted_at FROM {posts} WHERE quality_score IS NOT NULL AND id IN (SELECT post_id FROM {links} WHERE company_id = 3)
  AND id IN (SELECT post_id FROM {links} WHERE position_id = 4) ORDER BY quality_score DESC, posted_at DESC NULLS LAST, id LIMIT 20""")
def _(t):
    return score.top_posts(t.posts, t.links, 3, 4).select("id", "quality_score", "posted_at")


PERIOD_SQL = "concat(CAST(year(posted_at) AS VARCHAR), 'Q', CAST(quarter(posted_at) AS VARCHAR))"


@query("r48_period_label", f"SELECT CASE WHEN posted_at IS NOT NULL THEN {PERIOD_SQL} END AS period, count(*) AS n FROM {{posts}} GROUP BY 1")
def _(t):
    return t.posts.groupBy(period_label(F.col("posted_at")).alias("period")).agg(F.count("*").alias("n"))


@query("r49_active_pairs", "SELECT DISTINCT company_id, position_id FROM {links} WHERE post_id IN (SELECT id FROM {posts} WHERE extract_status = 'done' AND quality_score >= 30)")
def _(t):
    return aggregate.active_pairs(t.posts, t.links)


def candidates_sql(period: str, extra: str = "") -> str:
    return f"""SELECT company_id, position_id, period, rank, question_id, quality_score FROM (SELECT l.company_id, l.position_id, {period} AS period, q.id AS question_id, p.quality_score,
  row_number() OVER (PARTITION BY l.company_id, l.position_id, {period} ORDER BY p.quality_score DESC NULLS LAST, q.id DESC) AS rank
  FROM {{questions}} q JOIN {{posts}} p ON q.post_id = p.id JOIN {{links}} l ON l.post_id = p.id
  WHERE p.extract_status = 'done' AND coalesce(p.quality_score, 0) >= 30 AND q.vec_id IS NOT NULL {extra}) c WHERE rank <= 100"""


def candidates(t: Inputs, by_period: bool = False, post: bool = False) -> DataFrame:
    return aggregate.bucket_candidates(t.posts, t.links, t.questions, by_period=by_period, vector="vec_id", post=post)


CANDIDATES_SQL = candidates_sql("'all'")


@query("r50_bucket_candidates", CANDIDATES_SQL.replace("period, rank,", "period, CAST(rank AS INT) AS rank,", 1))
def _(t):
    return candidates(t)


@query("r50_bucket_candidates_by_period", candidates_sql(PERIOD_SQL, "AND p.posted_at IS NOT NULL").replace("period, rank,", "period, CAST(rank AS INT) AS rank,", 1))
def _(t):
    return candidates(t, True)


DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


#: Greedy clusters, rank by rank within a bucket: the representatives so far and their vectors pass from step to step.
GREEDY_SQL = f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT c.company_id, c.position_id, c.rank, c.question_id, c.quality_score, q.vec_id FROM ({CANDIDATES_SQL}) c JOIN {{questions}} q ON c.question_id = q.id),
sims AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y, {DOT} AS s FROM {{embeddings}} a, {{embeddings}} b),
step AS (
  SELECT company_id, position_id, rank, rank AS rep, [rank] AS reps, [vec_id] AS vecs FROM c WHERE rank = 1
  UNION ALL
  SELECT n.company_id, n.position_id, n.rank, CASE WHEN max(s) >= 0.25 THEN arg_max(r, (s, -r)) ELSE n.rank END AS rep,
    CASE WHEN max(s) >= 0.25 THEN any_value(reps) ELSE list_append(any_value(reps), n.rank) END AS reps,
    CASE WHEN max(s) >= 0.25 THEN any_value(vecs) ELSE list_append(any_value(vecs), any_value(n.vec_id)) END AS vecs
  FROM (SELECT company_id, position_id, rank, reps, vecs, unnest(reps) AS r, unnest(vecs) AS v FROM step) p
  JOIN c n ON n.company_id = p.company_id AND n.position_id = p.position_id AND n.rank = p.rank + 1 JOIN sims ON x = v AND y = n.vec_id
  GROUP BY n.company_id, n.position_id, n.rank
)
SELECT company_id, position_id, 'all' AS period, question_id, CAST(freq AS INT) AS freq, CAST(row_number() OVER (PARTITION BY company_id, position_id ORDER BY freq DESC, coalesce(quality_score, -1) DESC, rank) AS INT) AS place
FROM (SELECT company_id, position_id, rep, count(*) AS freq FROM step GROUP BY ALL) k JOIN c USING (company_id, position_id) WHERE c.rank = k.rep"""


def clustered(t: Inputs, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Clusters of all buckets, and the questions of their candidates. Only the posts of candidates are derived with texts, and only
    candidates meet their vectors."""
    found = stored(candidates(t, post=True), "candidates")
    q = t.of_posts("questions", found).select(F.col("id").alias("question_id"), "vec_id", "category", "content")
    asked = stored(aggregate.of_candidates(q, found), "asked")
    vectors = asked.select("question_id", "vec_id").join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("question_id", "embedding")
    return aggregate.cluster_questions(found.drop("post_id"), vectors, threshold), asked.drop("vec_id")


@query("r51_cluster_questions", GREEDY_SQL)
def _(t):
    return clustered(t, 0.25)[0].select("company_id", "position_id", "period", "question_id", "freq", "place")


#: Clusters as they are with a threshold that no pair reaches but equal vectors: the best question of each vector stays.
CLUSTERS_SQL = f"""SELECT company_id, position_id, period, question_id, quality_score, freq, row_number() OVER (PARTITION BY company_id, position_id, period ORDER BY freq DESC, coalesce(quality_score, -1) DESC, rank) AS place, category, content
FROM (SELECT c.*, q.vec_id, q.category, q.content, count(*) OVER (PARTITION BY company_id, position_id, period, vec_id) AS freq, row_number() OVER (PARTITION BY company_id, position_id, period, vec_id ORDER BY rank) AS nr
  FROM ({CANDIDATES_SQL}) c JOIN {{questions}} q ON c.question_id = q.id) x WHERE nr = 1"""


def clusters(t: Inputs) -> DataFrame:
    rows, asked = clustered(t, 0.92)
    return rows.join(asked, "question_id")


@query("r51_cluster_equal_vectors", f"SELECT company_id, position_id, period, question_id, CAST(freq AS INT) AS freq, CAST(place AS INT) AS place FROM ({CLUSTERS_SQL}) c")
def _(t):
    return clusters(t).select("company_id", "position_id", "period", "question_id", "freq", "place")


@query("r52_question_block", f"""SELECT company_id, position_id, period, string_agg(lpad(CAST(place AS VARCHAR), 3, ' ') || '.' || CASE WHEN category IS NULL THEN '' ELSE ' [' || category || ']' END || ' (freq=' || freq || ') ' || content, chr(10) ORDER BY place) AS block
FROM ({CLUSTERS_SQL}) c GROUP BY company_id, position_id, period""")
def _(t):
    return aggregate.question_block(clusters(t))


@query("r53_summarise_buckets", f"""
WITH c AS (SELECT *, coalesce(category, 'uncategorised') AS topic FROM ({CLUSTERS_SQL}) x),
s AS (SELECT company_id, position_id, period, topic, CAST(sum(freq) AS BIGINT) AS frequency, array_to_string(list(content ORDER BY place)[1:2], '|') AS samples, array_to_string(coalesce(list(content ORDER BY place) FILTER (WHERE freq <= 2), [])[1:2], '|') AS rare FROM c GROUP BY ALL)
SELECT company_id, position_id, period, topic, frequency, samples, CASE WHEN rare <> '' THEN rare END AS rare FROM s""")
def _(t):
    s = aggregate.summarise_buckets(clusters(t))
    top = s.select("company_id", "position_id", "period", F.explode("high_frequency_topics").alias("x"), "edge_cases")
    edge = F.try_element_at(F.filter("edge_cases", lambda e: e["topic"] == F.col("x.topic")), F.lit(1))
    return top.select("company_id", "position_id", "period", F.col("x.topic").alias("topic"), F.col("x.frequency").alias("frequency"), F.array_join("x.sample_questions", "|").alias("samples"), F.array_join(edge["questions"], "|").alias("rare"))


@query("r54_render_summary", """
SELECT doc_id, rtrim(CASE WHEN doc_id % 3 > 0 THEN '{h[0]}' || chr(10) || chr(10) || '### ' || lang || ' <sub>×' || n_chars || '</sub>' || chr(10) || chr(10) || '> ' || source || chr(10) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 2 > 0 THEN '{h[1]}' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 > 1 THEN '{h[2]}' || chr(10) || chr(10) || '### ' || source || chr(10) || chr(10) || '> ' || lang || chr(10) || chr(10) || '> ' || n_chars || chr(10) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 > 2 THEN '{h[3]}' || chr(10) || chr(10) || '1. ' || source || chr(10) || '2. ' || lang || chr(10) || chr(10) ELSE '' END, '') || '' AS content_md FROM {documents}""".replace("{h[0]}", aggregate.HEADINGS[0]).replace("{h[1]}", aggregate.HEADINGS[1]).replace("{h[2]}", aggregate.HEADINGS[2]).replace("{h[3]}", aggregate.HEADINGS[3]))
def _(t):
    topic = F.struct(F.col("lang").alias("topic"), F.col("n_chars").alias("frequency"), F.array("source").alias("sample_questions"))
    edge = F.struct(F.col("source").alias("topic"), F.array(F.col("lang"), F.col("n_chars").cast("string")).alias("questions"))
    none = F.array().cast("array<string>")
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.array(topic)).otherwise(F.filter(F.array(topic), lambda x: F.lit(False))).alias("high_frequency_topics"), F.when(F.col("doc_id") % 2 > 0, F.array("lang")).otherwise(none).alias("focus_areas"), F.when(F.col("doc_id") % 5 > 1, F.array(edge)).alias("edge_cases"), F.when(F.col("doc_id") % 7 > 2, F.array("source", "lang")).otherwise(none).alias("prep_advice"))
    out = aggregate.render_summary(rows)
    return out.select("doc_id", F.when(F.col("content_md") == "", "").otherwise(F.concat("content_md", F.lit("\n"))).alias("content_md"))


#: Stored summaries: of every other pair, with made-up counts, some of JSON.
SUMMARIES_SQL = """SELECT company_id, position_id, 'all' AS period, CASE WHEN company_id % 4 = 0 THEN '{"a": 1}' ELSE concat('## t ', company_id) END AS content_md,
  CAST(position_id AS INT) AS sample_count, CAST(CASE WHEN company_id % 3 = 0 THEN 100 ELSE 7 END AS INT) AS candidate_count, TIMESTAMP '2001-01-01 00:00:00' + INTERVAL 1 DAY * CAST(company_id AS INT) AS updated_at
FROM (SELECT c.id AS company_id, p.id AS position_id FROM {companies} c CROSS JOIN {positions} p) x WHERE (company_id + position_id) % 2 = 0"""


def summaries(t: Inputs) -> DataFrame:
    pairs = t.companies.select(F.col("id").alias("company_id")).crossJoin(t.positions.select(F.col("id").alias("position_id"))).filter("(company_id + position_id) % 2 = 0")
    return pairs.select(
        "company_id", "position_id", F.lit("all").alias("period"), F.when(F.col("company_id") % 4 == 0, '{"a": 1}').otherwise(F.concat(F.lit("## t "), "company_id")).alias("content_md"),
        F.col("position_id").cast("int").alias("sample_count"), F.when(F.col("company_id") % 3 == 0, 100).otherwise(7).alias("candidate_count"),
        (F.lit("2001-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("company_id").cast("int"))).alias("updated_at"),
    )


COUNTS_SQL = f"SELECT company_id, position_id, period, count(*) AS candidate_count FROM ({CANDIDATES_SQL}) c GROUP BY ALL"
STATUS_SQL = f"""SELECT n.company_id, n.position_id, n.period, n.candidate_count, s.candidate_count AS stored, CASE WHEN n.candidate_count = s.candidate_count THEN 'unchanged' ELSE 'ok' END AS reason
FROM ({COUNTS_SQL}) n LEFT JOIN ({SUMMARIES_SQL}) s USING (company_id, position_id, period)"""


def status(t: Inputs) -> DataFrame:
    counts = candidates(t).groupBy("company_id", "position_id", "period").agg(F.count("*").alias("candidate_count"))
    return aggregate.bucket_status(counts, summaries(t))


@query("r54_single_object", f"""
SELECT doc_id, left(md, length(md) - 1) AS content_md FROM (SELECT doc_id, '{aggregate.HEADINGS[1]}' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10)
  || CASE WHEN doc_id % 5 > 1 THEN '{aggregate.HEADINGS[2]}' || chr(10) || chr(10) || '### ' || source || chr(10) || chr(10) || '> ' || lang || chr(10) || chr(10) || chr(10) ELSE '' END AS md FROM {{documents}}) x""")
def _(t):
    """Records with one object, or one text, where a list is usual."""
    edge = F.struct(F.col("source").alias("topic"), F.array("lang").alias("questions"))
    none = F.array().cast("array<string>")
    rows = t.documents.select("doc_id", F.lit(None).cast("array<struct<topic:string,frequency:bigint,sample_questions:array<string>>>").alias("high_frequency_topics"), F.col("lang").alias("focus_areas"), F.when(F.col("doc_id") % 5 > 1, edge).alias("edge_cases"), none.alias("prep_advice"))
    return aggregate.render_summary(rows).select("doc_id", "content_md")


@query("r55_bucket_status", STATUS_SQL)
def _(t):
    return status(t)


def written(t: Inputs) -> DataFrame:
    return clusters(t).groupBy("company_id", "position_id", "period").agg(F.concat(F.lit("new "), F.count("*").cast("string")).alias("content_md"), F.count("*").cast("int").alias("sample_count"), F.sum("freq").cast("int").alias("candidate_count"))


WRITTEN_SQL = f"SELECT company_id, position_id, period, concat('new ', count(*)) AS content_md, CAST(count(*) AS INT) AS sample_count, CAST(sum(freq) AS INT) AS candidate_count FROM ({CLUSTERS_SQL}) c GROUP BY ALL"


@query("r56_upsert_summaries", f"""
WITH s AS ({SUMMARIES_SQL}), w AS ({WRITTEN_SQL})
SELECT company_id, position_id, period, coalesce(w.content_md, s.content_md) AS content_md, coalesce(w.sample_count, s.sample_count) AS sample_count, coalesce(w.candidate_count, s.candidate_count) AS candidate_count,
  CASE WHEN w.content_md IS NULL THEN s.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at FROM s FULL JOIN w USING (company_id, position_id, period)""")
def _(t):
    return aggregate.upsert_summaries(summaries(t), written(t), NOW)


@query("r57_bucket_report", f"""
SELECT a.company_id, a.position_id, a.period, a.candidate_count, CAST(coalesce(w.sample_count, 0) AS BIGINT) AS sample_count, CAST(coalesce(length(w.content_md), 0) AS BIGINT) AS content_length, a.reason = 'ok' AND w.content_md IS NOT NULL AS written, a.reason
FROM ({STATUS_SQL}) a LEFT JOIN ({WRITTEN_SQL}) w USING (company_id, position_id, period)""")
def _(t):
    return aggregate.bucket_report(status(t), written(t))


STATS_SQL = """SELECT company_id, c.canonical AS company, position_id, o.canonical AS position, count(DISTINCT p.id) AS post_count, CAST(round(avg(quality_score)) AS INT) AS avg_quality, max(posted_at) AS latest
FROM {links} l JOIN {posts} p ON l.post_id = p.id JOIN {companies} c ON l.company_id = c.id JOIN {positions} o ON l.position_id = o.id WHERE extract_status = 'done' GROUP BY 1, 2, 3, 4"""


def stats(t: Inputs) -> DataFrame:
    return aggregate.company_position_stats(t.posts, t.links, t.companies, t.positions)


@query("r58_company_position_stats", STATS_SQL)
def _(t):
    return stats(t)


@query("r59_corrupt_summaries", f"SELECT company_id, position_id, content_md FROM ({SUMMARIES_SQL}) s WHERE company_id % 4 = 0")
def _(t):
    return aggregate.corrupt_summaries(summaries(t)).select("company_id", "position_id", "content_md")


@query("r60_list_summaries", f"""SELECT company_id, c.canonical AS company, position_id, p.canonical AS position, sample_count, updated_at FROM ({SUMMARIES_SQL}) s JOIN {{companies}} c ON company_id = c.id JOIN {{positions}} p ON position_id = p.id
WHERE p.canonical = 'Brand#4' ORDER BY updated_at DESC, company_id, position_id, period LIMIT 7""")
def _(t):
    return aggregate.list_summaries(summaries(t), t.companies, t.positions, position="Brand#4", limit=7).select("company_id", "company", "position_id", "position", "sample_count", "updated_at")


@query("r60_get_summary", f"SELECT company_id, position_id, period, content_md, CAST(length(content_md) AS INT) AS content_length FROM ({SUMMARIES_SQL}) s WHERE company_id = 3 AND position_id = 5")
def _(t):
    return aggregate.get_summary(summaries(t), 3, 5).select("company_id", "position_id", "period", "content_md", "content_length")


@query("r61_cosine", f"SELECT a.vec_id, round({DOT}, 6) AS similarity FROM {{embeddings}} a JOIN {{embeddings}} b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM {{embeddings}})")
def _(t):
    e, n = t.embeddings, t.embeddings.count()
    other = e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("b"))
    return e.join(other, (F.col("vec_id") * 7 + 1) % n == F.col("o")).select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("r62_search", f"""
SELECT id, post_id, content, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank FROM (SELECT q.id, q.post_id, q.content, {DOT} AS s
FROM {{questions}} q JOIN {{embeddings}} a ON q.vec_id = a.vec_id CROSS JOIN (SELECT * FROM {{embeddings}} WHERE vec_id = 3) b
WHERE q.post_id IN (SELECT post_id FROM {{links}} WHERE company_id = 3) AND q.post_id IN (SELECT id FROM {{posts}} WHERE quality_score >= 40)) x ORDER BY s DESC, id LIMIT 20""")
def _(t):
    vector = t.embeddings.filter("vec_id = 3").first()["embedding"]
    return search.search(t.questions.join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left"), t.posts, t.links, vector, company_id=3, min_score=40)


@query("r63_search_many", f"""
SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DOT} DESC, a.vec_id) AS rank
FROM {{embeddings}} a, {{embeddings}} b WHERE b.vec_id % 100 = 0) x WHERE rank <= 10""")
def _(t):
    return search.search_many(t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 10)


@query("r63_search_every_row", f"""
SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, {DOT} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DOT} DESC, a.vec_id) AS rank
FROM {{embeddings}} a, {{embeddings}} b) x WHERE rank <= 5""")
def _(t):
    return search.search_many(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 5)


WITHOUT_SQL = "SELECT id, content FROM {questions} WHERE vec_id IS NULL"


@query("r64_backfill", f"""
SELECT q.id, string_agg(CAST(CAST(coalesce(v, 0) * 4294967296 AS BIGINT) AS VARCHAR), ',' ORDER BY slots.slot) AS vector
FROM ({WITHOUT_SQL}) q CROSS JOIN (SELECT unnest(range(64)) AS slot) slots LEFT JOIN {encoded_sql(WITHOUT_SQL, "id", "content")} e ON e.id = q.id AND e.slot = slots.slot GROUP BY q.id""")
def _(t):
    """The whole vectors; a component is a multiple of 2^-32 in 32-bit floats, so it is told exactly."""
    q = search.join_vectors(t.questions, t.embeddings).select("id", "content", "embedding")
    parts = F.transform("embedding", lambda x: (x.cast("double") * 2**32).cast("long").cast("string"))
    return search.backfill(q).select("id", F.array_join(parts, ",").alias("vector"))


@query("r65_coverage", "SELECT count(vec_id) AS embedded, count(*) AS total, CAST(0 AS BIGINT) AS cleared FROM {questions}")
def _(t):
    q = t.questions.withColumn("embedding", F.when(F.col("vec_id").isNotNull(), F.array(F.lit(1.0))))
    return search.coverage(q).crossJoin(search.coverage(search.clear_vectors(q)).select(F.col("embedded").alias("cleared")))


def counted_sql(names: str, key: str, extra: str) -> str:
    return f"SELECT n.id, n.canonical, n.{extra}, count(DISTINCT l.post_id) AS post_count FROM {{{names}}} n LEFT JOIN {{links}} l ON l.{key} = n.id GROUP BY 1, 2, 3 ORDER BY post_count DESC, canonical LIMIT 10 OFFSET 2"


@query("r66_list_companies", counted_sql("companies", "company_id", "industry"))
def _(t):
    return catalog.list_companies(t.companies, t.links, limit=10, offset=2)


@query("r66_list_companies_plain", "SELECT id, canonical, industry FROM {companies} ORDER BY canonical LIMIT 10 OFFSET 2")
def _(t):
    return catalog.list_companies(t.companies, t.links, with_counts=False, limit=10, offset=2)


@query("r67_list_positions", counted_sql("positions", "position_id", "category"))
def _(t):
    return catalog.list_positions(t.positions, t.links, limit=10, offset=2)


@query("r68_company_positions", f"SELECT position, post_count, avg_quality FROM ({STATS_SQL}) s WHERE company_id = 3")
def _(t):
    return catalog.company_positions(stats(t), t.companies, 3)[1].select("position", "post_count", "avg_quality")


def feed_sql(where: str, limit: str) -> str:
    return f"""SELECT p.id AS post_id, p.posted_at, count(DISTINCT q.id) AS question_count, array_to_string(list_sort(list(DISTINCT c.canonical)), ',') AS companies, array_to_string(list_sort(list(DISTINCT o.canonical)), ',') AS positions,
  array_to_string(list_sort(list(DISTINCT q.round_type)), ',') AS round_types FROM {{posts}} p JOIN {{questions}} q ON q.post_id = p.id JOIN {{links}} l ON l.post_id = p.id JOIN {{companies}} c ON l.company_id = c.id JOIN {{positions}} o ON l.position_id = o.id
WHERE p.extract_status = 'done' {where} GROUP BY 1, 2 ORDER BY posted_at DESC NULLS LAST, post_id DESC {limit}"""


def feed(t: Inputs, **filters) -> DataFrame:
    return catalog.feed(t.posts, t.links, t.questions, t.companies, t.positions, **filters)


@query("r69_feed", feed_sql("", "LIMIT 20 OFFSET 5"))
def _(t):
    out = feed(t, offset=5)
    return out.select("post_id", "posted_at", "question_count", *(F.array_join(c, ",").alias(c) for c in ("companies", "positions", "round_types")))


@query("r69_feed_of_company", feed_sql("AND c.canonical = 'NATION_3' AND q.category = 'F'", "LIMIT 20"))
def _(t):
    out = feed(t, company="NATION_3", category="F")
    return out.select("post_id", "posted_at", "question_count", *(F.array_join(c, ",").alias(c) for c in ("companies", "positions", "round_types")))


@query("r70_feed_details", f"""SELECT f.post_id, string_agg(q.content, '|' ORDER BY round_no NULLS LAST, id) AS contents, (list(q.content ORDER BY round_no NULLS LAST, id))[1] AS excerpt
FROM ({feed_sql("", "LIMIT 20")}) f JOIN {{questions}} q ON q.post_id = f.post_id GROUP BY f.post_id""")
def _(t):
    return catalog.feed_details(feed(t), t.questions, t.posts).select("post_id", F.array_join("questions.content", "|").alias("contents"), "excerpt")


@query("r71_post_brief", """SELECT post_id, array_to_string(list_sort(list(DISTINCT c.canonical)), ',') AS companies, array_to_string(list_sort(list(DISTINCT p.canonical)), ',') AS positions
FROM {links} JOIN {companies} c ON company_id = c.id JOIN {positions} p ON position_id = p.id GROUP BY post_id""")
def _(t):
    return catalog.post_brief(t.links, t.companies, t.positions).select("post_id", F.array_join("companies", ",").alias("companies"), F.array_join("positions", ",").alias("positions"))


@query("r72_bucket_questions", f"""SELECT DISTINCT q.id, q.content, q.category, coalesce(p.quality_score, 0) AS quality_score FROM {{questions}} q JOIN {{posts}} p ON q.post_id = p.id JOIN {{links}} l ON l.post_id = p.id
WHERE p.extract_status = 'done' AND coalesce(p.quality_score, 0) >= 30 AND company_id = 3 AND position_id = 4""")
def _(t):
    return catalog.bucket_questions(t.posts, t.links, t.questions, 3, 4, "all").drop("post_id")


@query("r72_bucket_questions_of_period", f"""SELECT q.id, count(*) AS n FROM {{questions}} q JOIN {{posts}} p ON q.post_id = p.id JOIN {{links}} l ON l.post_id = p.id
WHERE p.extract_status = 'done' AND coalesce(p.quality_score, 0) >= 30 AND company_id = 3 AND position_id = 4 AND year(posted_at) = 1995 GROUP BY q.id""")
def _(t):
    quarters = [catalog.bucket_questions(t.posts, t.links, t.questions, 3, 4, f"1995Q{i}") for i in (1, 2, 3, 4)]
    out = quarters[0]
    for q in quarters[1:]:
        out = out.unionByName(q)
    return out.groupBy("id").agg(F.count("*").alias("n"))


@query("r73_questions_by_category", "SELECT coalesce(category, 'uncategorised') AS category, count(*) AS n FROM {questions} GROUP BY 1")
def _(t):
    return catalog.questions_by_category(t.questions)


@query("r74_post_links", "SELECT post_id, c.canonical AS company, p.canonical AS position FROM (SELECT * FROM {links} ORDER BY post_id DESC, company_id, position_id LIMIT 20) l JOIN {companies} c ON company_id = c.id JOIN {positions} p ON position_id = p.id")
def _(t):
    return catalog.post_links(t.links, t.companies, t.positions)


@query("r75_corpus_totals", f"""SELECT (SELECT count(*) FROM {{posts}} WHERE extract_status = 'done') AS done_posts, (SELECT count(*) FROM {{questions}}) AS questions, (SELECT count(vec_id) FROM {{questions}}) AS embedded,
  (SELECT count(*) FROM {{companies}}) AS companies, (SELECT count(*) FROM {{positions}}) AS positions, (SELECT count(*) FROM ({SUMMARIES_SQL}) s) AS summaries""")
def _(t):
    return catalog.corpus_totals(t.posts, t.questions, t.companies, t.positions, summaries(t), vector="vec_id")


@query("r76_status_counts", "SELECT extract_status, count(*) AS n FROM {posts} GROUP BY extract_status")
def _(t):
    return catalog.status_counts(t.posts)


@query("r76_latest_failures", "SELECT id, source_url, extract_error FROM {posts} WHERE extract_status = 'failed' ORDER BY fetched_at DESC, id DESC LIMIT 20")
def _(t):
    return catalog.latest_failures(t.posts)


TARGETS_SQL = "SELECT q.id FROM {questions} q JOIN {posts} p ON q.post_id = p.id WHERE extract_status = 'done' AND coalesce(quality_score, 0) >= 30 AND (answer_ai IS NULL OR answer_ai_version < 2)"


@query("r77_answer_targets", TARGETS_SQL + " AND q.post_id IN (SELECT post_id FROM {links} WHERE company_id = 3) ORDER BY q.id LIMIT 200")
def _(t):
    return answers.answer_targets(t.questions, t.posts, t.links, 2, company_id=3, limit=200).select("id")


def given(t: Inputs) -> DataFrame:
    return t.questions.filter("id % 10 = 3").select("id", F.when(F.col("id") % 20 == 3, F.concat(F.lit("fresh "), "id")).alias("answer"))


@query("r78_apply_answers", "SELECT id, CASE WHEN id % 20 = 3 THEN concat('fresh ', id) ELSE answer_ai END AS answer_ai, CAST(CASE WHEN id % 20 = 3 THEN 5 ELSE answer_ai_version END AS INT) AS answer_ai_version FROM {questions}")
def _(t):
    return answers.apply_answers(t.questions, given(t), 5)[0].select("id", "answer_ai", "answer_ai_version")


@query("r78_answer_counts", "SELECT count(*) FILTER (WHERE id % 20 = 3) AS generated, count(*) FILTER (WHERE id % 20 <> 3) AS failed FROM {questions} WHERE id % 10 = 3")
def _(t):
    return answers.apply_answers(t.questions, given(t), 5)[1]


@query("r79_importance", "SELECT doc_id, CASE WHEN length(text) > 200 THEN 5 WHEN length(text) > 80 THEN 4 ELSE 3 END AS importance FROM {documents}")
def _(t):
    return t.documents.select("doc_id", importance(F.col("text")).alias("importance"))


@query("r80_answer_cards", """WITH i AS (SELECT DISTINCT CAST(event_id * 3 AS BIGINT) AS id FROM {events})
SELECT i.id, content, answer_ai AS answer, CASE WHEN content IS NULL THEN 'question not found' WHEN answer_ai IS NULL THEN 'no answer yet' END AS error FROM i LEFT JOIN {questions} q ON i.id = q.id""")
def _(t):
    return answers.answer_cards(t.events.select((F.col("event_id") * 3).alias("id")).distinct(), t.questions).select("id", "content", "answer", "error")


@query("r81_usage_summary", """SELECT count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses, count(*) AS total, round(count(*) FILTER (WHERE cache_hit) / count(*), 6) AS hit_rate,
  CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(tokens_in) / 1e6 * 1.0 + sum(tokens_out) / 1e6 * 2.0, 6) AS cost FROM {telemetry}""")
def _(t):
    return telemetry.usage_summary(t.telemetry)


@query("r82_stage_latency", "SELECT stage, count(*) AS runs, round(avg(ms), 4) AS avg_ms FROM {telemetry} GROUP BY stage")
def _(t):
    return telemetry.stage_latency(t.telemetry)


@query("r83_upper_median", "SELECT stage, (list(ms ORDER BY ms))[count(*) // 2 + 1] AS p50, count(*) AS n FROM {telemetry} GROUP BY stage")
def _(t):
    return telemetry.upper_median(t.telemetry, "stage", "ms")


@query("r83_upper_median_of_all", "SELECT 'all' AS stage, (list(ms ORDER BY ms))[count(*) // 2 + 1] AS p50, count(*) AS n FROM {telemetry}")
def _(t):
    return telemetry.upper_median(t.telemetry.select(F.lit("all").alias("stage"), "ms"), "stage", "ms")


@query("r84_throughput", "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM {telemetry} WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def _(t):
    return telemetry.throughput(t.telemetry, "2024-01-15 12:00:00")


def dead(t: Inputs) -> DataFrame:
    rows = t.posts.filter("extract_status = 'failed'").select(F.when(F.col("id") % 2 == 0, "extract").otherwise("answer").alias("task"), F.col("id").alias("seq"), "source_url", F.col("extract_error").alias("error"), (F.col("id") % 4).alias("attempt"))
    return telemetry.to_quarantine(rows, 2)


DEAD_SQL = "SELECT CASE WHEN id % 2 = 0 THEN 'extract' ELSE 'answer' END AS task, id AS seq, '{\"source_url\":\"' || source_url || '\"}' AS payload, extract_error AS error FROM {posts} WHERE extract_status = 'failed' AND id % 4 >= 2"


@query("r85_to_quarantine", DEAD_SQL)
def _(t):
    return dead(t)


@query("r85_drain", f"SELECT task, seq, nr <= 10 AS taken FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS nr FROM ({DEAD_SQL}) d) x")
def _(t):
    first, rest = telemetry.drain(dead(t), 10)
    return first.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False))).select("task", "seq", "taken")


@query("r85_list_dead", f"SELECT task, seq, payload, error, CAST(nr AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY seq) AS nr FROM ({DEAD_SQL}) d) x WHERE nr <= 25")
def _(t):
    return telemetry.list_dead(dead(t), 25)


@query("r85_dead_counts", f"SELECT task, count(*) AS n FROM ({DEAD_SQL}) d GROUP BY task")
def _(t):
    return telemetry.dead_counts(dead(t))


#: Records arrive in five slices by their number, then those of the first slice again.
SLICES = 5
SLICE_SQL = "CAST(floor(pos * 5 / (SELECT max(pos) + 1 FROM {records})) AS BIGINT)"


@query("r86_ingest_stream", f"""
SELECT detail_url, content_id, title, created_at_ms FROM (SELECT *, row_number() OVER (PARTITION BY detail_url ORDER BY slice, created_at_ms, content_id, title) AS nr
FROM ({FLAT_SQL.replace("FROM {records}", f", {SLICE_SQL} AS slice FROM {{records}}")}) f WHERE length(title) > 0) x WHERE nr = 1""")
def _(t):
    path, out = work_folder(t.spark, "arrivals"), work_folder(t.spark, "posts")
    rows = stored(nested(t), "records")
    top = rows.agg(F.max("pos")).first()[0] or 0
    for i in [*range(SLICES), 0]:  # each is a trigger of four files
        part = rows.filter(F.floor(F.col("pos") * SLICES / (top + 1)) == i).drop("pos")
        part.repartition(4).write.mode("append").json(path)
    jobs.ingest_stream(t.spark, path, out, work_folder(t.spark, "offsets"), "https://example.com", "joblist", files_per_batch=4, buckets=16).awaitTermination()
    return jobs.stored_posts(t.spark, out).select("detail_url", "content_id", "title", "created_at_ms")


@query("r84_throughput_stream", """
SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM {telemetry} GROUP BY 1
HAVING date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM {telemetry})""")
def _(t):
    """Events arrive in four files; every third is up to nine minutes late, less than the watermark allows."""
    events = stored(t.telemetry.select("ts", (F.unix_micros("ts") + F.when(F.col("event_id") % 3 == 0, 540_000_000).otherwise(0)).alias("at")), "events")
    path = work_folder(t.spark, "arrivals")
    low, high = events.agg(F.min("at"), F.max("at")).first()
    for i in range(4):
        part = events.filter((F.col("at") >= low + (high - low + 1) * i // 4) & (F.col("at") < low + (high - low + 1) * (i + 1) // 4))
        part.select("ts").coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.appended(jobs.throughput_stream(stream), work_folder(t.spark, "minutes"), work_folder(t.spark, "state"))


@query("r87_counters_stream", "SELECT stage, count(*) AS runs, CAST(sum(CAST(round(ms * 100) AS BIGINT)) AS BIGINT) AS total_hundredths FROM {telemetry} GROUP BY stage")
def _(t):
    path = work_folder(t.spark, "events")
    events = t.telemetry
    events.select("ts", "stage", "ms").write.parquet(path)
    stream = t.spark.readStream.schema("ts timestamp, stage string, ms double").parquet(path)
    return jobs.final_state(jobs.counters_stream(stream), work_folder(t.spark, "counters"), work_folder(t.spark, "state"))


@query("r87_counters_by_status", "SELECT stage, CASE WHEN cache_hit THEN 'cached' ELSE 'called' END AS status, count(*) AS runs, CAST(sum(CAST(round(ms * 100) AS BIGINT)) AS BIGINT) AS total_hundredths FROM {telemetry} GROUP BY ALL")
def _(t):
    path = work_folder(t.spark, "events")
    t.telemetry.select("ts", "stage", F.when(F.col("cache_hit"), "cached").otherwise("called").alias("status"), "ms").repartition(4).write.parquet(path)
    stream = t.spark.readStream.schema("ts timestamp, stage string, status string, ms double").option("maxFilesPerTrigger", 1).parquet(path)
    return jobs.final_state(jobs.counters_stream(stream, ("stage", "status")), work_folder(t.spark, "statuses"), work_folder(t.spark, "state"))


@query("r88_daily_update", f"""
SELECT 'imported' AS step, (SELECT count(DISTINCT detail_url) FROM ({BATCH_SQL}) b WHERE detail_url NOT IN (SELECT source_url FROM {{posts}})) AS n
UNION ALL SELECT 'to_process', (SELECT count(*) FROM {{posts}} WHERE extract_status IN ('pending', 'failed')) + (SELECT count(DISTINCT detail_url) FROM ({BATCH_SQL}) b WHERE detail_url NOT IN (SELECT source_url FROM {{posts}}))
UNION ALL SELECT 'buckets', (SELECT count(DISTINCT (company_id, position_id)) FROM ({CANDIDATES_SQL}) c)
UNION ALL SELECT 'answer_targets', (SELECT count(*) FROM ({TARGETS_SQL}) x)""")
def _(t):
    return jobs.daily_update(t.posts, t.links, t.questions, batch(t), 2, vector="vec_id")


#: Posts after the run's processing: every second waiting one is done.
PROCESSED_SQL = """(SELECT id, posted_at, CASE WHEN extract_status IN ('pending', 'failed') AND id % 2 = 0 THEN 'done' ELSE extract_status END AS extract_status,
  CASE WHEN extract_status IN ('pending', 'failed') AND id % 2 = 0 THEN 50 ELSE quality_score END AS quality_score FROM {posts})"""
BUCKETS_SQL = f"SELECT company_id, position_id, count(*) AS n FROM ({CANDIDATES_SQL}) c GROUP BY company_id, position_id"
BUCKETS_AFTER_SQL = BUCKETS_SQL.replace("{posts}", PROCESSED_SQL)


@query("r88_daily_chain", f"""
SELECT 'to_process' AS step, (SELECT count(*) FROM {{posts}} WHERE extract_status IN ('pending', 'failed')) + (SELECT count(DISTINCT detail_url) FROM ({BATCH_SQL}) b WHERE detail_url NOT IN (SELECT source_url FROM {{posts}})) AS n
UNION ALL SELECT 'imported', (SELECT count(DISTINCT detail_url) FROM ({BATCH_SQL}) b WHERE detail_url NOT IN (SELECT source_url FROM {{posts}}))
UNION ALL SELECT 'buckets', (SELECT count(*) FROM ({BUCKETS_AFTER_SQL}) a)
UNION ALL SELECT 'changed_buckets', (SELECT count(*) FROM ({BUCKETS_AFTER_SQL}) a LEFT JOIN ({BUCKETS_SQL}) o ON a.company_id = o.company_id AND a.position_id = o.position_id WHERE o.n IS NULL OR o.n <> a.n)
UNION ALL SELECT 'answer_targets', (SELECT count(*) FROM ({TARGETS_SQL.replace("{posts}", PROCESSED_SQL)}) x)""")
def _(t):
    outcomes = t.posts.filter("extract_status IN ('pending', 'failed') AND id % 2 = 0").select(F.col("id").alias("post_id"), F.lit("done").alias("outcome"), F.lit(50).alias("quality_score"))
    before = candidates(t).groupBy(*aggregate.BUCKET).agg(F.count("*").alias("candidate_count"))
    return jobs.daily_update(t.posts, t.links, t.questions, batch(t), 2, vector="vec_id", outcomes=outcomes, summaries=before)


#: Buckets of companies and positions that a processed post has; even companies have a stored summary of the state before.
DAILY_SQL = f"""
WITH a AS (SELECT company_id, position_id, period, count(*) AS n, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS ids FROM ({CANDIDATES_SQL.replace("{posts}", PROCESSED_SQL)}) x GROUP BY ALL),
b AS (SELECT company_id, position_id, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS old FROM ({CANDIDATES_SQL}) y GROUP BY ALL),
k AS (SELECT company_id, position_id, count(*) AS samples FROM ({CLUSTERS_SQL.replace("{posts}", PROCESSED_SQL)}) z GROUP BY ALL),
d AS (SELECT a.*, samples FROM a JOIN k USING (company_id, position_id) LEFT JOIN b USING (company_id, position_id)
  WHERE (company_id, position_id) IN (SELECT (company_id, position_id) FROM {{links}} WHERE post_id IN (SELECT id FROM {{posts}} WHERE extract_status IN ('pending', 'failed') AND id % 2 = 0))
  AND (company_id % 2 <> 0 OR old IS NULL OR old <> ids))
"""


def daily(t: Inputs) -> dict[str, DataFrame]:
    # derived tables that the run reads many times
    questions = stored(t.questions.select("id", "post_id", "vec_id", "category", "content", "answer_ai", "answer_ai_version"), "questions")
    links = stored(t.links, "links")
    outcomes = t.posts.filter("extract_status IN ('pending', 'failed') AND id % 2 = 0").select(F.col("id").alias("post_id"), F.lit("done").alias("outcome"), F.lit(50).alias("quality_score"))
    vectors = questions.filter("vec_id is not null").select(F.col("id").alias("question_id"), "vec_id").join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("question_id", "embedding")
    before = aggregate.fingerprints(aggregate.bucket_candidates(t.posts, links.filter("company_id % 2 = 0"), questions, vector="vec_id"), questions)
    old = before.select(*aggregate.BUCKET, F.lit("old").alias("content_md"), F.lit(1).alias("sample_count"), F.col("candidate_count").cast("int").alias("candidate_count"), F.lit(NOW).cast("timestamp").alias("updated_at"), "fingerprint")
    return jobs.daily_run(t.posts, links, questions, vectors, old, batch(t), outcomes, 2, NOW)


@query("r88_daily_summaries", DAILY_SQL + "SELECT company_id, position_id, period, CAST(n AS INT) AS candidate_count, CAST(samples AS INT) AS sample_count FROM d")
def _(t):
    run = daily(t)
    return run["summaries"].join(run["changed"].select(*aggregate.BUCKET), aggregate.BUCKET, "left_semi").filter("content_md <> 'old'").select(*aggregate.BUCKET, "candidate_count", "sample_count")


@query("r88_daily_counts", DAILY_SQL + f"""
SELECT 'changed_buckets' AS step, count(*) AS n FROM d UNION ALL SELECT 'imported', (SELECT count(DISTINCT detail_url) FROM ({BATCH_SQL}) b WHERE detail_url NOT IN (SELECT source_url FROM {{posts}}))
UNION ALL SELECT 'answer_targets', (SELECT count(*) FROM ({TARGETS_SQL.replace("{posts}", PROCESSED_SQL)}) x)""")
def _(t):
    return daily(t)["counts"].filter("step IN ('changed_buckets', 'imported', 'answer_targets')")
