"""Queries on sources and ingest (rows 1-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.functions.times import local_minute, parse_local
from quizmill.operators import ingest
from quizmill.plans.registry import Inputs, query
from quizmill.session import work_folder
from quizmill.sources import files
from quizmill.sources.adapters import NOW

BASE = "https://example.com"


def nested(t: Inputs) -> DataFrame:
    """The records as the site's interface nests them."""
    s = F.lit(None).cast("string")
    return t.records.select(
        F.col("content_type").cast("int").alias("contentType"), F.col("content_id").alias("contentId"),
        F.struct(F.col("moment_id").alias("id"), "uuid", "title", F.col("new_title").alias("newTitle"), "content", F.col("created_ms").alias("createdAt"), s.alias("ip4Location")).alias("momentData"),
        F.struct(F.col("author").alias("nickname"), s.alias("educationInfo"), s.alias("secondMajorName"), s.alias("authDisplayInfo")).alias("userBrief"),
        F.struct(F.col("views").alias("viewCnt"), F.lit(None).cast("long").alias("likeCnt"), F.col("total_comments").alias("totalCommentCnt"), F.col("comments").alias("commentCnt")).alias("frequencyData"),
        F.struct(s.alias("contentID_var")).alias("extraInfo"), "pos",
    )


FLAT_SQL = """SELECT CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE new_title END AS title,
  coalesce(trim(content), '') AS content,
  CASE WHEN content_type = 74 AND uuid IS NOT NULL THEN 'https://example.com/feed/main/detail/' || uuid
       ELSE 'https://example.com/discuss/' || coalesce(content_id, moment_id) END AS detail_url,
  CASE WHEN created_ms = 0 THEN '' ELSE strftime(make_timestamp(created_ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END AS created_at,
  CAST(created_ms AS BIGINT) AS created_at_ms, author, '' AS school, '' AS major, '' AS auth_display, '' AS ip_location, views AS view_count,
  CAST(0 AS BIGINT) AS like_count, CASE WHEN coalesce(total_comments, 0) <> 0 THEN total_comments ELSE comments END AS comment_count,
  CAST(content_type AS INT) AS content_type, coalesce(content_id, moment_id) AS content_id, coalesce(uuid, '') AS uuid FROM {records}"""


@query("r1_read_crawl_jsonl", "SELECT source AS title, text AS content, CAST(doc_id AS VARCHAR) AS content_id FROM {documents}")
def _(t):
    lines = t.documents.select(F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content"), F.col("doc_id").cast("string").alias("content_id"))).alias("value"))
    edges = t.spark.range(3).select(F.element_at(F.array(F.lit('{"crawled_at": "2024-01-01", "api_endpoint": "x"}'), F.lit(""), F.lit('{"total": 1, "finished_at": "2024-01-02"}')), F.col("id").cast("int") + 1).alias("value"))
    path = work_folder(t.spark, "crawl")
    lines.union(edges).write.text(path)
    return files.read_crawl_jsonl(t.spark, path).select("title", "content", "content_id")


@query("r2_flatten_records", FLAT_SQL)
def _(t):
    return files.flatten_records(nested(t), BASE, "joblist")


@query("r3_detail_url", f"SELECT content_id, detail_url, count(*) AS n FROM ({FLAT_SQL}) f GROUP BY content_id, detail_url")
def _(t):
    return files.flatten_records(nested(t), BASE, "joblist").groupBy("content_id", "detail_url").agg(F.count("*").alias("n"))


@query("r4_write_posts_jsonl", f"SELECT title, content_id, view_count, comment_count FROM ({FLAT_SQL}) f")
def _(t):
    flat, path = files.flatten_records(nested(t), BASE, "joblist"), work_folder(t.spark, "posts")
    files.write_posts_jsonl(flat.filter("content_type = 74"), path)
    files.write_posts_jsonl(flat.filter("content_type <> 74"), path)
    return files.read_crawl_jsonl(t.spark, path).select("title", "content_id", "view_count", "comment_count")


@query("r5_export_posts", """
SELECT p.id AS post_id, (SELECT count(DISTINCT company_id) FROM {links} l WHERE l.post_id = p.id) AS n_companies,
  (SELECT count(DISTINCT position_id) FROM {links} l WHERE l.post_id = p.id) AS n_positions,
  (SELECT count(*) FROM {questions} q WHERE q.post_id = p.id) AS question_count,
  (SELECT string_agg(content, '|' ORDER BY round_no NULLS LAST, id) FROM {questions} q WHERE q.post_id = p.id) AS contents
FROM {posts} p WHERE extract_status = 'done'""")
def _(t):
    out = files.export_posts(t.posts, t.links, t.companies, t.positions, t.questions)
    contents = F.when(F.size("questions") > 0, F.array_join("questions.content", "|"))
    return out.select("post_id", F.size("companies").cast("long").alias("n_companies"), F.size("positions").cast("long").alias("n_positions"), "question_count", contents.alias("contents"))


def canonicals(t: Inputs) -> DataFrame:
    c = t.companies.select(F.lit("company").alias("entity_type"), "id", "canonical")
    return c.unionByName(t.positions.select(F.lit("position").alias("entity_type"), "id", "canonical"))


CANONICALS_SQL = "SELECT 'company' AS entity_type, id, canonical FROM {companies} UNION ALL SELECT 'position', id, canonical FROM {positions}"


@query("r6_seed_aliases", """
WITH known AS (%s), seed AS (SELECT DISTINCT 'company' AS entity_type, s_name AS canonical, concat('the ', s_name) AS alias FROM {supplier}
  UNION SELECT 'company', n_name, concat('the ', n_name) FROM {nation}),
fresh AS (SELECT entity_type, canonical, (SELECT max(id) FROM known WHERE entity_type = 'company') + row_number() OVER (ORDER BY canonical) AS id
  FROM (SELECT DISTINCT entity_type, canonical FROM seed) s WHERE canonical NOT IN (SELECT canonical FROM known WHERE entity_type = 'company')),
every AS (SELECT entity_type, canonical, id FROM known UNION ALL SELECT entity_type, canonical, id FROM fresh),
names AS (SELECT entity_type, canonical, canonical AS alias FROM seed UNION SELECT entity_type, canonical, alias FROM seed)
SELECT entity_type, alias, canonical_id, CAST(confidence AS DOUBLE) AS confidence FROM {alias_dict}
UNION ALL SELECT n.entity_type, n.alias, e.id, 1.0 FROM names n JOIN every e USING (entity_type, canonical)
WHERE NOT EXISTS (SELECT 1 FROM {alias_dict} a WHERE a.entity_type = n.entity_type AND a.alias = n.alias)""" % CANONICALS_SQL)
def _(t):
    names = t.supplier.select(F.col("s_name").alias("canonical")).union(t.nation.select("n_name")).distinct()
    seed = names.select(F.lit("company").alias("entity_type"), "canonical", F.array(F.concat(F.lit("the "), "canonical")).alias("aliases"))
    return files.seed_aliases(seed, canonicals(t), t.alias_dict)[1].withColumn("confidence", F.col("confidence").cast("double"))


@query("r7_tables_round_trip", "SELECT extract_status, count(*) AS n, count(quality_score) AS scored, CAST(sum(quality_score) AS BIGINT) AS total FROM {posts} GROUP BY extract_status")
def _(t):
    from quizmill.sources.schemas import TABLES
    from quizmill.sources.tables import write_table

    folder = work_folder(t.spark, "tables")
    write_table(t.posts, folder, "posts")
    back = t.spark.read.schema(TABLES["posts"]).parquet(f"{folder}/posts")
    return back.groupBy("extract_status").agg(F.count("*").alias("n"), F.count("quality_score").alias("scored"), F.sum("quality_score").alias("total"))


#: The columns that the domain tables have, by table: numbers and times, then texts.
ROUND_TRIP = {
    "companies": (["id"], ["canonical", "industry"]), "positions": (["id"], ["canonical", "category"]),
    "posts": (["id", "posted_at", "fetched_at", "quality_score", "extract_version"], ["source_url", "title", "raw_html", "cleaned_text", "extract_status", "extract_error"]),
    "links": (["post_id", "company_id", "position_id"], []),
    "questions": (["id", "post_id", "round_no", "answer_ai_version"], ["round_type", "content", "category", "answer_brief", "answer_ai"]),
    "alias_dict": (["canonical_id", "confidence"], ["entity_type", "alias"]),
}


def round_trip_sql(name: str) -> str:
    numbers, texts = ROUND_TRIP[name]
    filled = " + ".join(f"count({c})" for c in numbers + texts)
    chars = " + ".join(f"coalesce(sum(length({c})), 0)" for c in texts) or "0"
    return f"SELECT '{name}' AS name, count(*) AS n, CAST(sum({numbers[0]}) AS BIGINT) AS total, CAST({filled} AS BIGINT) AS filled, CAST({chars} AS BIGINT) AS chars FROM {{{name}}}"


@query("r7_all_tables_round_trip", " UNION ALL ".join(map(round_trip_sql, ROUND_TRIP))
  + " UNION ALL SELECT 'summaries', count(*), CAST(sum(doc_id) AS BIGINT), CAST(count(doc_id) * 2 + count(*) * 2 + count(source) AS BIGINT), CAST(sum(length(source)) + 3 * count(*) AS BIGINT) FROM {documents}")
def _(t):
    """All seven tables written and read back, with the values that each holds and the length of its texts; summaries are one
    of each document, as the domain has none of its own."""
    from quizmill.sources.tables import read_tables, write_table

    folder = work_folder(t.spark, "tables")
    summaries = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("company_id"), F.lit(0).cast("long").alias("position_id"), F.lit("all").alias("period"), F.col("source").alias("content_md"))
    for name in (*ROUND_TRIP, "summaries"):
        write_table(summaries if name == "summaries" else getattr(t, name), folder, name)
    out = None
    for name, rows in read_tables(t.spark, folder).items():
        key = ROUND_TRIP[name][0][0] if name in ROUND_TRIP else "id"
        filled = sum((F.count(c) for c in rows.columns), F.lit(0))
        chars = sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, kind in rows.dtypes if kind == "string"), F.lit(0))
        one = rows.agg(F.count("*").alias("n"), F.sum(key).alias("total"), filled.cast("long").alias("filled"), chars.cast("long").alias("chars")).select(F.lit(name).alias("name"), "n", "total", "filled", "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("r8_dedup_records", "SELECT content_id, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY page, pos) AS r FROM {records}) x WHERE r = 1")
def _(t):
    return ingest.dedup_records(t.records, ["content_id"], ["page", "pos"]).select("content_id", "page", "pos")


@query("r9_only_new", f"SELECT content_id, detail_url FROM ({FLAT_SQL}) f WHERE detail_url NOT IN (SELECT source_url FROM {{posts}})")
def _(t):
    return ingest.only_new(files.flatten_records(nested(t), BASE, "joblist"), t.posts).select("content_id", "detail_url")


@query("r10_catch_up", """
WITH r AS (SELECT page, pos, content_id, row_number() OVER (PARTITION BY content_id ORDER BY page, pos) = 1 AND content_id IS NOT NULL AS is_new FROM {records} WHERE content_id IS NOT NULL),
p AS (SELECT page, count(*) FILTER (WHERE is_new) AS n FROM r GROUP BY page),
w AS (SELECT page, n = 0 AND lag(n, 1, 1) OVER (ORDER BY page) = 0 AS ends, lead(page) OVER (ORDER BY page) > page + 1 AS gap FROM p)
SELECT page, pos, content_id, is_new FROM r WHERE page <= coalesce((SELECT min(page) FROM w WHERE ends OR gap), 1000000000)""")
def _(t):
    rows = t.records.filter("content_id IS NOT NULL").select("page", "pos", "content_id")
    return ingest.catch_up(rows).select("page", "pos", "content_id", "is_new")


@query("r11_filter_usable", """
SELECT moment_id, content_id FROM {records} WHERE content_id IS NOT NULL AND length(trim(coalesce(content, ''))) > 0 AND length(trim(title)) > 0
AND (created_ms = 0 OR make_timestamp(created_ms * 1000) BETWEEN TIMESTAMP '2023-11-14 22:20:00' AND TIMESTAMP '2023-11-15 06:00:00')""")
def _(t):
    rows = t.records.withColumn("created", F.when(F.col("created_ms") != 0, F.timestamp_millis("created_ms")))
    return ingest.filter_usable(rows, "2023-11-14 22:20:00", "2023-11-15 06:00:00").select("moment_id", "content_id")


@query("r12_local_time", """
SELECT doc_id, strftime(make_timestamp(ms * 1000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown, epoch(date_trunc('minute', make_timestamp(ms * 1000)))::BIGINT AS parsed
FROM (SELECT doc_id, 1700000000000 + doc_id * 61000 AS ms FROM {documents}) d""")
def _(t):
    rows = t.documents.select("doc_id", local_minute(F.lit(1700000000000) + F.col("doc_id") * 61000).alias("shown"))
    return rows.withColumn("parsed", F.unix_timestamp(parse_local(F.col("shown"))))


BATCH_SQL = """SELECT concat('https://example.com/discuss/', doc_id * 31) AS detail_url, source AS title, text AS content, '' AS created_at, doc_id AS line FROM {documents} WHERE doc_id % 3 > 0
UNION ALL SELECT concat('https://example.com/discuss/', doc_id), lang, '', '', doc_id + 1000000000 FROM {documents}"""


def batch(t: Inputs) -> DataFrame:
    return t.spark.sql(BATCH_SQL, documents=t.documents)


IMPORT_SQL = f"""
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detail_url ORDER BY line) AS r FROM ({BATCH_SQL}) x) y WHERE r = 1),
j AS (SELECT p.*, b.detail_url, b.title AS b_title, b.content AS b_content, b.line FROM {{posts}} p FULL JOIN b ON p.source_url = b.detail_url),
n AS (SELECT *, (SELECT max(id) FROM {{posts}}) + row_number() OVER (PARTITION BY id IS NULL ORDER BY line) AS new_id FROM j)
"""


@query("r13_import_posts", IMPORT_SQL + """SELECT coalesce(id, new_id) AS id, coalesce(source_url, detail_url) AS source_url, CASE WHEN id IS NULL THEN b_title ELSE title END AS title, raw_html,
  CASE WHEN id IS NULL THEN b_content ELSE cleaned_text END AS cleaned_text, posted_at, fetched_at, CASE WHEN id IS NULL THEN 'pending' ELSE extract_status END AS extract_status, extract_error, quality_score,
  CASE WHEN id IS NULL THEN 0 ELSE extract_version END AS extract_version, CASE WHEN line IS NULL THEN NULL WHEN id IS NULL THEN 'new' ELSE 'skipped' END AS outcome FROM n""")
def _(t):
    return ingest.import_posts(batch(t), t.posts)[0]


@query("r13_import_forced", IMPORT_SQL + """SELECT coalesce(id, new_id) AS id, CASE WHEN line IS NOT NULL THEN b_content ELSE cleaned_text END AS cleaned_text, raw_html, quality_score,
  CASE WHEN line IS NOT NULL THEN 'pending' ELSE extract_status END AS extract_status, CASE WHEN line IS NULL THEN NULL WHEN id IS NULL THEN 'new' ELSE 'updated' END AS outcome FROM n""")
def _(t):
    return ingest.import_posts(batch(t), t.posts, force=True)[0].select("id", "cleaned_text", "raw_html", "quality_score", "extract_status", "outcome")


@query("r13_import_counts", IMPORT_SQL + "SELECT count(*) FILTER (WHERE id IS NULL) AS \"new\", CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE id IS NOT NULL AND line IS NOT NULL) AS updated FROM j")
def _(t):
    return ingest.import_posts(batch(t), t.posts, force=True)[1]


@query("r14_upsert_raw", f"""
WITH g AS (SELECT concat('https://example.com/discuss/', page_id * 97) AS page_url, html, CASE WHEN page_id % 2 = 0 THEN 'titled' END AS page_title FROM {{pages}}),
j AS (SELECT *, (SELECT max(id) FROM {{posts}}) + row_number() OVER (PARTITION BY id IS NULL ORDER BY page_url) AS new_id, page_url IS NOT NULL AS given,
  page_url IS NOT NULL AND coalesce(extract_status, '') <> 'done' AS again FROM {{posts}} p FULL JOIN g ON p.source_url = g.page_url)
SELECT coalesce(id, new_id) AS id, coalesce(source_url, page_url) AS source_url, coalesce(page_title, title) AS title, CASE WHEN given THEN html ELSE raw_html END AS raw_html, cleaned_text, posted_at,
  CASE WHEN given THEN TIMESTAMP '{NOW}' ELSE fetched_at END AS fetched_at, CASE WHEN again THEN 'pending' ELSE extract_status END AS extract_status,
  CASE WHEN again THEN NULL ELSE extract_error END AS extract_error, quality_score, CASE WHEN id IS NULL THEN 0 ELSE extract_version END AS extract_version FROM j""")
def _(t):
    g = t.pages.select(F.concat(F.lit("https://example.com/discuss/"), F.col("page_id") * 97).alias("source_url"), "html", F.when(F.col("page_id") % 2 == 0, "titled").alias("page_title"))
    return ingest.upsert_raw(g, t.posts, NOW)


@query("r15_discover_urls", r"""
WITH h AS (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '(https?://[^\s"''<>\\]+)', 1)))) AS raw FROM {pages}),
u AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(raw, '^https?://') THEN raw WHEN raw LIKE '//%' THEN 'https:' || raw WHEN raw LIKE '/%' THEN 'https://example.com' || raw ELSE 'https://example.com/' || raw END, '[?#].*$', '') AS url FROM h)
SELECT DISTINCT page_id, url FROM u WHERE regexp_matches(url, '^https://example\.com/[a-z]+$|^https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+$')""")
def _(t):
    return ingest.discover_urls(t.pages, BASE, [r"^https://example\.com/[a-z]+$", r"^https?://[a-z]+\.example\.com/[a-z]{2}/[0-9]+$"])


@query("r16_frontier", """
SELECT DISTINCT source_url AS url FROM {posts} WHERE source_url NOT IN (SELECT concat('https://example.com/discuss/', page_id) FROM {pages} WHERE NOT contains(html, 'clown'))""")
def _(t):
    fetched = ingest.drop_gone(t.pages, ["clown"]).select(F.concat(F.lit("https://example.com/discuss/"), "page_id").alias("url"))
    return ingest.frontier(t.posts.select(F.col("source_url").alias("url")), fetched)


WORDS = {3: ["threa", "heit"], 2: ["tion", "enque"], 1: ["and", "der"], -4: ["idiot", "%%%"]}


@query("r17_keyword_score", "SELECT doc_id, CAST(s AS BIGINT) AS score, s >= 4 AS keep FROM (SELECT doc_id, " + " + ".join(f"CASE WHEN contains(t, '{k}') THEN {w} ELSE 0 END" for w, ks in WORDS.items() for k in ks) + " AS s FROM (SELECT doc_id, source || ' ' || substring(text, 1, 500) AS t FROM {documents}) d) e")
def _(t):
    rows = t.documents.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    return ingest.keyword_score(rows, WORDS).select("doc_id", "score", "keep")


@query("r18_page_date", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-05-06 07:08:09' WHEN doc_id % 3 = 1 THEN make_timestamp(2020 + doc_id % 5, 1 + doc_id % 12, 1 + doc_id % 28, 0, 0, 0.0) END AS published FROM {documents}""")
def _(t):
    html = F.when(F.col("doc_id") % 3 == 0, '<html><meta name="pubdate" content="2024-05-06T07:08:09Z"></html>').otherwise("<html></html>")
    date = F.concat(F.lit("seen 2021-02-30 then "), (2020 + F.col("doc_id") % 5).cast("string"), F.lit("年"), (1 + F.col("doc_id") % 12).cast("string"), F.lit("月"), (1 + F.col("doc_id") % 28).cast("string"), F.lit("日 "))
    text = F.concat(F.when(F.col("doc_id") % 3 == 1, date).otherwise(""), F.regexp_replace("text", "[0-9]", "x"))
    return t.documents.select("doc_id", ingest.page_date(html, text).alias("published"))
