"""Domain tables derived from the given tables. The same SQL text serves Spark and the DuckDB oracles: names of given tables
and of other domain tables are in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quizmill.sources.tables import table

NOW = "2001-08-01 00:00:00"

ADAPTERS = {
    "companies": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS canonical, r_name AS industry FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "positions": "SELECT DISTINCT CAST(substring(p_brand, 7) AS BIGINT) AS id, p_brand AS canonical, concat('cat', CAST(substring(p_brand, 7) AS BIGINT) % 4) AS category FROM {part}",
    "posts": """SELECT o_orderkey AS id, concat('https://example.com/discuss/', o_orderkey) AS source_url, o_orderpriority AS title,
  concat('<p>', o_orderkey, '</p>') AS raw_html, concat('text of ', o_orderkey) AS cleaned_text,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS posted_at,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS fetched_at,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS extract_status,
  CASE WHEN o_orderstatus = 'P' THEN concat('error ', o_orderkey % 5) END AS extract_error,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) END AS quality_score,
  CAST(o_orderkey % 3 AS INT) AS extract_version FROM {orders}""",
    "links": """SELECT DISTINCT l_orderkey AS post_id, CAST(s_nationkey AS BIGINT) AS company_id, CAST(substring(p_brand, 7) AS BIGINT) AS position_id
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    "questions": """SELECT id, post_id, round_no, round_type, content, category, answer_brief, answer_ai_version,
  CASE WHEN answer_ai_version > 0 THEN concat('answer ', id) END AS answer_ai,
  CASE WHEN id % 7 = 0 THEN NULL ELSE id % (SELECT count(*) FROM {embeddings}) END AS vec_id
FROM (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id,
    l_orderkey AS post_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber % 4 AS INT) END AS round_no, l_returnflag AS round_type,
    concat(p_name, ' ', p_type) AS content, CASE WHEN l_quantity < 5 THEN NULL ELSE l_linestatus END AS category,
    CASE WHEN l_discount < 0.03 THEN NULL WHEN l_discount < 0.05 THEN '  ' ELSE p_brand END AS answer_brief,
    CAST(l_linenumber % 3 AS INT) AS answer_ai_version
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) q""",
    "alias_dict": """SELECT 'company' AS entity_type, n_name AS alias, CAST(n_nationkey AS BIGINT) AS canonical_id, 1.0 AS confidence FROM {nation}
UNION ALL SELECT 'company', lower(n_name), CAST(n_nationkey AS BIGINT), 0.9 FROM {nation} WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'position', p_brand, CAST(substring(p_brand, 7) AS BIGINT), 1.0 FROM (SELECT DISTINCT p_brand FROM {part}) b""",
    "mentions": """SELECT l_orderkey AS post_id, 'company' AS entity_type,
  CASE WHEN l_partkey % 5 = 0 THEN concat('  ', lower(n_name), ' ') WHEN l_partkey % 7 = 0 THEN concat('new ', n_name) WHEN l_partkey % 11 = 0 THEN ' ' ELSE n_name END AS alias
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT l_orderkey, 'position', CASE WHEN l_partkey % 9 = 0 THEN concat('x', p_brand) ELSE p_brand END FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "telemetry": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS stage, value AS ms, event_id % 5 = 0 AS cache_hit,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens_in, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 AS tokens_out, user_id FROM {events}""",
    "records": """SELECT CASE WHEN doc_id % 3 = 0 THEN 74 ELSE 250 END AS content_type, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id >= (SELECT 4 * max(doc_id) / 5 FROM {documents}) THEN '1'
    ELSE CAST(CAST(CASE WHEN doc_id % 4 = 0 THEN floor(doc_id / 8) ELSE doc_id END AS BIGINT) AS VARCHAR(20)) END AS content_id,
  CAST(doc_id AS VARCHAR(20)) AS moment_id, CASE WHEN doc_id % 2 = 0 THEN concat('u', doc_id) END AS uuid,
  CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE concat(' ', source, ' ') END AS title, concat('new ', lang) AS new_title,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS content, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1700000000000 + doc_id * 60000 END AS created_ms,
  lang AS author, n_chars AS views, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 50 END AS total_comments, doc_id % 9 AS comments,
  CAST(floor(doc_id / 20) AS BIGINT) AS page, doc_id AS pos FROM {documents}""",
}


def _uses(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", ADAPTERS[name])


def domain(spark: SparkSession, folder: str, name: str, instead: dict[str, DataFrame] | None = None) -> DataFrame:
    """The domain table ``name`` over the given tables in ``folder``, or those in ``instead`` in place of them."""
    found = instead or {}
    inputs = {n: found[n] if n in found else domain(spark, folder, n, found) if n in ADAPTERS else table(spark, folder, n) for n in set(_uses(name))}
    return spark.sql(ADAPTERS[name], **inputs)


def with_domain(sql: str) -> str:
    """``sql`` with a WITH clause for each domain table that it, or another one, names in braces."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _uses(name):
            if n in ADAPTERS:
                visit(n)
        if name not in order:
            order.append(name)

    for n in re.findall(r"\{(\w+)\}", sql):
        if n in ADAPTERS:
            visit(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    heads = ",\n".join(f"{n} AS ({plain(ADAPTERS[n])})" for n in order)
    body = plain(sql).strip()
    if not heads:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"
