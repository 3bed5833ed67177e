"""Queries on cleaning, extraction and entity resolution (rows 19-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.session import stored
from quizmill.operators import clean, extract, normalize
from quizmill.operators.search import hashed_grams
from quizmill.plans.ingest import CANONICALS_SQL, canonicals
from quizmill.plans.registry import Inputs, query

PATTERNS, TOKENS, MARKER = (r"^[0-9]+(\s+[0-9]+)*\s*$", r"^The and .*$"), ("Les.", "And ornd."), "erly|heit"

#: ASCII rules on the lines of documents; texts of these have no white space but spaces and line feeds.
NOISE_SQL = r"""
SELECT doc_id, lines, list_position([length(trim(x)) BETWEEN 4 AND 29 AND regexp_matches(trim(x), 'erly|heit') FOR x IN lines], true) AS cut FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents}) d"""
STRIPPED_SQL = rf"""
SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(CASE WHEN cut > 0 THEN lines[1:cut - 1] ELSE lines END,
  lambda x: trim(x) = '' OR NOT (regexp_matches(trim(x), '^[0-9]+(\s+[0-9]+)*\s*$|^The and .*$') OR trim(x) IN ('Les.', 'And ornd.'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM ({NOISE_SQL}) n"""


def unescaped_sql(text: str) -> str:
    """The references that the given pages hold; a page may break one off."""
    return f"replace(replace(replace(replace(regexp_replace({text}, '&amp$', '&'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&')"


UNSEEN_SQL = "(?is)<!--.*?(-->|$)|" + "|".join(rf"<{d}\b[^>]*>.*?(</{d}\s*>|$)" for d in clean.DROPPED)
TITLE_SQL = "(?is)<title[^>]*>(.*?)</title>"
BODY_SQL = f"regexp_replace(regexp_replace(regexp_replace(h, '{TITLE_SQL}', chr(10)), '(?is)^.*<body[^>]*>', ''), '(?s)<[/!?a-zA-Z][^>]*(>|$)', chr(10), 'g')"


@query("r19_clean_html", rf"""
WITH s AS (SELECT page_id, regexp_replace(coalesce(html, ''), '{UNSEEN_SQL}', chr(10), 'g') AS h FROM {{pages}}),
b AS (SELECT page_id, nullif(trim({unescaped_sql(f"regexp_extract(h, '{TITLE_SQL}', 1)")}), '') AS title, {unescaped_sql(BODY_SQL)} AS t FROM s),
l AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^\d+(\s+\d+)*\s*$')), chr(10)) AS text FROM b)
SELECT page_id, title, text, CAST(length(text) AS INT) AS char_count FROM l""")
def _(t):
    return clean.clean_html(t.pages.select("page_id", "html")).select("page_id", "title", "text", "char_count")


@query("r20_strip_noise", STRIPPED_SQL.replace("{{", "{").replace("}}", "}"))
def _(t):
    return t.documents.select("doc_id", clean.strip_noise(F.col("text"), PATTERNS, TOKENS, MARKER).alias("text"))


@query("r21_pick_body", """
SELECT doc_id, CASE WHEN length(split_part(text, chr(10), 1)) > 50 THEN split_part(text, chr(10), 1) WHEN length(split_part(text, chr(10), 2)) > 50 THEN split_part(text, chr(10), 2)
  WHEN length(text) > 50 THEN substring(text, 1, 5000) ELSE '' END AS body FROM {documents}""")
def _(t):
    parts = [F.split_part("text", F.lit("\n"), F.lit(i)) for i in (1, 2)]
    return t.documents.select("doc_id", clean.pick_body(parts, F.col("text")).alias("body"))


@query("r22_route_posts", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no_raw_html' WHEN doc_id % 10 = 1 THEN 'no_cleaned_text' WHEN length(text) < 300 THEN 'too_short:' || length(text) || '<300' END AS skip_reason,
  CASE WHEN doc_id % 10 > 1 AND length(text) < 300 THEN 'skipped' ELSE 'pending' END AS extract_status,
  CASE WHEN doc_id % 10 > 1 AND length(text) < 300 THEN 'too_short:' || length(text) || '<300' END AS extract_error FROM {documents}""")
def _(t):
    text = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("text"))
    rows = t.documents.select("doc_id", text.alias("cleaned_text"), F.when(F.col("doc_id") % 10 != 0, "<html>").alias("raw_html"), F.lit("pending").alias("extract_status"), F.lit(None).cast("string").alias("extract_error"))
    return clean.route_posts(rows, 300).select("doc_id", "skip_reason", "extract_status", "extract_error")


def payloads(t: Inputs, content: Column | None = None) -> DataFrame:
    """Conversations as extraction records in JSON: two turns make a round; some are cut off, some break a rule.

    A question's content is the whole text of a turn, unless ``content`` is given.
    """
    content = F.col("text") if content is None else content
    q = F.struct(F.col("turn"), F.when(F.col("conv_id") % 19 == 7, F.lit("x")).otherwise(F.concat(F.lit("  "), content)).alias("content"), F.when(F.col("turn") % 2 == 0, "HR").when(F.col("turn") % 4 == 1, "made up").alias("category"), F.when(F.col("turn") % 3 == 0, "brief").alias("answer_brief"))
    number = F.when(F.col("conv_id") % 17 == 5, 99).when(F.col("conv_id") % 17 == 6, 1).otherwise(F.floor(F.col("turn") / 2) + 1).cast("int")
    rounds = t.conversations.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("nr")).agg(F.array_sort(F.collect_list(q)).alias("qs"), F.min(number).alias("round_no"), F.min("role").alias("role"))
    rounds = rounds.select("conv_id", F.struct("nr", "round_no", F.when(F.col("role") == "system", "HR面").otherwise(F.col("role")).alias("round_type"), F.transform("qs", lambda x: x.dropFields("turn")).alias("questions")).alias("round"))
    per = rounds.groupBy("conv_id").agg(F.array_sort(F.collect_list("round")).alias("rounds"))
    record = F.struct(F.array(F.lit("acme")).alias("companies"), F.array(F.lit("dev")).alias("positions"), F.when(F.col("conv_id") % 5 == 0, "暑期实习").when(F.col("conv_id") % 5 == 1, "校招").when(F.col("conv_id") % 5 == 2, "odd").alias("level"), F.when(F.col("conv_id") % 3 == 0, "2024-05-17").when(F.col("conv_id") % 3 == 1, "May").alias("interview_date"), F.transform("rounds", lambda r: r.dropFields("nr")).alias("rounds"))
    text = F.to_json(record)
    return per.select(F.col("conv_id").alias("post_id"), F.when(F.col("conv_id") % 23 == 3, F.substring(text, 1, 40)).otherwise(text).alias("payload"))


def parsed(t: Inputs, content: Column | None = None) -> DataFrame:
    return extract.normalise_extraction(extract.parse_extraction(payloads(t, content)))


@query("r23_parse_extraction", "SELECT conv_id AS post_id, conv_id % 23 = 3 AS corrupt, CASE WHEN conv_id % 23 <> 3 THEN count(DISTINCT turn // 2) END AS n_rounds FROM {conversations} GROUP BY conv_id")
def _(t):
    return extract.parse_extraction(payloads(t)).select("post_id", "corrupt", F.when(F.col("record").isNotNull(), F.size("record.rounds").cast("long")).alias("n_rounds"))


@query("r24_normalise_extraction", """
SELECT conv_id AS post_id, CASE conv_id % 5 WHEN 0 THEN '实习' WHEN 1 THEN '校招' WHEN 2 THEN 'odd' END AS level, CASE WHEN conv_id % 3 = 0 THEN '2024-05' END AS interview_date,
  count(*) FILTER (WHERE turn % 2 = 1 AND turn % 4 = 1) AS other_categories FROM {conversations} WHERE conv_id % 23 <> 3 GROUP BY conv_id""")
def _(t):
    others = F.flatten(F.transform("record.rounds", lambda r: F.filter(r["questions"], lambda q: q["category"] == "其他")))
    return parsed(t).filter("record is not null").select("post_id", "record.level", "record.interview_date", F.size(others).cast("long").alias("other_categories"))


@query("r25_split_valid", """
SELECT DISTINCT conv_id AS post_id, CASE WHEN conv_id % 23 = 3 THEN 'corrupt' ELSE concat_ws(',', CASE WHEN conv_id % 17 = 5 THEN 'round_no' END, CASE WHEN conv_id % 19 = 7 THEN 'content' END, CASE WHEN conv_id % 5 = 2 THEN 'level' END) END AS violations FROM {conversations}""")
def _(t):
    valid, rejected = extract.split_valid(parsed(t))
    return valid.unionByName(rejected).select("post_id", F.when(F.col("corrupt"), "corrupt").otherwise(F.array_join("violations", ",")).alias("violations"))


QUESTIONS_SQL = """SELECT conv_id AS post_id, CASE WHEN conv_id % 17 = 6 THEN 1 ELSE CAST(turn // 2 + 1 AS INT) END AS round_no, trim('  ' || text) AS content,
  CASE WHEN turn % 2 = 0 THEN 'HR' WHEN turn % 4 = 1 THEN '其他' END AS category FROM {conversations}
WHERE conv_id % 23 <> 3 AND conv_id % 17 <> 5 AND conv_id % 19 <> 7 AND conv_id % 5 <> 2 AND trim(text) <> ''"""


def exploded(t: Inputs, content: Column | None = None) -> DataFrame:
    return extract.explode_questions(extract.split_valid(parsed(t, content))[0])


@query("r26_explode_questions", QUESTIONS_SQL)
def _(t):
    return exploded(t).select("post_id", "round_no", "content", "category")


@query("r26_replace_questions", f"""
WITH n AS ({QUESTIONS_SQL}) SELECT post_id, content FROM {{questions}} WHERE post_id NOT IN (SELECT post_id FROM n) UNION ALL SELECT post_id, content FROM n""")
def _(t):
    return extract.replace_questions(t.questions.select("post_id", "content"), stored(exploded(t).select("post_id", "content"), "exploded"))


@query("r27_question_totals", "SELECT conv_id AS post_id, CASE WHEN conv_id % 23 = 3 THEN 0 ELSE count(*) END AS n_questions FROM {conversations} GROUP BY conv_id")
def _(t):
    return extract.question_totals(extract.parse_extraction(payloads(t))).select("post_id", "n_questions")


def keyed(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", "lang", extract.content_key({"text": F.col("text")}, "extract", "v1").alias("key"))


@query("r28_split_cached", """
WITH c AS (SELECT DISTINCT text FROM {documents} WHERE doc_id % 2 = 0)
SELECT lang, count(*) FILTER (WHERE c.text IS NOT NULL) AS hits, count(DISTINCT CASE WHEN c.text IS NULL THEN d.text END) AS misses FROM {documents} d LEFT JOIN c ON d.text = c.text GROUP BY lang""")
def _(t):
    rows = keyed(t)
    cache = rows.filter("doc_id % 2 = 0").select("key").distinct().withColumn("result", F.lit("r"))
    hits, misses = extract.split_cached(rows, cache)
    h = hits.groupBy("lang").agg(F.count("*").alias("hits"))
    m = rows.join(misses, "key", "left_semi").groupBy("lang").agg(F.count_distinct("key").alias("misses"))
    langs = rows.select("lang").distinct()
    return langs.join(h, "lang", "left").join(m, "lang", "left").select("lang", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("misses", F.lit(0)).alias("misses"))


@query("r29_apply_outcomes", """
SELECT id, CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE extract_status END AS extract_status,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'boom' WHEN 2 THEN 'too_short' ELSE extract_error END AS extract_error, CAST(CASE WHEN id % 4 = 0 THEN 7 ELSE extract_version END AS INT) AS extract_version FROM {posts}""")
def _(t):
    k = F.col("id") % 4
    o = t.posts.filter(k < 3).select(F.col("id").alias("post_id"), F.when(k == 0, "done").when(k == 1, "failed").otherwise("skipped").alias("outcome"), F.when(k == 1, "boom").when(k == 2, "too_short").alias("error"), F.lit(7).alias("version"))
    return extract.apply_outcomes(t.posts, o).select("id", "extract_status", "extract_error", "extract_version")


@query("r30_retry_batch", "SELECT id, extract_status FROM {posts} WHERE extract_status IN ('pending', 'failed') ORDER BY fetched_at DESC, id DESC LIMIT 50")
def _(t):
    return extract.retry_batch(t.posts, ["pending", "failed"], 50).select("id", "extract_status")


@query("r31_stale_posts", "SELECT id, CASE WHEN extract_version < 2 THEN 'pending' ELSE extract_status END AS extract_status, extract_version < 2 AS stale FROM {posts}")
def _(t):
    stale = extract.stale_posts(t.posts, 2).select("id", F.lit(True).alias("stale"))
    return extract.requeue_stale(t.posts, 2).join(stale, "id", "left").select("id", "extract_status", F.coalesce("stale", F.lit(False)).alias("stale"))


ALIASES_SQL = "SELECT DISTINCT post_id, entity_type, trim(alias) AS alias FROM {mentions} WHERE trim(alias) <> ''"


@query("r32_post_aliases", ALIASES_SQL)
def _(t):
    return normalize.post_aliases(t.mentions)


@query("r33_resolve_dictionary", f"""
SELECT a.entity_type, a.alias, d.canonical_id, count(*) AS n FROM ({ALIASES_SQL}) a LEFT JOIN {{alias_dict}} d ON a.entity_type = d.entity_type AND a.alias = d.alias GROUP BY 1, 2, 3""")
def _(t):
    return normalize.resolve_dictionary(normalize.post_aliases(t.mentions), t.alias_dict).groupBy("entity_type", "alias", "canonical_id").agg(F.count("*").alias("n"))


RANKED_SQL = """SELECT a.vec_id AS alias_id, c.vec_id AS canonical_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank
FROM {embeddings} a, {embeddings} c WHERE a.vec_id % 5 > 0 AND c.vec_id % 5 = 0"""


def ranked(t: Inputs) -> DataFrame:
    e = t.embeddings
    return normalize.resolve_vector(e.filter("vec_id % 5 > 0").select(F.col("vec_id").alias("alias_id"), "embedding"), e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("canonical_id"), "embedding"), 5, 0.3)


@query("r34_resolve_vector", f"SELECT alias_id, canonical_id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank, rank = 1 AND s >= 0.3 AS matched FROM ({RANKED_SQL}) r WHERE rank <= 5")
def _(t):
    return ranked(t)


@query("r35_review_candidates", f"SELECT alias_id, count(*) AS n, string_agg(CAST(canonical_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ({RANKED_SQL}) r WHERE rank <= 5 AND s >= 0.2 GROUP BY alias_id")
def _(t):
    out = normalize.review_candidates(ranked(t), 0.2)
    return out.select("alias_id", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: c["canonical_id"].cast("string")), ",").alias("ids"))


#: Decisions on aliases outside the dictionary: by length of the alias, some matched, some with too little confidence.
DECISIONS_SQL = """SELECT DISTINCT entity_type, trim(alias) AS alias, length(alias) % 3 < 2 AS is_match, CAST(length(alias) % 7 AS BIGINT) AS canonical_id,
  CASE WHEN length(alias) % 5 = 0 THEN NULL WHEN length(alias) % 2 = 0 THEN 0.9 ELSE 0.6 END AS confidence,
  CASE WHEN entity_type = 'company' THEN upper(trim(alias)) END AS proposed
FROM {mentions} WHERE trim(alias) <> '' AND alias = trim(alias)"""


def spellings(t: Inputs) -> DataFrame:
    """The distinct aliases as they are written, few beside their mentions, which are read for them once."""
    return stored(t.mentions.select("entity_type", "alias").distinct(), "spellings")


def names_of(spelled: DataFrame) -> DataFrame:
    return spelled.select("entity_type", F.trim("alias").alias("alias")).filter(F.length("alias") > 0).distinct()


def decisions(t: Inputs, spelled: DataFrame) -> DataFrame:
    return t.spark.sql(DECISIONS_SQL, mentions=spelled)


RESOLVED_SQL = f"""
WITH k AS ({CANONICALS_SQL}), a AS (SELECT DISTINCT entity_type, alias FROM ({ALIASES_SQL}) x), dc AS ({DECISIONS_SQL}),
s AS (SELECT a.entity_type, a.alias, d.canonical_id AS dict_id, CASE WHEN dc.is_match AND coalesce(dc.confidence, 0.5) >= 0.7 THEN dc.canonical_id END AS dec_id,
  coalesce(dc.confidence, 0.5) AS dec_conf, coalesce(dc.proposed, a.alias) AS name
  FROM a LEFT JOIN {{alias_dict}} d ON a.entity_type = d.entity_type AND a.alias = d.alias LEFT JOIN dc ON a.entity_type = dc.entity_type AND a.alias = dc.alias),
f AS (SELECT entity_type, canonical, (SELECT max(id) FROM k WHERE k.entity_type = n.entity_type) + row_number() OVER (PARTITION BY entity_type ORDER BY canonical) AS id
  FROM (SELECT DISTINCT entity_type, name AS canonical FROM s WHERE dict_id IS NULL AND dec_id IS NULL AND (entity_type, name) NOT IN (SELECT entity_type, canonical FROM k)) n),
r AS (SELECT s.entity_type, s.alias, coalesce(dict_id, dec_id, e.id) AS canonical_id, CASE WHEN dict_id IS NOT NULL THEN 'dictionary' WHEN dec_id IS NOT NULL THEN 'decision' ELSE 'new' END AS source,
  CAST(CASE WHEN dict_id IS NOT NULL THEN 1.0 WHEN dec_id IS NOT NULL THEN dec_conf ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN dict_id IS NULL AND dec_id IS NULL THEN s.name END AS name
  FROM s LEFT JOIN (SELECT * FROM k UNION ALL SELECT entity_type, id, canonical FROM f) e ON s.entity_type = e.entity_type AND s.name = e.canonical)
"""


def encoded_sql(rows: str, key: str, text: str) -> str:
    """SQL of the default encoder over ``rows``: ``key, slot, v``, the components that are not zero, as the encoder's 32-bit floats."""
    return f"""(SELECT {key}, slot, CAST(CAST(v AS FLOAT) / CAST(sqrt(sum(v * v) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v FROM (
  SELECT {key}, (x // 1048576) % 64 AS slot, sum(CASE WHEN (x // 65536) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM (
    SELECT {key}, ((ord(substr(s, j, 1)) * 961 + ord(substr(s, j + 1, 1)) * 31 + ord(substr(s, j + 2, 1))) * 2654435761) % 4294967296 AS x
    FROM (SELECT {key}, s, unnest(range(1, length(s) - 1)) AS j FROM (SELECT {key}, lower(concat(' ', {text}, ' ')) AS s FROM ({rows}) r) m) g) h
  GROUP BY ALL) c WHERE v <> 0)"""


#: All four tiers: names outside the dictionary are encoded and searched; what is left and has candidates is decided by length.
TIERS_SQL = f"""
WITH k AS ({CANONICALS_SQL}), a AS (SELECT DISTINCT entity_type, alias FROM ({ALIASES_SQL}) x),
u AS (SELECT row_number() OVER () AS nr, * FROM a WHERE (entity_type, alias) NOT IN (SELECT entity_type, alias FROM {{alias_dict}})),
kn AS (SELECT row_number() OVER () AS knr, * FROM k),
eu AS {encoded_sql("SELECT * FROM u", "nr", "alias")}, ek AS {encoded_sql("SELECT * FROM kn", "knr", "canonical")},
sim AS (SELECT nr, knr, sum(eu.v * ek.v) AS s FROM eu JOIN ek USING (slot) GROUP BY nr, knr),
cand AS (SELECT u.nr, u.entity_type, u.alias, kn.id, coalesce(s, 0) AS s, row_number() OVER (PARTITION BY u.nr ORDER BY coalesce(s, 0) DESC, kn.id) AS rank
  FROM u JOIN kn ON u.entity_type = kn.entity_type LEFT JOIN sim ON sim.nr = u.nr AND sim.knr = kn.knr),
s AS (SELECT a.entity_type, a.alias, d.canonical_id AS dict_id, CASE WHEN c.s >= 0.85 THEN c.id END AS vec_id, round(c.s, 6) AS vec_sim,
  CASE WHEN c.s < 0.85 AND c.s >= 0.55 AND length(a.alias) % 2 = 0 THEN c.id END AS dec_id, CASE WHEN a.entity_type = 'company' THEN upper(a.alias) ELSE a.alias END AS name
  FROM a LEFT JOIN {{alias_dict}} d ON a.entity_type = d.entity_type AND a.alias = d.alias LEFT JOIN cand c ON c.entity_type = a.entity_type AND c.alias = a.alias AND c.rank = 1),
f AS (SELECT entity_type, canonical, (SELECT max(id) FROM k WHERE k.entity_type = n.entity_type) + row_number() OVER (PARTITION BY entity_type ORDER BY canonical) AS id
  FROM (SELECT DISTINCT entity_type, name AS canonical FROM s WHERE dict_id IS NULL AND vec_id IS NULL AND dec_id IS NULL AND (entity_type, name) NOT IN (SELECT entity_type, canonical FROM k)) n),
r AS (SELECT s.entity_type, s.alias, coalesce(dict_id, vec_id, dec_id, e.id) AS canonical_id,
  CASE WHEN dict_id IS NOT NULL THEN 'dictionary' WHEN vec_id IS NOT NULL THEN 'vector' WHEN dec_id IS NOT NULL THEN 'decision' ELSE 'new' END AS source,
  CAST(CASE WHEN dict_id IS NOT NULL THEN 1.0 WHEN vec_id IS NOT NULL THEN vec_sim WHEN dec_id IS NOT NULL THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
  FROM s LEFT JOIN (SELECT * FROM k UNION ALL SELECT entity_type, id, canonical FROM f) e ON s.entity_type = e.entity_type AND s.name = e.canonical)
"""


def resolved(t: Inputs) -> DataFrame:
    spelled = spellings(t)
    out = normalize.resolve(names_of(spelled), t.alias_dict, canonicals(t), decisions(t, spelled))
    return stored(out.withColumn("confidence", F.col("confidence").cast("double")), "resolved")


def reviewed(review: DataFrame) -> DataFrame:
    """Decisions on names under review: the best candidate, for names of even length; else a new name."""
    best = F.try_element_at(F.col("candidates.canonical_id"), F.lit(1))
    match = best.isNotNull() & (F.length("alias") % 2 == 0)
    proposed = F.when(F.col("entity_type") == "company", F.upper("alias"))
    return review.select("entity_type", "alias", match.alias("is_match"), F.when(match, best).alias("canonical_id"), F.lit(0.9).alias("confidence"), proposed.alias("proposed"))


def tiers(t: Inputs) -> DataFrame:
    return normalize.resolve(normalize.post_aliases(t.mentions), t.alias_dict, canonicals(t), reviewed, encoder=hashed_grams)


@query("r39_resolve_four_tiers", TIERS_SQL + "SELECT entity_type, alias, canonical_id, source, confidence FROM r")
def _(t):
    return tiers(t).select("entity_type", "alias", "canonical_id", "source", F.col("confidence").cast("double").alias("confidence"))


@query("r42_shares_of_four_tiers", TIERS_SQL + "SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY source")
def _(t):
    return normalize.tier_shares(stored(tiers(t), "tiers"))


@query("r36_apply_decisions", RESOLVED_SQL + "SELECT entity_type, alias, canonical_id, confidence FROM r WHERE source = 'decision'")
def _(t):
    spelled = spellings(t)
    rest = normalize.resolve_dictionary(names_of(spelled), t.alias_dict).filter("canonical_id is null").select("entity_type", "alias")
    return normalize.apply_decisions(rest, decisions(t, spelled)).filter("canonical_id is not null").select("entity_type", "alias", "canonical_id", F.col("confidence").cast("double").alias("confidence"))


@query("r37_create_canonicals", RESOLVED_SQL + "SELECT entity_type, alias, name, canonical_id, confidence FROM r WHERE source = 'new'")
def _(t):
    return resolved(t).filter("source = 'new'").select("entity_type", "alias", "name", "canonical_id", "confidence")


@query("r38_learn_aliases", RESOLVED_SQL + """, l AS (SELECT entity_type, alias, canonical_id, CASE WHEN source = 'new' THEN 1.0 ELSE confidence END AS confidence FROM r WHERE source <> 'dictionary'
  UNION ALL SELECT entity_type, name, canonical_id, 1.0 FROM r WHERE source = 'new'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, alias ORDER BY canonical_id, confidence DESC) AS nr FROM l) x WHERE nr = 1)
SELECT entity_type, alias, canonical_id, CAST(confidence AS DOUBLE) AS confidence FROM {alias_dict}
UNION ALL SELECT entity_type, alias, canonical_id, CAST(confidence AS DOUBLE) FROM n WHERE (entity_type, alias) NOT IN (SELECT entity_type, alias FROM {alias_dict})""")
def _(t):
    return normalize.learn_aliases(t.alias_dict, resolved(t))


@query("r39_resolve", RESOLVED_SQL + "SELECT entity_type, alias, canonical_id, source, confidence FROM r")
def _(t):
    return resolved(t).select("entity_type", "alias", "canonical_id", "source", "confidence")


@query("r40_rebuild_links", RESOLVED_SQL + f""", p AS (SELECT a.post_id, a.entity_type, r.canonical_id FROM ({ALIASES_SQL}) a JOIN r ON a.entity_type = r.entity_type AND a.alias = r.alias WHERE a.post_id % 2 = 0)
SELECT post_id, company_id, position_id FROM {{links}} WHERE post_id NOT IN (SELECT post_id FROM p)
UNION ALL SELECT DISTINCT c.post_id, c.canonical_id, q.canonical_id FROM p c JOIN p q ON c.post_id = q.post_id WHERE c.entity_type = 'company' AND q.entity_type = 'position'""")
def _(t):
    per_post = stored(normalize.post_canonicals(t.mentions.filter("post_id % 2 = 0"), resolved(t)), "per-post")
    return normalize.rebuild_links(per_post, t.links)


@query("r41_alias_growth", "SELECT entity_type, count(*) AS n FROM {alias_dict} GROUP BY entity_type")
def _(t):
    return normalize.alias_growth(t.alias_dict)


@query("r41_learned_aliases", "SELECT entity_type, alias, canonical_id FROM {alias_dict} WHERE confidence < 1 ORDER BY entity_type, alias LIMIT 5")
def _(t):
    return normalize.learned_aliases(t.alias_dict, 5).select("entity_type", "alias", "canonical_id")


@query("r41_list_aliases", "SELECT c.canonical, a.alias FROM {alias_dict} a JOIN {companies} c ON a.canonical_id = c.id WHERE entity_type = 'company'")
def _(t):
    return normalize.list_aliases(t.alias_dict, canonicals(t), "company").select("canonical", "alias")


@query("r42_tier_shares", RESOLVED_SQL + "SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY source")
def _(t):
    return normalize.tier_shares(resolved(t))
