"""Crawl files, nested records, the alias seed and the nested export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions.times import local_minute
from quizmill.operators.numbering import numbered
from quizmill.sources.schemas import API_RECORD, CRAWL_POST


def read_crawl_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Posts of crawl files. Header, trailer and blank lines have no title and are dropped."""
    return spark.read.schema(CRAWL_POST).json(path).filter(F.col("title").isNotNull())


def read_api_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_RECORD).json(path)


def write_posts_jsonl(df: DataFrame, path: str) -> None:
    """Append posts, one JSON object a line."""
    df.write.mode("append").json(path)


def detail_url(content_type: Column, uuid: Column, content_id: Column, moment_id: Column, base: str) -> Column:
    """Type 74 with a uuid has a feed page; others a discussion page by content id, else by moment id; without any, null."""
    def text(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    ident = F.coalesce(text(content_id), text(moment_id))
    feed = (content_type == 74) & text(uuid).isNotNull()
    return F.when(feed, F.concat(F.lit(f"{base}/feed/main/detail/"), text(uuid))).when(ident.isNotNull(), F.concat(F.lit(f"{base}/discuss/"), ident))


def flatten_records(df: DataFrame, base: str, source: str = "tab") -> DataFrame:
    """The sixteen flat fields of nested records. Without a title, the detail page's one (``tab``: column ``detail_title``,
    if there is one) or ``newTitle`` (``joblist``); strings are trimmed and default to '', counters to 0."""
    def text(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit(""))

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0).cast("long"))

    second = "momentData.newTitle" if source == "joblist" else "detail_title" if "detail_title" in df.columns else None
    title = F.coalesce(F.nullif(text("momentData.title"), F.lit("")), text(second) if second else F.lit(""))
    content = F.coalesce(F.nullif(text("momentData.content"), F.lit("")), text("detail_content") if "detail_content" in df.columns else F.lit(""))
    ident = F.coalesce(F.nullif(text("contentId"), F.lit("")), F.nullif(text("extraInfo.contentID_var"), F.lit("")))
    total = number("frequencyData.totalCommentCnt")
    return df.select(
        title.alias("title"), content.alias("content"),
        detail_url(F.col("contentType"), F.col("momentData.uuid"), ident, F.col("momentData.id"), base).alias("detail_url"),
        local_minute(F.col("momentData.createdAt")).alias("created_at"), number("momentData.createdAt").alias("created_at_ms"),
        text("userBrief.nickname").alias("author"), text("userBrief.educationInfo").alias("school"), text("userBrief.secondMajorName").alias("major"),
        text("userBrief.authDisplayInfo").alias("auth_display"), text("momentData.ip4Location").alias("ip_location"),
        number("frequencyData.viewCnt").alias("view_count"), number("frequencyData.likeCnt").alias("like_count"),
        F.when(total != 0, total).otherwise(number("frequencyData.commentCnt")).alias("comment_count"),
        F.coalesce("contentType", F.lit(0)).alias("content_type"), F.coalesce(ident, text("momentData.id")).alias("content_id"), text("momentData.uuid").alias("uuid"),
    )


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A YAML seed {entity type: [{canonical, aliases}]} as ``entity_type, canonical, aliases``; a small file, parsed on the driver."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = [(kind.rstrip("s") if kind.endswith("ions") else {"companies": "company"}.get(kind, kind), e["canonical"], e.get("aliases") or []) for kind, entries in yaml.safe_load(text).items() for e in entries]
    return spark.createDataFrame(rows, "entity_type string, canonical string, aliases array<string>")


def seed_aliases(seed: DataFrame, canonicals: DataFrame, alias_dict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonicals, alias_dict) after loading ``seed(entity_type, canonical, aliases)``.

    Canonicals ``(entity_type, id, canonical)`` that are new get the next ids of their type by name; each (type, alias) that
    is new, the canonical itself among them, is added with confidence 1. Of an alias of two canonicals the smaller name wins.
    """
    names = seed.select("entity_type", "canonical").distinct()
    fresh = names.join(canonicals, ["entity_type", "canonical"], "left_anti")
    top = canonicals.groupBy("entity_type").agg(F.max("id").alias("top"))
    fresh = numbered(fresh, ["canonical"], ["entity_type"])
    fresh = fresh.join(top, "entity_type", "left").select("entity_type", (F.coalesce("top", F.lit(0)) + F.col("number")).cast("long").alias("id"), "canonical")
    every = canonicals.select("entity_type", "id", "canonical").unionByName(fresh)
    aliases = seed.select("entity_type", "canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    first = aliases.groupBy("entity_type", "alias").agg(F.min("canonical").alias("canonical")).join(alias_dict, ["entity_type", "alias"], "left_anti")
    new = first.join(every, ["entity_type", "canonical"]).select("entity_type", "alias", F.col("id").alias("canonical_id"), F.lit(1.0).alias("confidence"))
    return every, alias_dict.select("entity_type", "alias", "canonical_id", "confidence").unionByName(new)


def export_posts(posts: DataFrame, links: DataFrame, companies: DataFrame, positions: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per done post with arrays of names and of questions (by round, nulls last, then id); arrays are never null.

    Each side is gathered by post on its own, so companies, positions and questions do not multiply one another.
    """
    def names(side: DataFrame, key: str, out: str) -> DataFrame:
        named = links.select("post_id", key).distinct().join(side.select(F.col("id").alias(key), "canonical"), key)
        return named.groupBy("post_id").agg(F.sort_array(F.collect_set("canonical")).alias(out))

    q = F.struct(F.coalesce("round_no", F.lit(2**31 - 1)).alias("o"), F.col("id"), "round_no", "round_type", "content", "category", "answer_brief")
    asked = questions.groupBy("post_id").agg(F.array_sort(F.collect_list(q)).alias("questions"))
    asked = asked.withColumn("questions", F.transform("questions", lambda x: x.dropFields("o")))
    done = posts.filter("extract_status = 'done'").select(F.col("id").alias("post_id"), "source_url", "title", "posted_at", "quality_score")
    out = done.join(names(companies, "company_id", "companies"), "post_id", "left").join(names(positions, "position_id", "positions"), "post_id", "left").join(asked, "post_id", "left")
    for c, kind in out.select("companies", "positions", "questions").dtypes:
        out = out.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return out.withColumn("question_count", F.size("questions").cast("long"))
