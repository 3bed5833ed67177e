"""Catalogue, feed and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.functions.domains import excerpt


def _listing(names: DataFrame, links: DataFrame, key: str, with_counts: bool, limit: int | None, offset: int) -> DataFrame:
    if not with_counts:
        out = names.orderBy("canonical", "id")
    else:
        n = links.select(key, "post_id").distinct().groupBy(F.col(key).alias("id")).agg(F.count("*").alias("post_count"))
        out = names.join(n, "id", "left").withColumn("post_count", F.coalesce("post_count", F.lit(0))).orderBy(F.desc("post_count"), "canonical", "id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def list_companies(companies: DataFrame, links: DataFrame, with_counts: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Companies with their numbers of posts, none included, most first; or by name without numbers."""
    return _listing(companies.select("id", "canonical", "industry"), links, "company_id", with_counts, limit, offset)


def list_positions(positions: DataFrame, links: DataFrame, with_counts: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    return _listing(positions.select("id", "canonical", "category"), links, "position_id", with_counts, limit, offset)


def company_positions(stats: DataFrame, companies: DataFrame, company_id: int) -> tuple[bool, DataFrame]:
    """(whether the company exists, its positions from the statistics, most posts first)."""
    known = not companies.filter(F.col("id") == company_id).isEmpty()
    return known, stats.filter(F.col("company_id") == company_id).orderBy(F.desc("post_count"), "position")


def feed(posts: DataFrame, links: DataFrame, questions: DataFrame, companies: DataFrame, positions: DataFrame, company: str | None = None, position: str | None = None, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Done posts with a question, newest first: names of companies and positions, types of rounds, number of questions.

    Filters also narrow what is gathered. Links and questions are gathered by post on their own before they meet.
    """
    named = links.join(companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("company")), "company_id").join(positions.select(F.col("id").alias("position_id"), F.col("canonical").alias("position")), "position_id")
    for col, value in (("company", company), ("position", position)):
        if value is not None:
            named = named.filter(F.col(col) == value)
    asked = questions if category is None else questions.filter(F.col("category") == category)
    sides = named.groupBy("post_id").agg(F.sort_array(F.collect_set("company")).alias("companies"), F.sort_array(F.collect_set("position")).alias("positions"))
    asked = asked.groupBy("post_id").agg(F.sort_array(F.collect_set("round_type")).alias("round_types"), F.count_distinct("id").alias("question_count"))
    done = posts.filter("extract_status = 'done'").select(F.col("id").alias("post_id"), "title", "source_url", "posted_at", "quality_score")
    out = done.join(asked, "post_id").join(sides, "post_id", "inner" if company is not None or position is not None else "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("companies", "positions")}).orderBy(F.desc_nulls_last("posted_at"), F.desc("post_id"))
    return (out.offset(offset) if offset else out).limit(limit)


def feed_details(page: DataFrame, questions: DataFrame, posts: DataFrame) -> DataFrame:
    """The page with its questions (by round, nulls last, then id) and an excerpt: the first question, else the text."""
    on_page = questions.join(F.broadcast(page.select("post_id")), "post_id", "left_semi")  # a page has `limit` rows
    item = F.struct(F.coalesce("round_no", F.lit(2**31 - 1)).alias("o"), "id", "round_no", "round_type", "content", "category")
    asked = on_page.groupBy("post_id").agg(F.array_sort(F.collect_list(item)).alias("questions"))
    text = posts.select(F.col("id").alias("post_id"), "cleaned_text")
    out = page.join(asked, "post_id", "left").join(text, "post_id", "left")
    out = out.withColumn("excerpt", excerpt(F.coalesce(F.element_at("questions.content", 1), "cleaned_text")))
    return out.withColumn("questions", F.transform("questions", lambda x: x.dropFields("o"))).drop("cleaned_text")


def post_brief(links: DataFrame, companies: DataFrame, positions: DataFrame) -> DataFrame:
    """Distinct names of companies and positions per post."""
    named = links.join(companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("company")), "company_id").join(positions.select(F.col("id").alias("position_id"), F.col("canonical").alias("position")), "position_id")
    return named.groupBy("post_id").agg(F.sort_array(F.collect_set("company")).alias("companies"), F.sort_array(F.collect_set("position")).alias("positions"))


def bucket_questions(posts: DataFrame, links: DataFrame, questions: DataFrame, company_id: int, position_id: int, period=None, min_quality: int = 30) -> DataFrame:
    """All questions of a bucket: by category, nulls last, then score, nulls last, then id. ``period`` is a label, or ``all``."""
    from quizmill.functions.times import period_label

    good = posts.filter((F.col("extract_status") == "done") & (F.coalesce("quality_score", F.lit(0)) >= min_quality))
    if period not in (None, "all"):
        good = good.filter(period_label(F.col("posted_at")) == period)
    here = links.filter((F.col("company_id") == company_id) & (F.col("position_id") == position_id)).select("post_id")
    out = questions.join(here, "post_id", "left_semi").join(good.select(F.col("id").alias("post_id"), F.col("quality_score").alias("_s")), "post_id")
    out = out.orderBy(F.asc_nulls_last("category"), F.desc_nulls_last("_s"), "id")
    return out.select("id", "post_id", "content", "category", F.coalesce("_s", F.lit(0)).alias("quality_score"))


def questions_by_category(questions: DataFrame, unknown: str = "uncategorised") -> DataFrame:
    return questions.groupBy(F.coalesce("category", F.lit(unknown)).alias("category")).agg(F.count("*").alias("n"))


def post_links(links: DataFrame, companies: DataFrame, positions: DataFrame, limit: int = 20) -> DataFrame:
    """Links with names, newest posts first. The few rows are chosen before names are joined."""
    top = links.orderBy(F.desc("post_id"), "company_id", "position_id").limit(limit)
    c = companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("company"))
    p = positions.select(F.col("id").alias("position_id"), F.col("canonical").alias("position"))
    return top.join(c, "company_id").join(p, "position_id").select("post_id", "company", "position")


def corpus_totals(posts: DataFrame, questions: DataFrame, companies: DataFrame, positions: DataFrame, summaries: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row of totals; the sides joined have one row each."""
    out = posts.agg(F.count_if(F.col("extract_status") == "done").alias("done_posts")).crossJoin(questions.agg(F.count("*").alias("questions"), F.count(vector).alias("embedded")))
    for df, name in ((companies, "companies"), (positions, "positions"), (summaries, "summaries")):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


def status_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("extract_status").agg(F.count("*").alias("n"))


def latest_failures(posts: DataFrame, limit: int = 20) -> DataFrame:
    return posts.filter("extract_status = 'failed'").orderBy(F.desc("fetched_at"), F.desc("id")).select("id", "source_url", "extract_error").limit(limit)


