"""Answers: which questions need one, writing them back, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.functions.domains import importance
from quizmill.operators.search import of_links

NOT_FOUND, NO_ANSWER = "question not found", "no answer yet"


def answer_targets(questions: DataFrame, posts: DataFrame, links: DataFrame, version: int, regenerate: bool = False, company_id: int | None = None, position_id: int | None = None, min_quality: int = 30, limit: int | None = None) -> DataFrame:
    """Questions of good done posts whose answer is missing or older than ``version`` (or all), by id."""
    good = posts.filter((F.col("extract_status") == "done") & (F.coalesce("quality_score", F.lit(0)) >= min_quality)).select(F.col("id").alias("post_id"))
    rows = questions if regenerate else questions.filter(F.col("answer_ai").isNull() | (F.coalesce("answer_ai_version", F.lit(0)) < version))
    out = of_links(rows.join(good, "post_id", "left_semi"), links, company_id, position_id).orderBy("id")
    return out if limit is None else out.limit(limit)


def apply_answers(questions: DataFrame, answers: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(questions with ``answers(id, answer)`` put in, counts of generated and failed ones). A null answer is a failure;
    of several answers to a question the least one counts."""
    answers = answers.groupBy("id").agg(F.min("answer").alias("answer"))
    a = answers.select("id", F.col("answer").alias("_a"))
    out = questions.join(a, "id", "left").withColumn("answer_ai_version", F.when(F.col("_a").isNotNull(), F.lit(version)).otherwise(F.col("answer_ai_version"))).withColumn("answer_ai", F.coalesce("_a", "answer_ai")).drop("_a")
    return out, answers.agg(F.count("answer").alias("generated"), F.count_if(F.col("answer").isNull()).alias("failed"))


def answer_cards(ids: DataFrame, questions: DataFrame) -> DataFrame:
    """Every id of ``ids(id)`` with content, answer and importance, or an error."""
    q = questions.select("id", "content", "category", "answer_ai")
    out = ids.join(q, "id", "left")
    error = F.when(F.col("content").isNull(), NOT_FOUND).when(F.col("answer_ai").isNull(), NO_ANSWER)
    return out.select("id", "content", "category", F.col("answer_ai").alias("answer"), F.when(F.col("content").isNotNull(), importance(F.col("content"))).alias("importance"), error.alias("error"))
