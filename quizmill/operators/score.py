"""Quality of posts, 0 to 100, from a nested record or from flat questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.operators.search import of_links


@dataclass(frozen=True)
class Weights:
    """(points each, most) of questions, answers and rounds; recency as (days at most, points)."""

    quantity: tuple[int, int] = (3, 30)
    answers: tuple[int, int] = (4, 20)
    rounds: tuple[int, int] = (7, 20)
    recency: tuple[tuple[int, int], ...] = ((90, 30), (180, 25), (360, 15), (720, 8))


def recency(posted: Column, now: Column, weights: Weights) -> Column:
    """Points by whole days since the post; none for an unknown date, the most for a date to come."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(posted)) / 86_400_000_000)
    out = F.lit(0)
    for limit, points in reversed(weights.recency):
        out = F.when(days <= limit, points).otherwise(out)
    return F.when(posted.isNull(), 0).otherwise(out)


def _points(quantity: Column, answers: Column, rounds: Column, recent: Column, w: Weights) -> list[Column]:
    parts = [F.least(n * each, F.lit(most)).cast("int") for n, (each, most) in ((quantity, w.quantity), (answers, w.answers), (rounds, w.rounds))]
    parts.append(recent.cast("int"))
    names = ("quantity", "answers", "rounds", "recency")
    return [p.alias(n) for p, n in zip(parts, names)] + [F.least(sum(parts[1:], parts[0]), F.lit(100)).cast("int").alias("total")]


def filled(answer: Column) -> Column:
    return F.coalesce(F.length(F.trim(answer)) > 0, F.lit(False))


def score_extracted(df: DataFrame, now: str, weights: Weights = Weights()) -> DataFrame:
    """Adds the points of ``record.rounds``; empty rounds count as rounds; a null record has recency alone."""
    rounds = F.coalesce("record.rounds", F.filter("record.rounds", lambda r: F.lit(False)))
    sizes = F.transform(rounds, lambda r: F.greatest(F.size(r["questions"]), F.lit(0)))
    answered = F.transform(rounds, lambda r: F.greatest(F.size(F.filter(r["questions"], lambda q: filled(q["answer_brief"]))), F.lit(0)))
    total = lambda xs: F.coalesce(F.aggregate(xs, F.lit(0), lambda a, x: a + x), F.lit(0))
    recent = recency(F.col("posted_at").cast("timestamp"), F.lit(now).cast("timestamp"), weights)
    return df.select("*", *_points(total(sizes), total(answered), F.greatest(F.size(rounds), F.lit(0)), recent, weights))


def rescore_from_questions(posts: DataFrame, questions: DataFrame, now: str, weights: Weights = Weights()) -> DataFrame:
    """``post_id`` and points of done posts. A missing or zero round is round 1; without questions there is recency alone."""
    number = F.when(F.coalesce("round_no", F.lit(0)) == 0, 1).otherwise(F.col("round_no"))
    sums = questions.groupBy("post_id").agg(F.count("*").alias("q"), F.count_if(filled(F.col("answer_brief"))).alias("a"), F.count_distinct(number).alias("r"))
    done = posts.filter("extract_status = 'done'").select(F.col("id").alias("post_id"), "posted_at").join(sums, "post_id", "left")
    recent = recency(F.col("posted_at").cast("timestamp"), F.lit(now).cast("timestamp"), weights)
    return done.select("post_id", *_points(*(F.coalesce(c, F.lit(0)) for c in ("q", "a", "r")), recent, weights))


FIVE_BANDS = ((80, "80-100"), (60, "60-79"), (40, "40-59"), (20, "20-39"), (0, "0-19"))
FOUR_BANDS = ((75, "75-100"), (50, "50-74"), (25, "25-49"), (0, "0-24"))


def score_histogram(posts: DataFrame, bands: tuple = FIVE_BANDS) -> DataFrame:
    """Scored posts per band: ``band, n, low`` by the smallest score found in it."""
    label = F.lit(None).cast("string")
    for low, name in sorted(bands):
        label = F.when(F.col("quality_score") >= low, name).otherwise(label)
    return posts.filter("quality_score is not null").groupBy(label.alias("band")).agg(F.count("*").alias("n"), F.min("quality_score").alias("low")).orderBy("low")


def thin_posts(posts: DataFrame, below: int = 20, limit: int = 20) -> DataFrame:
    return posts.filter((F.col("extract_status") == "done") & (F.col("quality_score") < below)).orderBy("quality_score", "id").limit(limit)


def top_posts(posts: DataFrame, links: DataFrame, company_id: int | None = None, position_id: int | None = None, limit: int = 20) -> DataFrame:
    """Scored posts, best first, then newest; posts without a date last."""
    rows = of_links(posts.filter("quality_score is not null"), links, company_id, position_id, key="id")
    return rows.orderBy(F.desc("quality_score"), F.desc_nulls_last("posted_at"), "id").limit(limit)
