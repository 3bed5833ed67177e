"""Extraction records: parse, normalise, validate, explode; work avoidance; outcomes of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions.domains import CATEGORIES, LEVELS, OTHER, ROUND_TYPES, UNKNOWN_LEVEL
from quizmill.sources.schemas import EXTRACTION


def parse_extraction(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """Adds ``record`` and ``corrupt``: text that is no record of the schema. Null text is corrupt too.

    The parsed record leaves a generator, which later filters and columns are not moved through: a text is parsed once, not
    again for every field that they read.
    """
    parsed = F.from_json(json_col, EXTRACTION + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.select("*", F.explode(F.array(parsed)).alias("_parsed"))
    out = out.withColumn("corrupt", F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull())
    return out.withColumn("record", F.when(~F.col("corrupt"), F.col("_parsed").dropFields("_corrupt"))).drop("_parsed")


def normalise_extraction(df: DataFrame, levels: tuple = LEVELS, round_types: tuple = ROUND_TYPES, categories: tuple = CATEGORIES, other: str = OTHER) -> DataFrame:
    """``record`` with the level that a longer one contains (first of ``levels`` wins), round types and categories outside
    their domain as ``other``, and the interview date as ``YYYY-MM`` or null."""
    level = F.lit(None).cast("string")
    for name in reversed(levels[:-1]):
        level = F.when(F.col("record.level").contains(name), name).otherwise(level)
    level = F.coalesce(level, F.col("record.level"))

    def known(c: Column, domain: tuple) -> Column:
        return F.when((F.length(c) > 0) & ~c.isin(*domain), other).otherwise(c)

    def questions(qs: Column) -> Column:
        return F.transform(qs, lambda q: q.withField("category", known(q["category"], categories)))

    rounds = F.transform("record.rounds", lambda r: r.withField("round_type", known(r["round_type"], round_types)).withField("questions", questions(r["questions"])))
    date = F.col("record.interview_date")
    month = F.when((F.length(date) >= 7) & (F.substring(date, 5, 1) == "-"), F.substring(date, 1, 7))
    return df.withColumn("record", F.when(F.col("record").isNotNull(), F.col("record").withField("level", level).withField("rounds", rounds).withField("interview_date", month)))


def split_valid(df: DataFrame, levels: tuple = LEVELS, unknown: str = UNKNOWN_LEVEL) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): one violation rejects the post. ``violations`` names them; a missing level is ``unknown``."""
    rounds = F.coalesce("record.rounds", F.array().cast("array<struct<round_no:int,round_type:string,questions:array<struct<content:string,category:string,answer_brief:string>>>>"))
    bad_round = F.exists(rounds, lambda r: r["round_no"].isNull() | (r["round_no"] < 1) | (r["round_no"] > 20))
    bad_text = F.exists(rounds, lambda r: F.exists(F.coalesce(r["questions"], F.array().cast("array<struct<content:string,category:string,answer_brief:string>>")), lambda q: F.coalesce(F.length(q["content"]), F.lit(0)) < 2))
    bad_level = ~F.coalesce(F.col("record.level"), F.lit(unknown)).isin(*levels)
    found = F.array_compact(F.array(F.when(F.col("corrupt"), "corrupt"), F.when(bad_round, "round_no"), F.when(bad_text, "content"), F.when(bad_level, "level")))
    out = df.withColumn("violations", found)
    whole = F.when(F.col("record").isNotNull(), F.col("record").withField("level", F.coalesce("record.level", F.lit(unknown))))
    return out.filter(F.size("violations") == 0).withColumn("record", whole), out.filter(F.size("violations") > 0)


def explode_questions(df: DataFrame, id_col: str = "post_id") -> DataFrame:
    """One row per question: ``post_id, seq, round_no, round_type, content, category, answer_brief``; round 1 where it is
    missing or 0, content trimmed, blank ones dropped, ``seq`` in the order of the record."""
    rounds = df.select(id_col, F.posexplode("record.rounds").alias("r", "round"))
    rows = rounds.select(id_col, "r", "round", F.posexplode("round.questions").alias("q", "question"))
    number = F.when(F.coalesce("round.round_no", F.lit(0)) == 0, 1).otherwise(F.col("round.round_no"))
    out = rows.select(id_col, (F.col("r").cast("long") * 1000 + F.col("q")).alias("seq"), number.alias("round_no"), F.col("round.round_type").alias("round_type"), F.trim("question.content").alias("content"), F.col("question.category").alias("category"), F.col("question.answer_brief").alias("answer_brief"))
    return out.filter(F.length("content") > 0)


def replace_questions(questions: DataFrame, new: DataFrame) -> DataFrame:
    """Questions with those of the posts in ``new`` replaced. ``new`` is read twice, so it is best stored."""
    return questions.join(new.select("post_id").distinct(), "post_id", "left_anti").unionByName(new, allowMissingColumns=True)


def question_totals(df: DataFrame) -> DataFrame:
    sizes = F.transform(F.coalesce("record.rounds", F.expr("array()")), lambda r: F.greatest(F.size(r["questions"]), F.lit(0)))
    return df.withColumn("n_questions", F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def content_key(fields: dict[str, Column], namespace: str, version: str) -> Column:
    """A 64-digit key of the work: sha256 of the fields as JSON in the order of their names, with namespace and version."""
    payload = F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("|", F.lit(namespace), F.lit(version), payload), 256)


def split_cached(df: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows with their cached results, distinct keys that have none). Only keys are joined, not texts."""
    hits = df.join(cache, key)
    return hits, df.select(key).distinct().join(cache.select(key), key, "left_anti")


def first_of(df: DataFrame, key: str) -> DataFrame:
    """Of rows that share a key the least one in the order of the other columns, nulls first."""
    return df.groupBy(key).agg(F.min(F.struct(*(c for c in df.columns if c != key))).alias("_row")).select(key, "_row.*")


def apply_outcomes(posts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``posts`` with ``outcomes(post_id, outcome, error, version)``: done sets the version and clears the error, failed sets
    the error, skipped the reason. Of several outcomes of a post the least in the order of outcome, error, version counts."""
    outcomes = first_of(outcomes.select("post_id", "outcome", "error", "version"), "post_id")
    o = outcomes.select(F.col("post_id").alias("id"), "outcome", "error", "version")
    done = F.col("outcome") == "done"
    return posts.join(o, "id", "left").withColumns({
        "extract_status": F.coalesce("outcome", "extract_status"),
        "extract_error": F.when(done, None).when(F.col("outcome").isNotNull(), F.col("error")).otherwise(F.col("extract_error")),
        "extract_version": F.when(done, F.col("version")).otherwise(F.col("extract_version")),
    }).drop("outcome", "error", "version")


def retry_batch(posts: DataFrame, statuses: list[str], limit: int) -> DataFrame:
    """The newest posts in one of the statuses."""
    return posts.filter(F.col("extract_status").isin(*statuses)).orderBy(F.desc("fetched_at"), F.desc("id")).limit(limit)


def stale_posts(posts: DataFrame, version: int) -> DataFrame:
    return posts.filter(F.col("extract_version") < version)


def requeue_stale(posts: DataFrame, version: int) -> DataFrame:
    return posts.withColumn("extract_status", F.when(F.col("extract_version") < version, "pending").otherwise(F.col("extract_status")))
