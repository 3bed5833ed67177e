"""Buckets (company, position, period): candidates, near-duplicate clusters, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quizmill.functions.times import period_label
from quizmill.session import small, stored

BUCKET = ["company_id", "position_id", "period"]
#: Good posts whose questions and links meet in one task.
POSTS_A_TASK = 20_000


def active_pairs(posts: DataFrame, links: DataFrame, min_quality: int = 30) -> DataFrame:
    """Distinct (company, position) with a done post of at least ``min_quality``."""
    good = posts.filter((F.col("extract_status") == "done") & (F.col("quality_score") >= min_quality)).select(F.col("id").alias("post_id"))
    return links.join(good, "post_id", "left_semi").select("company_id", "position_id").distinct()


def bucket_candidates(posts: DataFrame, links: DataFrame, questions: DataFrame, by_period: bool = False, min_quality: int = 30, top_n: int = 100, vector: str = "embedding", post: bool = False) -> DataFrame:
    """The ``top_n`` questions of every bucket: ``company_id, position_id, period, rank, question_id, quality_score``, and ``post_id``
    if ``post`` asks for it.

    Done posts of sufficient score and questions with a vector count; order: score (nulls last), then the larger id. Only
    ids and scores meet the links that multiply them, and Spark limits groups before the shuffle by bucket. For that it sorts
    what a task has; posts are dealt to as many tasks as their number asks for, so that this does not grow with the table.
    """
    period = period_label(F.col("posted_at")) if by_period else F.lit("all")
    good = posts.filter((F.col("extract_status") == "done") & (F.coalesce("quality_score", F.lit(0)) >= min_quality))
    good = good.select(F.col("id").alias("post_id"), "quality_score", period.alias("period"))
    tasks = -(-good.count() // POSTS_A_TASK)
    if tasks > 1:
        good = good.repartition(tasks, "post_id")
    asked = questions.filter(F.col(vector).isNotNull()).select("post_id", F.col("id").alias("question_id"))
    rows = good.join(asked, "post_id").join(links, "post_id")
    if by_period:
        rows = rows.filter("period is not null")
    rank = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(F.desc_nulls_last("quality_score"), F.desc("question_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top_n).select(*BUCKET, "rank", "question_id", "quality_score", *(["post_id"] if post else []))


def of_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``rows(question_id, ..)`` of candidates. These are few, and where their ids can be sent to all tasks the rows, with their
    texts and vectors, are filtered before any shuffle. ``candidates`` are read twice, so they are best stored."""
    return rows.join(small(candidates.select("question_id").distinct(), 16), "question_id", "left_semi")


def fingerprints(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Per bucket ``candidate_count`` and ``fingerprint``: the same for the same set of questions, in whatever order, and another
    one, but for a chance of 2^-64, if a question or its content differs. Hashes of questions are combined by a sum and
    an exclusive or, in part before the shuffle."""
    candidates = stored(candidates, "candidates")
    q = questions.select(F.col("id").alias("question_id"), "content")
    rows = candidates.join(of_candidates(q, candidates), "question_id").select(*BUCKET, F.xxhash64("question_id", "content").alias("h"), F.xxhash64("content", "question_id", F.lit(1)).alias("g"))
    out = rows.groupBy(*BUCKET).agg(F.count("*").alias("candidate_count"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("g").alias("x"))
    return out.select(*BUCKET, "candidate_count", F.concat_ws(":", F.col("s").cast("string"), F.col("x").cast("string")).alias("fingerprint"))


def cluster_rows(vectors: list, threshold: float) -> tuple[list[int], list[int]]:
    """(representatives, their frequencies) of vectors in rank order: each goes to the most similar representative (the first
    of equal ones) if that reaches ``threshold``, else represents itself; one without a vector always does."""
    kept, freq, held = [], [], []  # held: cluster of each row of the matrix
    matrix, n = None, 0
    for i, v in enumerate(vectors):
        if v is not None:
            x = np.asarray(v, float)
            if n:
                sims = matrix[:n] @ x
                best = int(sims.argmax())
                if sims[best] >= threshold:
                    freq[held[best]] += 1
                    continue
            if matrix is None:
                matrix = np.zeros((len(vectors), len(x)))
            matrix[n] = x
            n += 1
            held.append(len(kept))
        kept.append(i)
        freq.append(1)
    return kept, freq


def cluster_questions(candidates: DataFrame, vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Clusters of each bucket: ``company_id, position_id, period, question_id, quality_score, freq, place`` ordered by
    frequency, score, and rank. ``vectors(question_id, embedding)`` join the candidates only here; a bucket holds at most
    as many rows as there are candidates a bucket."""
    rows = candidates.join(vectors, "question_id", "left").select(*BUCKET, "rank", "question_id", "quality_score", "embedding")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        kept, freq = cluster_rows(list(pdf["embedding"]), threshold)
        out = pdf.loc[kept, [*BUCKET, "rank", "question_id", "quality_score"]].assign(freq=freq)
        out["_s"] = out["quality_score"].fillna(-1)
        out = out.sort_values(["freq", "_s", "rank"], ascending=[False, False, True], kind="stable")
        return out.assign(place=range(1, len(out) + 1))[[*BUCKET, "question_id", "quality_score", "freq", "place"]]

    return rows.groupBy(*BUCKET).applyInPandas(cluster, "company_id long, position_id long, period string, question_id long, quality_score int, freq int, place int")


def question_block(clusters: DataFrame) -> DataFrame:
    """The numbered list of each bucket as text, from ``clusters(.., place, freq, category, content)``."""
    item = F.array_sort(F.collect_list(F.struct("place", "freq", F.coalesce("category", F.lit("")).alias("category"), "content")))

    def line(x):
        mark = F.when(x["category"] != "", F.concat(F.lit(" ["), x["category"], F.lit("]"))).otherwise("")
        return F.concat(F.lpad(x["place"].cast("string"), 3, " "), F.lit("."), mark, F.lit(" (freq="), x["freq"].cast("string"), F.lit(") "), x["content"])

    return clusters.groupBy(*BUCKET).agg(item.alias("items")).select(*BUCKET, F.array_join(F.transform("items", line), "\n").alias("block"))


def summarise_buckets(clusters: DataFrame, topics: int = 10, samples: int = 2, rare: int = 2, unknown: str = "uncategorised") -> DataFrame:
    """A summary record per bucket without a model: ``high_frequency_topics`` (categories by summed frequency, with their
    first questions), ``focus_areas`` (their names), ``edge_cases`` (per category the questions of frequency up to ``rare``),
    ``prep_advice`` (empty)."""
    rows = clusters.withColumn("topic", F.coalesce("category", F.lit(unknown)))
    q = F.struct("place", "content")
    per = rows.groupBy(*BUCKET, "topic").agg(
        F.sum("freq").cast("long").alias("frequency"),
        F.slice(F.array_sort(F.collect_list(q)), 1, samples).alias("first"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("freq") <= rare, q))), 1, samples).alias("rare"),
    )
    rank = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(F.desc("frequency"), "topic"))
    per = per.withColumn("r", rank).filter(F.col("r") <= topics)
    text = lambda c: F.transform(c, lambda x: x["content"])
    top = F.struct("r", "topic", "frequency", text(F.col("first")).alias("sample_questions"))
    edge = F.when(F.size("rare") > 0, F.struct("r", "topic", text(F.col("rare")).alias("questions")))
    out = per.groupBy(*BUCKET).agg(F.array_sort(F.collect_list(top)).alias("t"), F.array_sort(F.collect_list(edge)).alias("e"))
    return out.select(
        *BUCKET, F.transform("t", lambda x: x.dropFields("r")).alias("high_frequency_topics"), F.transform(F.slice("t", 1, 5), lambda x: x["topic"]).alias("focus_areas"),
        F.transform("e", lambda x: x.dropFields("r")).alias("edge_cases"), F.array().cast("array<string>").alias("prep_advice"),
    )


# The headings of stored summaries.
HEADINGS = ("## 高频考点 Top 10", "## 重点考察方向", "## 易忽略的偏门题", "## 备考建议")


def render_summary(df: DataFrame) -> DataFrame:
    """Adds ``content_md``: four sections, each left out if it is empty. A single object or text in place of a list counts as
    a list of it."""
    for c in ("high_frequency_topics", "focus_areas", "edge_cases", "prep_advice"):
        if not isinstance(df.schema[c].dataType, ArrayType):
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.array(c)))
    n = F.lit("\n")
    quotes = lambda qs: F.array_join(F.transform(F.coalesce(qs, F.array().cast("array<string>")), lambda q: F.concat(F.lit("> "), q, F.lit("\n\n"))), "")
    topics = F.transform("high_frequency_topics", lambda t: F.concat(F.lit("### "), F.coalesce(t["topic"], F.lit("")), F.lit(" <sub>×"), F.coalesce(t["frequency"], F.lit(1)).cast("string"), F.lit("</sub>\n\n"), quotes(t["sample_questions"]), n))
    areas = F.transform("focus_areas", lambda a: F.concat(F.lit("- "), a, n))
    edges = F.transform("edge_cases", lambda e: F.concat(F.lit("### "), F.coalesce(e["topic"], F.lit("")), F.lit("\n\n"), quotes(e["questions"]), n))
    advice = F.transform("prep_advice", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a, n))
    sections = []
    for name, heading, items, gap in (("high_frequency_topics", HEADINGS[0], topics, ""), ("focus_areas", HEADINGS[1], areas, "\n"), ("edge_cases", HEADINGS[2], edges, ""), ("prep_advice", HEADINGS[3], advice, "\n")):
        sections.append(F.when(F.size(name) > 0, F.concat(F.lit(heading + "\n\n"), F.array_join(items, ""), F.lit(gap))).otherwise(""))
    # lines are joined, not ended, by line feeds: the last one goes
    return df.withColumn("content_md", F.regexp_replace(F.concat(*sections), r"\n\z", ""))


def bucket_status(counts: DataFrame, summaries: DataFrame, compare: str = "candidates") -> DataFrame:
    """Per bucket of ``counts(.., candidate_count)`` a ``reason``: no_candidates, unchanged or ok. ``compare="reference"``
    compares the candidates with the stored number of clusters instead of the stored number of candidates."""
    stored = "sample_count" if compare == "reference" else "candidate_count"
    s = summaries.select(*BUCKET, F.col(stored).alias("stored"))
    reason = F.when(F.col("candidate_count") == 0, "no_candidates").when(F.col("candidate_count") == F.col("stored"), "unchanged").otherwise("ok")
    return counts.join(s, BUCKET, "left").select(*BUCKET, "candidate_count", "stored", reason.alias("reason"))


def upsert_summaries(summaries: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Summaries with those of ``new`` in place of the old ones of the same key."""
    cols = ["content_md", "sample_count", "candidate_count"]
    n = new.select(*BUCKET, *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(True).alias("_new"))
    both = summaries.select(*BUCKET, *cols, F.col("updated_at").cast("timestamp").alias("updated_at")).join(n, BUCKET, "full_outer")
    pick = [F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return both.select(*BUCKET, *pick, F.when(F.col("_new"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"))


def bucket_report(status: DataFrame, written: DataFrame) -> DataFrame:
    """Outcome per bucket: candidates, samples, length of the summary, whether it was written, and why."""
    w = written.select(*BUCKET, "sample_count", F.length("content_md").alias("content_length"))
    out = status.join(w, BUCKET, "left")
    return out.select(*BUCKET, "candidate_count", F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"), F.coalesce("content_length", F.lit(0)).cast("long").alias("content_length"), ((F.col("reason") == "ok") & F.col("content_length").isNotNull()).alias("written"), "reason")


def company_position_stats(posts: DataFrame, links: DataFrame, companies: DataFrame, positions: DataFrame) -> DataFrame:
    """Posts, rounded mean score and latest date per company and position, of done posts. Links are unique, so posts are
    counted without a distinct; names join the few groups, not the links."""
    done = posts.filter("extract_status = 'done'").select(F.col("id").alias("post_id"), "quality_score", "posted_at")
    stats = links.join(done, "post_id").groupBy("company_id", "position_id").agg(F.count("*").alias("post_count"), F.round(F.avg("quality_score")).cast("int").alias("avg_quality"), F.max("posted_at").alias("latest"))
    c = companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("company"))
    p = positions.select(F.col("id").alias("position_id"), F.col("canonical").alias("position"))
    return stats.join(c, "company_id").join(p, "position_id").select("company_id", "company", "position_id", "position", "post_count", "avg_quality", "latest")


def corrupt_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries whose text is a JSON object instead of markdown."""
    return summaries.filter(F.trim("content_md").startswith("{") & F.expr("try_parse_json(content_md)").isNotNull())


def list_summaries(summaries: DataFrame, companies: DataFrame, positions: DataFrame, company: str | None = None, position: str | None = None, period: str | None = None, limit: int = 20) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), F.col("canonical").alias("company"))
    p = positions.select(F.col("id").alias("position_id"), F.col("canonical").alias("position"))
    out = summaries.join(c, "company_id").join(p, "position_id")
    for col, value in (("company", company), ("position", position), ("period", period)):
        if value is not None:
            out = out.filter(F.col(col) == value)
    return out.orderBy(F.desc("updated_at"), *BUCKET).limit(limit)


def get_summary(summaries: DataFrame, company_id: int, position_id: int, period: str = "all") -> DataFrame:
    hit = (F.col("company_id") == company_id) & (F.col("position_id") == position_id) & (F.col("period") == period)
    return summaries.filter(hit).withColumn("content_length", F.length("content_md"))
