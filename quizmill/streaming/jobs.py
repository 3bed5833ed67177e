"""Streams: ingest of crawl files, running counters, throughput; and the daily chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.operators.aggregate import BUCKET, bucket_candidates, bucket_status, cluster_questions, fingerprints, of_candidates, render_summary, summarise_buckets
from quizmill.operators.answers import answer_targets
from quizmill.operators.extract import first_of
from quizmill.operators.ingest import dedup_records, import_posts
from quizmill.session import stored
from quizmill.sources.files import flatten_records
from quizmill.sources.schemas import API_RECORD, CRAWL_POST


#: What the ingest stream stores: posts by a hash of their URL, then by the batch that brought them.
STORE = CRAWL_POST + ", bucket int, batch long"


def url_bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, base: str, source: str = "tab", files_per_batch: int = 1, late: str = "1 hour", buckets: int = 64):
    """New files of nested records under ``path`` -> posts under ``out``, each URL once; known posts are skipped. Runs until all
    files that are there have been read.

    Records are flattened. A record that is sent again (the same URL and a hash of all fields) within ``late`` of its first arrival is
    dropped by a stateful operator, whose state a watermark on the time of arrival clears; no record counts as late itself.
    What stays is merged into the store: of a batch the first row of a URL wins (by creation time, content id, title), and
    an anti join with the stored posts skips known URLs, however long ago they came. The store is partitioned by a hash of the
    URL, and a batch reads the URLs of the partitions that its own URLs fall into. A batch that is run again overwrites what
    it has written itself. Records without a title or URL are dropped.
    """
    spark.createDataFrame([], STORE).write.partitionBy("bucket", "batch").mode("append").parquet(out)  # a store that can be read
    records = spark.readStream.schema(API_RECORD).option("maxFilesPerTrigger", files_per_batch).json(path)
    posts = flatten_records(records, base, source).filter("length(title) > 0 and detail_url is not null")
    marked = posts.withColumn("_same", F.xxhash64(*posts.columns)).withColumn("_seen", F.current_timestamp())
    once = marked.withWatermark("_seen", late).dropDuplicatesWithinWatermark(["detail_url", "_same"]).drop("_seen", "_same")

    def store(batch: DataFrame, number: int) -> None:
        merge_posts(batch, out, number, buckets)

    return once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_posts(batch: DataFrame, out: str, number: int, buckets: int = 64) -> DataFrame:
    """Append the posts of ``batch`` whose URL the store lacks; returns the stored URLs it was compared with."""
    first = dedup_records(batch, ["detail_url"], ["created_at_ms", "content_id", "title"]).withColumn("bucket", url_bucket(F.col("detail_url"), buckets))
    first = stored(first, "arrived")
    touched = [r[0] for r in first.select("bucket").distinct().collect()]  # ``buckets`` at most
    known = stored_posts(batch.sparkSession, out).filter(F.col("bucket").isin(touched) & (F.col("batch") < number)).select("bucket", "detail_url")
    new = first.join(known, ["bucket", "detail_url"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
    new.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
    return known


def stored_posts(spark: SparkSession, out: str) -> DataFrame:
    """What the ingest stream has stored."""
    return spark.read.schema(STORE).parquet(out)


def counters_stream(events: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Running count and total per stage (or per stage and status) of a stream or batch of events; state holds a row for each."""
    return events.groupBy(*by).agg(F.count("*").alias("runs"), F.sum(F.round(F.col("ms") * 100).cast("long")).alias("total_hundredths"))


def throughput_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute. In append mode a minute is given once, when the watermark, ``late`` behind the latest event so
    far, has passed its end; events that come later than that are dropped and change no minute."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


def final_state(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now; the whole result after the last batch, written to ``out`` with every batch."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def appended(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now; the rows that it appends, once each, are files under ``out``."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def daily_update(posts: DataFrame, links: DataFrame, questions: DataFrame, batch: DataFrame, version: int, vector: str = "embedding", outcomes: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """Counts of one daily run, a row per step: import the batch, posts to process (pending or failed), buckets to aggregate,
    questions that need an answer.

    ``outcomes(post_id, outcome, quality_score)`` of processed posts take effect before buckets and questions are counted. With
    ``summaries`` a further step counts the buckets that are changed since theirs were written; the others are left alone.
    """
    merged, counts = import_posts(batch, posts)
    steps = [counts.select(F.lit("imported").alias("step"), F.col("new").alias("n"))]
    waiting = merged.filter(F.col("extract_status").isin("pending", "failed"))
    steps.append(waiting.agg(F.count("*").alias("n")).select(F.lit("to_process").alias("step"), "n"))
    after = merged.select("id", "posted_at", "extract_status").join(posts.select("id", "quality_score"), "id", "left")
    if outcomes is not None:
        o = outcomes.select(F.col("post_id").alias("id"), "outcome", F.col("quality_score").alias("score"))
        after = after.join(o, "id", "left").select("id", "posted_at", F.coalesce("outcome", "extract_status").alias("extract_status"), F.coalesce("score", "quality_score").alias("quality_score"))
    buckets = bucket_candidates(after, links, questions, vector=vector).groupBy(*BUCKET).agg(F.count("*").alias("candidate_count"))
    steps.append(buckets.agg(F.count("*").alias("n")).select(F.lit("buckets").alias("step"), "n"))
    if summaries is not None:
        changed = bucket_status(buckets, summaries).filter("reason = 'ok'")
        steps.append(changed.agg(F.count("*").alias("n")).select(F.lit("changed_buckets").alias("step"), "n"))
    targets = answer_targets(questions, after, links, version)
    steps.append(targets.agg(F.count("*").alias("n")).select(F.lit("answer_targets").alias("step"), "n"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def daily_run(posts: DataFrame, links: DataFrame, questions: DataFrame, vectors: DataFrame, summaries: DataFrame, batch: DataFrame, outcomes: DataFrame, version: int, now: str, threshold: float = 0.92) -> dict[str, DataFrame]:
    """One daily run over whole tables: ``posts`` (with what ``batch`` brought, and ``outcomes`` in effect), ``changed`` buckets,
    ``summaries`` (with those of changed buckets written anew), ``targets`` (questions that need an answer) and ``counts``.

    Only buckets of companies and positions of processed posts are computed. A bucket is changed if the fingerprint of its
    set of questions differs from the stored one, so questions that are replaced by as many others show; buckets that lost
    all candidates keep their summary. ``summaries`` has a column ``fingerprint``, null where none is known.
    ``questions(id, post_id, content, category, ..)`` are those after processing, ``vectors(question_id, embedding)`` theirs.
    A second run on what the first one returned imports and changes nothing.
    """
    merged, counts = import_posts(batch, posts)
    o = first_of(outcomes, "post_id").select(F.col("post_id").alias("id"), F.col("outcome").alias("_outcome"), F.col("quality_score").alias("_score"))
    after = merged.drop("outcome").join(o, "id", "left")
    after = after.withColumns({"extract_status": F.coalesce("_outcome", "extract_status"), "quality_score": F.coalesce("_score", "quality_score")}).drop("_outcome", "_score")
    after = stored(after, "posts")

    touched = links.join(o.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("company_id", "position_id").distinct()
    near = links.join(stored(touched, "touched"), ["company_id", "position_id"], "left_semi")
    asked = questions.join(vectors.select(F.col("question_id").alias("id"), F.lit(True).alias("_vector")), "id", "left")
    candidates = stored(bucket_candidates(after, near, asked, vector="_vector"), "candidates")
    prints = fingerprints(candidates, questions)
    old = summaries.select(*BUCKET, F.col("fingerprint").alias("_old"))
    changed = prints.join(old, BUCKET, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")
    changed = stored(changed, "changed")

    asking = stored(candidates.join(changed, BUCKET, "left_semi"), "asking")
    clusters = stored(cluster_questions(asking, of_candidates(vectors, asking), threshold), "grouped")
    texts = of_candidates(questions.select(F.col("id").alias("question_id"), "category", "content"), clusters)
    clusters = stored(clusters.join(texts, "question_id"), "clusters")
    sizes = clusters.groupBy(*BUCKET).agg(F.count("*").cast("int").alias("sample_count"))
    new = render_summary(summarise_buckets(clusters)).select(*BUCKET, "content_md").join(sizes, BUCKET).join(changed.withColumn("candidate_count", F.col("candidate_count").cast("int")), BUCKET)
    new = stored(new.withColumn("updated_at", F.lit(now).cast("timestamp")), "written")
    kept = summaries.join(new.select(*BUCKET), BUCKET, "left_anti")
    written = kept.unionByName(new, allowMissingColumns=True)

    targets = answer_targets(questions, after, links, version)
    step = lambda name, n: n.select(F.lit(name).alias("step"), F.col(n.columns[0]).alias("n"))
    every = step("imported", counts.select("new"))
    for name, rows in (("to_process", merged.filter(F.col("extract_status").isin("pending", "failed"))), ("buckets", prints), ("changed_buckets", changed), ("answer_targets", targets)):
        every = every.unionByName(step(name, rows.agg(F.count("*"))))
    return {"posts": after, "changed": changed, "summaries": written, "targets": targets, "counts": every}
