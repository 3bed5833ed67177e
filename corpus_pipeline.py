"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), calls one operator of ``quizmill.llm`` on all its documents and returns what it keeps;
``run`` writes each result as Parquet and hands it on. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from quizmill.llm.common import materialise, small, table

KEEP_SCORE = 0.7


def nested(docs: DataFrame, *own) -> DataFrame:
    """Each row as one column ``doc``, beside what a stage derives from it, so that no column of ``docs`` can clash with one
    of a stage."""
    return docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")).select("*", *own)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, doc_id, text`` with ``_row``, a 64-bit hash that differs for rows of different id or text, null ids and texts included.

    Stages decide by it, as ids may be null or repeated with other texts. A second hash shows whether two rows share one by
    chance; then another seed is taken.
    """
    parts = [F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text"]
    seed = 0
    while True:
        rows = nested(docs, F.xxhash64(*parts, F.lit(seed)).alias("_row"))
        other = F.xxhash64(F.lit(seed), *parts)
        met = rows.select("_row", other.alias("o")).groupBy("_row").agg(F.min("o").alias("a"), F.max("o").alias("b"))
        if met.filter("a <> b").isEmpty():
            return rows
        seed += 1


def as_documents(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` of keyed rows for an operator, the key in place of the id."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of keyed ``rows`` without those of ``gone(doc_id)``, keys that are broadcast only if a count shows that
    they are few."""
    return rows.join(small(gone.select(F.col("doc_id").alias("_row"))), "_row", "left_anti").select("doc.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below KEEP_SCORE go, those without an id, and null, empty and very long texts, like any other. The
    classifier learns from the labels of documents of this stage's input; where none has a label there is no score, and all
    rows stay."""
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    if model is None:
        return docs
    rows = keyed(docs)
    scores = materialise(quality.score(as_documents(rows), model), "scores")
    return without(rows, scores.filter(F.col("score") < KEEP_SCORE).select("doc_id").distinct())


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null ones counting as empty, one row stays, that with the largest id. A row without an id stays only if
    no equal text has one. Rows that share an id but not the text, and rows without an id whose texts differ, do not touch
    each other. Very long texts are compared whole.

    Of rows that repeat the id that stays and its text, the first in the order of text (letters in capitals may differ) and
    the other columns stays.
    """
    found = materialise(exact_dedup.exact_dedup(docs, keep="largest"), "exact")
    norm = exact_dedup.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = nested(docs, F.sha2(norm.cast("binary"), 256).alias("_hash"))

    def match(keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), 120)
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_sha")), how)

    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    again = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").count().filter("count > 1")
    again = materialise(again.select("doc_id", "text_sha256"), "repeats")
    if again.isEmpty():
        return match(gone, "left_anti").select("doc.*")
    one = match(again, "left_semi").groupBy("doc_id", "_hash").agg(F.min(F.struct("text", "doc")).alias("r")).select("r.doc.*")
    return match(gone.union(again), "left_anti").select("doc.*").unionByName(one)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity of 0.8) the row with the smallest id stays; rows without
    an id come last, and of rows that share the id one stays. Null, empty and blank texts have no near duplicates; very long
    ones are compared whole."""
    rows = keyed(docs)
    found = materialise(jaccard_join.jaccard_join(as_documents(rows), k=5, threshold=80).select("doc_id", "component_id"), "near")
    linked = found.filter("doc_id <> component_id").select("component_id").distinct()
    members = found.join(small(linked), "component_id", "left_semi").select(F.col("doc_id").alias("_row"), "component_id")
    members = rows.select("_row", F.col("doc_id").alias("id")).join(small(members), "_row").distinct()
    members = materialise(members, "components")
    first = F.min(F.struct(F.col("id").isNull(), "id", "_row"))
    best = members.groupBy("component_id").agg(first.alias("first")).select("component_id", F.col("first._row").alias("best"))
    gone = members.join(small(best), "component_id").filter("_row <> best").select(F.col("_row").alias("doc_id"))
    return without(rows, gone)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or a whole shorter item, go, those without an id too. Null and
    empty texts hold none and stay; very long ones are searched whole."""
    rows = keyed(docs)
    found = materialise(decontaminate.decontaminate(as_documents(rows), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated"), "leaks")
    return without(rows, found.filter("contaminated").select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences of permitted lengths, which are written and read back; every row has
    pieces, null and empty texts that of the end id alone."""
    return packing.placed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None  # the classifier and the packing have no SQL form; tests check each stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
