"""Exact de-duplication by 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import ascii_lower, materialise, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fold_case: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, text_md5``.

    Texts are equal if identical byte for byte after lower-casing A-Z (``fold_case``). Of equal texts the row with the
    ``smallest`` or ``largest`` id stays.

    The grouping key is the 128-bit hash *and* the text itself, so that Spark compares the bytes inside a hash group and a
    hash collision gives two groups. Counts and the id that stays are combined before the shuffle: a group holding a third
    of all rows leaves one row per task. Rows then find their group by hash alone; texts are moved a second time only for
    hashes that really collided.

    Edge cases: null text counts as empty; a null id never stays unless all ids of its group are null; rows that repeat the
    same id and text give as many rows, of which one at most is kept; an empty table gives an empty table; columns besides
    id and text are ignored, whatever their names.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (ascii_lower(text) if fold_case else text).alias("norm"))
    rows = rows.select("doc_id", "norm", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"))

    groups = rows.groupBy("h", "norm").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
    groups = materialise(groups.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size", "keep_id"), "texts")
    collided = groups.groupBy("h").count().filter("count > 1").select("h")

    ids = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies")) if collided.isEmpty() else None
    if ids is not None:
        found = ids.join(groups, "h")
    else:  # texts that share a hash: tell them apart by a second, 256-bit hash of the bytes
        full = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        found = full.groupBy("doc_id", "h", "text_sha256").agg(F.count("*").alias("copies")).join(groups, ["h", "text_sha256"])
    one = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    found = found.select("doc_id", "keep_id", "group_size", "text_sha256", F.lower(F.hex("h")).alias("text_md5"), one)
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "text_md5")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
