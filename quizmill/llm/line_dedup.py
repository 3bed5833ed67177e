"""Line-level de-duplication: lines that many documents share are dropped, all but one of their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import BROADCAST_BYTES, ascii_lower, materialise, small, table

#: Hashes of lines that are broadcast at most, at 64 bytes each.
BROADCAST_HASHES = BROADCAST_BYTES // 64
#: Rows of one hash, about, that meet in one task where hashes are joined by a shuffle.
SALT_ROWS = 100_000

#: Fixed by the rule: what is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_text``.

    A line's key is the line stripped of blanks and with A-Z lower-cased. Keys of at least ``min_chars`` code points found
    in at least ``min_docs`` distinct documents lose all their lines except those in the largest id that holds the key.

    Plan: explode the distinct keys of each document, hash them to 128 bits and write (document, hash) rows once. Documents
    per hash are counted with partial sums before the shuffle, so a line that a third of all documents hold leaves one row
    per task. The hashes over the threshold meet the written rows again: broadcast if a count shows that they are few, else
    by a join in which each hash is split by a salt, as many ways as its count asks for. What reaches the texts is a set of
    hashes per document that lost a line; the lines are then filtered by position inside their own row, without moving or
    sorting them.

    Edge cases: null or empty text is one empty line; rows that repeat an id count as one document, and each loses the lines
    that any of them holds in excess; a null id counts as no document and keeps all its lines; a very long text stays in its own
    row, of which only hashes of lines move; an empty table gives an empty table; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)

    def key(c):
        return ascii_lower(F.trim(c, F.lit(BLANKS)))

    def digest(c):
        return F.unhex(F.md5(c.cast("binary")))

    long_keys = F.array_distinct(F.filter(F.transform(lines, key), lambda k: F.length(k) >= min_chars))
    held = src.filter("doc_id is not null").select("doc_id", F.explode(long_keys).alias("k")).select("doc_id", digest(F.col("k")).alias("h"))
    held = materialise(held, "lines")
    # a hash comes once for each row; only if ids repeat must rows of one id be told apart
    repeats = src.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = not repeats.isEmpty()
    once = held.distinct() if again else held
    common = once.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    common = materialise(common, "common")
    if common.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        found = held.join(F.broadcast(common.select("h", "last")), "h")
    else:
        spread = common.select("h", "last", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
        dealt = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))  # as often as its own count asks for
        heavy = small(spread.filter("salts > 1").select("h", "salts"), 64)
        salted = held.join(heavy, "h", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        found = salted.drop("salts").join(dealt.drop("salts"), ["h", "salt"])
    lost = found.filter(F.col("doc_id") < F.col("last")).groupBy("doc_id").agg(F.collect_set("h").alias("lost"))

    stays = F.filter(lines, lambda x: ~((F.length(F.trim(x, F.lit(BLANKS))) >= min_chars) & F.array_contains("lost", digest(key(x)))))
    out = src.join(lost, "doc_id", "left").withColumn("kept_lines", F.when(F.col("lost").isNull(), lines).otherwise(stays))
    n_lines = F.size(lines).cast("long")
    return out.select(
        "doc_id",
        n_lines.alias("n_lines"),
        (n_lines - F.size("kept_lines")).alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join("kept_lines", "\n")).alias("kept_text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), c AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.pos, l.line, c.k IS NULL OR l.doc_id = c.last AS stays FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
