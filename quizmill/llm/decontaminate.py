"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Index: one posting (term, doc, pos) for every place where a document uses a term of the test set, or any term if the index is
to serve later test sets. Search: a window of a test item is looked up by its rarest terms. The postings of the rarest one
aim at places of the next rarest; postings near the aim are proximity matches, those at it alignments (document position minus
item position). Of each alignment the offset-adjusted list of the whole item is intersected with the index, and runs of
matching places as long as a window are exact matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import ascii_lower, materialise, small, table

#: Fixed by the rule: what separates words. A-Z are lower-cased, so that on a text as it is they belong to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The posting that closes each document; its position is the number of words. No word can be a line feed.
END = "\n"
#: Words that two rarest terms may stand off their distance in the item, for a proximity match.
SLOP = 3


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def words(text: Column) -> Column:
    return raw_words(ascii_lower(F.coalesce(text, F.lit(""))))


def test_words(items: DataFrame) -> DataFrame:
    """``item, item_id, size, p, term`` of every word of the items, one row each, ``item`` being a hash of id and words. Rows
    that repeat an item's id and words count once; items without words have none."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).distinct()
    places = ws.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "ws").alias("item"), "item_id", F.size("ws").alias("size"), F.posexplode("ws").alias("p", "w"))
    return places.select("item", "item_id", "size", "p", "w", F.xxhash64("w").alias("term"))


def build_index(docs: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Postings ``term long, doc long, pos int, doc_id``: the words of ``tests`` as they stand in ``docs``, all words without it,
    and the closing posting of every row, which alone carries its id. ``doc`` numbers the rows.

    An index of all words serves any test set. The vocabulary of the tests is broadcast if a count shows that it is small,
    else joined by a shuffle. The index is written once to the shared folder; the postings stay where the scan made them,
    so nothing is shuffled here. Terms are 64-bit hashes: of a million distinct words two share one with a chance of 3e-8.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), raw_words(F.col("text")).alias("ws"))
    posted = rows.select("doc_id", "doc", F.posexplode(F.concat("ws", F.array(F.lit(END)))).alias("pos", "raw"))
    posted = posted.select("doc_id", "doc", "pos", ascii_lower(F.col("raw")).alias("w"))
    if tests is not None:
        vocabulary = materialise(tests.select("w").union(tests.sparkSession.range(1).select(F.lit(END))).distinct(), "vocabulary")
        most = vocabulary.agg(F.max(F.octet_length("w"))).first()[0] or 0
        posted = posted.join(small(vocabulary, most + 40), "w")
    own = F.when(F.col("w") == END, F.col("doc_id"))
    return materialise(posted.select(F.xxhash64("w").alias("term"), "doc", "pos", own.alias("doc_id")), "postings")


def anchors(index: DataFrame, tests: DataFrame, window: int) -> DataFrame:
    """The two rarest places of each window of each item, of those whose term the index holds, without repeats:
    ``item, p1, t1, p2, t2, whole``; ``whole`` if the index holds all terms of such a window.

    Frequencies are counted over the whole index. With one place only, it stands twice.
    """
    freq = index.groupBy("term").agg(F.count("*").alias("n"))
    known = tests.join(small(materialise(freq.join(small(materialise(tests.select("term").distinct(), "terms")), "term", "left_semi"), "frequencies")), "term")
    last = F.greatest(F.col("size") - window, F.lit(0))
    offsets = F.sequence(F.greatest(F.col("p") - window + 1, F.lit(0)), F.least(F.col("p"), last))
    places = known.withColumn("off", F.explode(offsets))
    every = Window.partitionBy("item", "off")
    rarest = every.orderBy("n", "p")
    ranked = places.select(
        "item", F.col("p").alias("p1"), F.col("term").alias("t1"), F.lead("p").over(rarest).alias("p2"), F.lead("term").over(rarest).alias("t2"),
        F.row_number().over(rarest).alias("rank"), (F.count("*").over(every) == F.least("size", F.lit(window))).alias("whole"),
    )
    best = ranked.filter("rank = 1").select("item", "p1", "t1", F.coalesce("p2", "p1").alias("p2"), F.coalesce("t2", "t1").alias("t2"), "whole")
    return best.groupBy("item", "p1", "t1", "p2", "t2").agg(F.bool_or("whole").alias("whole"))


def near_places(index: DataFrame, tests: DataFrame, window: int, slop: int) -> DataFrame:
    """``doc, item, diag, exact, near``: places where the two rarest terms of a window stand up to ``slop`` words off their
    distance; ``exact`` if at it and the index holds the whole window, ``near`` if the terms have two places.

    Positions are joined by buckets of ``slop + 1`` words and their neighbours, not pairwise.
    """
    pairs, step = materialise(anchors(index, tests, window), "anchors"), slop + 1
    first = index.join(small(pairs, 56), index["term"] == pairs["t1"]).select("item", "doc", "pos", "p1", "p2", "t2", "whole")
    first = first.withColumn("aim", F.col("pos") + F.col("p2") - F.col("p1"))
    first = first.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("aim") / step) + i for i in (-1, 0, 1)))))
    second = index.join(small(pairs.select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    second = second.select(F.col("term").alias("t2"), "doc", F.col("pos").alias("pos2"), F.floor(F.col("pos") / step).alias("bucket"))
    met = first.join(second, ["t2", "doc", "bucket"]).filter(F.abs(F.col("pos2") - F.col("aim")) <= slop)
    met = met.filter((F.col("p1") == F.col("p2")) & (F.col("pos") == F.col("pos2")) | (F.col("p1") != F.col("p2")) & (F.col("pos") != F.col("pos2")))
    exact = F.bool_or(F.col("whole") & (F.col("pos2") == F.col("aim")))
    return materialise(met.groupBy("doc", "item", (F.col("pos") - F.col("p1")).alias("diag")).agg(exact.alias("exact"), F.bool_or(F.col("p1") != F.col("p2")).alias("near")), "near")


def phrase_matches(index: DataFrame, tests: DataFrame, aligned: DataFrame, window: int) -> DataFrame:
    """``doc, item_id, start, len``: runs of words of a document that equal a run of an item, each at least a window long
    (``window`` words, or the whole of a shorter item).

    Only postings of documents with an alignment are met again, by document, place and term.
    """
    expected = aligned.join(tests, "item").select("doc", "item", "item_id", "size", "diag", "p", "term", (F.col("diag") + F.col("p")).cast("int").alias("pos"))
    held = index.select("term", "doc", "pos").join(small(materialise(aligned.select("doc").distinct(), "aligned")), "doc", "left_semi")
    met = expected.join(held, ["doc", "pos", "term"])
    order = Window.partitionBy("doc", "item", "diag").orderBy("p")
    runs = met.withColumn("run", F.col("p") - F.row_number().over(order)).groupBy("doc", "item", "item_id", "size", "diag", "run")
    runs = runs.agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
    return runs.filter(F.col("len") >= F.least("size", F.lit(window))).select("doc", "item_id", "start", "len")


def covered(hits: Column) -> Column:
    """Words inside the union of the hits, which are ordered by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        new = F.greatest(end - F.greatest(acc["end"], h["start"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(hits, zero, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = SLOP, index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, item_ids, hits, contaminated, n_near``.

    ``n_hit`` counts the words of the document inside any occurrence of a window, ``item_ids`` lists the items with
    occurring windows as strings in string order; ``hits`` are the runs of words that contain them. ``n_near`` counts the
    items of which a window's two rarest terms that occur at all stand within ``slop`` words of their distance in the item;
    such matches never make a document contaminated. ``index`` is what ``build_index`` made of ``docs``, if at hand.

    Edge cases: a null or wordless text has no words and no hits; null or wordless items match nothing; rows that repeat a
    document's id are searched each, a null id too; items without an id match, but are not listed or counted; a very long
    text is postings like any other; empty tables give no hits or an empty table; columns besides the ids and texts are
    ignored.
    """
    tests = materialise(test_words(items), "tests")
    index = build_index(docs, tests) if index is None else index
    found = near_places(index, tests, window, slop)
    hits = phrase_matches(index, tests, found.filter("exact").select("doc", "item", "diag"), window)
    hits = hits.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "len", "item_id"))).alias("hits"))
    near = found.filter("near").join(small(materialise(tests.select("item", "item_id").distinct(), "items")), "item")
    near = near.groupBy("doc").agg(F.count_distinct("item_id").alias("n_near"))
    closed = index.filter(F.col("term") == F.xxhash64(F.lit(END))).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = closed.join(hits, "doc", "left").join(near, "doc", "left")
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["item_id"].cast("string")), lambda x: x.isNotNull())))
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce(covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), "hits", F.col("hits").isNotNull().alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), "contaminated", "n_near")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, ws, least(len(ws), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[o:o + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS o FROM b)
), dw AS (
  SELECT doc_id, n, o, array_to_string(ws[o:o + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS o FROM d, (SELECT DISTINCT n FROM bw))
), h AS (SELECT doc_id, item_id, o, n FROM dw JOIN bw USING (n, w)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id),
tw AS (  -- proximity: words of items, with places from 0
  SELECT item, item_id, len(ws) AS size, unnest(ws) AS w, unnest(range(len(ws))) AS p
  FROM (SELECT row_number() OVER () AS item, item_id, ws FROM (SELECT DISTINCT item_id, ws FROM b))
), dp AS (SELECT doc_id, w, pos FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d) WHERE w IN (SELECT w FROM tw)),
f AS (SELECT w, count(*) AS n FROM dp GROUP BY w),
tr AS (
  SELECT item, item_id, p, w, row_number() OVER (PARTITION BY item, o ORDER BY n, p) AS r, o
  FROM (SELECT *, unnest(range(greatest(p - 9, 0), least(p, greatest(size - 10, 0)) + 1)) AS o FROM tw JOIN f USING (w))
), tp AS (
  SELECT DISTINCT x.item, x.item_id, x.p AS p1, x.w AS w1, y.p AS p2, y.w AS w2 FROM tr x JOIN tr y ON x.item = y.item AND x.o = y.o AND x.r = 1 AND y.r = 2
), nr AS (
  SELECT x.doc_id, count(DISTINCT item_id) AS n_near FROM tp JOIN dp x ON x.w = w1 JOIN dp y ON y.w = w2 AND y.doc_id = x.doc_id
  WHERE abs(y.pos - (x.pos + p2 - p1)) <= 3 AND x.pos <> y.pos GROUP BY x.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
