"""Hard-negative mining with segment summaries.

A vector is cut into segments. Of each the mean and the deviation are stored. On a segment of n components the inner product of
x and y is n * mean(x) * mean(y) plus the product of what is left of the means, which lies within n * dev(x) * dev(y) of zero.
So the sum over segments bounds the score from both sides by a short inner product. Coarse summaries follow from fine ones:
bounds are taken over one segment, then two, four, ..., each time only for the pairs that are still open, and exact scores
only for the pairs that no bound decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import materialise, table
from quizmill.operators.blocks import block_join, block_rows

#: Segments of the stored summaries, a power of two.
SEGMENTS = 8
#: Pairs of an anchor and a row that a task weighs at once.
PAIRS = 1 << 20
#: Components lie within this, see ``mine``.
MOST = float(1 << 62)
FOUND = "anchor long, slot int, row long, vec_id long, score long"


def segment_lengths(width: int) -> np.ndarray:
    """Lengths of the finest segments: as even as possible, SEGMENTS of them or fewer for short vectors."""
    count = SEGMENTS
    while count > max(width, 1):
        count //= 2
    return np.diff(np.linspace(0, width, count + 1).astype(int))


def summaries(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(rows, 2, segments): means and deviations of the finest segments."""
    at, n = np.concatenate(([0], np.cumsum(lengths)[:-1])), np.maximum(lengths, 1)
    if not x.shape[1]:
        return np.zeros((len(x), 2, len(lengths)))
    mean = np.add.reduceat(x, at, axis=1) / n
    left = x - np.repeat(mean, lengths, axis=1)
    return np.stack([mean, np.sqrt(np.add.reduceat(left * left, at, axis=1) / n)], axis=1)


def levels(s: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From one segment to the finest: (means, deviations), each times the root of the segments' lengths."""
    mean, var, n = s[:, 0], s[:, 1] ** 2, lengths.astype(float)
    out = []
    while True:
        root = np.sqrt(n)
        out.append((mean * root, np.sqrt(var) * root))
        if len(n) == 1:
            return out[::-1]
        total = np.maximum(n[::2] + n[1::2], 1)
        p, q = n[::2] / total, n[1::2] / total
        apart = mean[:, ::2] - mean[:, 1::2]
        var = p * var[:, ::2] + q * var[:, 1::2] + p * q * apart * apart
        mean, n = p * mean[:, ::2] + q * mean[:, 1::2], n[::2] + n[1::2]


def _exact(x: np.ndarray) -> np.ndarray:
    """Doubles where inner products of such vectors are exact in them, else 64-bit integers."""
    most = float(np.abs(x).max(initial=0))
    return x if most * most * max(x.shape[1], 1) < 2**53 else np.clip(x, -MOST, MOST).astype(np.int64)


class Side:
    """The rows of a block: numbers, exact vectors and bounds by level."""

    def __init__(self, pdf: pd.DataFrame, width: int):
        self.x, stored = np.stack(pdf["x"].to_numpy()).astype(float), np.stack(pdf["summary"].to_numpy()).astype(float)
        lengths = segment_lengths(width)
        self.levels = levels(stored.reshape(len(pdf), 2, -1), lengths)
        self.row, self.vec_id, self.label = (pdf[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))


def scores_between(a: Side, g: Side, i: slice, j: slice, low: np.ndarray, high: np.ndarray, open_: np.ndarray):
    """(anchor, row, score) of the pairs in ``open_`` whose score lies in [low, high] of its anchor, exactly.

    Bounds are taken for whole blocks while many pairs are open, and for the open pairs alone where these are few.
    """
    for (am, ad), (gm, gd) in zip(a.levels, g.levels):
        am, ad, gm, gd = am[i], ad[i], gm[j], gd[j]
        if not open_.any():
            break
        if open_.mean() > 0.1:
            middle, spread = am @ gm.T, ad @ gd.T
            spread = spread + 0.5 + 1e-9 * (np.abs(middle) + spread)  # scores are whole numbers; rounding is far below
            open_ &= (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
        else:
            u, v = np.nonzero(open_)
            middle, spread = np.einsum("ij,ij->i", am[u], gm[v]), np.einsum("ij,ij->i", ad[u], gd[v])
            spread = spread + 0.5 + 1e-9 * (np.abs(middle) + spread)
            open_[u, v] = (middle + spread >= low[u]) & (middle - spread <= high[u])
    u, v = np.nonzero(open_)
    x, y = a.x[i], g.x[j]
    both = _exact(np.concatenate([x, y]))
    x, y = both[: len(x)], both[len(x) :]
    score = (x @ y.T)[u, v] if len(u) > 0.05 * open_.size else np.einsum("ij,ij->i", x[u], y[v])
    fits = (score >= low[u]) & (score <= high[u])
    return u[fits], v[fits], score[fits].astype(np.int64)


def _best(anchor, slot, row, vec_id, score, k):
    """Of each (anchor, slot) the first ``k`` by score, then id, then row number."""
    order = np.lexsort((row, vec_id, -score, slot, anchor))
    group = np.stack([anchor[order], slot[order]])
    new = np.ones(len(order), bool)
    new[1:] = (group[:, 1:] != group[:, :-1]).any(0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _search(a: Side, g: Side, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> pd.DataFrame:
    """The first ``k`` rows of ``g`` for each anchor and each of its windows [low, high], of the anchor's label or of others."""
    held = [np.empty(0, np.int64) for _ in range(5)]
    slots = lows.shape[1]
    floor = lows.astype(float).copy()  # rises to the k-th best score so far
    step = max(1, PAIRS // max(len(a.row), 1))
    for at in range(0, len(g.row), step):
        j = slice(at, at + step)
        for first in range(0, len(a.row), max(1, PAIRS // step)):
            i = slice(first, first + max(1, PAIRS // step))
            allowed = (a.label[i][:, None] == g.label[j][None, :]) == same
            if same:
                allowed &= a.row[i][:, None] != g.row[j][None, :]
            # one bound for all windows of an anchor; each window then takes what is its own
            u, v, score = scores_between(a, g, i, j, floor[i].min(1, initial=np.inf), highs[i].max(1, initial=-np.inf), allowed)
            for slot in range(slots):
                own = (score >= floor[i, slot][u]) & (score <= highs[i, slot][u])
                new = u[own] + first, np.full(int(own.sum()), slot), g.row[j][v[own]], g.vec_id[j][v[own]], score[own]
                held = [np.concatenate(x) for x in zip(held, new)]
        keep = _best(*held, k)
        held = [x[keep] for x in held]
        where, inverse, count = np.unique(held[0] * max(slots, 1) + held[1], return_inverse=True, return_counts=True)
        last = np.full(len(where), np.iinfo(np.int64).max)
        np.minimum.at(last, inverse, held[4])
        full = count == k
        np.put(floor, where[full], np.maximum(np.take(floor, where[full]), last[full]))
    anchor, slot, row, vec_id, score = held
    return pd.DataFrame({"anchor": a.row[anchor], "slot": slot.astype(np.int32), "row": row, "vec_id": vec_id, "score": score})


def prepared(vectors: DataFrame, width: int) -> DataFrame:
    """``row, vec_id, label, x, summary`` of rows(row, vec_id, label, x): vectors padded with zeros, and their summaries."""
    lengths = segment_lengths(width)

    def summed(frames):
        for pdf in frames:
            x = np.zeros((len(pdf), width))
            for i, v in enumerate(pdf["x"]):
                x[i, : len(v)] = v
            pdf["x"] = list(x)
            pdf["summary"] = list(summaries(x, lengths).reshape(len(x), -1))
            yield pdf

    return vectors.mapInPandas(summed, "row long, vec_id long, label long, x array<double>, summary array<double>")


def valid_vectors(embeddings: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, x`` of the rows that take part: x is floor(256 * component) as doubles."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-MOST)), F.lit(MOST))).cast("double"))
    kept = embeddings.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("x"))


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, x)``.

    Anchors are the rows of the condition ``is_anchor``. The score of two rows is the inner product of their vectors of whole
    numbers, held as doubles; higher comes first, then the smaller ``vec_id``. An anchor's positives are its first
    ``positives`` other rows of its label. For each of them the first ``negatives`` rows of other labels with
    ``least`` * positive_score <= 100 * negative_score <= ``most`` * positive_score are returned.

    Plan: vectors and summaries are written once. Blocks of anchors meet blocks of rows, of equal label for positives (see
    ``quizmill.operators.blocks``); of each pair of blocks the best few rows an anchor leave the task, and a window with a
    limit that Spark applies before the shuffle merges them.

    Edge cases: components beyond 2^62 count as that, and scores beyond 64 bits wrap; shorter vectors are padded with zeros;
    rows that repeat an id are rows of their own, as anchors too, and among equal scores and ids either may come first;
    an anchor without another row of its label gives nothing, a positive without negatives in range neither (so none with a
    negative score does); no anchors or an empty table give an empty table; other columns are ignored.
    """
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x"), "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    gallery = materialise(prepared(rows, width), "summaries")
    anchors = gallery.filter(is_anchor)
    size = block_rows(width)

    def nearest(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, g = Side(left, width), Side(right, width)
        return _search(a, g, np.full((len(left), 1), -np.inf), np.full((len(left), 1), np.inf), True, positives)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    found = block_join(anchors, gallery, "row", ["label"], size, nearest, FOUND)
    found = found.withColumn("nr", F.row_number().over(best)).filter(F.col("nr") <= positives)
    found = materialise(found.select("anchor", (F.col("nr") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bounds = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    asking = anchors.join(bounds.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("wanted")), "row")

    def between(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, g = Side(left, width), Side(right, width)
        low, high = np.full((len(left), positives), np.inf), np.full((len(left), positives), -np.inf)
        for i, scores in enumerate(left["wanted"] ):
            for slot, s in enumerate(scores):
                low[i, slot], high[i, slot] = -(-least * int(s) // 100), most * int(s) // 100
        return _search(a, g, low, high, False, negatives)

    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    out = block_join(asking.withColumn("all", F.lit(0)), gallery.withColumn("all", F.lit(0)), "row", ["all"], size, between, FOUND)
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = out.join(found, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, g.vec_id, a.label = g.label AS same, list_inner_product(a.x, g.x)::BIGINT AS score
  FROM v a JOIN v g ON a.vec_id <> g.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
