"""MinHash near-duplicates by a signature-coordinate inverted join.

A signature has one minimum of hashed shingles per coordinate. Every distinct set is posted under each of its (coordinate,
value) pairs. Two sets that link agree in at least ``matches`` of the coordinates, but for a stated chance, so:

* Skip: a pair that one set alone holds decides nothing and is left out; a set with fewer than ``matches`` shared pairs has no
  partner and leaves the join.
* Prefix: of its c shared pairs, rarest first in an order common to all sets, a set posts the first c - matches + 1. Two sets
  that agree in ``matches`` pairs meet in one of these. The other lists, the longest ones, are never merged: what they would
  add is counted in the signatures.
* Count: of the sets that meet in a list, those whose signatures agree in ``matches`` coordinates are retained, then confirmed
  by the exact intersection of their full sets.

The lists are worked on as in ``jaccard_join``: a list names a centre, so n copies give n - 1 pairs; lists whose sets then still
lie in different components are compared in tiles of bounded size, from which only merges of components leave a task.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import materialise, small, table
from quizmill.llm.jaccard_join import KEY_SCHEMA, TASK_KEYS, Join, U, _combined, chunks, classes, fingerprints, member_rows, mix, shingle_sets

#: Coordinates of a signature, and the chance that a pair at the threshold is missed.
COORDINATES, LOSS = 32, 1e-7
#: Sets of a list from which on the list is hot: its size is sent to all tasks in place of being joined.
HOT_LIST = 50_000

_NAMES = [f"s{i}" for i in range(COORDINATES)]
_SALTS = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def least_matches(threshold: int, loss: float = LOSS) -> int:
    """The largest number of matches that a pair of similarity ``threshold`` falls short of with a chance of at most ``loss``."""
    p, chance, t = threshold / 100, 0.0, 0
    while t < COORDINATES:
        chance += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if chance > loss:
            break
        t += 1
    return max(t, 1)


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, coordinates): minima of the hashed shingles; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, COORDINATES), U)
    held = np.flatnonzero(np.diff(bounds))
    if len(held):
        for i, salt in enumerate(_SALTS):
            out[held, i] = np.minimum.reduceat(tokens * (salt | U(1)) ^ salt, bounds[:-1][held])
    return out


def set_rows(batches, k: int, seed: int = 0):
    """Size, name and signature of each text's set."""
    for ids, texts in chunks(batches):
        tokens, bounds = shingle_sets(texts, k)
        f, g = fingerprints(tokens, bounds, seed)
        columns = np.ascontiguousarray(signatures(tokens, bounds).T).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), *map(pa.array, columns)], names=["doc_id", "n", "f", "g", *_NAMES])


def posting_rows(batches):
    """Rows (f, n, signature) -> postings, one for each coordinate, to be dealt by key as in ``jaccard_join``."""
    at = mix(np.arange(COORDINATES, dtype=U) + U(0xA24BAED4963EE407))[:, None]
    for b in batches:
        if b.num_rows:
            f, n = np.asarray(b.column(0)).view(U), np.asarray(b.column(1))
            keys = mix(np.stack([np.asarray(c).view(U) for c in b.columns[2:]]) + at)
            yield _combined(keys.ravel(), np.tile(f, COORDINATES), np.tile(n, COORDINATES))


class SignatureTile:
    """Which pairs of one tile's sets agree in enough coordinates, by 16 bits of each value, so never too few."""

    def __init__(self, columns: list, rows: np.ndarray, n: np.ndarray, threshold: int):
        self.values = np.stack([(np.asarray(c)[rows] & 0xFFFF).astype(np.uint16) for c in columns], axis=1)
        self.matches = least_matches(threshold)

    def near(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (self.values[u] == self.values[v]).sum(1) >= self.matches
        return u[near], v[near]


class MinHashJoin(Join):
    columns, compare = _NAMES, SignatureTile
    schema = "doc_id long, n long, f long, g long, " + ", ".join(f"{s} long" for s in _NAMES)

    def describe(self, seed: int):
        k = self.k
        return lambda batches: set_rows(batches, k, seed)

    def postings(self) -> DataFrame:
        """``key, f, n``: the (coordinate, value) pairs that several sets share. Sets that are too small to link with any but
        equal ones post nothing."""
        least = -(-self.threshold // (100 - self.threshold)) if self.threshold < 100 else 1 << 40
        sets = self.rows.filter((F.col("n") >= least) & F.col("doc_id").isNotNull())
        expected = self.nodes.filter(F.col("n") >= least).count() * COORDINATES
        dealt = sets.select("f", "n", *_NAMES).mapInArrow(posting_rows, KEY_SCHEMA).repartition(expected // TASK_KEYS + 1, "p")
        return materialise(dealt.mapInArrow(member_rows, "key long, f long, n int").distinct(), "postings")

    def groups(self) -> DataFrame:
        """The lists of the prefixes. Sizes of lists meet the postings by key; those of hot lists are sent to all tasks where
        a count shows that they fit, so no task joins a hot key."""
        matches = least_matches(self.threshold)
        postings = self.postings()
        sizes = materialise(postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        hot = small(sizes.filter(F.col("size") > HOT_LIST))
        sized = postings.join(hot, "key").unionByName(postings.join(hot, "key", "left_anti").join(sizes.filter(F.col("size") <= HOT_LIST), "key"))
        lists = sized.groupBy("f", "n").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("lists"))  # COORDINATES at most
        lists = lists.filter(F.size("lists") >= matches)
        prefix = F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))
        held = lists.select(F.explode(prefix).alias("l"), "f", "n").select(F.col("l.key").alias("key"), "f", "n")
        return self.lists(materialise(held, "prefixes"))

    def near_pairs(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(x, y)`` whose signatures agree in enough coordinates."""
        involved = materialise(pairs.select(F.explode(F.array("x", "y")).alias("f")).distinct(), "nodes")
        sketch = small(materialise(self.sketched(involved), "signatures"), 8 * (COORDINATES + 2))
        left = sketch.select(F.col("f").alias("x"), *_NAMES)
        right = sketch.select(F.col("f").alias("y"), *(F.col(s).alias(f"o{s}") for s in _NAMES))
        agree = sum((F.col(s) == F.col(f"o{s}")).cast("int") for s in _NAMES)
        return pairs.join(left, "x").join(right, "y").filter(agree >= least_matches(self.threshold)).select("x", "y")

    def sketch_bytes(self, sketch: DataFrame) -> int:
        return sketch.count() * 8 * (COORDINATES + 2)


def minhash_join(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, class_id, component_id``.

    Documents link if 100 * |intersection| >= threshold * |union| of their sets of k-word shingles, confirmed on the full sets.
    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links.

    A link at the threshold is missed if signatures agree in fewer coordinates than ``least_matches`` asks for: with a
    chance of LOSS, 1e-7, at most, and less for more similar sets and where other links join the two documents.

    Edge cases: null, empty and blank texts have an empty set and link with nothing, each being a component of its own;
    texts of fewer than k words have one shingle; very long texts are one set, of which only the signature and, for confirmation,
    the hashed set move; a row that repeats an id gives a row of its own, by its own text; a null id gets its size and no
    class or component, and links nothing; ties are decided by the smaller id; an empty table gives an empty table; columns
    besides ``doc_id`` and ``text`` are ignored. Shingles are equal if their 64-bit hashes are, see ``jaccard_join``.
    """
    return classes(MinHashJoin(docs, k, threshold))


def query(spark, sf_dir: str) -> DataFrame:
    found = minhash_join(table(spark, sf_dir, "documents"), k=3, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = None  # links close over components, which plain SQL reaches only by recursion over all pairs
