"""Vectors: cosine, nearest neighbours, semantic search, backfill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.operators.blocks import block_join, block_rows
from quizmill.session import stored

#: Vectors that every task holds, at most; more queries make more passes over the gallery.
QUERY_BLOCK = 4096
#: Pivots of a block of vectors, the rows that they are chosen from, and pairs that are multiplied at once.
PIVOTS, PIVOT_ROWS, PAIRS = 128, 4096, 1 << 20
#: Vectors that are gathered at once.
PIECE = 1 << 14
FOUND = "query_id long, id long, similarity double"


def cosine(a: Column, b: Column) -> Column:
    """The inner product of two normalised vectors in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine_pairs(q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """All inner products of two sets of vectors; an empty set gives an empty matrix."""
    q, g = np.atleast_2d(np.asarray(q, float)), np.atleast_2d(np.asarray(g, float))
    if not q.size or not g.size:
        return np.zeros((len(q) if q.size else 0, len(g) if g.size else 0))
    return q @ g.T


def _below(x: np.ndarray) -> np.ndarray:
    """``x`` in 32 bits, rounded down."""
    return np.nextafter(np.clip(x, -3e38, 3e38).astype(np.float32), np.float32(-np.inf))


class _Best:
    """The best ``k`` rows of each of ``count`` queries, by similarity, then by the smaller id, of all that are shown.

    Products of a piece, in 32 bits, are compared with the k-th best that a query has so far; only those that may reach it are
    computed pair by pair in 64, which gives equal rows equal similarities wherever they lie, and are cut to ``k`` a query when they become many. So
    memory depends on the piece and on ``count * k``, not on how many rows are shown.
    """

    def __init__(self, count: int, k: int):
        self.k, self.least = k, np.full(count, -np.inf)
        self.held: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.size = 0

    def show(self, at: np.ndarray, q: np.ndarray, ids: np.ndarray, g: np.ndarray) -> None:
        """Show the rows ``g`` of ``ids`` to the queries ``q``, which are those at the places ``at``."""
        if not len(at) or not len(g):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            sims = q.astype(np.float32) @ g.astype(np.float32).T
        # what 32 bits may be off; what overflows them is near, and then computed in 64
        slack = 1.2e-7 * (g.shape[1] + 4) * np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", g, g).max()) + 1e-30
        near = ~(sims < _below(self.least[at] - slack)[:, None])
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * self.k)
        if len(many):
            kth = np.partition(np.nan_to_num(sims[many], nan=-np.inf, posinf=-np.inf), len(g) - self.k, axis=1)[:, len(g) - self.k] - slack[many]
            self.least[at[many]] = np.maximum(self.least[at[many]], kth)
            near[many] = ~(sims[many] < _below(self.least[at[many]] - slack[many])[:, None])
        u, v = np.divmod(np.flatnonzero(near), len(g))
        for i in range(0, len(u), PIECE):
            x, y = u[i : i + PIECE], v[i : i + PIECE]
            self.held.append((at[x], ids[y], np.einsum("ij,ij->i", q[x], g[y])))
            self.size += len(x)
            if self.size > 2 * max(len(self.least) * self.k, PIECE):
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, ids, similarities), ``k`` a query at most, best first."""
        rows, ids, sims = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -sims, rows))
        rows, ids, sims = rows[order], ids[order], sims[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.least[rows[last]] = np.maximum(self.least[rows[last]], sims[last])
        stay = place < self.k
        self.held, self.size = [(rows[stay], ids[stay], sims[stay])], 0
        return self.held[0]


def _vectors(column) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _against_gallery(queries: DataFrame, rows: list, k: int) -> DataFrame:
    """Queries stream past a small gallery that every task holds."""
    ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    step = max(1, PAIRS // max(len(ids), 1))

    def best(frames):
        for pdf in frames:
            for at in range(0, len(pdf) if len(ids) else 0, step):
                part = pdf.iloc[at : at + step]
                found = _Best(len(part), k)
                found.show(np.arange(len(part)), _vectors(part["embedding"]), ids, matrix)
                places, keys, sims = found.best()
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[places], "id": keys, "similarity": sims})

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInPandas(best, FOUND)


def _against_queries(block: list, gallery: DataFrame, k: int) -> DataFrame:
    """The gallery streams past a block of queries; each partition gives its best k."""
    ids, matrix = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float)
    step = max(1, PAIRS // max(len(ids), 1))

    def best(frames):
        found, every = _Best(len(ids), k), np.arange(len(ids))
        for pdf in frames:
            for at in range(0, len(pdf) if len(ids) else 0, step):
                part = pdf.iloc[at : at + step]
                found.show(every, matrix, part["id"].to_numpy(), _vectors(part["embedding"]))
        places, keys, sims = found.best()
        if len(places):
            yield pd.DataFrame({"query_id": ids[places], "id": keys, "similarity": sims})

    return gallery.select(F.col("id").cast("long").alias("id"), "embedding").mapInPandas(best, FOUND)


def _pivots(g: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, the pivot of each row, its distance to it): up to ``count`` rows of ``g``, each the farthest from those before."""
    chosen, of = [0], np.zeros(len(g), np.int64)
    apart = np.linalg.norm(g - g[0], axis=1)
    while len(chosen) < min(count, len(g)) and apart.max() > 0:
        i = int(apart.argmax())
        d = np.linalg.norm(g - g[i], axis=1)
        nearer = d < apart
        of[nearer], apart[nearer] = len(chosen), d[nearer]
        chosen.append(i)
    return g[chosen], of, apart


def _block_best(rows: np.ndarray, q: np.ndarray, ids: np.ndarray, g: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
    """([rows, ids, similarities] of the best ``k`` of each query, pairs that were multiplied).

    Rows lie in cells around pivots, which a spread of the rows gives. By the triangle inequality the product with a row differs
    from that with its pivot by the query's length times the radius of the cell at most. The least products that the best
    cells of a query can have, as many as hold ``k`` rows, bound its k-th best from below; a cell whose greatest product
    does not reach the k-th best so far is not multiplied with the query. Bounds cost one value for each cell of a query, and
    products are taken in pieces of PAIRS.
    """
    pivots, _, _ = _pivots(g[:: max(1, len(g) // PIVOT_ROWS)], min(PIVOTS, int(len(g) ** 0.5) + 1))
    of = np.concatenate([(g[i : i + PIECE] @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1) for i in range(0, len(g), PIECE)])
    order = np.argsort(of, kind="stable")
    ids, g, of = ids[order], g[order], of[order]
    starts = np.searchsorted(of, np.arange(len(pivots) + 1))
    sizes = np.diff(starts)
    radius = np.array([np.linalg.norm(g[a:b] - p, axis=1).max(initial=0) for a, b, p in zip(starts, starts[1:], pivots)])
    near_pivot, length = q @ pivots.T, np.linalg.norm(q, axis=1)
    order = np.argsort(near_pivot.argmax(1), kind="stable")  # queries that lean the same way ask for the same cells
    rows, q, near_pivot, length = rows[order], q[order], near_pivot[order], length[order]
    out, pairs, width = [], 0, max(1, int(PAIRS**0.5))
    for i in range(0, len(q), width):
        part = slice(i, i + width)
        spread = length[part, None] * radius * (1 + 1e-9) + 1e-9
        upper, lower = near_pivot[part] + spread, near_pivot[part] - spread
        found = _Best(len(upper), k)
        if len(g) >= k:
            by = np.argsort(-lower, axis=1)
            enough = (np.cumsum(sizes[by], axis=1) >= k).argmax(1)
            found.least[:] = lower[np.arange(len(by)), by[np.arange(len(by)), enough]]
        cells = [c for c in np.argsort(-upper.max(0), kind="stable") if sizes[c]]
        while cells:
            few = max(1, int(np.searchsorted(np.cumsum(sizes[cells]), width // 2)))  # small cells are shown together
            near = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in cells[:few]])
            reach, cells = upper[:, cells[:few]].max(1), cells[few:]
            for a in range(0, len(near), width):
                at, piece = np.flatnonzero(reach >= found.least), near[a : a + width]
                found.show(at, q[part][at], ids[piece], g[piece])
                pairs += len(at) * len(piece)
        places, keys, sims = found.best()
        out.append([rows[part][places], keys, sims])
    return [np.concatenate(x) for x in zip(*out)], pairs


def nearest(queries: DataFrame, gallery: DataFrame, k: int, work: tuple | None = None) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``k`` nearest rows of ``gallery(id, embedding)`` of each of
    ``queries(query_id, embedding)``, each row of which is searched, also if its id is null or repeats; ties go to the smaller id; similarities are rounded to 6 digits at the end.

    Up to QUERY_BLOCK queries go to every task and the gallery streams past them; else a gallery of up to that size goes to
    every task and the queries stream past it; neither side is shuffled then. Beyond that, blocks of queries meet blocks of
    the gallery in one job (``quizmill.operators.blocks``), where cells around pivots of the block spare most inner products
    of clustered vectors. A task multiplies PAIRS pairs at a time and holds the best so far (``_Best``). The best ``k`` of each pair of blocks are merged by a limited window, which
    Spark applies before its shuffle too. ``work`` may be two accumulators, for all pairs of the blocks and those multiplied.
    """
    # rows are told apart by a number, as ids of queries may repeat or be null
    numbered = stored(queries.filter("embedding is not null").select("query_id", "embedding", F.monotonically_increasing_id().alias("_row")), "queries")
    queries = numbered.select(F.col("_row").alias("query_id"), "embedding")
    gallery = gallery.filter("embedding is not null").select("id", "embedding")
    if queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        found = _against_queries(queries.collect(), gallery, k)
    elif gallery.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        found = _against_gallery(queries, gallery.collect(), k)
    else:
        width = numbered.agg(F.max(F.size("embedding"))).first()[0]
        right = stored(gallery.select(F.monotonically_increasing_id().alias("_row"), F.col("id").cast("long").alias("id"), "embedding"), "gallery")

        def meet(_key, left: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            q, g = _vectors(left["embedding"]), _vectors(other["embedding"])
            best, pairs = _block_best(left["_row"].to_numpy(), q, other["id"].to_numpy(), g, k)
            if work:
                work[0].add(len(q) * len(g))
                work[1].add(pairs)
            return pd.DataFrame(dict(zip(("query_id", "id", "similarity"), best)))

        found = block_join(numbered.select("_row", "embedding").withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), "_row", ["_all"], block_rows(width), meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("query_id", "_row")
    return best.join(numbered.select("_row", "query_id"), "_row").select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def of_links(rows: DataFrame, links: DataFrame, company_id: int | None, position_id: int | None, key: str = "post_id") -> DataFrame:
    """Rows whose post has a link of the company and one of the position, not necessarily the same; rows never repeat."""
    for value, column in ((company_id, "company_id"), (position_id, "position_id")):
        if value is not None:
            rows = rows.join(links.filter(F.col(column) == value).select(F.col("post_id").alias(key)), key, "left_semi")
    return rows


def search(questions: DataFrame, posts: DataFrame, links: DataFrame, vector: list[float], company_id: int | None = None, position_id: int | None = None, min_score: int | None = None, limit: int = 20) -> DataFrame:
    """The nearest questions: ``id, post_id, content, similarity, rank``. Filters by semi joins come before the vectors."""
    rows = of_links(questions.filter("embedding is not null"), links, company_id, position_id)
    if min_score is not None:
        rows = rows.join(posts.filter(F.col("quality_score") >= min_score).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    spark = questions.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
    found = nearest(query, rows.select("id", "embedding"), limit)
    return found.join(rows.select("id", "post_id", "content"), "id").select("id", "post_id", "content", "similarity", "rank").orderBy("rank")


def search_many(queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """Top ``k`` for each of many queries."""
    return nearest(queries, gallery, k)


def hashed_grams(texts, dim: int = 64, n: int = 3) -> np.ndarray:
    """The default encoder: hashed character n-grams of the text between blanks, in lower case, L2-normalised; the same for the
    same text everywhere.

    All texts are one array of code points. A gram is its code points as digits to base 31, times an odd constant, modulo 2^32;
    of that, high bits give the place and another bit the sign.
    """
    marked = [f" {t or ''} ".lower() for t in texts]
    marked = [t + "\0" * (n - len(t)) for t in marked]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    count = size - n + 1
    row = np.repeat(np.arange(len(marked)), count)
    at = np.arange(int(count.sum())) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = h * np.uint64(31) + codes[at + i]
    h = (h * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    sign = ((h >> np.uint64(16)) & np.uint64(1)).astype(float) * 2 - 1
    place = row * dim + ((h >> np.uint64(20)) % np.uint64(dim)).astype(np.int64)
    out = np.bincount(place, sign, len(marked) * dim).reshape(-1, dim).astype(np.float32)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, np.float32(1), norm)


def encode(df: DataFrame, text: str, encoder=hashed_grams, batch_size: int = 4096) -> DataFrame:
    """``df`` with ``embedding``; ``encoder`` maps a list of texts to a matrix and is called with at most ``batch_size`` of them."""
    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                yield part.assign(embedding=list(np.asarray(encoder(part[text].tolist()), np.float32)))

    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return df.mapInPandas(run, schema + ", embedding array<float>")


def backfill(questions: DataFrame, encoder=hashed_grams, batch_size: int = 4096, limit: int | None = None, force: bool = False) -> DataFrame:
    """``id, embedding`` of the questions that lack a vector (or of all with ``force``), the smallest ids first with a limit.
    See ``encode``."""
    rows = questions if force else questions.filter("embedding is null")
    rows = rows.select("id", "content")
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    return encode(rows, "content", encoder, batch_size).select("id", "embedding")


def join_vectors(questions: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """``questions`` with the ``embedding`` of their ``key`` in ``vectors``, null where there is none. Null keys match nothing; the
    join deals them to tasks by the question's id, so that those without a vector do not all meet in one task."""
    v = vectors.select(F.col(key).alias("_key"), "embedding")
    match = (F.col(key) == F.col("_key")) & (F.coalesce(key, "id") == F.col("_key"))
    return questions.join(v, match, "left").drop("_key")


def with_vectors(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Questions with new vectors put in; the others keep theirs."""
    new = vectors.select("id", F.col("embedding").alias("_v"))
    return questions.join(new, "id", "left").withColumn("embedding", F.coalesce("_v", "embedding")).drop("_v")


def clear_vectors(questions: DataFrame) -> DataFrame:
    return questions.withColumn("embedding", F.lit(None).cast(questions.schema["embedding"].dataType))


def coverage(questions: DataFrame, vector: str = "embedding") -> DataFrame:
    return questions.agg(F.count(vector).alias("embedded"), F.count("*").alias("total"))
