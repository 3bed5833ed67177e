"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features, ridge scores from
partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import materialise, table
from quizmill.llm.jaccard_join import chunks

#: At most so many labelled rows are used, those with the smallest hashes of their ids.
SAMPLE_ROWS = 60_000
#: The largest number of features, which bounds the sums that the driver adds.
FEATURES, SEED = 384, 20_240_101
#: The kernel's width, the ridge penalty and the number of features are chosen among these, by the error over folds of the
#: training rows. Fewer features are the first of more, so their sums are parts of the same sums.
WIDTHS, RIDGES, SIZES = (3.0, 5.0, 8.0, 12.0), (1e-4, 1e-3, 1e-2, 1e-1), (96, 192, 384)
#: Folds of the labelled rows, by a hash of the id; the last one calibrates.
FOLDS = 4
#: Raw scores are calibrated in so many bins of equal width.
BINS = 400
#: At most so many partial sums of the normal equations reach the driver.
PARTIALS = 8

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "mark": b"#$%&*", "shout": b"!", "bar": b"|", "stop": b".,;:?", "line": b"\n", "other": b"@^~<>{}[]\\/=+_`\"()-'"}
STATS = ("bytes", "words", "word_len", "upper", "digit", "mark", "shout", "bar", "stop", "line", "other", "high", "distinct", "repeat", "short", "longest", "caps", "marked")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[int(at[0]) : int(at[-1])] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the flags are set between the bounds."""
    run = np.concatenate(([0], np.cumsum(flags)))
    return (run[bounds[1:]] - run[bounds[:-1]]).astype(float)


def document_stats(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text: sizes as logarithms, the rest as shares. Empty and null texts give zeros."""
    data, at = _bytes_of(texts)
    n, out = len(at) - 1, np.zeros((len(at) - 1, len(STATS)))
    if not len(data):
        return out
    size = np.maximum(np.diff(at), 1)
    count = {}
    for name, letters in _CLASSES.items():
        flag = np.zeros(256, bool)
        flag[list(letters)] = True
        count[name] = _per(flag[data], at)
    count["high"] = _per(data >= 128, at)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    inside = ~blank[data]
    before = np.concatenate(([False], inside[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    bounds = np.searchsorted(starts, at)
    words = np.maximum(np.diff(bounds), 1)
    if len(starts):
        letters = data[inside]
        begin = np.cumsum(inside)[starts] - 1
        length = np.diff(np.append(begin, len(letters)))
        place = np.arange(len(letters)) - np.repeat(begin, length)
        power = np.cumprod(np.concatenate(([1], np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)
        word = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * power[place], begin)
        same = np.zeros(len(word), bool)
        same[1:] = word[1:] == word[:-1]
        same[bounds[:-1][bounds[:-1] < len(word)]] = False
        distinct = np.array([len(np.unique(word[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], float)
        flag = np.zeros(256, bool)
        flag[list(b"#$%&*!|")] = True
        last = letters[np.append(begin[1:], len(letters)) - 1]
        upper = np.add.reduceat((letters >= 65) & (letters <= 90), begin, dtype=np.int64)
        longest = np.zeros(n)
        held = np.flatnonzero(np.diff(bounds))
        longest[held] = np.maximum.reduceat(length, bounds[:-1][held])
        out[:, STATS.index("word_len")] = np.log1p(_per(inside, at) / words)
        out[:, STATS.index("distinct")] = distinct / words
        out[:, STATS.index("repeat")] = _per(same, bounds) / words
        out[:, STATS.index("short")] = _per(length <= 2, bounds) / words
        out[:, STATS.index("longest")] = np.log1p(longest)
        out[:, STATS.index("caps")] = _per((upper > 1) & (upper * 2 > length), bounds) / words
        out[:, STATS.index("marked")] = _per(flag[last], bounds) / words
    out[:, 0], out[:, 1] = np.log1p(np.diff(at)), np.log1p(np.diff(bounds))
    ascii_letters = np.maximum(count["upper"] + count["lower"], 1)
    for name in ("digit", "mark", "shout", "bar", "stop", "other", "high"):
        out[:, STATS.index(name)] = count[name] / size
    out[:, STATS.index("upper")] = count["upper"] / ascii_letters
    out[:, STATS.index("line")] = count["line"] / words
    # shares are small and skewed; roots spread them
    for name in ("upper", "digit", "mark", "shout", "bar", "other", "repeat", "caps", "marked"):
        out[:, STATS.index(name)] **= 0.5
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    width: float = WIDTHS[0]
    ridge: float = RIDGES[0]
    size: int = FEATURES
    kept: np.ndarray | None = None  # of each statistic, 0 if it is left out

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - self.mean) / self.scale
        return fourier(x if self.kept is None else x * self.kept, self.width, self.size)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score in 0..1: linear between the centres of the calibrated bins."""
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray, width: float, size: int = FEATURES) -> np.ndarray:
    """The first ``size`` features cos(w x + b), whose inner products approximate a Gaussian kernel of that width, and a
    constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / width, (x.shape[1], FEATURES))[:, :size], rng.uniform(0, 2 * np.pi, FEATURES)[:size]
    return np.hstack([np.sqrt(2 / size) * np.cos(np.clip(x, -6, 6) @ w + b), np.ones((len(x), 1))])


def fewer(sums: np.ndarray, size: int) -> np.ndarray:
    """The normal equations of the first ``size`` features from those of FEATURES."""
    at = np.append(np.arange(size), [-2, -1])
    scale = np.append(np.full(size, np.sqrt((len(sums) - 2) / size)), [1.0, 1.0])
    return sums[np.ix_(at, at)] * scale[:, None] * scale


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def _sums(batches, make):
    """One row per partition: the sum over its batches of the array that ``make(stats, label)`` returns."""
    total = None
    for b in batches:
        if b.num_rows:
            stats = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
            part = make(stats, np.asarray(b.column(1), float))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).tobytes()], pa.binary())], names=["s"])


def summed(sample: DataFrame, make) -> np.ndarray | None:
    """The sum over the rows of ``sample(stats, label)``, of which each partition returns its share."""
    parts = sample.select("stats", "label").mapInArrow(lambda it: _sums(it, make), "s binary").collect()  # a megabyte each
    return sum(np.frombuffer(r[0]) for r in parts) if parts else None


def _stat_rows(batches):
    for b in batches:
        table = pa.Table.from_batches([b])
        for ids, texts, label, fold in _labelled_chunks(table):
            stats = document_stats(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(stats), pa.list_(pa.float64())), label, fold], names=["doc_id", "stats", "label", "fold"])


def _labelled_chunks(table: pa.Table):
    table = table.combine_chunks()
    for batch in table.to_batches():
        done = 0
        for ids, texts in chunks([batch.select(["doc_id", "text"])]):
            yield ids, texts, batch.column(2).slice(done, len(ids)), batch.column(3).slice(done, len(ids))
            done += len(ids)


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from normal equations; the constant has no penalty."""
    gram, right = sums[:-1, :-1], sums[:-1, -1]
    size = len(gram) - 1
    penalty = ridge * max(gram[-1, -1], 1.0) / size * np.eye(size + 1)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def missed(folds: list[np.ndarray], ridge: float) -> float:
    """The squared error over the folds, each predicted from the others."""
    total, out = sum(folds), 0.0
    for s in folds if len(folds) > 1 else ():
        w = np.append(solved(total - s, ridge), -1.0)
        out += float(w @ s @ w)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on labelled documents ``labels(doc_id, label)``; None if there are none.

    The labelled rows with the smallest hashes, ``sample_rows`` at most, are joined by broadcast, which that bound allows.
    Three quarters fit the ridge weights, a quarter the calibration, by a hash of the id. All choices are those of the least
    squared error over the three folds of the former, each fold being predicted from the other two: first width, penalty
    and number of features; then, with the fewest features, each statistic is left out in turn, and those without which
    the error is less are left out together if the error then is less with the best penalty and number of features too.
    Only sums reach the driver: one fold's normal equations give both its share of a fit and its error under any weights.

    Edge cases: labelled rows that repeat an id count each; of equal hashes the smaller id is taken; very long texts are
    statistics like any other; empty tables, of documents or labels, give no model.
    """
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    chosen = labels.filter("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    chosen = chosen.orderBy(hashed, "doc_id", "label").limit(sample_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "fold")
    sample = materialise(rows.mapInArrow(_stat_rows, "doc_id long, stats array<double>, label double, fold int"), "stats").coalesce(PARTIALS)

    d = len(STATS)
    moments = summed(sample, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return None
    mean = moments[1 : d + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[d + 1 :] / moments[0] - mean**2, 1e-6))
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(x, y):
        z = np.hstack([model.features(x), y[:, None]])
        return z.T @ z

    def by_fold(make) -> list[np.ndarray]:
        found = [summed(sample.filter(F.col("fold") == fold), make) for fold in range(FOLDS - 1)]
        found = [s for s in found if s is not None]
        return found or [summed(sample, make)]  # a handful of rows, all of the calibration fold

    def tried(kept):
        """The best of (error, width, size, ridge, kept, weights) at the model's width and statistics."""
        folds = [s.reshape(FEATURES + 2, FEATURES + 2) for s in by_fold(normal)]
        parts = {size: [fewer(s, size) for s in folds] for size in SIZES}
        error, size, ridge = min((missed(parts[size], ridge), size, ridge) for size in SIZES for ridge in RIDGES)
        return (error, model.width, size, ridge, kept, solved(sum(parts[size]), ridge)), parts[SIZES[0]]

    best = None
    for model.width in WIDTHS:
        found, fewest = tried(None)
        if best is None or found[0] < best[0][0]:
            best = found, fewest
    best, fewest = best
    model.width = best[1]
    if len(fewest) > 1:
        few = Model(mean, scale, model.weights, model.edges, model.levels, model.width, size=SIZES[0])
        side = SIZES[0] + 2

        def without_each(x, y):
            out = np.empty((d, side, side))
            for i in range(d):
                few.kept = (np.arange(d) != i).astype(float)
                z = np.hstack([few.features(x), y[:, None]])
                out[i] = z.T @ z
            return out

        folds = [s.reshape(d, side, side) for s in by_fold(without_each)]
        base = min(missed(fewest, ridge) for ridge in RIDGES)
        kept = np.array([min(missed([s[i] for s in folds], ridge) for ridge in RIDGES) >= base for i in range(d)], float)
        if 0 < kept.sum() < d:
            model.kept = kept
            best = min(best, tried(kept)[0], key=lambda x: x[0])
    _, model.width, model.size, model.ridge, model.kept, model.weights = best

    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x, y):
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, BINS - 1)
        return np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    counts = summed(sample.filter(F.col("fold") == FOLDS - 1), histogram)
    if counts is None:
        counts = summed(sample, histogram)
    n, good = counts.reshape(2, BINS)
    held = n > 0
    model.edges = ((edges[1:] + edges[:-1]) / 2)[held]
    model.levels = isotonic(good[held] / n[held], n[held])
    return model


def _score_rows(batches, model: Model | None):
    for ids, texts in chunks(batches):
        score = model.score(document_stats(texts)) if model else np.full(len(ids), 0.5)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every whole text, in one pass without a shuffle. Without a model every score is 0.5.

    Null and empty texts have statistics of zero and get a score like any other; rows that repeat an id are scored each.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _score_rows(it, model), "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out quarter: crc32 of the id as text, modulo 4, is not 2."""
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).select("doc_id", F.col("quality").alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, training_labels(table(spark, sf_dir, "labels"))))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))  # a null id is in no fold
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


ORACLE_SQL = None  # a fitted model; tests measure held-out accuracy
