"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters of a word, with a mark at its start and its end, are predicted from the letters before them in the word. Counts come
from all training texts: words are counted per language by Spark, then n-grams of the distinct words, then lower orders,
totals and discounts. No n-gram is left out. Models that a count shows to be small are sent to the workers, in sorted arrays of
64-bit n-gram hashes that all languages share, with a column of probabilities per language; larger ones stay tables that the
distinct words are joined with. A text gets the language of least cross-entropy per letter; a threshold per language, a quantile
over training texts kept out of the counts, marks doubtful ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import materialise, small, table

ORDER = 4
#: N-grams times languages, at most, of models that are sent to the workers: 8 bytes each. Larger ones are joined with.
MODEL_CELLS = 4_000_000
#: A text is doubtful above this quantile of the calibration texts' cross-entropies, times this margin.
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.25
#: One training text in so many gives thresholds in place of counts.
CALIBRATION_PART = 10
#: Letters that a text has at least to count for the thresholds of rejection.
CALIBRATION_LETTERS = 20
#: Distinct words that one task counts, or one worker remembers, before it starts anew.
WORDS = 300_000

LETTERS = re.compile(r"[^\W\d_]+")
U = np.uint64


#: ASCII letters stay, other ASCII characters become blanks, bytes of longer characters stay.
_SEPARATE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """The runs of letters of the text in lower case: ``LETTERS.findall``, in most texts by a split."""
    if not text:
        return []
    ws = text.lower().encode().translate(_SEPARATE).decode().split()
    if text.isascii() or "".join(ws).isalpha():
        return ws
    return [x for w in ws for x in ((w,) if w.isalpha() else LETTERS.findall(w))]


def _word_counts(batches):
    """Words per language of one partition, summed as far as memory bounds allow."""
    held: dict[str, Counter] = {}

    def rows():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, held.values())) > WORDS:
                yield from rows()
    yield from rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all texts with a language."""
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n``: n-grams of ``order`` characters of the marked words, each ending in a letter or the end mark.

    Shorter contexts at the start of a word are kept as they are: the word mark stands for all that is before it.
    """
    marked = F.concat(F.lit("\x02"), F.col("word"), F.lit("\x03"))
    ends = F.sequence(F.lit(2), F.length(marked))
    grams = words.select("lang", "n", marked.alias("w"), F.explode(ends).alias("e"))
    return grams.select("lang", F.expr(f"substring(w, greatest(e - {order} + 1, 1), e - greatest(e - {order} + 1, 1) + 1)").alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Model:
    """For each order: sorted hashes of n-grams with the discounted probability per language, and sorted hashes of
    contexts with the weight of the lower order; or ``tables(level, part, key, v)`` with the same in place of the arrays."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray | None = None
    reject: np.ndarray | None = None
    tables: DataFrame | None = None
    order: int = ORDER

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word under each language."""
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(U) + U(1)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        start = np.cumsum(sizes) - sizes
        depth = np.arange(len(codes)) - np.repeat(start, sizes)  # characters before, in the word
        predicted = depth > 0
        p = np.repeat(self.floor[None, :], len(codes), axis=0)
        with np.errstate(over="ignore"):
            grams = [codes]
            power = U(1)
            for n in range(1, len(self.grams)):
                power = power * U(0x100000001B3)
                shifted = np.concatenate((np.zeros(n, U), codes[:-n]))
                grams.append(np.where(depth >= n, grams[-1] + shifted * power, grams[-1]))
        for n, ((keys, value), (heads, rest)) in enumerate(zip(self.grams, self.contexts)):
            if n == 0:
                weight = np.repeat(rest[:1], len(codes), axis=0)
            else:
                # the context of the position: n characters before, fewer at the start of the word
                ctx = np.concatenate((np.zeros(1, U), grams[n - 1][:-1]))
                at = np.minimum(np.searchsorted(heads, ctx), len(heads) - 1)
                weight = np.where((heads[at] == ctx)[:, None], rest[at], 1.0)
            at = np.minimum(np.searchsorted(keys, grams[n]), len(keys) - 1)
            own = np.where((keys[at] == grams[n])[:, None], value[at], 0.0)
            used = depth >= n if n else np.ones(len(codes), bool)
            p = np.where(used[:, None], own + weight * p, p)
        logs = np.where(predicted[:, None], np.log(np.maximum(p, 1e-12)), 0.0)
        return np.add.reduceat(logs, start, axis=0)


class Scorer:
    """Scores texts with one model and remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.at, self.table, self.n = model, {}, np.zeros((1024, len(model.langs))), 0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per letter and word end under each language, letters, and letters with word ends, of each text; no
        letters: zeros."""
        held = [words_of(t) for t in texts]
        new = list({w for ws in held for w in ws} - self.at.keys())
        if self.n + len(new) > WORDS:
            self.at, self.n = {}, 0
            new = list({w for ws in held for w in ws})
        if new:
            logs = np.vstack([self.model.log_probs(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
            if self.n + len(new) > len(self.table):
                self.table = np.vstack([self.table[: self.n], np.zeros((max(len(new), self.n), self.table.shape[1]))])
            self.table[self.n : self.n + len(new)] = logs
            self.at.update(zip(new, range(self.n, self.n + len(new))))
            self.n += len(new)
        out, size, units = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        for i, ws in enumerate(held):
            if ws:
                size[i] = sum(map(len, ws))
                units[i] = size[i] + len(ws)
                out[i] = -self.table[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(0) / units[i]
        return out, size, units


def _fold(text_rows, model: Model):
    scorer = Scorer(model)
    for batch in text_rows:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield part, *scorer.entropies(part.column(1).to_pylist())


SCORED = "doc_id long, lang string, lang_pred string, score double, cross_entropy double, own double, letters double"


def _scored_rows(batches, model: Model):
    at = {lang: k for k, lang in enumerate(model.langs)}
    for part, e, size, units in _fold(batches, model):
        best = e.argmin(1)
        # the posterior of the best language under equal priors; ties go to the first language in sort order
        odds = np.exp(-(e - e.min(1, keepdims=True)) * units[:, None])
        score = np.where(size > 0, 1 / odds.sum(1), 0.0)
        lang = [model.langs[b] if s else "und" for b, s in zip(best, size)]
        own = [e[i, at[x]] if x in at else None for i, x in enumerate(part.column(2).to_pylist())]
        columns = [part.column(0).cast(pa.int64()), part.column(2), pa.array(lang), pa.array(score), pa.array(e.min(1)), pa.array(own, pa.float64()), pa.array(size)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "lang_pred", "score", "cross_entropy", "own", "letters"])


def levels(top: DataFrame, order: int) -> DataFrame:
    """``level, lang, gram, n``: the n-grams of the highest order with their counts, and those of all lower orders with the
    number of distinct characters found before them; what begins a word, with nothing before it, keeps its count."""
    held = [top.select(F.lit(order).alias("level"), "lang", "gram", "n")]
    for k in range(order - 1, 0, -1):
        up = held[-1]
        found = up.filter(F.length("gram") == k + 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        begin = up.filter(F.length("gram") <= k).select("lang", "gram", "n")
        held.append(found.union(begin).select(F.lit(k).alias("level"), "lang", "gram", "n"))
    out = held[0]
    for part in held[1:]:
        out = out.union(part)
    return out


def probabilities(counts: DataFrame, langs: list[str]) -> DataFrame:
    """``level, part, key, v``: values of n-grams (part ``gram``) and weights of contexts (part ``context``) per language.

    Only keys as long as their level are looked up; the shorter ones that begin a word count in the discounts.
    """
    ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    d = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5)
    rows = counts.join(F.broadcast(counts.groupBy("level", "lang").agg(d.alias("d"))), ["level", "lang"])  # a row per level and language
    rows = rows.withColumn("head", F.expr("substring(gram, 1, length(gram) - 1)"))
    grams = rows.filter(F.length("gram") == F.col("level"))  # the contexts of these hold no shorter n-grams
    total = F.sum("n").over(Window.partitionBy("level", "lang", "head"))  # no more rows than there are characters
    values = grams.select("level", F.lit("gram").alias("part"), F.col("gram").alias("key"), "lang", ((F.col("n") - F.col("d")) / total).alias("v"))
    rest = grams.groupBy("level", "lang", F.col("head").alias("key")).agg((F.max("d") * F.count("*") / F.sum("n")).alias("v"))
    both = values.unionByName(rest.select("level", F.lit("context").alias("part"), "key", "lang", "v"))
    found = F.map_from_entries(F.collect_list(F.struct("lang", "v")))
    per = F.transform(F.array(*map(F.lit, langs)), lambda x: F.try_element_at("found", x))
    default = F.when(F.col("part") == "gram", 0.0).otherwise(1.0)
    return both.groupBy("level", "part", "key").agg(found.alias("found")).select("level", "part", "key", F.transform(per, lambda x: F.coalesce(x, default)).alias("v"))


def learn(docs: DataFrame, order: int = ORDER, cells: int = MODEL_CELLS) -> Model | None:
    """The models of ``docs(text, lang)``, without thresholds; None if no text with a language has a letter.

    All n-grams of all texts are in the models. Beyond ``cells`` n-grams times languages they stay a table.
    """
    counts = materialise(levels(gram_counts(word_counts(docs), order), order), "grams")
    vocabulary = dict(counts.filter("level = 1").groupBy("lang").count().collect())
    langs = sorted(vocabulary)
    if not langs:
        return None
    model = Model(langs, floor=np.array([1.0 / (vocabulary[lang] + 1) for lang in langs]), order=order)
    tables = materialise(probabilities(counts, langs), "model")
    if tables.count() * len(langs) > cells:
        model.tables = tables
        return model
    for n in range(1, order + 1):
        for part, into in (("gram", model.grams), ("context", model.contexts)):
            found = tables.filter((F.col("level") == n) & (F.col("part") == part)).select("key", "v").toArrow()
            keys = np.array([_hash(g) for g in found.column(0).to_pylist()] or [0], U)
            values = found.column(1).combine_chunks().flatten().to_numpy() if found.num_rows else np.full(len(langs), float(part == "context"))
            by = np.argsort(keys)
            into.append((keys[by], values.reshape(len(keys), len(langs))[by]))
    return model


def _text_words(batches):
    """``row, doc_id, lang, word, n`` of each text; texts without letters give a row without a word."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            held = [list(Counter(words_of(t)).items()) or [(None, 0)] for t in part.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in held]))
            words, n = pa.array([w for x in held for w, _ in x], pa.string()), pa.array([c for x in held for _, c in x], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(3).take(at), part.column(0).cast(pa.int64()).take(at), part.column(2).take(at), words, n], names=["row", "doc_id", "lang", "word", "n"])


def _added(logs: Column, n: int, times=1) -> Column:
    return F.array(*(F.sum(logs[k] * times) for k in range(n)))


def _joined(docs: DataFrame, model: Model) -> DataFrame:
    """What ``_scored_rows`` gives, by joins: n-grams with the models, words with their n-grams, texts with their words."""
    size, order = len(model.langs), model.order
    row_bytes = 64 + 8 * size  # an n-gram and a value per language
    texts = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_text_words, "row long, doc_id long, lang string, word string, n long")
    words = texts.filter("word is not null").select("word").distinct()
    marked = words.select("word", F.concat(F.lit("\x02"), "word", F.lit("\x03")).alias("w"))
    ends = marked.select("word", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("e"))
    parts = materialise(ends.select("word", F.expr(f"substring(w, greatest(e - {order} + 1, 1), least(e, {order}))").alias("gram")), "parts")
    grams = parts.select("gram").distinct().withColumn("p", F.array(*(F.lit(float(x)) for x in model.floor)))
    for n in range(1, order + 1):
        of = model.tables.filter(F.col("level") == n)
        own = of.filter("part = 'gram'").select(F.col("key").alias("own_key"), F.col("v").alias("own"))
        rest = of.filter("part = 'context'").select(F.col("key").alias("rest_key"), F.col("v").alias("rest"))
        used = F.length("gram") >= n
        grams = grams.withColumn("own_key", F.when(used, F.expr(f"substring(gram, -{n}, {n})"))).withColumn("rest_key", F.when(used, F.expr(f"substring(gram, -{n}, {n - 1})")))
        grams = grams.join(small(own, row_bytes), "own_key", "left").join(small(rest, row_bytes), "rest_key", "left")
        lower = F.when(F.col("rest").isNull(), F.col("p")).otherwise(F.zip_with("rest", "p", lambda a, b: a * b))
        grams = grams.select("gram", F.when(~used | F.col("own").isNull(), lower).otherwise(F.zip_with("own", lower, lambda a, b: a + b)).alias("p"))
    logs = grams.select("gram", F.transform("p", lambda x: F.log(F.greatest(x, F.lit(1e-12)))).alias("logs"))
    per_word = parts.join(logs, "gram").groupBy("word").agg(_added(F.col("logs"), size).alias("logs"))
    found = texts.join(per_word, "word", "left").groupBy("row", "doc_id", "lang").agg(
        _added(F.col("logs"), size, F.col("n")).alias("sums"), F.sum(F.coalesce(F.length("word"), F.lit(0)) * F.col("n")).alias("letters"), F.sum("n").alias("words")
    )
    e = F.when(F.col("letters") > 0, F.transform("sums", lambda x: -x / (F.col("letters") + F.col("words")))).otherwise(F.array(*[F.lit(0.0)] * size))
    langs = F.array(*map(F.lit, model.langs))
    found = found.withColumn("e", e).withColumn("least", F.array_min("e"))
    odds = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(-(x - F.col("least")) * (F.col("letters") + F.col("words"))))
    lang = F.when(F.col("letters") > 0, F.element_at(langs, F.array_position("e", F.col("least")).cast("int"))).otherwise("und")
    own = F.try_element_at("e", F.nullif(F.array_position(langs, F.col("lang")), F.lit(0)).cast("int"))
    score = F.when(F.col("letters") > 0, 1 / odds).otherwise(0.0)
    return found.select("doc_id", "lang", lang.alias("lang_pred"), score.alias("score"), F.col("least").alias("cross_entropy"), own.alias("own"), F.col("letters").cast("double").alias("letters"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, lang_pred, score, cross_entropy, own, letters`` of every whole text; ``own`` is the cross-entropy
    under the language that the text has, null where that is none of the models'.

    Rows without an id are scored too. With arrays it is one pass without a shuffle, with tables a join.
    """
    rows = docs.select("doc_id", "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    if model.tables is not None:
        return _joined(rows, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _scored_rows(it, sent.value), SCORED)


def quantiles(found: DataFrame, q: float) -> dict[str, float]:
    """The quantile of ``e`` per language of ``found(lang, e)`` over all rows, to within 1e-6.

    Rows are counted in bins of a thousandth, then the bins that hold it in bins of a millionth, so no task and not the
    driver holds more than the bins. ``found`` is read twice.
    """
    bins: dict[str, list] = {}
    coarse = F.floor(F.col("e") * 1000)
    for lang, b, n in found.groupBy("lang", coarse.alias("b")).count().orderBy("lang", "b").collect():
        bins.setdefault(lang, []).append((b, n))
    ranks = {}
    for lang, held in bins.items():
        at = q * (sum(n for _, n in held) - 1)
        for rank in {math.floor(at), math.ceil(at)}:
            before = 0
            for b, n in held:
                if rank < before + n:
                    break
                before += n
            ranks[lang, rank] = b, rank - before
    if not ranks:
        return {}
    chosen = found.sparkSession.createDataFrame(sorted({(lang, b) for (lang, _), (b, _) in ranks.items()}), "lang string, b long")
    fine = found.withColumn("b", coarse).join(F.broadcast(chosen), ["lang", "b"]).groupBy("lang", "b", F.floor(F.col("e") * 1_000_000).alias("f")).agg(F.count("*"), F.max("e"))
    within: dict[tuple, list] = {}
    for lang, b, _, n, e in fine.orderBy("lang", "b", "f").collect():
        within.setdefault((lang, b), []).append((n, e))

    def value(lang, rank):
        b, left = ranks[lang, rank]
        for n, e in within[lang, b]:
            if left < n:
                return e
            left -= n

    out = {}
    for lang, held in bins.items():
        at = q * (sum(n for _, n in held) - 1)
        low, high = value(lang, math.floor(at)), value(lang, math.ceil(at))
        out[lang] = low + (high - low) * (at - math.floor(at))
    return out


def calibration() -> Column:
    """The texts, by a hash of the id, that give thresholds and no counts: one in CALIBRATION_PART. A null id is none of them."""
    return F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION_PART)) == 0)


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set the thresholds of rejection from ``rows``, what ``scored`` gave for the training texts: quantiles over those of the
    calibration part; of languages that have none there, over all."""
    found = rows.filter((F.col("letters") >= CALIBRATION_LETTERS) & F.col("own").isNotNull())
    limits = quantiles(found.filter(calibration()).select("lang", F.col("own").alias("e")), REJECT_QUANTILE)
    if not limits.keys() >= set(model.langs):
        limits = quantiles(found.select("lang", F.col("own").alias("e")), REJECT_QUANTILE) | limits
    model.reject = np.array([limits.get(lang, np.inf) for lang in model.langs]) * REJECT_MARGIN


def fit(docs: DataFrame, order: int = ORDER, cells: int = MODEL_CELLS) -> Model | None:
    """Fit on ``docs(doc_id, text, lang)``; None if no text with a language has a letter. Null languages are left out.

    Texts of the calibration part give the thresholds and none of the counts, all other texts the counts; together they are
    all these documents. Where one of the parts is empty, the other serves both. ``cells`` bounds only what is broadcast.
    """
    docs = docs.filter("lang is not null")
    model = learn(docs.filter(~calibration()), order, cells) or learn(docs, order, cells)
    if model is not None:
        calibrate(model, materialise(scored(docs, model), "calibration"))
    return model


def marked(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` from what ``scored`` gave."""
    limit = F.try_element_at(F.array(*(F.lit(float(x)) for x in model.reject)), F.nullif(F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang_pred")), F.lit(0)).cast("int"))
    doubt = F.coalesce((F.col("letters") > 0) & (F.col("cross_entropy") > limit), F.lit(False))
    return rows.select("doc_id", "lang_pred", "score", "cross_entropy", doubt.alias("rejected"))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` of every whole text.

    ``lang_pred`` is a learned language, or ``und`` for null texts and texts without letters (score 0) and without a
    model; of equal cross-entropies the first language in sort order. ``score`` is its posterior, every language being as likely
    beforehand. ``rejected`` marks texts whose best cross-entropy is above the calibrated threshold of that language.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("rejected"))
    return marked(scored(docs, model), model)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))  # a null id is in no fold
    known = docs.filter(~held & F.col("lang").isNotNull())
    model = learn(known.filter(~calibration())) or learn(known)
    if model is None:
        out = predict(docs, None)
    else:
        rows = materialise(scored(docs, model), "scored")  # texts are scored once, for the thresholds and the result
        calibrate(model, rows.filter(~held))
        out = marked(rows, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


ORACLE_SQL = None  # a fitted model; tests measure held-out accuracy and check the models against plain formulas
