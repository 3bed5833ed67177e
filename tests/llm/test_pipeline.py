import os
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quizmill.llm import decontaminate, quality, token_output

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def test_stages_take_effect_and_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) <= seen and len(rows) == out.count()
        if name == "quality classifier":
            assert set(rows) == {i for i, s in scores.items() if s >= corpus_pipeline.KEEP_SCORE}
        if name == "exact dedup":
            folded = [decontaminate_fold(t) for t in rows.values()]
            before = {decontaminate_fold(r.text) for r in docs.collect()}
            assert len(set(folded)) == len(folded) and set(folded) == before
        if name == "n-gram Jaccard join":
            sets = {i: shingles(t) for i, t in rows.items()}
            items = sorted(sets)
            assert not any(sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for n, a in enumerate(items) for b in items[:n])
        if name == "benchmark decontamination":
            again = decontaminate.decontaminate(out, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert again.filter("contaminated").isEmpty()
        docs, seen = spark.createDataFrame(out.collect(), out.schema), set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen
    texts, encoder = {r.doc_id: r.text for r in docs.collect()}, token_output.Encoder.of(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for r in packed:  # the ids of each piece, as read from the sequences
        ids = [*encoder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in packed) == sum(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())


def decontaminate_fold(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_repeated_rows_and_empty_input(spark):
    docs = spark.createDataFrame([(1, "A b"), (1, "A b"), (2, "a B"), (3, None)], "doc_id long, text string")
    kept = corpus_pipeline.exact_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3]
    again = corpus_pipeline.exact_stage(spark, docs.filter("doc_id = 1"), SF).collect()
    assert [r.doc_id for r in again] == [1]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_stage_tells_rows_of_one_id_apart(spark):
    rows = [(None, "x"), (None, "x"), (None, "y"), (None, "A b"), (1, "A b"), (1, "A b"), (1, "a b"), (1, "c"), (2, "c"), (1, "d"), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, "x"), (None, "y"), (1, "A b"), (1, "d"), (2, "c"), (3, None)], key=repr)
    assert kept(corpus_pipeline.exact_stage(spark, docs, SF)) == want
    single = docs.filter("text in ('c', 'd', 'y')")
    assert kept(corpus_pipeline.exact_stage(spark, single, SF)) == sorted([(None, "y"), (1, "d"), (2, "c")], key=repr)


def test_later_stages_tell_rows_of_one_id_apart(spark):
    near = LONG + " more"
    docs = spark.createDataFrame([(1, LONG), (2, near), (2, "quite another text of its own"), (None, near + " words"), (None, "a last one")], "doc_id long, text string")
    want = sorted([(1, LONG), (2, "quite another text of its own"), (None, "a last one")], key=repr)
    assert kept(corpus_pipeline.near_stage(spark, docs, SF)) == want
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, item), (1, "clean"), (None, item), (None, "clean too")], "doc_id long, text string")
    assert kept(corpus_pipeline.decontaminate_stage(spark, docs, SF)) == sorted([(1, "clean"), (None, "clean too")], key=repr)


def test_quality_stage_by_row_and_without_a_model(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "bad"), (None, "good")], "doc_id long, text string")
    monkeypatch.setattr(quality, "fit", lambda *_: None)
    assert corpus_pipeline.quality_stage(spark, docs, SF).count() == 4
    monkeypatch.setattr(quality, "fit", lambda *_: "model")
    monkeypatch.setattr(quality, "score", lambda d, m: d.selectExpr("doc_id", "IF(text = 'bad', 0.0D, 1.0D) AS score"))
    assert kept(corpus_pipeline.quality_stage(spark, docs, SF)) == sorted([(1, "good"), (None, "good")], key=repr)


def test_clashing_columns_and_odd_texts_pass_all_stages(spark):
    names = ["_row", "_hash", "_id", "_sha", "doc", "id", "component_id", "text_sha256", "keep_id", "score"]
    rows = [(1, LONG), (2, LONG), (3, LONG + " more"), (4, None), (5, ""), (6, "w " * 50_000), (None, "alone here")]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = {"exact dedup": {2, 3, 5, 6, None}, "n-gram Jaccard join": {1, 4, 5, 6, None}, "benchmark decontamination": {1, 2, 3, 4, 5, 6, None}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert name not in left or set(got) == left[name]
        assert all(got[i][n] == f"{n}{i}" for i in got for n in names)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {1, 2, 3, 4, 5, 6, None}
