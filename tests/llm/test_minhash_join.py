import random

import numpy as np
import pytest
from test_jaccard_join import corpus, edited, plain

from quizmill.llm import jaccard_join as J
from quizmill.llm import minhash_join as M


def run(spark, docs, k, threshold):
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in docs], "doc_id long, text string, n int, key string, s0 int").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in M.minhash_join(df, k, threshold).collect()}


@pytest.mark.parametrize("seed,k,threshold", [(1, 3, 85), (2, 5, 80), (3, 2, 100)])
def test_against_brute_force(spark, seed, k, threshold):
    docs = corpus(seed)
    assert run(spark, docs, k, threshold) == plain(docs, k, threshold)


def test_one_large_group_hot_lists_and_tiles(spark, monkeypatch):
    """Near copies that share long lists, some only by a chain; hot lists are sent, tiles cut small, no centre named."""
    monkeypatch.setattr(M, "HOT_LIST", 20)
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "TILE_TOKENS", 4000)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(180)]
    docs = [" ".join(edited(rng, base, rng.randrange(1, 7))) for _ in range(150)]
    chain = [f"c{i}" for i in range(300)]
    docs += [" ".join(chain[i * 10 : i * 10 + 200]) for i in range(10)]
    docs = list(enumerate(docs)) + [(1000 + i, t) for i, t in corpus(5)]
    assert run(spark, docs, 3, 85) == plain(docs, 3, 85)


def test_query_columns_and_edges(spark, monkeypatch):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (2, "A b\tc d e"), (7, None), (8, " \n"), (9, "one two"), (10, "one  TWO"), (11, "w " * 40_000), (12, "x y w " + "w " * 40_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    monkeypatch.setattr(M, "table", lambda *_: df)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.query(spark, "").collect()}
    assert got == {None: (3, None, True), 3: (3, 2, False), 2: (3, 2, True), 7: (0, 7, True), 8: (0, 8, True), 9: (1, 9, True), 10: (1, 9, False), 11: (1, 11, True), 12: (3, 12, True)}
    assert run(spark, [], 3, 85) == {}


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain(docs, 3, 85)


def test_matches_of_pairs_at_the_threshold():
    """Agreeing coordinates are as many as the similarity says, and none of 3,000 pairs at it falls short."""
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(3000):
        core, x, y = rng.integers(0, 2**63, 170).astype(np.uint64), rng.integers(0, 2**63, 15).astype(np.uint64), rng.integers(0, 2**63, 15).astype(np.uint64)
        tokens = np.concatenate([core, x, core, y])
        s = M.signatures(tokens, np.array([0, 185, 370]))
        agree.append(int((s[0] == s[1]).sum()))
    assert abs(np.mean(agree) / M.COORDINATES - 0.85) < 0.01
    assert min(agree) >= M.least_matches(85) >= 14
