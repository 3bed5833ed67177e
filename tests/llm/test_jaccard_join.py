import random

import numpy as np
import pyarrow as pa
import pytest

from quizmill.llm import jaccard_join as J


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(docs, k, threshold):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(["new", "other", "word"]) + str(rng.randrange(50))
    return out


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    shared = [f"s{i}" for i in range(40)]
    for base in range(14):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(6):
            docs.append(" ".join(edited(rng, words, rng.randrange(0, 1 + len(words) // 30 + 1))))
    docs += [" ".join(shared + [f"t{rng.randrange(999)}" for _ in range(20)]) for _ in range(15)]
    docs += ["", None, " \t\n", "a", "A", "a b", "a  B", "É é", "é É"] + docs[:5]
    return list(enumerate(docs))


def run(spark, docs, k, threshold):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, n int, key string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df, k, threshold).collect()}


@pytest.mark.parametrize("seed,k,threshold", [(1, 4, 85), (2, 5, 80), (3, 2, 70)])
def test_against_brute_force(spark, seed, k, threshold):
    docs = corpus(seed)
    assert run(spark, docs, k, threshold) == plain(docs, k, threshold)


def test_chain_of_links_and_hub(spark, monkeypatch):
    """Copies of one base that link with it but hardly with each other, and a chain."""
    monkeypatch.setattr(J, "HUB_ROUNDS", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    docs = [(100 - i, " ".join(edited(rng, base, 3))) for i in range(40)] + [(500, " ".join(base))]
    chain = [f"c{i}" for i in range(300)]
    for i in range(10):
        docs.append((600 + i, " ".join(chain[i * 10 : i * 10 + 200])))
    assert run(spark, docs, 4, 85) == plain(docs, 4, 85)


def test_tiles_split_and_null_ids_repeats_and_empty(spark, monkeypatch):
    docs = corpus(7)
    monkeypatch.setattr(J, "TILE", 3)
    monkeypatch.setattr(J, "TILE_TOKENS", 200)
    monkeypatch.setattr(J, "HUB_ROUNDS", 1)
    assert run(spark, docs + docs[:10], 4, 85) == plain(docs, 4, 85)
    out = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(out, 4, 85).collect()}
    assert got == {None: (2, None), 1: (2, 1)}
    assert run(spark, [], 4, 85) == {}


@pytest.mark.parametrize("shares", [[], [(1.0, 0.3, 50.0)], [(0.5, 0.9, 1e6), (0.5, 0.1, 2.0)]])
def test_signatures_never_miss_a_linked_pair(shares):
    """The pigeonhole: sets at the threshold always share a key, whatever the allocation."""
    rng = np.random.default_rng(3)
    bands = J.Bands(85, shares)
    for n in list(range(1, 60)) + [100, 147, 300, 1000]:
        for _ in range(6):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            most = n * 15 // 85
            drop = int(rng.integers(0, most + 1))
            add = most - drop if drop else int(rng.integers(0, most + 1))
            y = np.concatenate([x[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both < 85 * (len(x) + len(y) - both) or np.array_equal(np.sort(x), np.sort(y)):
                continue
            tokens = np.concatenate([np.sort(x), np.sort(y)])
            keys, sets = J.signatures(tokens, np.array([0, len(x), len(tokens)]), bands)
            assert set(keys[sets == 0]) & set(keys[sets == 1]), (n, drop, add)


def test_shingle_sets_of_slices_and_long_texts():
    texts = ["zero zero", "One two three four five", None, "x " * 30_000, "", "é ü é ü é"]
    whole = J.shingle_sets(pa.array(texts), 4)
    part = J.shingle_sets(pa.array(["pad pad pad"] + texts).slice(1), 4)
    assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])
    assert np.diff(whole[1]).tolist() == [len(shingles(t, 4)) for t in texts]
    bound = J.sketches(whole[0], whole[1], J.SKETCH)
    assert bound.shape == (6, J.SKETCH)


def test_shared_keys_without_any_link(spark):
    rng = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(120))
    docs = [(i, shared + " " + " ".join(f"t{rng.randrange(9999)}" for _ in range(60))) for i in range(20)]
    got = run(spark, docs, 4, 85)
    assert got == plain(docs, 4, 85) and all(c == i for i, (_, c) in got.items())


def test_large_sets(spark):
    rng = random.Random(11)
    base = [f"l{i}" for i in range(3000)]
    docs = [(i, " ".join(edited(rng, base, n))) for i, n in enumerate([0, 40, 110, 160, 300, 600])] + [(9, " ".join(base[:2600])), (10, " ".join(base[1000:]))]
    assert run(spark, docs, 4, 85) == plain(docs, 4, 85)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 300)], "x long, y long")
    assert {r.node: r.component for r in J.components(edges).collect()} == {**{i: 1 for i in range(1, 71)}, 200: 200, 300: 200}


def test_any_text_of_a_repeated_id_links_and_rows_stay_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base)] + [(2, f"other{i} " * 7 + f"tail{i}") for i in range(6)] + [(2, base + " more"), (2, base + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in J.jaccard_join(docs, k=5, threshold=80).collect())
    assert out == [(1, 56, 1, 1)] + [(2, 2, 2, 2)] * 6 + [(2, 57, 2, 1)] * 2
    docs = spark.createDataFrame([(1, base), (1, "x y z x y z w"), (2, base), (3, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_join(docs, 5, 80).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_threshold_of_equal_sets_only(spark):
    docs = corpus(3)
    assert run(spark, docs, 4, 100) == plain(docs, 4, 100)


def test_without_centres_tiles_find_every_link(spark, monkeypatch):
    """All links come from the tiles, among them those of long texts, of chance neighbours and of one large group."""
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    docs = [t for _, t in corpus(8)] + [" ".join(edited(rng, base, rng.randrange(1, 6))) for _ in range(120)]
    long = [f"l{i}" for i in range(11_000)]
    docs += [" ".join(edited(rng, long, m)) for m in (0, 150, 400, 500, 900)] + [" ".join(long[:10_000])]
    docs = list(enumerate(docs))
    assert run(spark, docs, 4, 85) == plain(docs, 4, 85)


def test_tiles_return_rows_in_proportion_to_sets():
    """Of n sets that are near one another but do not link, n rows and n - 1 edges leave a tile, and no merge."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.sort(np.concatenate([core, rng.integers(0, 2**63, 34).astype(np.uint64)])) for _ in range(60)]  # 0.854 of the union or less
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    tokens = np.concatenate(sets)
    words = J.sketches(tokens, bounds, J.SKETCH)
    ids = np.arange(60)
    columns = [np.zeros(60, np.int64), np.zeros(60, np.int32), ids, np.diff(bounds), ids]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array([None] * 60, pa.list_(pa.int64()))] + [pa.array(w) for w in words.T], names=[f"c{i}" for i in range(6 + J.SKETCH)])
    kind, _, _ = (np.asarray(c) for c in pa.Table.from_batches(list(J.near_rows([batch], 86))).columns)
    assert (kind == 0).sum() == 60 and (kind == 1).sum() == 59
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
    for threshold, merges in ((86, 0), (85, 59)):
        batch = pa.RecordBatch.from_arrays([pa.array(columns[i]) for i in (0, 1, 2, 4)] + [lists], names=["tile", "block", "f", "c", "tokens"])
        assert sum(b.num_rows for b in J.merge_rows([batch], threshold)) == merges


def test_folded_sketches_and_forest():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 2**63, 5000).astype(np.uint64)
    large = J.sketches(tokens, np.array([0, 5000]), 1024)[0].view(np.uint64)
    for words in (16, 128):
        assert np.array_equal(J.fold(large, words), J.sketches(tokens, np.array([0, 5000]), words)[0].view(np.uint64))
    assert [J.level(n) for n in (1, 1200, 1201, 9600, 9601, 76_801)] == [16, 16, 128, 128, 1024, 8192]
    forest = J.Forest(np.array([7, 7, 3, 4, 5]))
    a, b = forest.join(np.array([0, 1, 2, 0, 1]), np.array([2, 2, 0, 3, 3]))
    assert len(a) == 2 and len(set(forest.label[:4])) == 1 and forest.label[4] != forest.label[0]


def test_tiles_arrive_whole_and_one_by_one():
    tile = np.repeat([1, 2, 5, 6, 9], [3, 40, 1, 1, 7])
    table = pa.table({"tile": tile, "x": np.arange(len(tile))})
    for rows in (1, 4, 50, 100):
        got = list(J.whole_tiles(table.to_batches(rows), 64))
        assert [x for g in got for x in np.asarray(g[1])] == list(range(len(tile)))
        ends = [(np.asarray(g[0])[0], np.asarray(g[0])[-1]) for g in got]
        assert all(a[1] != b[0] for a, b in zip(ends, ends[1:])) and (rows > 4 or len(got) > 2)
    assert list(J.whole_tiles([])) == []
