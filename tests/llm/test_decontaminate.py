import random
import re
from collections import Counter

import pytest

from quizmill.llm.decontaminate import build_index, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, items, window=10):
    out = {}
    for i, text in docs:
        d, hit, found = ws(text), set(), set()
        for item, t in items:
            w = ws(t)
            n = min(window, len(w))
            for o in range(len(w) - n + 1 if w else 0):
                for s in range(len(d) - n + 1):
                    if d[s : s + n] == w[o : o + n]:
                        hit.update(range(s, s + n))
                        found.add(str(item))
        out[i] = (len(d), len(hit), sorted(found))
    return out


def run(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], "doc_id long, text string, pos int, term string")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, ws string")
    out = decontaminate(d, b, window)
    return {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in out.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Été", "x1", "zz", "q", "über"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 5, 8, 12]))) for i in range(8)] + [(98, None), (99, "...")]
    docs = [(i, say(rng.randrange(0, 60)) + ". " + rng.choice([t for _, t in items[:8]]).upper() + "!") for i in range(25)]
    docs += [(100, None), (101, ""), (102, "--"), (103, say(3000))]
    assert run(spark, docs, items, 6) == plain(docs, items, 6)


def test_overlapping_and_repeated_occurrences(spark):
    items = [(7, "a b a b a b a b a b a b"), (8, "one two three"), (8, "one two three")]
    docs = [(1, "a b " * 12), (2, "A, b; a b a b a b a b"), (3, "a b a b a b a b a c"), (4, "xx one-TWO three one two THREE"), (4, "xx one-TWO three one two THREE"), (5, "one two")]
    got = run(spark, docs, items)
    assert got == plain(docs, items)
    assert got[4] == (7, 6, ["8"]) and got[3][1] == 0 and got[5][1] == 0


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b c")], []) == {1: (3, 0, [])}


def plain_near(docs, items, window, slop):
    """Items of which the two rarest known words of a window stand within ``slop`` of their distance."""
    texts, tests = [ws(t) for _, t in docs], {(i, tuple(ws(t))) for i, t in items}
    freq, vocabulary = Counter(w for d in texts for w in d), {w for _, t in tests for w in t}
    out = []
    for d in texts:
        found = set()
        for item, t in tests:
            for o in range(max(len(t) - window, 0) + 1):
                known = sorted((freq[t[p]], p) for p in range(o, min(o + window, len(t))) if freq[t[p]])
                if len(known) > 1:
                    p1, p2 = known[0][1], known[1][1]
                    at1, at2 = ([i for i, w in enumerate(d) if w == t[p]] for p in (p1, p2))
                    if any(x != y and abs(y - x - p2 + p1) <= slop for x in at1 for y in at2):
                        found.add(item)
        out.append(len(found))
    assert vocabulary
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity_against_brute_force(spark, slop):
    rng = random.Random(slop)
    vocabulary = ["the", "of", "and", "Été", "x1", "zz", "q", "rare", "odd"]
    say = lambda n: " ".join(rng.choices(vocabulary, weights=[9, 9, 9, 2, 2, 2, 2, 1, 1], k=n))
    items = [(i, say(rng.choice([1, 3, 5, 9])) + rng.choice(["", " nowhere"])) for i in range(8)] + [(5, "rare one two odd"), (6, None)]
    docs = [(i, say(rng.randrange(0, 30))) for i in range(30)] + [(40, "rare one three odd"), (None, "odd rare"), (41, "rare a b c d e f g h odd"), (41, "rare"), (42, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_near) for r in decontaminate(d, b, 6, slop).collect())
    assert got == sorted((i or -1, len(ws(t)), n) for (i, t), n in zip(docs, plain_near(docs, items, 6, slop)))


def test_an_index_of_all_words_serves_other_tests(spark):
    docs = [(1, "one two three four"), (2, "five six, seven"), (None, "three four one"), (3, "x " * 30_000 + "six seven")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = build_index(d)
    for items in ([(1, "two three")], [(1, "six seven"), (2, "four one")], [(None, "one two")]):
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate(d, b, 3, index=index).collect()}
        assert got == {i: v[:2] for i, v in plain(docs, items, 3).items()}


def test_rows_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "one two x x"), (1, "y y three four"), (1, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate(docs, items, 4).collect()) == [(1, 0), (1, 0), (1, 4)]
