import math
import random

import numpy as np
import pytest

from quizmill.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x string, summary string"


def plain(rows):
    vectors = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id % 7 == 0:
            label = (label + 1) % 10
        vectors.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, (a, av, al) in enumerate(vectors):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), b, label) for j, (b, v, label) in enumerate(vectors) if j != i]
        scored.sort()
        for s, p, label in [x for x in scored if x[2] == al][:5]:
            found = [x for x in scored if x[2] != al and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def of(spark, monkeypatch, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    monkeypatch.setattr(h, "table", lambda *_: df)
    return sorted(map(tuple, h.query(spark, "").collect()))


def cloud(n, width, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0.2, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [c * rng.random() + rng.gauss(0, 0.3) for c in centres[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 5, 24])
def test_matches_plain(spark, monkeypatch, width):
    monkeypatch.setattr(h, "PAIRS", 500)
    monkeypatch.setattr(h, "block_rows", lambda _: 90)  # several blocks a side
    rows = cloud(900, width, width)
    want = plain(rows)
    assert want and of(spark, monkeypatch, rows) == want


def test_edges(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = cloud(210, 4, 7)
    rows += [(300, None, 1), (400, [1.0, None, 1.0, 1.0], 1), (500, [nan, 1.0, 1.0, 1.0], 1), (600, [inf, 1.0, 1.0, 1.0], 1), (700, [1.0] * 4, None), (None, [9.0] * 4, 1)]
    rows += [(800, [1.0] * 4, 77)]  # an anchor alone with its label
    rows += [(900 + i, [0.5] * 4, i % 2) for i in range(40)]  # ties
    assert of(spark, monkeypatch, rows) == plain(rows)
    assert of(spark, monkeypatch, []) == []
    assert of(spark, monkeypatch, [(1, [1.0], 0)]) == []


def test_large_components_stay_exact(spark, monkeypatch):
    rows = [(i, [float(2**25 + 3 * i), 1.0 + i], i % 2) for i in range(0, 220, 4)]
    assert of(spark, monkeypatch, rows) == plain(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for width in (1, 7, 8, 13, 64):
        x = np.floor(rng.normal(5, 40, (60, width)))
        lengths = h.segment_lengths(width)
        exact, last = x @ x.T, None
        for mean, dev in h.levels(h.summaries(x, lengths), lengths):
            middle, spread = mean @ mean.T, dev @ dev.T
            assert (np.abs(exact - middle) <= spread + 1e-6).all()
            assert last is None or (spread <= last + 1e-6).all()  # finer segments never bound worse
            last = spread
