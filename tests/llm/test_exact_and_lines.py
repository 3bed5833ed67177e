import hashlib
from collections import Counter

from quizmill.llm.exact_dedup import exact_dedup
from quizmill.llm.line_dedup import line_dedup

DOCS = "doc_id long, text string, kept string, h string"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(s):
    return (s or "").translate(str.maketrans(UP, LOW))


def make(spark, pairs):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in pairs], DOCS)


def test_exact_groups_fold_ascii_only_and_keep_one(spark):
    pairs = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, "x" * 200_000), (7, "X" * 200_000), (8, "one")]
    for keep, best in (("smallest", min), ("largest", max)):
        out = {r.doc_id: r for r in exact_dedup(make(spark, pairs), keep=keep).collect()}
        groups = {}
        for i, t in pairs:
            groups.setdefault(fold(t), []).append(i)
        assert len(out) == len(pairs)
        for text, ids in groups.items():
            for i in ids:
                assert (out[i].keep_id, out[i].group_size, out[i].kept) == (best(ids), len(ids), i == best(ids))
                assert out[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_repeated_rows_nulls_and_empty_table(spark):
    out = exact_dedup(make(spark, [(1, "a"), (1, "a"), (2, "A"), (None, "a"), (None, "b")]), keep="smallest").collect()
    assert len(out) == 5
    assert sum(r.kept for r in out if r.keep_id == 1) == 1
    assert Counter(r.group_size for r in out) == {4: 4, 1: 1}
    assert [r.kept for r in out if r.doc_id is None and r.group_size == 1] == [True]
    assert exact_dedup(make(spark, [])).count() == 0


def test_exact_tells_collided_hashes_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.md5
    monkeypatch.setattr(F, "md5", lambda c: real(F.lit("the same for all")))
    out = {r.doc_id: r for r in exact_dedup(make(spark, [(1, "a"), (2, "A"), (3, "b")])).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in out.items()} == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}


def plain_lines(pairs, min_chars=40, min_docs=5):
    held, last = {}, {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            k = fold(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(i)
    last = {k: max(ids) for k, ids in held.items() if len(ids) >= min_docs}
    out = {}
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(fold(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_shared_by_many_documents_are_dropped(spark):
    a, b, short = "The same line of forty characters, at least.", "Été: another long line that is in four only.", "short line"
    pairs = [(i, "\n".join([f"own {i}", "  " + (a.upper() if i % 2 else a) + "\t", short, "", a])) for i in range(6)]
    pairs += [(10 + i, b + f"\n{i}") for i in range(4)] + [(20, None), (21, ""), (22, "\n\n"), (23, a), (24, "x" * 100_000)]
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(make(spark, pairs)).collect()}
    assert out == plain_lines(pairs)
    assert out[0][1] == 2 and out[23][1] == 0 and out[10][1] == 0
    assert line_dedup(make(spark, [])).count() == 0


def test_lines_count_documents_not_places_or_repeated_rows(spark):
    line = "a line of more than forty characters, said over and over"
    pairs = [(1, "\n".join([line] * 9)), (2, line), (3, line), (3, line), (3, line), (None, line)]
    assert all(r.n_dropped == 0 for r in line_dedup(make(spark, pairs)).collect())


def test_hot_lines_are_joined_in_parts(spark, monkeypatch):
    """Where lines are not broadcast, each is split as often as its own count asks for."""
    from quizmill.llm import line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(module, "SALT_ROWS", 7)
    lines = [f"a line number {i} of more than forty characters in all" for i in range(30)]
    pairs = [(i, "\n".join([lines[0], *(x for k, x in enumerate(lines) if i % (k + 1) == 0), f"own {i}"])) for i in range(90)]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(make(spark, pairs)).collect()} == plain_lines(pairs)
