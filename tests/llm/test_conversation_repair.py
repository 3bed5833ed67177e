import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quizmill.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block string"
BLANK = " \t\n\x0b\x0c\r"


def plain(turns):
    """The contract, conversation by conversation, with the ASCII-least audit found by comparing whole audits."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        rows = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(x for x in text if x not in ".!?")
        if h == 4:
            role = "user"
        rows += [(turn, role, text)] * (2 if h == 3 else 1)
    return {conv: one(rows) for conv, rows in convs.items()}


def one(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {}  # (row, state) -> (cost, audit, said), from the end on

    def least(i, q, inserts=0):
        if inserts == 0 and (i, q) in best:
            return best[i, q]
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        if inserts < 2:
            x = least(i, step[q], inserts + 1)
            found.append((x[0] + 2, "I" + x[1], (f"{name[step[q]]}:",) + x[2]))
        if i < len(rows):
            x = least(i + 1, q)
            found.append((x[0] + 3, "D" + x[1], x[2]))
            _, role, text = rows[i]
            if faults[i] not in (1, 2):
                late = int(faults[i] == 3)
                if initials[i] == step[q] or (q == "" and initials[i] == "s"):
                    x = least(i + 1, initials[i])
                    found.append((x[0] + late, "K" + x[1], (f"{role}:{text}",) + x[2]))
                x = least(i + 1, step[q])
                found.append((x[0] + 2 + late, "R" + x[1], (f"{name[step[q]]}:{text}",) + x[2]))
        out = min(found) if found else (10**9, "", ())
        if inserts == 0:
            best[i, q] = out
        return out

    for i in range(len(rows), -1, -1):
        for q in ("", "s", "u", "a"):
            least(i, q)
    cost, audit, said = best[0, ""]
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def of(spark, monkeypatch, turns):
    """The query over ``turns``."""
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA)
    monkeypatch.setattr(c, "table", lambda *_: df)
    return {r[0]: tuple(r)[1:] for r in c.query(spark, "").collect()}


def chats(n, seed, longest=14):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            out.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", "", " \t", "Why?", "Well! \n", None, "x" * 3])))
    return out


def test_matches_plain_search(spark, monkeypatch):
    turns = chats(300, 1)
    assert of(spark, monkeypatch, turns) == plain(turns)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_blocks_of_a_long_conversation(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "BLOCK_BITS", bits)
    monkeypatch.setattr(c, "CHUNK", 7)
    rng = random.Random(bits)
    turns = chats(20, 2) + [(999, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"t{t}."])) for t in range(60)]
    turns += [(None, t // 2, "user", "same.") for t in range(9)]
    assert of(spark, monkeypatch, turns) == plain(turns)


def test_edges(spark, monkeypatch):
    assert of(spark, monkeypatch, []) == {}
    gone = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    turns = [(5, gone, "user", "All of it goes."), (6, None, "user", None), (7, 2**40, "assistant", "long " * 50_000 + ".")]
    got = of(spark, monkeypatch, turns)
    assert got == plain(turns)
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in c.query(spark, sf).collect()} == plain(turns)


def test_real_outputs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes")], "conv_id long, turn long, role string, text string")
    faults, edits, repaired = c.repair(turns)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    assert [tuple(r[n] for n in names) for r in faults.collect()] == [(0, 0, 0, 1, 1)]
    assert [(r.edit, r.role, r.price) for r in edits.orderBy("block", "nr").collect()] == [("K", None, 0), ("I", "assistant", 2), ("K", None, 0), ("K", None, 1)]
    assert [(r.role, r.text) for r in repaired.orderBy("block", "nr").collect()] == [("user", "Hi."), ("assistant", ""), ("user", "There?"), ("assistant", "Yes")]
