import pytest
from pyspark.sql import functions as F

from quizmill.llm.chat_format import Template, escape, format_chats, parse_chats, segments, unescape

TURNS = "conv_id long, turn long, role string, text string, start string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "[", "<<SYS>>\n<</SYS>>", "[/TURN][ROLE]x[/ROLE]", "", "<</s>", "é\n\\n", "<<<SYS>>"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string")
    for r in df.select("t", escape(F.col("t"), Template()).alias("e"), unescape(escape(F.col("t"), Template())).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in Template().controls())


def test_round_trip_and_loss_mask(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)] + [(2, 0, "system", None), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "tool [ROLE]", "x</s>"), (3, 1, None, "y")]
    out = {r.conv_id: r for r in parse_chats(format_chats(make(spark, rows))).collect()}
    for conv in (1, 2, 3):
        want = [(r or "", t or "") for c, _, r, t in sorted(rows, key=lambda x: (x[0], x[1])) if c == conv]
        assert [(t.role, t.text) for t in out[conv].turns] == want
        spans = [out[conv].formatted[s.start : s.start + s.length] for s in out[conv].loss_spans]
        assert len(spans) == sum(r == "assistant" for r, _ in want)
    assert [out[2].formatted[s.start : s.start + s.length] for s in out[2].loss_spans] == ["a"]


def test_state_machine(spark):
    def order(roles):
        return [(1, i, r, "t") for i, r in enumerate(roles)]

    for roles, valid, bad in ((["system", "user", "assistant"], True, None), (["user", "assistant", "user", "assistant"], True, None), (["user"], False, None), (["assistant"], False, 0), (["user", "user", "assistant"], False, 1), (["user", "system"], False, 1), (["user", "who"], False, 1)):
        r = format_chats(make(spark, order(roles))).first()
        assert (r.valid, r.first_bad_turn) == (valid, bad), roles


def test_ties_repeats_empty_and_null_ids(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "user", "n")]
    out = {r.conv_id: r for r in format_chats(make(spark, rows)).collect()}
    assert out[1].formatted == "[INST]a[/INST][INST]a[/INST][INST]b[/INST]"
    assert out[None].formatted == "[INST]n[/INST]"
    assert format_chats(make(spark, [])).count() == 0
    assert segments(make(spark, rows)).count() == 4


def test_other_template(spark):
    t = Template(marks={"q": ("Q:", ";;"), "a": ("A:", ";;")}, follows={"^": ("q",), "q": ("a",)}, ends=("a",), trained=("q", "a"))
    r = parse_chats(format_chats(make(spark, [(1, 0, "q", "1;;Q:"), (1, 1, "a", "x")]), t), t).first()
    assert r.valid and [(x.role, x.text) for x in r.turns] == [("q", "1;;Q:"), ("a", "x")] and len(r.loss_spans) == 2
    with pytest.raises(ValueError):
        Template(marks={"q": ("Q", ";")})
