import pytest
from pyspark.sql import functions as F

from quizmill.operators import clean, extract, ingest
from quizmill.sources.schemas import EXTRACTION

PAGE = """<html><head><title> The page </title><style>p{}</style></head><body><header>menu</header><nav>x</nav><article><h1>Head</h1><p>First <b>bold</b> text</p>
<script>var a = "<p>no</p>";</script><p>Second &amp; last</p></article><footer>foot</footer></body></html>"""


def test_page_text(spark):
    title, text = spark.createDataFrame([(1, PAGE)], "page_id long, html string").transform(clean.clean_html).select("title", "text").first()
    assert title == "The page" and text == "Head\nFirst\nbold\ntext\nSecond & last"


def test_clean_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<html><body>abc</body></html>"), (3, None)], "page_id long, html string")
    out = {r.page_id: r for r in clean.clean_html(df).collect()}
    assert out[1].title == "The page" and "menu" not in out[1].text and "foot" not in out[1].text
    assert (out[2].text, out[2].char_count) == ("abc", 3) and out[3].text == ""


@pytest.mark.parametrize("text,want", [
    ("body\n评论 点赞 收藏 分享\nafter", "body"),
    ("body\n" + "x" * 30 + "点赞收藏\nafter", "body\n" + "x" * 30 + "点赞收藏\nafter"),
    ("a\n93\n9 42 4\nb", "a\nb"), ("a\n 分享 \nb", "a\nb"), ("a\n\n\n\n\nb", "a\n\nb"), ("", ""), (None, None), ("　wide　\n查看3道真题", "wide"), ("a\r\n12\r\nb", "a\nb"),
])
def test_strip_noise(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(clean.strip_noise(F.col("t"))).first()[0] == want


def test_routing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "h"), (3, "abc", "h"), (4, " " * 200, "h"), (5, "x" * 100, None)], "id long, cleaned_text string, raw_html string")
    df = df.withColumn("extract_status", F.lit("pending")).withColumn("extract_error", F.lit(None).cast("string"))
    out = {r.id: (r.skip_reason, r.extract_status) for r in clean.route_posts(df).collect()}
    assert out == {1: ("no_raw_html", "pending"), 2: ("no_cleaned_text", "pending"), 3: ("too_short:3<100", "skipped"), 4: ("no_cleaned_text", "pending"), 5: (None, "pending")}


def record(spark, *payloads):
    return extract.normalise_extraction(extract.parse_extraction(spark.createDataFrame(list(enumerate(payloads)), "post_id long, payload string")))


def test_extraction(spark):
    good = '{"companies": ["a"], "level": "暑期实习", "interview_date": "2024-05-17", "rounds": [{"round_no": 1, "round_type": "odd", "questions": [{"content": " q1 ", "category": "算法"}, {"content": "q2", "category": "odd"}]}, {"round_no": 2, "questions": []}]}'
    bad_round, short = good.replace('"round_no": 1', '"round_no": 99'), good.replace('" q1 "', '"q"')
    valid, rejected = extract.split_valid(record(spark, good, bad_round, short, '{"rounds": [', None, '{"interview_date": "soon"}', '{"level": "odd"}'))
    ok = {r.post_id: r.record for r in valid.collect()}
    assert set(ok) == {0, 5} and ok[0].level == "实习" and ok[0].interview_date == "2024-05" and ok[5].interview_date is None and ok[5].level == "未知"
    assert {r.post_id: r.violations for r in rejected.collect()} == {1: ["round_no"], 2: ["content"], 3: ["corrupt"], 4: ["corrupt"], 6: ["level"]}
    rows = extract.explode_questions(valid).orderBy("seq").collect()
    assert [(r.round_no, r.round_type, r.content, r.category) for r in rows] == [(1, "其他", "q1", "算法"), (1, "其他", "q2", "其他")]
    assert {r.post_id: r.n_questions for r in extract.question_totals(valid).collect()} == {0: 2, 5: 0}
    assert EXTRACTION.startswith("companies")


def test_texts_are_parsed_once(spark):
    from quizmill.plans import content
    from quizmill.plans.registry import QUERIES

    def parses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")

    t = content.Inputs(spark, "/root/testdata/sf0.001")
    assert parses(content.exploded(t)) == 1
    assert parses(QUERIES["r25_split_valid"](spark, t.folder)) == 2  # one for each of the parts it puts together
    assert parses(QUERIES["r26_replace_questions"](spark, t.folder)) == 0  # stored before it is read twice


def test_content_key_is_stable(spark):
    df = spark.createDataFrame([("t", 1)], "a string, b int")
    one = df.select(extract.content_key({"a": F.col("a"), "b": F.col("b")}, "n", "v1")).first()[0]
    two = df.select(extract.content_key({"b": F.col("b"), "a": F.col("a")}, "n", "v1")).first()[0]
    assert one == two and len(one) == 64
    assert one != df.select(extract.content_key({"a": F.col("a"), "b": F.col("b")}, "n", "v2")).first()[0]
    assert one != df.select(extract.content_key({"a": F.col("a"), "b": F.col("b")}, "m", "v1")).first()[0]


def test_discover_urls(spark):
    html = '<a href="/discuss/1?from=x">1</a><a href=\'https://www.example.com/discuss/2\'>2</a><a href="/about">no</a><script>{"u": "https://www.example.com/feed/main/detail/ab-c"}</script><a href="/discuss/1?ref=y">again</a>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    out = ingest.discover_urls(df, "https://www.example.com", [r"/discuss/\d+$", r"/feed/main/detail/[\w-]+$"])
    assert sorted(r.url for r in out.collect()) == ["https://www.example.com/discuss/1", "https://www.example.com/discuss/2", "https://www.example.com/feed/main/detail/ab-c"]


def test_page_date(spark):
    rows = [('<meta property="article:published_time" content="2024-05-06T07:08:09Z">', "x 2020-01-01"), ("<p>", "on 2021-02-30 or 2022年1月15日"), ("<p>", "none"), ('<meta content="bad" name="pubdate">', "2023/12/31")]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "h string, t string").select(ingest.page_date(F.col("h"), F.col("t"))).collect()]
    assert got == ["2024-05-06 07:08:09", "2022-01-15 00:00:00", "None", "2023-12-31 00:00:00"]


def test_questions_carry_whole_texts(spark):
    from types import SimpleNamespace

    from quizmill.plans import content

    long, late = "word " * 40 + "end", " " * 80 + "late"
    turns = [(10, 0, "user", long), (10, 1, "assistant", late), (10, 2, "user", '"quoted"\n\\ ' + long), (10, 3, "assistant", "short")]
    t = SimpleNamespace(conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.round_no, r.content) for r in content.exploded(t).collect()}
    assert got == {(turn // 2 + 1, text.strip()) for _, turn, _, text in turns}


def test_repeated_outcomes_and_answers_do_not_multiply(spark):
    from quizmill.operators import answers

    posts = spark.createDataFrame([(1, "pending", None, 0)], "id long, extract_status string, extract_error string, extract_version int")
    o = spark.createDataFrame([(1, "failed", "e", None), (1, "done", None, 3)], "post_id long, outcome string, error string, version int")
    assert [tuple(r) for r in extract.apply_outcomes(posts, o).collect()] == [(1, "done", None, 3)]
    q = spark.createDataFrame([(1, None, None)], "id long, answer_ai string, answer_ai_version int")
    out, counts = answers.apply_answers(q, spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "id long, answer string"), 3)
    assert [tuple(r) for r in out.collect()] == [(1, "a", 3)] and counts.first().asDict() == {"generated": 1, "failed": 0}


def test_html_without_a_parser(spark):
    pages = {
        1: "<p>a<br>b <b>c</b></p><!-- <p>x</p> -->d",
        2: "<body>x</body><BODY class='a>b'>y &amp; z&nbsp;&lt;p&gt; &copy;&copy &#65;&#x42; &#128; &#0; &nope; &</body>",
        3: "<title> One &amp; two </title><title>Three</title>text<script>var a = '<p>no</p>';</script><nav>no<p>no</nav>yes<style>p{}",
        4: "a < b and c > d <p title=\"x > y\">e</p> <a href='/q",
        5: "<title> </title>", 6: "", 7: None, 8: "<!-- open", 9: "<header>never closed <p>x", 10: "l1\r\nl2 \x0b l3",
    }
    df = spark.createDataFrame([(i, h, "kept") for i, h in pages.items()], "page_id long, html string, text string")
    out = {r.page_id: (r.title, r.text) for r in clean.clean_html(df.drop("text")).collect()}
    assert out == {
        1: (None, "a\nb\nc\nd"), 2: (None, "y & z\xa0<p> ©© AB € � &nope; &"), 3: ("One & two", "text\nyes"), 4: (None, "a < b and c > d\ne"),
        5: (None, ""), 6: (None, ""), 7: (None, ""), 8: (None, ""), 9: (None, ""), 10: (None, "l1\nl2\nl3"),
    }
