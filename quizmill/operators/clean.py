"""Cleaning: HTML to text, interface noise, body selection, length gate."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions.domains import strip_wide

#: Elements whose text is not part of a page's text.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript")

# The wording of the site's interface in stored pages.
NOISE_TOKENS = ("评论", "点赞", "收藏", "分享", "浏览", "真题解析", "一键发评", "快捷表情", "图片", "话题", "表情", "全部评论", "暂无评论", "广告", "相关推荐", "回复TA")
NOISE_MARKER = "点赞.*收藏|收藏.*点赞"
NOISE_PATTERNS = (
    r"^评论\s*点赞\s*收藏.*分享.*浏览\s*\d*\s*$",
    r"^.*点赞\s*收藏.*真题解析.*$",
    r"^一键发评.*表情\s*$",
    r"^首次评论必得.*牛币.*$",
    r"^全部评论.*$",
    r"^暂无评论.*抢首评.*$",
    r"^校招信息汇总表.*$",
    r"^广告\s*$",
    r"^相关推荐\s*$",
    r"^更多真题[：:].*$",
    r"^查看\d+道",
    r"^\d+\s+\d+\s+\d+\s*分享\s*点赞.*$",
    r"^快捷表情\s*$",
    r"^图片\s*话题\s*表情\s*$",
    r"^回复TA\s*$",
    r"^\d+\s*点赞.*$",
    r"^\d+(\s+\d+)*\s*$",
)


LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Comments and dropped elements, each up to its end or that of the page; then any other tag, also one that the page breaks off.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(" + "|".join(DROPPED) + r")\b[^>]*>.*?(?:</\1\s*>|\z)"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_TAG = r"""(?s)<(?:/?[a-zA-Z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+|[!?/][^>]*+)(?:>|\z)|<[a-zA-Z/!?][^>]*+\z"""
_BODY = r"""(?is)\A.*<body\b(?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
_PIECES = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unescape(text: Column) -> Column:
    """Character references by what they stand for: the names of the HTML standard, as the standard library lists them (those
    that need no semicolon also without one), and numbers; what stands for nothing stays."""
    names = F.map_from_arrays(F.array(*(F.lit("&" + n) for n in html5)), F.array(*(F.lit(v) for v in html5.values())))
    low = F.array(*(F.lit(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(0x80, 0xA0)))  # as the standard reads these numbers

    def number(n: Column) -> Column:
        bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(n.between(0x80, 0x9F), F.element_at(low, (n - 0x7F).cast("int"))).otherwise(letter)

    def one(p: Column) -> Column:
        digits = F.rtrim(F.substring(p, 3, 12), F.lit(";"))
        known = F.when(p == "&amp;", "&").when(p == "&nbsp;", "\xa0").when(p == "&lt;", "<").when(p == "&gt;", ">").when(p == "&quot;", '"')
        known = known.when(p.rlike("^&#[xX]"), number(F.conv(F.substring(digits, 2, 9), 16, 10).cast("long"))).when(p.startswith("&#"), number(F.conv(F.substring(digits, 1, 10), 10, 10).cast("long")))
        return F.when(~p.startswith("&"), p).otherwise(F.coalesce(known, F.try_element_at(names, p), p))

    return _once(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECES), F.lit(0)), one), "")).otherwise(t))


def clean_html(pages: DataFrame, patterns: tuple = NOISE_PATTERNS, tokens: tuple = NOISE_TOKENS, marker: str = NOISE_MARKER) -> DataFrame:
    """Replaces ``html`` by ``title, text, char_count``: the text of the body, or of the page without one, between tags, trimmed, a
    line for each piece, without noise; the title is null if there is none or it is blank.

    Built-in functions do all of it. Comments and the elements in DROPPED go with all they hold, up to their first end tag, or to
    the page's end if they have none; a tag that the page breaks off goes too. Null and empty pages have the text ''.
    """
    seen = F.regexp_replace(F.coalesce("html", F.lit("")), _UNSEEN, "\n")
    rows = pages.withColumn("_seen", seen)
    title = _once(strip_wide(unescape(F.regexp_extract("_seen", _TITLE, 1))), lambda t: F.nullif(t, F.lit("")))
    body = F.regexp_replace(F.regexp_replace("_seen", _TITLE, "\n"), _BODY, "")
    lines = F.split(unescape(F.regexp_replace(body, _TAG, "\n")), LINES, -1)
    text = F.array_join(F.filter(F.transform(lines, strip_wide), lambda x: x != ""), "\n")
    out = rows.withColumn("title", title).withColumn("text", strip_noise(text, patterns, tokens, marker)).drop("html", "_seen")
    return out.withColumn("char_count", F.length("text"))


def strip_noise(text: Column, patterns: tuple = NOISE_PATTERNS, tokens: tuple = NOISE_TOKENS, marker: str = NOISE_MARKER) -> Column:
    """Cut at the first line of 4 to 29 characters that matches ``marker``, then drop lines that match a pattern or equal a
    token; blank lines stay; three or more line feeds become two; white space at both ends goes. Each line is stripped once."""
    noise = "|".join(f"(?:{p})" for p in patterns)

    def marked(p: Column) -> Column:
        return F.length(p["s"]).between(4, 29) & p["s"].rlike(marker)

    def stays(p: Column) -> Column:
        drop = F.lit(False)
        if tokens:
            drop = drop | p["s"].isin(*tokens)
        if patterns:
            drop = drop | p["s"].rlike(noise)
        return (p["s"] == "") | ~drop

    def kept(pairs: Column) -> Column:
        cut = F.array_position(F.transform(pairs, marked), True)
        return F.filter(F.when(cut > 0, F.slice(pairs, F.lit(1), (cut - 1).cast("int"))).otherwise(pairs), stays)

    pairs = F.transform(F.split(text, LINES, -1), lambda x: F.struct(x.alias("line"), strip_wide(x).alias("s")))
    joined = F.array_join(_once(pairs, kept)["line"], "\n")
    return strip_wide(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def pick_body(candidates: list[Column], body: Column, min_chars: int = 50, max_chars: int = 5000) -> Column:
    """The first candidate of more than ``min_chars`` characters, else the body cut to ``max_chars`` if it is longer than
    ``min_chars``, else ''."""
    picked = [F.when(F.length(c) > min_chars, c) for c in candidates]
    return F.coalesce(*picked, F.when(F.length(body) > min_chars, F.substring(body, 1, max_chars)), F.lit(""))


def route_posts(df: DataFrame, min_chars: int = 100) -> DataFrame:
    """Adds ``skip_reason``; short texts become skipped with an error. Existing texts are used, html is needed for new ones."""
    text, n = F.col("cleaned_text"), F.length("cleaned_text")
    blank = F.length(strip_wide(text)) == 0
    reason = F.when(text.isNull() & F.col("raw_html").isNull(), "no_raw_html").when(text.isNull() | (n == 0), "no_cleaned_text")
    short = F.concat(F.lit("too_short:"), n.cast("string"), F.lit(f"<{min_chars}"))
    reason = reason.when(n < min_chars, short).when(blank, "no_cleaned_text")
    out = df.withColumn("skip_reason", reason)
    skipped = F.coalesce(F.col("skip_reason").startswith("too_short"), F.lit(False))
    return out.withColumn("extract_error", F.when(skipped, F.col("skip_reason")).otherwise(F.col("extract_error"))).withColumn("extract_status", F.when(skipped, "skipped").otherwise(F.col("extract_status")))
