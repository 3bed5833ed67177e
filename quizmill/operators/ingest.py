"""Ingest: de-duplication, catch-up, import and upsert of posts, discovery of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions.times import parse_local
from quizmill.operators.numbering import numbered
from quizmill.session import stored


def dedup_records(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of each key the first row in ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def only_new(df: DataFrame, posts: DataFrame, url: str = "detail_url") -> DataFrame:
    """Rows whose URL is not stored yet. Rows without a URL are not stored under one and stay."""
    return df.join(posts.select(F.col("source_url").alias(url)), url, "left_anti")


def catch_up(df: DataFrame, posts: DataFrame | None = None, patience: int = 2, key: str = "content_id", url: str = "detail_url") -> DataFrame:
    """Rows of the pages that are taken, with ``is_new``.

    A record is new if its key is seen for the first time (page, then pos) and, where ``posts`` are given, its URL is not
    stored; rows that repeat key, page and pos are new together. ``patience`` pages in a row without a new record, or a
    missing page, end the run after them; a page with a new record starts the count anew.

    Plan: the first place of each key is a minimum, taken in part before the shuffle. Up to the first missing page pages have
    consecutive numbers, so a run of ``patience`` blank ones ends at page p if p, p - 1, ... are blank: each blank page counts
    for itself and the next ones, and sums by page number show the runs. No window orders the pages.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("page", "pos")).alias("_first"))
    first = first.select("_key", F.col("_first.page").alias("_page"), F.col("_first.pos").alias("_pos"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("page") == F.col("_page")) & (F.col("pos") == F.col("_pos"))
    rows = df.join(first, same, "left").withColumn("is_new", F.col("_page").isNotNull()).drop("_key", "_page", "_pos")
    if posts is not None:
        known = posts.select(F.col("source_url").alias(url)).distinct().withColumn("_stored", F.lit(True))
        rows = rows.join(known, url, "left").withColumn("is_new", F.col("is_new") & F.col("_stored").isNull()).drop("_stored")
    rows = stored(rows, "records")
    pages = stored(rows.groupBy("page").agg(F.count_if("is_new").alias("n")), "pages")

    reach = F.explode(F.sequence(F.lit(0), F.lit(patience - 1)))
    blank = pages.filter("n = 0").select("page", reach.alias("i")).select((F.col("page") + F.col("i")).alias("page"), (F.col("i") == 0).cast("int").alias("own"))
    ends = blank.groupBy("page").agg(F.count("*").alias("run"), F.max("own").alias("own")).filter((F.col("run") == patience) & (F.col("own") == 1)).select("page")
    near = pages.select(F.explode(F.array(F.struct("page", F.lit(True).alias("there")), F.struct((F.col("page") + 1).alias("page"), F.lit(False).alias("there")))).alias("x")).select("x.*")
    gaps = near.groupBy("page").agg(F.bool_or("there").alias("there")).filter(~F.col("there")).select((F.col("page") - 1).alias("page"))
    last = ends.union(gaps).agg(F.min("page")).first()[0]
    return rows if last is None else rows.filter(F.col("page") <= last)


def filter_usable(df: DataFrame, since: str | None = None, until: str | None = None, id_col: str = "content_id", ts: str = "created") -> DataFrame:
    """Rows with an id, content and title, dated inside [since, until]; an unknown date passes."""
    def filled(c: str) -> Column:
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))

    out = df.filter(filled(id_col) & filled("content") & filled("title"))
    for bound, op in ((since, "ge"), (until, "le")):
        if bound:
            limit = F.lit(bound).cast("timestamp")
            out = out.filter(F.col(ts).isNull() | (F.col(ts) >= limit if op == "ge" else F.col(ts) <= limit))
    return out


def _after_largest(posts: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` rows with ids after the largest of ``posts``, in ``order``."""
    top = posts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new, order, name="_nr").withColumn("id", F.col("_nr") + top).drop("_nr")


def import_posts(batch: DataFrame, posts: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(posts, counts) after importing ``batch(title, content, detail_url, created_at, line)``.

    Of lines with one URL the first wins. New URLs come in as pending, in version 0, with ids after the largest by line; known ones are skipped
    or, with ``force``, get the new text and become pending. All columns of ``posts`` stay; ``outcome`` says what became of
    a line (null: none was given). ``counts``: new, skipped, updated. Posts without an id count as stored.
    """
    rows = dedup_records(batch.filter(F.length(F.trim("detail_url")) > 0), ["detail_url"], ["line"])
    rows = rows.select(F.col("detail_url").alias("source_url"), F.struct("title", "content", parse_local(F.col("created_at")).alias("posted_at"), "line").alias("_new"))
    both = stored(posts.withColumn("_known", F.lit(True)).join(rows, "source_url", "full_outer"), "imported")
    known, given = F.col("_known").isNotNull(), F.col("_new").isNotNull()
    change = given & (~known | F.lit(force))
    kind = F.when(given & ~known, "new").when(given & known & F.lit(force), "updated").when(given, "skipped")
    out = both.withColumns({
        "title": F.when(known, F.col("title")).otherwise(F.col("_new.title")),
        "cleaned_text": F.when(change, F.col("_new.content")).otherwise(F.col("cleaned_text")),
        "posted_at": F.when(known, F.col("posted_at")).otherwise(F.col("_new.posted_at")),
        "extract_status": F.when(change, "pending").otherwise(F.col("extract_status")), "outcome": kind,
    })
    if "extract_version" in posts.columns:
        out = out.withColumn("extract_version", F.when(known, F.col("extract_version")).otherwise(F.lit(0)).cast(posts.schema["extract_version"].dataType))
    out = out.withColumn("_line", F.col("_new.line"))
    out = out.filter(known).unionByName(_after_largest(posts, out.filter(~known), ["_line", "source_url"])).select(*posts.columns, "outcome")
    counts = both.agg(*(F.count_if(kind == k).alias(k) for k in ("new", "skipped", "updated")))
    return out, counts


def upsert_raw(pages: DataFrame, posts: DataFrame, now: str) -> DataFrame:
    """``posts`` after storing ``pages(source_url, html, page_title)``, each URL once: new ones are pending, in version 0, with ids after the
    largest by URL; known ones get the html, the title if one is given that is not empty, and the time, and are pending again
    without an error unless they are done. All columns stay, and so does the html of posts that no page is given for."""
    page = pages.select("source_url", F.struct("html", F.nullif("page_title", F.lit("")).alias("title")).alias("_page"))
    both = stored(posts.withColumn("_known", F.lit(True)).join(page, "source_url", "full_outer"), "upserted")
    known, given = F.col("_known").isNotNull(), F.col("_page").isNotNull()
    again = given & ~F.coalesce(F.col("extract_status") == "done", F.lit(False))
    out = both.withColumns({
        "title": F.coalesce("_page.title", "title"), "raw_html": F.when(given, F.col("_page.html")).otherwise(F.col("raw_html")),
        "fetched_at": F.when(given, F.lit(now).cast("timestamp")).otherwise(F.col("fetched_at").cast("timestamp")),
        "extract_status": F.when(again, "pending").otherwise(F.col("extract_status")), "extract_error": F.when(~again, F.col("extract_error")),
    })
    if "extract_version" in posts.columns:
        out = out.withColumn("extract_version", F.when(known, F.col("extract_version")).otherwise(F.lit(0)).cast(posts.schema["extract_version"].dataType))
    return out.filter(known).unionByName(_after_largest(posts, out.filter(~known), ["source_url"])).select(*posts.columns)


def discover_urls(pages: DataFrame, base: str, shapes: list[str]) -> DataFrame:
    """``page_id, url``: distinct post URLs of listing pages, from href values and bare URLs.

    Paths are resolved against ``base``, queries and fragments cut; a URL stays if it matches one of ``shapes``.
    """
    hrefs = F.regexp_extract_all("html", F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.regexp_extract_all("html", F.lit("(https?://[^\\s\"'<>\\\\]+)"), F.lit(1))
    raw = pages.select("page_id", F.explode(F.array_union(hrefs, bare)).alias("raw"))
    scheme = base.split("://")[0]
    whole = F.when(F.col("raw").rlike("^https?://"), F.col("raw")).when(F.col("raw").startswith("//"), F.concat(F.lit(f"{scheme}:"), "raw"))
    whole = whole.when(F.col("raw").startswith("/"), F.concat(F.lit(base.rstrip("/")), "raw")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "raw"))
    out = raw.select("page_id", F.regexp_replace(whole, "[?#].*$", "").alias("url"))
    return out.filter(F.col("url").rlike("|".join(f"(?:{s})" for s in shapes))).distinct()


def frontier(discovered: DataFrame, fetched: DataFrame) -> DataFrame:
    """Discovered URLs that were not fetched yet."""
    return discovered.select("url").distinct().join(fetched.select("url"), "url", "left_anti")


def drop_gone(pages: DataFrame, markers: list[str], text: str = "html") -> DataFrame:
    """Pages without any of the marks of removed content."""
    gone = F.lit(False)
    for m in markers:
        gone = gone | F.col(text).contains(m)
    return pages.filter(~F.coalesce(gone, F.lit(False)))


def keyword_score(df: DataFrame, weights: dict[int, list[str]], threshold: int = 4, head: int = 500) -> DataFrame:
    """Adds ``score``, the weights of the keywords in the title and the first ``head`` characters, and ``keep``."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("content", F.lit("")), 1, head))
    score = sum((F.when(F.col("_t").contains(k), w).otherwise(0) for w, ks in weights.items() for k in ks), F.lit(0))
    return df.withColumn("_t", text).withColumn("score", score.cast("long")).withColumn("keep", F.col("score") >= threshold).drop("_t")


def page_date(html: Column, text: Column, head: int = 3000) -> Column:
    """The published date of a page: of two meta tags (their public names are fixed values), else the first valid date in the first ``head`` characters. Days of two
    digits are read whole."""
    def meta(attr: str, name: str) -> Column:
        a = F.regexp_extract(html, f"(?i)<meta[^>]*{attr}=[\"']{name}[\"'][^>]*content=[\"']([^\"']+)[\"']", 1)
        b = F.regexp_extract(html, f"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*{attr}=[\"']{name}[\"']", 1)
        value = F.nullif(F.coalesce(F.nullif(a, F.lit("")), b), F.lit(""))
        return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, "(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " "))

    found = F.regexp_extract_all(F.substring(text, 1, head), F.lit("(20[0-9]{2}[-/年](?:0?[1-9]|1[0-2])[-/月](?:3[01]|[12][0-9]|0?[1-9]))(?![0-9])"), F.lit(1))
    dates = F.transform(found, lambda d: F.try_to_timestamp(F.regexp_replace(d, "[/年月]", "-"), F.lit("yyyy-M-d")))
    return F.coalesce(meta("property", "article:published_time"), meta("name", "pubdate"), F.element_at(F.concat(F.filter(dates, lambda d: d.isNotNull()), F.array(F.lit(None).cast("timestamp"))), 1))
