"""Text and results from web pages, and results as sources."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import collapsed, column, trimmed

TITLE_CHARS, SNIPPET_CHARS, QUERY_CHARS = 300, 1_000, 500
# How result pages are marked up.
BLOCK = r'(?s)<li class="b_algo".*?</li>'
HEAD = r'(?s)<h2[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
PARAGRAPH = r"(?s)<p[^>]*>(.*?)</p>"
LINK = r'<a href="([^"]*)">([^<]*)</a>'


CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def _unescape_closed(values: pd.Series) -> pd.Series:
    def decoded(m: re.Match) -> str:
        return m[0] if m[1] and m[0][1:] not in html.entities.html5 else html.unescape(m[0])

    return values.map(lambda v: None if v is None else CLOSED.sub(decoded, v))


def unescaped(value: Column | str, bare: bool = True) -> Column:
    """Character references decoded; there are over two thousand names, so the standard library's table is used. Without
    ``bare``, only references that a semicolon ends."""
    return F.pandas_udf(_unescape if bare else _unescape_closed, "string")(column(value))


def plain_text(value: Column | str, bare: bool = True) -> Column:
    return trimmed(collapsed(unescaped(F.regexp_replace(column(value), "<[^>]+>", " "), bare)))


def search_query(query: Column | str) -> Column:
    return F.left(trimmed(collapsed(query)), F.lit(QUERY_CHARS))


def html_results(responses: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, position, title, url, snippet) of result pages (query_id, html): of each address the first."""
    blocks = responses.select("query_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), 0)).alias("at", "block"))
    parsed = blocks.select("query_id", "at", F.regexp_extract("block", HEAD, 1).alias("raw_url"), F.regexp_extract("block", HEAD, 2).alias("raw_title"), F.regexp_extract("block", PARAGRAPH, 1).alias("raw_text"))
    shaped = parsed.select("query_id", "at", unescaped("raw_url").alias("url"), F.left(plain_text("raw_title"), F.lit(TITLE_CHARS)).alias("title"), F.left(plain_text("raw_text"), F.lit(SNIPPET_CHARS)).alias("snippet"))
    good = shaped.where(F.col("url").rlike("^https?://") & (F.col("title") != ""))
    once = good.withColumn("n", F.row_number().over(W.partitionBy("query_id", "url").orderBy("at"))).where("n = 1")
    return once.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("position") <= limit).select("query_id", "position", "title", "url", "snippet")


def json_results(responses: DataFrame, limit: int = 5) -> DataFrame:
    """The same of JSON answers (query_id, body); addresses may repeat, and the address stands for a missing title."""
    kind = "struct<results:array<struct<title:string,url:string,content:string>>>"
    rows = responses.select("query_id", F.posexplode(F.from_json("body", kind)["results"]).alias("at", "r"))
    title = F.left(F.coalesce(F.nullif(trimmed("r.title"), F.lit("")), F.col("r.url")), F.lit(TITLE_CHARS))
    good = rows.where(F.col("r.url").rlike("^https?://")).select("query_id", "at", title.alias("title"), F.col("r.url").alias("url"), F.left(F.coalesce("r.content", F.lit("")), F.lit(SNIPPET_CHARS)).alias("snippet"))
    return good.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).where(F.col("position") <= limit).select("query_id", "position", "title", "url", "snippet")


# Names and texts of results as sources.
SOURCE_NAME, SOURCE_TEXT = "联网来源 %d：%s｜%s", "# 联网来源 %d\n\n标题：%s\nURL：%s\n摘要：%s"


def as_sources(results: DataFrame, first_ord: int = 0) -> DataFrame:
    """Results (position, title, url, snippet) as Markdown sources, to be indexed beside a document."""
    return results.select((F.col("position") + first_ord).cast("long").alias("source_ord"), F.format_string(SOURCE_NAME, "position", "title", "url").alias("document"), F.format_string(SOURCE_TEXT, "position", "title", "url", F.coalesce("snippet", F.lit(""))).alias("text"))


class SearchError(RuntimeError):
    """The search gave no result, or no answer at all."""


def searcher(spark, html_fetch: Callable[[str], str] | None = None, json_fetch: Callable[[str], str] | None = None):
    """A search (question, limit) over a service that answers in JSON, or else one with result pages.

    The fetchers take the prepared query and give the answer's body. That nothing was found is an error, not an empty
    answer, so that nobody takes it for one.
    """

    def search(question: str, limit: int = 5) -> DataFrame:
        if json_fetch is None and html_fetch is None:
            raise SearchError("there is no search service")
        asked = spark.createDataFrame([(question,)], "q string").select(search_query("q").alias("q")).collect()[0].q
        if json_fetch is not None:
            found = json_results(spark.createDataFrame([(1, json_fetch(asked))], "query_id int, body string"), limit)
        else:
            found = html_results(spark.createDataFrame([(1, html_fetch(asked))], "query_id int, html string"), limit)
        found = found.select("position", "title", "url", "snippet")
        if found.isEmpty():
            raise SearchError(f"no result for {asked}")
        return found

    return search


def first_links(pages: DataFrame, limit: int) -> DataFrame:
    """The first links of each page with a title, each address once."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), 1).alias("link"), F.regexp_extract_all("html", F.lit(LINK), 2).alias("title"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("at", "r")).select("page_id", "at", F.col("r.link").alias("link"), F.col("r.title").alias("title")).where(F.trim("title") != "")
    once = rows.withColumn("n", F.row_number().over(W.partitionBy("page_id", "link").orderBy("at"))).where("n = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("at"))).where(F.col("rank") <= limit).select("page_id", "link", F.left("title", F.lit(TITLE_CHARS)).alias("title"), "rank")
