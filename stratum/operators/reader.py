"""Reading texts directly: windows of characters and pages by their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import column, trimmed

WINDOW_CHARS = 12_000
PAGE_HEADING = r"(?dmU)^##\s+第\s+(\d+)\s+页\s*$"
_MARK, _END = "\x01", "\x02"


def window(text: Column | str, offset: Column | int = 0, size: int = WINDOW_CHARS) -> Column:
    """The window at an offset; one that isn't the last ends at the last line end in its second half.

    ``previous_offset`` goes back a whole window and so is not the inverse of ``next_offset``.
    """
    text = column(text)
    total = F.length(text)
    start = F.greatest(F.lit(0), F.least(F.lit(offset) if isinstance(offset, int) else offset, F.greatest(F.lit(0), total - 1)))
    reach = F.least(total, start + size)
    tail = F.substring(text, start + size // 2 + 1, reach - start - size // 2)
    line_end = reach - F.instr(F.reverse(tail), "\n")  # place of the last line end, if there is one
    end = F.when((reach < total) & F.contains(tail, F.lit("\n")), line_end).otherwise(reach)
    return F.struct(
        trimmed(F.substring(text, start + 1, end - start)).alias("content"), start.alias("start_character"), end.alias("end_character"), total.alias("total_characters"),
        (start > 0).alias("has_previous"), (end < total).alias("has_more"), F.greatest(F.lit(0), start - size).alias("previous_offset"), end.alias("next_offset"),
    )


def pages(documents: DataFrame) -> DataFrame:
    """(document, page, ordinal, start_character, end_character, content) of (document, text): from each page heading to
    the next; of a page that occurs twice the last. Offsets are those in the text, before it is trimmed. Stored once,
    this is the table from which ``span_of`` reads pages by their number."""
    split = F.split(F.regexp_replace("text", PAGE_HEADING, f"{_MARK}$1{_END}$0"), _MARK)
    body = lambda p: F.regexp_replace(p, f"(?s)^[^{_END}]*{_END}", "")
    pieces = documents.select("document", F.posexplode(split).alias("ordinal", "piece"))
    pieces = pieces.select("document", "ordinal", F.when(F.col("ordinal") > 0, F.substring_index("piece", _END, 1).cast("int")).alias("page"), F.when(F.col("ordinal") > 0, body(F.col("piece"))).otherwise(F.col("piece")).alias("body"))
    before = W.partitionBy("document").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body")).over(before), F.lit(0)).cast("int")
    placed = pieces.withColumn("start_character", start).where("ordinal > 0")
    row = F.struct("ordinal", "start_character", (F.col("start_character") + F.length("body")).alias("end_character"), trimmed("body").alias("content"))
    return placed.groupBy("document", "page").agg(F.max_by(row, "ordinal").alias("last")).select("document", "page", "last.*")


def span_of(table: DataFrame, totals: DataFrame, first: int, last: int) -> DataFrame:
    """A row for each document of ``totals`` (document, total_characters): the pages of ``table`` asked for, joined, with
    where they start and end, the numbers of those that are missing, and the least and greatest page that there is.
    Without all pages, content and offsets are null."""
    ends = table.groupBy("document").agg(F.min("page").alias("least"), F.max("page").alias("greatest"))
    asked = table.where(F.col("page").between(first, last)).groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "content", "start_character", "end_character"))).alias("parts"))
    joined = totals.join(ends, "document", "left").join(asked, "document", "left")
    there = F.coalesce(F.transform("parts", lambda p: p["page"]), F.array().cast("array<int>"))
    joined = joined.withColumn("missing", F.array_except(F.sequence(F.lit(first), F.lit(last)), there))
    whole = F.size("missing") == 0
    return joined.select(
        "document",
        F.when(whole, F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n")).alias("content"),
        F.when(whole, F.col("parts")[0]["start_character"]).alias("start_character"),
        F.when(whole, F.element_at("parts", -1)["end_character"]).alias("end_character"),
        "total_characters",
        "missing",
        "least",
        "greatest",
    )


def page_span(documents: DataFrame, first: int, last: int) -> DataFrame:
    """``span_of`` the pages of (document, text)."""
    return span_of(pages(documents), documents.select("document", F.length("text").alias("total_characters")), first, last)


def page_slice(documents: DataFrame, first: int, last: int) -> DataFrame:
    """(document, content, missing) with the pages asked for joined; content is null where one is missing."""
    return page_span(documents, first, last).select("document", "content", "missing")
