"""Splitting texts into sections and overlapping chunks, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.text import CHARS_PER_TOKEN, column, let, newlines, token_estimate, trimmed

CHUNK_TOKENS, CHUNK_OVERLAP = 1_200, 160
PARENT_TOKENS = 6_000
LEAST_CUT = 1_000
SUMMARY_CHARS, SUMMARY_SENTENCES = 900, 3
#: Line anchors, only LF ends lines, and white space of any script.
HEADING = r"(?dmU)^(#{1,6})\s+(.+?)\s*$"
PREFACE, SECTION = "文档前言", "内容区段 "
#: Control characters that stand for a heading's parts while a text is cut; they don't occur in texts.
_HEAD, _TITLE, _BODY = "\x01", "\x02", "\x03"


def units(text: Column, target: int, overlap: int) -> Column:
    """Paragraphs; those longer than twice the target, but 1000 characters at least, are cut with an overlap."""
    longest = max(LEAST_CUT, int(target * 2.0))
    stride = longest - overlap

    def cut(p: Column) -> Column:
        cuts = F.ceil((F.length(p) - longest) / stride).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), cuts), lambda i: F.substring(p, i * stride + 1, F.lit(longest)))
        return F.when(F.length(p) > longest, pieces).when(p != "", F.array(p)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(text, "\n{2,}"), lambda p: let(trimmed(p), cut)))


def _chunked(normal: Column, target: int, overlap: int) -> Column:
    """Chunks of a text whose newlines are normal already; each unit is measured once."""
    strings = "array<string>"
    measured = F.transform(units(normal, target, overlap), lambda u: F.struct(u.alias("text"), token_estimate(u).alias("n")))
    start = F.struct(F.array().cast(strings).alias("out"), F.array().cast(strings).alias("cur"), F.lit(0).alias("n"))

    def assembled(a: Column) -> Column:
        return trimmed(F.array_join(a["cur"], "\n\n"))

    def flushed(a: Column, u: Column) -> Column:
        def after(done: Column) -> Column:
            tail = F.right(done, F.lit(overlap)) if overlap else F.lit("")
            fresh = F.when(tail != "", F.array(tail, u["text"])).otherwise(F.array(u["text"]))
            return let(fresh, lambda cur: F.struct(F.concat(a["out"], F.array(done)).alias("out"), cur.alias("cur"), token_estimate(F.array_join(cur, "\n\n")).cast("int").alias("n")))

        return let(assembled(a), after)

    def add(a: Column, u: Column) -> Column:
        full = (F.size(a["cur"]) > 0) & (a["n"] + u["n"] > target)
        more = F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(u["text"])).alias("cur"), (a["n"] + u["n"]).cast("int").alias("n"))
        return F.when(full, flushed(a, u)).otherwise(more)

    return F.aggregate(measured, start, add, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(assembled(a)))).otherwise(a["out"]))


def chunked(text: Column | str, target: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of up to about ``target`` tokens; each begins with the last ``overlap`` characters of the one before."""
    return let(newlines(text), lambda normal: F.when(normal == "", F.array().cast("array<string>")).otherwise(_cut(normal, target, overlap)))


def _cut(normal: Column, target: int, overlap: int) -> Column:
    """``_chunked``, without its fold where the text surely is one chunk: by the most tokens that its length, its bytes (a CJK
    character has two more than a Latin one) and its paragraphs allow, and by the longest paragraph that isn't cut."""
    n = F.length(normal)
    paragraphs = F.split(normal, "\n{2,}")
    most = (F.octet_length(normal) - n) / 2 + n / CHARS_PER_TOKEN + F.size(paragraphs)
    whole = F.array(trimmed(F.array_join(F.filter(F.transform(paragraphs, trimmed), lambda p: p != ""), "\n\n")))
    return F.when((n <= max(LEAST_CUT, int(target * 2.0))) & (most <= target), whole).otherwise(_chunked(normal, target, overlap))


def sections(text: Column | str) -> Column:
    """(title, text) of the sections that Markdown headings open, what stands before them, or else large parts."""
    none = F.array().cast("array<struct<title:string,text:string>>")

    def section(p: Column) -> Column:
        def shaped(title: Column) -> Column:
            body = trimmed(F.substring_index(p, _BODY, -1))
            return F.struct(title.alias("title"), trimmed(F.concat(F.substring_index(p, _TITLE, 1), F.lit(" "), title, F.lit("\n\n"), body)).alias("text"))

        return let(trimmed(F.substring_index(F.substring_index(p, _BODY, 1), _TITLE, -1)), shaped)

    def headed(pieces: Column) -> Column:
        preface = let(trimmed(F.element_at(pieces, 1)), lambda first: F.when(first != "", F.array(F.struct(F.lit(PREFACE).alias("title"), first.alias("text")))).otherwise(none))
        return F.concat(preface, F.transform(F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1)), section))

    def plain(normal: Column) -> Column:
        return F.transform(_cut(normal, PARENT_TOKENS, 0), lambda p, i: F.struct(F.concat(F.lit(SECTION), (i + 1).cast("string")).alias("title"), p.alias("text")))

    def split(normal: Column) -> Column:
        pieces = F.split(F.regexp_replace(normal, HEADING, f"{_HEAD}$1{_TITLE}$2{_BODY}"), _HEAD)
        return F.when(normal == "", none).otherwise(let(pieces, lambda found: F.when(F.size(found) > 1, headed(found)).otherwise(plain(normal))))

    return let(newlines(text), split)


def summary(title: Column | str, text: Column | str, most: int = SUMMARY_CHARS) -> Column:
    """Title and up to three sentences that together have ``most`` characters; the first is always taken.

    The heading that opened the section is left out. What looks like one at the start of a section with another title is
    none: a long paragraph was cut there.
    """
    title, text = column(title), column(text)
    opened = text.startswith("#") & (F.regexp_instr(text, F.lit(HEADING)) == 1) & (F.regexp_extract(text, HEADING, 2) == title)
    body = trimmed(F.when(opened, F.substring(text, F.length(F.regexp_substr(text, F.lit(HEADING))) + 1, F.length(text))).otherwise(text))
    cut_off = F.slice(F.split(body, r"(?U)(?<=[。！？.!?])\s*", SUMMARY_SENTENCES + 1), 1, SUMMARY_SENTENCES)  # the rest stays uncut
    sentences = F.filter(F.transform(cut_off, trimmed), lambda s: s != "")

    def take(a: Column, s: Column) -> Column:
        stop = a["stop"] | ((F.size(a["out"]) > 0) & (a["used"] + F.length(s) > most))
        out = F.when(stop, a["out"]).otherwise(F.concat(a["out"], F.array(s)))
        return F.struct(out.alias("out"), F.when(stop, a["used"]).otherwise(a["used"] + F.length(s)).alias("used"), (stop | (F.size(out) >= SUMMARY_SENTENCES)).alias("stop"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("stop"))
    taken = F.aggregate(sentences, start, take, lambda a: F.array_join(a["out"], " "))
    excerpt = F.when(taken != "", taken).otherwise(F.left(body, F.lit(most)))
    return F.left(F.concat(title, F.lit("："), excerpt), F.lit(most))
