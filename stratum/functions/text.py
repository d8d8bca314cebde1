"""Scalar text operators as Column expressions. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs, each of which counts as a token.
CJK = "\\u3400-\\u9FFF"
CHARS_PER_TOKEN = 3.5
#: White space of any script: what Unicode names so.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MESSAGE_BASE, MESSAGE_EACH = 3, 5


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what stands in a lambda several times is evaluated as often otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.btrim(column(c), F.lit(SPACES))


def collapsed(c: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(column(c), r"(?U)\s+", by)


def newlines(c: Column | str) -> Column:
    """CR and CRLF become LF; ends are trimmed."""
    return trimmed(F.replace(F.replace(column(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def has_cjk(c: Column) -> Column:
    """Whether there may be CJK ideographs: a text of single bytes has none."""
    return F.octet_length(c) > F.length(c)


def token_estimate(c: Column | str) -> Column:
    """One for each CJK ideograph and one for each 3.5 other characters, rounded up; at least one."""
    c = column(c)
    others = F.length(F.when(has_cjk(c), F.regexp_replace(c, f"[{CJK}]", "")).otherwise(c))
    return F.greatest(F.lit(1), (F.length(c) - others + F.ceil(others / F.lit(CHARS_PER_TOKEN))).cast("int"))


def message_tokens(messages: Column | str) -> Column:
    """Estimate for an array of (role, content)."""
    return F.aggregate(messages, F.lit(MESSAGE_BASE), lambda a, m: a + MESSAGE_EACH + token_estimate(m["role"]) + token_estimate(m["content"]))


def lexical_tokens(c: Column | str) -> Column:
    """Latin words, then CJK single characters, then pairs of CJK characters that follow each other (gaps ignored)."""
    none = F.array().cast("array<string>")

    def with_pairs(single: Column) -> Column:
        pairs = F.zip_with(F.slice(single, 1, F.size(single) - 1), F.slice(single, 2, F.size(single) - 1), lambda a, b: F.concat(a, b))
        return F.concat(single, F.when(F.size(single) >= 2, pairs).otherwise(none))

    def tokens(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit("[a-zA-Z0-9_][a-zA-Z0-9_.-]*"), 0)
        return F.when(has_cjk(low), F.concat(words, let(F.regexp_extract_all(low, F.lit(f"[{CJK}]"), 0), with_pairs))).otherwise(words)

    return let(F.lower(column(c)), tokens)


def compact(c: Column | str) -> Column:
    """Lower case without any white space, as the routing rules read a question."""
    return collapsed(F.lower(column(c)), "")


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of the terms occurs; they hold no pattern characters."""
    return c.rlike("|".join(terms))


def count_of(c: Column, term: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def content_id(kind: Column | str, *parts: Column) -> Column:
    """``kind`` and 16 hex digits of the SHA-256 of kind and parts, parted by the unit separator."""
    kind = column(kind)
    return F.concat(kind, F.lit("_"), F.left(F.sha2(F.concat_ws("\x1f", kind, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), F.lit(16)))


def clamped_int(c: Column | str, low: int, high: int, default: int) -> Column:
    """A whole number between two bounds; ``default`` for what is none."""
    value = column(c).try_cast("int")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def confidence(c: Column | str) -> Column:
    """A number between 0 and 1; 0.5 for what is none."""
    value = column(c).try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def json_object(c: Column | str) -> Column:
    """The JSON object in a model's answer: that of a fenced block, else from the first to the last brace; null if it doesn't parse."""
    c = column(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(outer)
    return F.when(F.is_variant_null(F.try_parse_json(found)) | F.try_parse_json(found).isNull(), F.lit(None)).otherwise(F.when(found != "", found))


def redacted(body: Column | str, secret: str = "") -> Column:
    """The message in a JSON error body, or the body itself, without keys; 300 characters at most."""
    body = column(body)
    message = F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message"), body)
    hidden = F.replace(message, F.lit(secret), F.lit("[redacted]")) if secret else message
    return F.left(F.regexp_replace(hidden, r"sk-[A-Za-z0-9_-]+", "[redacted]"), F.lit(300))
