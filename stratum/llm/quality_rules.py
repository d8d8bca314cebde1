"""Quality rules as weak supervision, with DataFrame operations only.

Every rule votes good, votes bad or abstains. From how the rules agree over all documents, expectation-maximisation
estimates the share of good documents and, for each rule, how often its vote is right on good and on bad ones; no labels
are read. A document is kept if the posterior probability that it is good reaches a half, so one bad vote of a rule that
often errs doesn't drop it, as all-must-pass filters do.

Votes depend on counts alone, and documents with equal votes weigh as one pattern. There are 3 ** len(RULES) patterns at
most, whatever the number of documents, so the estimate is a fold over one small array in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.text import let

from .common import cut, drop
from .mixing import WORD_GAP

SYMBOLS, SHOUTS = "#*$%&|<>", "!?"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
#: Rounds of expectation-maximisation, and what it starts from.
ROUNDS = 30
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.9, 0.998, 0.5
LEAST_RIGHT_ON_GOOD = 0.998
#: Votes that each estimate starts with, so that none is 0 or 1.
PSEUDO_VOTES = 10.0


@dataclass(frozen=True)
class Rule:
    """Conditions over the counts of ``measured``, read by Spark and DuckDB alike; where neither holds, the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("word length", "n_words >= 20 AND 2 * word_chars BETWEEN 7 * n_words AND 15 * n_words", "n_words >= 20 AND (2 * word_chars < 5 * n_words OR word_chars > 10 * n_words)"),
    Rule("symbols", "n_symbols * 100 <= n_words", "n_symbols * 10 > n_words"),
    Rule("repeated lines", "n_lines >= 5 AND n_dup_lines * 20 <= n_lines", "n_lines >= 5 AND n_dup_lines * 10 > n_lines * 3"),
    Rule("repeated words", "n_words >= 20 AND n_repeat_words * 50 <= n_words", "n_words >= 20 AND n_repeat_words * 20 > n_words * 3"),
    Rule("words without letters", "n_words >= 20 AND n_unlettered * 20 <= n_words", "n_words >= 20 AND n_unlettered * 5 > n_words"),
    Rule("capitals", "word_chars >= 50 AND n_capitals * 5 <= word_chars", "word_chars >= 50 AND n_capitals * 5 > word_chars * 2"),
    Rule("shouting", "n_words >= 20 AND n_shouts * 20 <= n_words", "n_words >= 20 AND n_shouts * 5 > n_words"),
    Rule("vocabulary", "n_words BETWEEN 50 AND 2000 AND n_distinct * 2 >= n_words", "n_words BETWEEN 50 AND 2000 AND n_distinct * 10 < n_words * 3"),
)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more, told apart by 64 bits of hash.

    Only texts with an equal pair of windows sort theirs; sorted, equal windows are neighbours.
    """
    none = F.lit(0).cast("long")
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = lambda w: F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + n) for n in range(WINDOW)]))

    def covered(at: Column) -> Column:  # places of the repeated windows, in order
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda a, n: a + n)).otherwise(none)

    def sorted_places(windows: Column) -> Column:
        return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def counted(windows: Column) -> Column:
        all_differ = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(all_differ, none).otherwise(let(let(sorted_places(windows), repeated), covered))

    return F.when(F.size(words) > WINDOW, let(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), counted)).otherwise(none)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id and the counts that the rules read) of each row of (doc_id, text); all but doc_id are long."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select("doc_id", "text", F.array_remove(F.split("text", WORD_GAP), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_GAP.replace("[", "[^").rstrip("+"))).alias("lines"))

    def occurrences(characters: str) -> Column:
        rest = F.col("text")
        for c in characters:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return F.length("text") - F.length(rest)

    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": occurrences(SYMBOLS),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_unlettered": F.size(F.filter("words", lambda w: ~w.rlike("\\p{L}"))),
        "n_capitals": F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}+", "")),
        "n_shouts": occurrences(SHOUTS),
        "n_distinct": F.size(F.array_distinct("words")),
    }
    return split.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def voted(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counts`` plus pattern: the rules' votes as digits to the base 3, bad 0, abstention 1, good 2."""
    pattern = F.lit(0)
    for place, rule in enumerate(rules):
        digit = F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 2).otherwise(1)
        pattern = pattern + digit * 3**place
    return counts.withColumn("pattern", pattern.cast("int"))




def _expected(rows: Column, model: Column) -> Column:
    """``rows`` (pattern, n, digits) plus good: how many of the n documents are good, under ``model``."""
    weights = F.zip_with(model["on_good"], model["on_bad"], lambda g, b: F.struct(F.log(g / (1 - b)).alias("good"), F.log((1 - g) / b).alias("bad")))

    def shared(w: Column) -> Column:
        def good(x: Column) -> Column:
            votes = F.zip_with(x["digits"], w, lambda d, e: F.when(d == 2, e["good"]).when(d == 0, e["bad"]).otherwise(F.lit(0.0)))
            odds = F.aggregate(votes, F.log(model["prior"] / (1 - model["prior"])), lambda a, v: a + v)
            return x.withField("good", x["n"] / (1 + F.exp(-odds)))

        return F.transform(rows, good)

    return let(weights, shared)


def _updated(rows: Column, places: Column) -> Column:
    """The model that fits the expected numbers of good documents best."""
    total = lambda value, where: F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.when(where(x), value(x)).otherwise(F.lit(0.0)))
    good, bad = (lambda x: x["good"]), (lambda x: x["n"] - x["good"])

    def right(value, digit: int, first: float, least: float = 0.0):
        def of(j: Column) -> Column:
            hits = total(value, lambda x: F.get(x["digits"], j) == digit)
            votes = total(value, lambda x: F.get(x["digits"], j) != 1)
            return F.greatest(F.lit(least), (hits + PSEUDO_VOTES * first) / (votes + PSEUDO_VOTES))

        return F.transform(places, of)

    prior = (total(good, lambda x: F.lit(True)) + PSEUDO_VOTES * PRIOR) / (total(lambda x: x["n"], lambda x: F.lit(True)) + PSEUDO_VOTES)
    return F.struct(prior.alias("prior"), right(good, 2, RIGHT_ON_GOOD, LEAST_RIGHT_ON_GOOD).alias("on_good"), right(bad, 0, RIGHT_ON_BAD).alias("on_bad"))


def estimated(patterns: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS) -> DataFrame:
    """One row (rows, model) of (pattern, n), one row each. ``model`` has the share of good documents (prior) and how
    often each rule that votes is right on good and on bad ones (on_good, on_bad); without patterns, what the estimate
    starts from. ``rows`` has pattern, n, digits and, under that model, good: how many of the n are good."""
    places = F.sequence(F.lit(0), F.lit(n_rules - 1))
    full = lambda value: F.array(*[F.lit(value)] * n_rules)
    digit = lambda pattern, j: F.floor(pattern / F.pow(F.lit(3), j)) % 3
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pattern", "n"))), lambda x: F.struct(x["pattern"].alias("pattern"), x["n"].cast("double").alias("n"), F.transform(places, lambda j: digit(x["pattern"], j)).alias("digits")))
    start = F.struct(F.lit(PRIOR).alias("prior"), full(RIGHT_ON_GOOD).alias("on_good"), full(RIGHT_ON_BAD).alias("on_bad"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: let(_expected(F.col("rows"), m), lambda seen: _updated(seen, places)))
    fitted = patterns.agg(rows.alias("rows")).select("rows", model.alias("model"))
    return fitted.select(_expected(F.col("rows"), F.col("model")).alias("rows"), "model")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (all long), base_failed, kept, posterior.

    A null or empty text has no words and fails the base rules; so does every text of under ten words. Texts are read
    whole, however long. Rows are judged one by one, so ids may be null or shared and rows repeated; every row counts in
    the estimate. A posterior of exactly a half keeps. Other columns are ignored, whatever their names; an empty table
    gives no rows. The counts, some 100 bytes a document, are written to the shared folder, so texts are read once.
    """
    counts = cut(voted(measured(docs), rules))
    patterns = cut(counts.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    each = estimated(patterns, len(rules), rounds).select(F.inline("rows"))
    verdicts = cut(each.select("pattern", (F.col("good") / F.col("n")).alias("posterior")))
    drop(patterns)
    joined = counts.join(F.broadcast(verdicts), "pattern")  # 3 ** len(rules) rows at most
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


def _oracle() -> str:
    gap, word = WORD_GAP.replace("\\\\", "\\"), WORD_GAP.replace("[", "[^")
    without = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    pattern = " + ".join(f"(CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 2 ELSE 1 END) * {3**j}" for j, r in enumerate(RULES))
    n = len(RULES)
    digits = ", ".join(f"(pattern // {3**j}) % 3 AS d{j}" for j in range(n))

    def share(i: int) -> str:
        odds = f"ln(prior / (1 - prior))" + "".join(f" + CASE d{j} WHEN 2 THEN ln(g{j} / (1 - b{j})) WHEN 0 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j in range(n))
        return f"1 / (1 + exp(-({odds})))"

    start = ", ".join([f"{PRIOR}::DOUBLE AS prior", *[f"{RIGHT_ON_GOOD}::DOUBLE AS g{j}, {RIGHT_ON_BAD}::DOUBLE AS b{j}" for j in range(n)]])
    right = lambda value, d, j, first: f"(coalesce(sum(CASE WHEN d{j} = {d} THEN {value} END), 0) + {PSEUDO_VOTES * first}) / (coalesce(sum(CASE WHEN d{j} <> 1 THEN {value} END), 0) + {PSEUDO_VOTES})"
    update = ", ".join([f"(coalesce(sum(n * p), 0) + {PSEUDO_VOTES * PRIOR}) / (coalesce(sum(n), 0) + {PSEUDO_VOTES}) AS prior", *[f"greatest({LEAST_RIGHT_ON_GOOD}, {right('n * p', 2, j, RIGHT_ON_GOOD)}) AS g{j}, {right('n * (1 - p)', 0, j, RIGHT_ON_BAD)} AS b{j}" for j in range(n)]])
    rounds = "".join(f", e{i + 1} AS MATERIALIZED (SELECT {update} FROM (SELECT v.*, {share(i)} AS p FROM v, e{i}))\n" for i in range(ROUNDS))
    return f"""
WITH base AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM base
), windows AS (
  SELECT k, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS g FROM (SELECT k, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})
), hit AS (SELECT DISTINCT k, i + unnest(range({WINDOW})) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM windows) WHERE n > 1
), repeats AS (SELECT k, count(*) AS n_repeat_words FROM hit GROUP BY k
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars, ({without('[' + SYMBOLS + ']')})::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS n_unlettered,
    {without(chr(92) + 'p{Lu}')} AS n_capitals, {without('[' + SHOUTS + ']')} AS n_shouts, len(list_distinct(words)) AS n_distinct
  FROM w LEFT JOIN repeats USING (k)
), judged AS (SELECT *, {pattern} AS pattern FROM counts
), v AS MATERIALIZED (SELECT *, {digits} FROM (SELECT pattern, count(*) AS n FROM judged GROUP BY pattern)
), e0 AS (SELECT {start})
{rounds}, posterior AS (SELECT pattern, {share(ROUNDS)} AS posterior FROM v, e{ROUNDS}
), failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept FROM failed JOIN posterior USING (pattern)
"""


ORACLE = _oracle()
