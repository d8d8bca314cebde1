"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of every ``WINNOW`` consecutive k-gram hashes the least is kept as a fingerprint (the leftmost of equal ones). As
``K + WINNOW - 1`` is the window of 13 words, each shared window holds a fingerprint that both sides keep at the same
place. Fingerprints of documents and items are joined, and each meeting is extended to the windows through it by
comparing the words themselves, so hashes that collide do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after A-Z have become a-z.
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW, K = 13, 5
WINNOW = WINDOW - K + 1
#: A fingerprint holds a hash of 36 bits above a position of 27 bits, so that the least one is also the leftmost.
POSITION_BITS = 27
HASH_MASK = (1 << 36) - 1


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), WORD_GAP), ""), F.array().cast("array<string>"))


def _grams(w: Column, n: Column, k: int, least: int) -> Column:
    """A packed (hash, 1-based position) for each of the k-grams; none if there are fewer than ``least`` words."""
    packed = F.transform(
        F.sequence(F.lit(1), n - (k - 1)),
        lambda i: F.shiftleft(F.xxhash64(F.slice(w, i, k)).bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    return F.when(n >= least, packed).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column) -> Column:
    kept = F.transform(F.sequence(F.lit(1), F.size(grams) - (WINNOW - 1)), lambda i: F.array_min(F.slice(grams, i, WINNOW)))
    return F.when(F.size(grams) >= WINNOW, F.array_distinct(kept)).otherwise(F.array().cast("array<bigint>"))


def _exploded(df: DataFrame, keys: list[str], packed: str, before: int, length: int) -> DataFrame:
    """A row for each fingerprint with its hash and the words around it; ``at`` is its place among these words.

    The outer form keeps the optimizer from copying the whole expression into a filter below; joins drop its nulls.
    """
    place = F.col("fp").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    start = F.greatest(F.lit(1), F.col("place") - before)
    return (
        df.select(*keys, "w", F.explode_outer(packed).alias("fp"))
        .select(*keys, "w", F.shiftright("fp", POSITION_BITS).alias("h"), place.alias("place"))
        .select(*keys, "h", "place", F.slice("w", start, length).alias("around"), (F.col("place") - start + 1).alias("at"))
    )


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``benchmark`` holds (item_id, text). Null and empty texts have no words, are never hit and hold no window; items of
    under 13 words are one window as a whole. Items that share an id count once; a null id counts as ``null``. Rows
    that share a doc_id, null included, are judged each by its own text, and equal rows alike. A text is read whole, up
    to 2^27 words. An empty benchmark hits nothing, an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    items = cut(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).distinct().withColumn("n", F.size("w")).where("n > 0"))
    keys = ["doc_id", "text_hash"]

    def fingerprints(df: DataFrame, ids: list[str]) -> DataFrame:
        grams = df.select(*ids, "w", _grams(F.col("w"), F.col("n"), K, WINDOW).alias("grams"))
        return _exploded(grams.select(*ids, "w", _winnowed(F.col("grams")).alias("kept")), ids, "kept", WINDOW - K, 2 * WINDOW - K)

    def sides(df: DataFrame) -> DataFrame:
        return cut(df.select("item", "h", F.col("around").alias("item_around"), F.col("at").alias("item_at")).where("h IS NOT NULL").distinct())

    of_items = sides(fingerprints(items, ["item"]))
    met = fingerprints(docs, keys).join(maybe_broadcast(of_items, of_items.count()), "h")
    offsets = F.filter(
        F.sequence(F.lit(0), F.lit(WINDOW - K)),
        lambda o: (F.col("at") - o >= 1)
        & (F.col("item_at") - o >= 1)
        & (F.col("at") - o + (WINDOW - 1) <= F.size("around"))
        & (F.col("item_at") - o + (WINDOW - 1) <= F.size("item_around"))
        & (F.slice("around", F.greatest(F.lit(1), F.col("at") - o), WINDOW) == F.slice("item_around", F.greatest(F.lit(1), F.col("item_at") - o), WINDOW)),
    )
    hits = [met.select(*keys, "item", "place", F.explode(offsets).alias("o")).select(*keys, "item", (F.col("place") - F.col("o")).alias("start"), F.lit(WINDOW).alias("length"))]
    for length in sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()):  # 12 at most
        whole = items.where(F.col("n") == length).select("item", "w", _grams(F.col("w"), F.col("n"), length, length).alias("grams"))
        of_short = sides(_exploded(whole, ["item"], "grams", 0, length))
        any_place = _exploded(docs.select(*keys, "w", _grams(F.col("w"), F.col("n"), length, length).alias("grams")), keys, "grams", 0, length)
        found = any_place.join(maybe_broadcast(of_short, of_short.count()), "h").where(F.col("around") == F.col("item_around"))
        hits.append(found.select(*keys, "item", F.col("place").alias("start"), F.lit(length).alias("length")))
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    per_doc = (
        reduce(DataFrame.unionByName, hits)
        .groupBy(*keys)
        .agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            F.col("doc_id").alias("hit_id"),
            F.col("text_hash").alias("hit_hash"),
            F.aggregate(
                "spans",
                F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("total")),
                lambda a, s: F.struct(
                    F.greatest(a["until"], s["start"] + s["length"]).alias("until"),
                    (a["total"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], a["until"]))).alias("total"),
                ),
                lambda a: a["total"],
            ).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.array_join("items", ",").alias("item_list"),
        )
    )
    counted = docs.select(*keys, F.col("n").cast("long").alias("n_words"))
    joined = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("text_hash").eqNullSafe(F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)
), hit AS (SELECT doc_id, item, s, dw.size FROM dw JOIN bw USING (size, win)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
