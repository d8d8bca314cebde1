"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Within each source the key's range is dealt into buckets of a bounded number
of rows; bucket sums give distributed prefix sums, and each source is cut at exactly its budget. A budget above the
source's size takes whole epochs first and cuts in the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: What separates words: the space and the characters 9 to 13.
WORD_GAP = "[ \\x09-\\x0D]+"
#: Rows alike that one task writes out; more are dealt over all tasks.
COPIES = 1_000


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_GAP), "")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``totals`` (source, n_rows, source_size) plus ``target``.

    Sources are ranked by code point, null last, and weighted cyclically. With caps c and weights w, resharing the
    excess by weight until none is above its cap gives target = min(c, t * w) for the one level t at which the
    targets add up to the whole size. Sources in the order of c / w are capped until the first that stays below.
    """
    everything = W.partitionBy()
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    position = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    ranked = totals.withColumn("weight", F.element_at(cycle, position)).withColumn("cap", F.col("source_size") * max_epochs)
    by_room = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, W.unboundedFollowing)
    leveled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_onward", F.sum("weight").over(onward))
        .withColumn("level", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_onward"))
        .withColumn("below", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("nth", F.row_number().over(by_room))
    )
    level = F.min_by("level", F.when(F.col("below"), F.col("nth"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return leveled.select("source", "n_rows", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, rows_per_bucket: int = 2_000) -> DataFrame:
    """One row per row of ``documents`` (doc_id, source, text): doc_id, source, size, source_size, target, taken.

    A null or empty text has size 0 and a null source is a source of its own, ranked last; texts are counted whole. Rows
    of one source are taken in the order of the md5 of their doc_id (a null doc_id counts as empty), then doc_id and
    size, so that reruns agree. Rows alike in these go through the sums as one, however many they are, and each gets its
    own place among them: which of them is cut is arbitrary, the rows returned are not. The words taken from a source
    add up to its target, rounded down. Other columns are ignored, whatever their names; an empty table gives none.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = cut(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = cut(source_targets(totals, weights, max_epochs))
    n_sources = targets.count()
    most = rows.agg(F.max("copies")).collect()[0][0] or 0
    buckets = F.least(F.ceil(F.col("n_rows") / rows_per_bucket), F.lit(65536)).cast("long")
    slot = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("long")
    t = targets.withColumnRenamed("source", "target_source")
    placed = rows.join(maybe_broadcast(t, n_sources), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source").withColumn("bucket", slot)
    sums = placed.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    offsets = cut(sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(maybe_broadcast(offsets, offsets.count()), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    first = joined.withColumn("before", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    nth = lambda a, b: F.explode(F.sequence(a, b)).alias("nth")
    zero = F.lit(0).cast("long")
    each = first.where(F.col("copies") <= COPIES).select("*", nth(zero, F.col("copies") - 1))
    if most > COPIES:
        runs = first.where(F.col("copies") > COPIES).select("*", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("low")).repartition(parts)
        each = each.unionByName(runs.select("*", nth(F.col("low"), F.least(F.col("low") + COPIES, F.col("copies")) - 1)).drop("low"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    return (
        each.withColumn("seen", F.col("before") + F.col("nth") * F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("seen"))))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 3 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM totals
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM ranked
), lev AS (
  SELECT (SELECT level FROM leveled WHERE cap > level * weight ORDER BY nth LIMIT 1) AS level
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM lev) * weight, cap::DOUBLE)) AS target FROM leveled
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cutoff AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(budget // source_size, 3) ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - seen)))::BIGINT AS taken
FROM cutoff
"""
