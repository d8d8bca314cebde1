"""Hybrid sparse search: BM25, TF-IDF cosine, reciprocal-rank fusion, coverage and phrase bonus, for batches of queries.

Ranks count all chunks that share a term with the query. They come from hits dealt to tasks in their order and counted by
task, and blocks of chunks that can matter to no result aren't scored at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import lexical_tokens, trimmed
from stratum.operators import batch
from stratum.operators.index import BLOCK_CHUNKS, Corpus, block_table, with_norms
from stratum.storage import removed, stored

K1, B = 1.2, 0.75
RANK_OFFSET, RANK_WEIGHT, COVERAGE_WEIGHT, PHRASE_WEIGHT = 60, 100, 4, 8.0
#: Scores are rounded before they are ranked, so that the order of sums can't decide ranks.
DIGITS = 9
#: Query terms up to this many rows are broadcast to the postings; beyond, both are shuffled by term.
BROADCAST_TERMS = 200_000
#: Hits that may hold their whole query are broadcast to the texts up to so many rows and characters; beyond, both are shuffled.
BROADCAST_HITS, BROADCAST_CHARS = 100_000, 1 << 25
#: Queries of more terms than this, all together, meet postings once for all blocks: what blocks promise would cost as much.
PROMISED_TERMS = 1_000
#: Blocks of a query that are opened first by each order; hits of a range that one task ranks; hits looked at in a block's
#: favour; steps of a score in which hits are counted.
FIRST_BLOCKS, RANGE_HITS, DEPTH, STEPS = 64, 65_536, 256, 64
#: Bins of a query's scores in which hits are counted.
BINS = 512
SLACK = 2e-6


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf, n_terms, inner, n_inner) of (query_id, query). A text that holds the whole query has all its
    terms but perhaps its first and last word, which may go on there; the others are inner ones."""
    tokens = queries.select("query_id", lexical_tokens("query").alias("tokens"))
    words = F.filter("tokens", lambda t: t.rlike("^[a-z0-9_]"))
    edges = F.array(F.get("tokens", F.lit(0)), F.try_element_at(words, F.lit(-1)))
    each = tokens.select("query_id", edges.alias("edges"), F.explode("tokens").alias("term"))
    counted = each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"), (~F.coalesce(F.bool_or(F.array_contains("edges", F.col("term"))), F.lit(False))).cast("int").alias("inner"))
    own = W.partitionBy("query_id")
    return counted.withColumn("n_terms", F.count(F.lit(1)).over(own)).withColumn("n_inner", F.sum("inner").over(own))


def _few(rows: int, limit: int = BROADCAST_TERMS) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts a side of that many rows at most, if these are few; else leaves it as it is."""
    return F.broadcast if rows <= limit else lambda side: side


def small(queries: DataFrame):
    """Broadcasts a side that has no more rows than the queries have terms, if these are few; else leaves it as it is."""
    return _few(query_terms(queries).count())


def range_averages(corpus: Corpus, ranges: DataFrame) -> DataFrame:
    """(query_id, average) length of the chunks in each range (query_id, range_start, range_end) that holds any, from
    the lengths summed up before its first and its last chunk."""
    before = corpus.stats.select(F.col("chunk_ord").alias("range_start"), F.col("length_before").alias("sum_before"))
    upto = corpus.stats.select((F.col("chunk_ord") + 1).alias("range_end"), (F.col("length_before") + F.col("length")).alias("sum_upto"))
    whole = ranges.where("range_end > range_start").join(before, "range_start").join(upto, "range_end")
    return whole.select("query_id", ((F.col("sum_upto") - F.col("sum_before")) / (F.col("range_end") - F.col("range_start"))).alias("average"))


@dataclass(frozen=True)
class Asked:
    """Queries made ready: their weighted terms, the range of each (or None), and average lengths (None: one for all)."""

    terms: DataFrame
    ranges: DataFrame | None
    averages: DataFrame
    phrases: DataFrame
    few: Callable[[DataFrame], DataFrame]
    tables: tuple[DataFrame, ...]

    def with_average(self, side: DataFrame) -> DataFrame:
        return side.crossJoin(F.broadcast(self.averages)) if self.ranges is None else side.join(self.few(self.averages), "query_id")  # one row, or one a query


def asked(corpus: Corpus, queries: DataFrame) -> Asked:
    """``queries`` has query_id and query, and may have chunk_start and chunk_end: then the average length is that of the
    range, while document frequencies and the number of chunks are always the whole corpus's."""
    ranges = None
    averages = corpus.stats.agg(F.avg("length").alias("average"))
    if "chunk_start" in queries.columns:
        start = F.greatest(F.lit(0), F.coalesce("chunk_start", F.lit(0))).cast("long")
        end = F.least(F.lit(corpus.n_chunks), F.coalesce("chunk_end", F.lit(corpus.n_chunks))).cast("long")
        ranges = queries.select("query_id", start.alias("range_start"), end.alias("range_end"))
        averages = range_averages(corpus, ranges)
    counted = stored(query_terms(queries), "query-terms")
    few = _few(counted.count())
    known = corpus.terms.join(few(counted.select("term").distinct()), "term", "left_semi")  # the vocabulary stays where it is
    terms = counted.join(few(known), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.log((F.lit(corpus.size) + 1) / (F.col("df") + 1)) + 1
    terms = terms.withColumn("weight", (1 + F.log("qtf")) * idf).withColumn("query_norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("query_id"))))
    terms = terms.where("df > 0").withColumn("rarity", F.log(1 + (F.lit(corpus.size) - F.col("df") + 0.5) / (F.col("df") + 0.5))).withColumn("idf", idf)
    weighted = stored(terms, "asked")
    removed(counted)
    return Asked(weighted, ranges, averages, queries.select("query_id", F.lower(trimmed("query")).alias("phrase")), few, (weighted,))


def _saturated(tf: Column, length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.greatest(F.lit(1), length) / F.col("average")))


def matched(corpus: Corpus, q: Asked, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_ord, bm25, cosine, n_met, n_terms, near) of all chunks that share a term with a query in its range, or of
    those in ``blocks`` (query_id, block). ``near``: it has all inner terms, so its text may hold the whole query."""
    met = corpus.postings.join(q.few(q.terms), "term")
    if blocks is not None:
        met = met.withColumn("block", F.floor(F.col("chunk_ord") / BLOCK_CHUNKS)).join(q.few(blocks), ["query_id", "block"])
    if q.ranges is not None:
        met = met.join(q.few(q.ranges), "query_id").where((F.col("chunk_ord") >= F.col("range_start")) & (F.col("chunk_ord") < F.col("range_end")))
    sums = (
        q.with_average(met)
        .groupBy("query_id", "chunk_ord")
        .agg(
            F.round(F.sum(F.col("qtf") * F.col("rarity") * _saturated(F.col("tf"), F.col("length"))), DIGITS).alias("bm25"),
            F.sum(F.col("weight") * (1 + F.log("tf")) * F.col("idf")).alias("product"),
            F.count(F.lit(1)).alias("n_met"),
            F.sum("inner").alias("inner"),
        )
    )
    # A chunk's postings lie together, so a row for each hit is shuffled; only then it meets the chunk's norm and what is the query's own.
    hits = with_norms(sums, corpus.stats).join(q.few(q.terms.select("query_id", "query_norm", "n_terms", "n_inner").distinct()), "query_id")
    cosine = F.round(F.col("product") / (F.col("query_norm") * F.col("norm")), DIGITS)
    return hits.select("query_id", "chunk_ord", "bm25", cosine.alias("cosine"), "n_met", "n_terms", (F.col("inner") == F.col("n_inner")).alias("near"))


def potentials(corpus: Corpus, q: Asked) -> DataFrame:
    """(query_id, block, most_bm25, most_cosine, n_could, n_terms, near): what chunks of a block can reach at most, from the
    blocks' greatest counts, least lengths and greatest shares of terms. Only blocks with a term of the query. Unless
    the corpus has its table of blocks already, they are computed of the postings of the queries' terms alone."""
    terms = q.few(q.terms.select("term").distinct())
    blocks = corpus.blocks if corpus.has("blocks") else block_table(corpus.postings.join(terms, "term", "left_semi"), corpus.stats)
    met = blocks.join(q.few(q.terms), "term")
    if q.ranges is not None:
        low, high = F.col("block") * BLOCK_CHUNKS, (F.col("block") + 1) * BLOCK_CHUNKS
        met = met.join(q.few(q.ranges), "query_id").where((high > F.col("range_start")) & (low < F.col("range_end")))
    slack = 10.0**-DIGITS
    return (
        q.with_average(met)
        .groupBy("query_id", "block")
        .agg(
            (F.sum(F.col("qtf") * F.col("rarity") * _saturated(F.col("most_tf"), F.col("least_length"))) * (1 + slack) + slack).alias("most_bm25"),
            (F.sum(F.col("weight") * F.col("idf") * F.col("most_share")) / F.first("query_norm") * (1 + slack) + slack).alias("most_cosine"),
            F.count(F.lit(1)).alias("n_could"),
            F.first("n_terms").alias("n_terms"),
            (F.sum("inner") == F.first("n_inner")).alias("near"),
        )
    )


def in_ranges(hits: DataFrame, score: str) -> DataFrame:
    """``hits`` sorted by query, falling ``score`` and chunk and dealt to tasks, with the task as ``<score>_part`` and the
    place there as ``<score>_place``; a table."""
    parts = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits.count() // RANGE_HITS))
    order = [F.col("query_id"), F.col(score).desc(), F.col("chunk_ord")]
    dealt = hits.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.withColumn(f"{score}_part", F.spark_partition_id()).withColumn(f"{score}_place", F.monotonically_increasing_id()), "ranges")


def ranked(dealt: DataFrame, score: str, name: str, used: list[DataFrame] | None = None) -> DataFrame:
    """Hits of ``in_ranges`` with their rank among all hits of their query; the table of counts is added to ``used``.

    A hit's place in its part, less the first place of its query there, and the query's hits in the parts before give its
    rank: counts of a row for each query and part, while hits stay in the task that reads them.
    """
    part, place = f"{score}_part", f"{score}_place"
    counted = dealt.groupBy("query_id", part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counted.select("query_id", part, (before - F.col("first") + 1).alias("shift")), "starts")
    if used is not None:
        used.append(starts)
    return dealt.join(_few(starts.count())(starts), ["query_id", part]).withColumn(name, F.col(place) + F.col("shift")).drop(part, place, "shift")


def _share(rank: Column) -> Column:
    return F.lit(float(RANK_WEIGHT)) / (RANK_OFFSET + rank)


def _share_of(rank):
    """``_share`` of columns and arrays alike."""
    return RANK_WEIGHT * 1.0 / (RANK_OFFSET + rank)


def thresholds(hits: DataFrame, value: Column, limit: int) -> DataFrame:
    """(query_id, threshold): at least ``limit`` hits of the query have a ``value`` of it or more; of queries with fewer
    hits no row. Values are counted in steps, so no query's hits meet in one task."""
    steps = hits.groupBy("query_id", F.floor(value * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("query_id").orderBy(F.col("step").desc()))
    return steps.withColumn("upto", upto).where(F.col("upto") >= limit).groupBy("query_id").agg((F.max("step") / STEPS).alias("threshold"))


def _hopeful(corpus: Corpus, q: Asked, hits: DataFrame, limit: int) -> DataFrame:
    """Hits that may be among the ``limit`` best of their query, with their score if all hits before them are known; a
    table. Texts are only read of hits that may hold the whole query and may be among the best."""
    near = F.col("near")
    fused = _share(F.col("rank_bm25")) + _share(F.col("rank_cosine")) + F.col("coverage") * COVERAGE_WEIGHT
    hits = hits.withColumn("coverage", F.col("n_met") / F.col("n_terms")).withColumn("fused", fused)
    least = thresholds(hits, F.col("coverage") * COVERAGE_WEIGHT, limit)
    hopeful = hits.join(q.few(least), "query_id", "left").where(F.col("fused") + F.when(near, PHRASE_WEIGHT).otherwise(0.0) >= F.coalesce("threshold", F.lit(0.0)))
    hopeful = stored(hopeful.select("query_id", "chunk_ord", "bm25", "cosine", "rank_bm25", "rank_cosine", "coverage", "fused", "near"), "hopeful")
    asking = hopeful.where(near).join(q.few(q.phrases), "query_id").select("query_id", "chunk_ord", "phrase")
    size = asking.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).collect()[0]
    few = _few(size.n, BROADCAST_HITS if size.chars <= BROADCAST_CHARS else -1)
    texts = corpus.chunks.select("chunk_ord", "text").join(few(asking), "chunk_ord")
    holding = texts.where(F.contains(F.lower("text"), F.col("phrase"))).select("query_id", "chunk_ord", F.lit(PHRASE_WEIGHT).alias("bonus"))
    met = hopeful.join(_few(size.n, BROADCAST_HITS)(holding), ["query_id", "chunk_ord"], "left") if size.n else hopeful.withColumn("bonus", F.lit(0.0))
    bonus = F.coalesce("bonus", F.lit(0.0))
    found = stored(met.select("query_id", "chunk_ord", "bm25", "cosine", "rank_bm25", "rank_cosine", "coverage", bonus.alias("bonus"), F.round(F.col("fused") + bonus, 6).alias("score")), "hopeful")
    removed(hopeful)
    return found


def _binned(hits: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """``hits`` with the bin of their score, and (query_id, bin, n, above): how many hits of the query a bin and those above hold."""
    greatest = hits.groupBy("query_id").agg(F.max(score).alias("greatest"))
    bins = hits.join(_few(greatest.count())(greatest), "query_id").withColumn(f"{score}_bin", F.floor(F.col(score) / F.greatest(F.col("greatest"), F.lit(1e-9)) * BINS)).drop("greatest")
    counted = bins.groupBy("query_id", f"{score}_bin").agg(F.count(F.lit(1)).alias("n"))
    over = W.partitionBy("query_id").orderBy(F.col(f"{score}_bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    return bins, stored(counted.withColumn("above", F.coalesce(F.sum("n").over(over), F.lit(0))), "bins")


def ranked_candidates(q: Asked, hits: DataFrame, limit: int, used: list[DataFrame]) -> DataFrame:
    """Of all ``hits`` those that may be among the ``limit`` best of their query, with both ranks among all hits.

    Hits are counted in bins of their score, so a hit's bin bounds its rank, and the bounds tell who may be among the best.
    Only bins that hold such hits are ranked; of the others the numbers count.
    """
    bounded = hits
    counts = {}
    for score in ("bm25", "cosine"):
        bounded, counts[score] = _binned(bounded, score)
        few = _few(counts[score].count())
        bounds = counts[score].select("query_id", f"{score}_bin", (F.col("above") + 1).alias(f"{score}_low"), (F.col("above") + F.col("n")).alias(f"{score}_high"))
        bounded = bounded.join(few(bounds), ["query_id", f"{score}_bin"])
        used.append(counts[score])
    told = F.col("n_met") / F.col("n_terms") * COVERAGE_WEIGHT
    at_least = _share(F.col("bm25_high")) + _share(F.col("cosine_high")) + told
    at_most = _share(F.col("bm25_low")) + _share(F.col("cosine_low")) + told + F.when(F.col("near"), PHRASE_WEIGHT).otherwise(0.0)
    least = stored(thresholds(bounded, at_least, limit), "least")
    judged = bounded.join(q.few(least), "query_id", "left").withColumn("hopeful", at_most + SLACK >= F.coalesce("threshold", F.lit(0.0)))
    judged = judged.select(*hits.columns, "bm25_bin", "cosine_bin", "hopeful")
    held = stored(judged.where("hopeful").groupBy("query_id", "bm25_bin", "cosine_bin").agg(F.count(F.lit(1)).alias("n")), "hopeful-bins")
    used += [least, held]
    out = None
    for score in ("bm25", "cosine"):
        own = held.select("query_id", f"{score}_bin").distinct()
        few = _few(counts[score].count())
        passed = F.coalesce(F.sum(F.when(F.col("chosen").isNull(), F.col("n")).otherwise(0)).over(W.partitionBy("query_id").orderBy(F.col(f"{score}_bin").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        shifts = counts[score].join(own.withColumn("chosen", F.lit(True)), ["query_id", f"{score}_bin"], "left").withColumn("passed", passed).where("chosen").select("query_id", f"{score}_bin", "passed")
        chosen = judged.join(few(shifts), ["query_id", f"{score}_bin"])
        columns = [*hits.columns, "hopeful", "passed"] if out is None else ["query_id", "chunk_ord", score, "hopeful", "passed"]
        dealt = in_ranges(chosen.select(*columns), score)
        rank = ranked(dealt, score, f"rank_{score}", used).where("hopeful").withColumn(f"rank_{score}", F.col(f"rank_{score}") + F.col("passed")).drop("hopeful", "passed")
        used.append(dealt)
        out = rank if out is None else out.join(rank.drop(score), ["query_id", "chunk_ord"])
    return out


def hybrid(corpus: Corpus, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` best chunks of each query by both ranks, coverage and phrase: query_id, rank, chunk_ord, score, source.

    Blocks of chunks that promise most are opened first. What is found there says which others can hold one of the best,
    or something that comes before one of them in either order; of these ever more are opened, until none is left. A block that stays
    closed can change neither the best nor their ranks, so the result is that of opening all.
    """
    q = asked(corpus, queries)
    place = lambda by: F.row_number().over(W.partitionBy("query_id", "needed").orderBy(F.col(by).desc(), "block"))

    def dealt(told: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Of the needed blocks of each query those ``most`` that promise most in either order, and all others."""
        split = stored(told.withColumn("open", F.col("needed") & ((place("most_bm25") <= most) | (place("most_cosine") <= most))).drop("needed"), "potentials")
        used.append(split)
        return split.where("open").drop("open"), split.where("NOT open").drop("open")

    used, hits, most, opening, closed = list(q.tables), None, FIRST_BLOCKS, None, None
    promised = q.terms.count() <= PROMISED_TERMS
    if not promised and q.ranges is None and (done := batch.ranked(corpus, q.terms, q.averages, K1, B, limit, _share_of, COVERAGE_WEIGHT, PHRASE_WEIGHT, SLACK, thresholds)):
        found = _hopeful(corpus, q, done[0], limit)
        removed(*used, *done[1])
        return top(found, limit).select("query_id", "rank", "chunk_ord", "score", F.lit("hybrid").alias("source"))
    if promised:  # else all blocks are opened at once
        opening = potentials(corpus, q)
        if corpus.n_chunks > FIRST_BLOCKS * BLOCK_CHUNKS:
            opening, closed = dealt(opening.withColumn("needed", F.lit(True)), most)
    while True:
        more = stored(matched(corpus, q, None if opening is None else opening.select("query_id", "block")), "matched")
        hits = more if hits is None else hits.unionByName(more)
        if closed is None or closed.isEmpty():  # these are all hits that count
            found = _hopeful(corpus, q, ranked_candidates(q, hits, limit, used), limit)
            used += [more, found]
            break
        by_bm25 = in_ranges(hits, "bm25")
        by_cosine = in_ranges(ranked(by_bm25, "bm25", "rank_bm25", used), "cosine")
        both = ranked(by_cosine, "cosine", "rank_cosine", used)
        found = _hopeful(corpus, q, both, limit)
        used += [more, by_bm25, by_cosine, found]
        beyond = closed.groupBy("query_id").agg(F.max("most_bm25").alias("b"), F.max("most_cosine").alias("c"))
        sure = found.join(beyond, "query_id", "left")
        known = lambda rank, value, most: F.when(F.coalesce(F.col(value) > F.col(most), F.lit(True)), _share(F.col(rank))).otherwise(F.lit(0.0))
        at_least = known("rank_bm25", "bm25", "b") + known("rank_cosine", "cosine", "c") + F.col("coverage") * COVERAGE_WEIGHT + F.col("bonus")
        best = thresholds(sure, at_least, limit).withColumnRenamed("threshold", "best")
        top_of = lambda rank, value: F.collect_list(F.when(F.col(rank) <= DEPTH, F.col(value))).alias("top_" + value)
        tops = both.where((F.col("rank_bm25") <= DEPTH) | (F.col("rank_cosine") <= DEPTH)).groupBy("query_id").agg(top_of("rank_bm25", "bm25"), top_of("rank_cosine", "cosine"))
        lowest = found.join(best, "query_id", "left").where(F.col("score") + SLACK >= F.coalesce("best", F.lit(0.0))).groupBy("query_id").agg(F.min("bm25").alias("low_bm25"), F.min("cosine").alias("low_cosine"))
        told = closed.join(best, "query_id", "left").join(tops, "query_id", "left").join(lowest, "query_id", "left")
        ahead = lambda value: F.coalesce(F.size(F.filter("top_" + value, lambda v: v > F.col("most_" + value))), F.lit(0))
        promise = _share(1 + ahead("bm25")) + _share(1 + ahead("cosine")) + F.col("n_could") / F.col("n_terms") * COVERAGE_WEIGHT + F.when(F.col("near"), PHRASE_WEIGHT).otherwise(0.0)
        needed = (promise + SLACK >= F.coalesce("best", F.lit(0.0))) | (F.col("most_bm25") >= F.coalesce("low_bm25", F.lit(0.0))) | (F.col("most_cosine") >= F.coalesce("low_cosine", F.lit(0.0)))
        most *= 4
        opening, closed = dealt(told.select(*closed.columns, needed.alias("needed")), most)
        if opening.isEmpty():
            break
    removed(*[table for table in used if table is not found])
    return top(found, limit).select("query_id", "rank", "chunk_ord", "score", F.lit("hybrid").alias("source"))


def scored(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_ord, bm25, cosine, coverage) of all chunks that share a term with a query in its range."""
    return matched(corpus, asked(corpus, queries)).select("query_id", "chunk_ord", "bm25", "cosine", (F.col("n_met") / F.col("n_terms")).alias("coverage"))


def top(hits: DataFrame, limit: int, score: str = "score") -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_ord")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def hierarchical(corpus: Corpus, queries: DataFrame, limit: int = 12, adjacent: int = 1, global_mode: bool = False) -> DataFrame:
    """Hybrid hits, children of the sections whose titles and summaries match best, and neighbours of the hits.

    A neighbour loses 0.15 for each place in the slice of children around the hit, counted from its start, not by the
    distance to the hit. Of a chunk that is found several ways the best score counts, and neighbours only count for
    chunks not found otherwise, first those of better hits.
    """
    base = stored(hybrid(corpus, queries, max(limit, 10)), "hits")
    children = corpus.chunks.select("chunk_ord", "parent_ord", F.col("part_index").alias("position"))
    parent_terms = corpus.sections.select("parent_ord", "summary", F.explode(F.array_distinct(lexical_tokens(F.concat_ws("\n", "title", "summary")))).alias("term"))
    few = small(queries)
    matched = parent_terms.join(few(query_terms(queries)), "term").groupBy("query_id", "parent_ord").agg((F.count(F.lit(1)) / F.first("n_terms")).alias("coverage"), F.first("summary").alias("summary"))
    phrases = queries.select("query_id", F.lower(trimmed("query")).alias("phrase"))
    score = F.col("coverage") * 6 + F.when(F.contains(F.lower("summary"), F.col("phrase")), 4.0).otherwise(0.0)
    order = W.partitionBy("query_id").orderBy(F.round("parent_score", DIGITS).desc(), "parent_ord")
    parents = matched.join(few(phrases), "query_id").withColumn("parent_score", score).withColumn("n", F.row_number().over(order)).where(F.col("n") <= (8 if global_mode else 4))
    from_parents = parents.join(children, "parent_ord").where("position < 4").select("query_id", "chunk_ord", F.round(F.col("parent_score") + (1.2 if global_mode else 0.4), 6).alias("score"), F.lit("parent_summary").alias("source"), F.lit(1).alias("level"))
    first = base.select("query_id", "chunk_ord", "score", "source", F.lit(0).alias("level")).unionByName(from_parents)
    best = W.partitionBy("query_id", "chunk_ord").orderBy(F.col("score").desc(), "level")
    merged = first.withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", "chunk_ord", "score", "source")
    at = base.join(children, "chunk_ord").select("query_id", "rank", F.col("score").alias("hit_score"), "parent_ord", F.col("position").alias("hit_position"))
    low = F.greatest(F.lit(0), F.col("hit_position") - adjacent)
    near = at.join(children, "parent_ord").where((F.col("position") >= low) & (F.col("position") <= F.col("hit_position") + adjacent))
    near = near.select("query_id", "chunk_ord", "rank", F.round(F.greatest(F.lit(0.01), F.col("hit_score") - 0.15 * (F.col("position") - low + 1)), 6).alias("score"))
    near = near.join(merged.select("query_id", "chunk_ord"), ["query_id", "chunk_ord"], "left_anti")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("query_id", "chunk_ord").orderBy("rank"))).where("n = 1").select("query_id", "chunk_ord", "score", F.lit("parent_neighbor").alias("source"))
    return top(merged.unionByName(near), limit).select("query_id", "rank", "chunk_ord", "score", "source")
