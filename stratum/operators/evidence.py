"""Retrieval strategies, evidence packing, artifact ids and citations, for tables of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import column, compact, content_id, token_estimate, trimmed
from stratum.operators.index import Corpus
from stratum.operators.search import hybrid
from stratum.storage import stored
from stratum.plans.routing import is_exhaustive, needs_coverage, with_memory

LEXICAL_LIMIT, COVERAGE_LIMIT, SAMPLES, FALLBACK = 7, 10, 5, 3
BLOCK_TOKENS = 80
LEAST_BUDGET, MOST_BUDGET, TASK_RESERVE = 1_000, 10_000, 2_000
EXCERPT = 500
#: Parts the case from the task in the ids of tasks of several cases.
OF_CASE = "\x1e"


def positions(n: Column, text: Column | str) -> Column:
    """Up to five places in a range of ``n`` chunks, spread evenly (halves go to even), in the order that the text asks for.

    From the end if it speaks of the end, from the start if of the start or background, else the middle, both ends, and
    the rest by their distance from the middle; equal distances go by place.
    """
    q = compact(text)
    samples = F.least(F.lit(SAMPLES), n).cast("int")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), samples - 1)), lambda i: F.rint(i * (n - 1) / F.greatest(F.lit(1), samples - 1)).cast("long")))
    ascending = F.array_sort(spread)
    half = (n - 1) / 2
    by_middle = F.transform(F.array_sort(F.transform(spread, lambda p: F.struct(F.abs(p - half).alias("d"), p.alias("p")))), lambda s: s["p"])
    mixed = F.array_distinct(F.concat(F.array(F.element_at(by_middle, 1), F.array_min(spread), F.array_max(spread)), by_middle))
    ordered = F.when(q.rlike("末尾|结尾"), F.reverse(ascending)).when(q.rlike("开头|背景"), ascending).otherwise(mixed)
    return F.when(n > 0, ordered).otherwise(F.array().cast("array<bigint>"))


def retrieve(corpus: Corpus, tasks: DataFrame, memory: str = "") -> DataFrame:
    """(task_id, position, chunk_ord, score, source, strategy) for each of ``tasks`` (task_id, objective, query, agent_type,
    chunk_start, chunk_end; few rows).

    Tasks that ask for everything get their whole range; broad ones get places spread over it, then lexical hits, ten
    in all; others get lexical hits, or if there are none the first three chunks.
    """
    query = with_memory("query", F.lit(memory))
    text = F.concat(F.col("objective"), query)
    plan = tasks.select("task_id", "agent_type", query.alias("query"), text.alias("text"), F.greatest(F.lit(0), F.col("chunk_start")).cast("long").alias("chunk_start"), F.least(F.lit(corpus.n_chunks), F.col("chunk_end")).cast("long").alias("chunk_end"))
    plan = plan.withColumn("mode", F.when(is_exhaustive("text"), "all").when(needs_coverage("agent_type", "text"), "broad").otherwise("exact"))
    inside = (F.col("chunk_ord") >= F.col("chunk_start")) & (F.col("chunk_ord") < F.col("chunk_end"))
    chunks = corpus.chunks.select("chunk_ord")
    everything = chunks.join(F.broadcast(plan.where("mode = 'all'")), inside).select("task_id", F.col("chunk_ord").alias("rank"), "chunk_ord", F.lit(1.0).alias("score"), F.lit("shard_exhaustive_scan").alias("source"), F.lit("sharded_exhaustive_scan").alias("strategy"))
    asked = plan.where("mode <> 'all'").select(F.col("task_id").alias("query_id"), "query", "chunk_start", "chunk_end")
    lexical = stored(hybrid(corpus, asked, LEXICAL_LIMIT).select(F.col("query_id").alias("task_id"), "rank", "chunk_ord", "score", "source"), "lexical-hits")
    exact_plan = plan.where("mode = 'exact'").select("task_id", "chunk_start", "chunk_end")
    exact = lexical.join(F.broadcast(exact_plan.select("task_id")), "task_id").withColumn("strategy", F.lit("sharded_hybrid_exact"))
    bare = exact_plan.join(lexical.select("task_id").distinct(), "task_id", "left_anti")
    first = F.sequence(F.col("chunk_start"), F.least(F.col("chunk_end"), F.col("chunk_start") + FALLBACK) - 1)
    fallback = bare.where("chunk_end > chunk_start").select("task_id", F.posexplode(first).alias("rank", "chunk_ord")).select("task_id", "rank", "chunk_ord", F.lit(0.01).alias("score"), F.lit("shard_fallback").alias("source"), F.lit("sharded_positional_fallback").alias("strategy"))
    broad_plan = plan.where("mode = 'broad'")
    places = broad_plan.select("task_id", "chunk_start", F.posexplode(positions(F.col("chunk_end") - F.col("chunk_start"), "text")).alias("rank", "place"))
    coverage = places.select("task_id", F.lit(0).alias("part"), "rank", (F.col("chunk_start") + F.col("place")).alias("chunk_ord"), F.lit(0.0).alias("score"), F.lit("positional_coverage").alias("source"))
    also = lexical.join(F.broadcast(broad_plan.select("task_id")), "task_id").select("task_id", F.lit(1).alias("part"), "rank", "chunk_ord", "score", "source")
    once = coverage.unionByName(also).withColumn("n", F.row_number().over(W.partitionBy("task_id", "chunk_ord").orderBy("part", "rank"))).where("n = 1")
    broad = once.withColumn("rank", F.row_number().over(W.partitionBy("task_id").orderBy("part", "rank"))).where(F.col("rank") <= COVERAGE_LIMIT).select("task_id", "rank", "chunk_ord", "score", "source", F.lit("sharded_hybrid_plus_positional_coverage").alias("strategy"))
    hits = everything.unionByName(exact).unionByName(fallback).unionByName(broad)
    return hits.withColumn("position", F.row_number().over(W.partitionBy("task_id").orderBy("rank"))).select("task_id", "position", "chunk_ord", "score", "source", "strategy")


def evidence_budget(input_budget: Column | str) -> Column:
    return F.greatest(F.lit(LEAST_BUDGET), F.least(F.lit(MOST_BUDGET), column(input_budget) - TASK_RESERVE))


def pack(hits: DataFrame, budget: Column | str, key: str = "task_id") -> DataFrame:
    """The hits (key, position, text) whose texts fit the budget, in order up to the first that doesn't; the first always."""
    cost = token_estimate(trimmed("text")) + BLOCK_TOKENS
    used = F.sum("cost").over(W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("cost", cost).withColumn("used", used).where((F.col("used") <= column(budget)) | (F.col("position") == 1))


def evidence(corpus: Corpus, hits: DataFrame, tasks: DataFrame, shard_bytes: int) -> DataFrame:
    """Packed hits as artifacts of kind evidence, with what a citation tells of them.

    Tasks of several cases have ids of case, ``OF_CASE`` and task; an artifact's id is that of the task's own.
    """
    texts = hits.join(corpus.chunks.select("chunk_ord", "chunk_id", "document", "section_title", "text", "byte_size"), "chunk_ord")
    texts = texts.join(corpus.sources.select("document", "source_bytes", "indexed_bytes"), "document", "left").fillna(0, ["source_bytes", "indexed_bytes"])
    of_task = tasks.select("task_id", "agent_type", "agent_instance_id", "shard_index", "shard_count", F.col("shard_bytes").alias("task_bytes"), evidence_budget("input_budget").alias("budget"))
    packed = pack(texts.join(F.broadcast(of_task), "task_id"), "budget")
    content = trimmed("text")
    return packed.select(
        content_id(F.lit("evidence"), content, F.col("chunk_id"), F.round("score", 6), F.col("source"), F.substring_index("task_id", OF_CASE, -1), F.col("agent_instance_id"), F.col("shard_index"), F.col("shard_count")).alias("artifact_id"),
        F.lit("evidence").alias("kind"), content.alias("content"), "task_id", "position", "chunk_ord", "chunk_id", "document", F.col("section_title").alias("section"), F.round("score", 6).alias("score"), F.col("source").alias("retrieval_source"), "strategy",
        F.col("source_bytes").alias("document_bytes"), "indexed_bytes", F.col("byte_size").alias("chunk_bytes"), (F.col("indexed_bytes") > shard_bytes).alias("source_exceeds_shard_limit"), F.lit(shard_bytes).alias("shard_byte_limit"),
        "agent_type", "agent_instance_id", "shard_index", "shard_count", F.col("task_bytes").alias("shard_bytes"),
    )


def citations(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """Evidence artifacts that ``ids`` (position, artifact_id) name, once each, in the order of their first mention."""
    once = ids.groupBy("artifact_id").agg(F.min("position").alias("cited_at"))
    return artifacts.where("kind = 'evidence'").join(once, "artifact_id").select(
        "cited_at", "artifact_id", "chunk_id", "document", "section", "score", "retrieval_source", F.left("content", F.lit(EXCERPT)).alias("excerpt"), "document_bytes", "indexed_bytes", "chunk_bytes", "source_exceeds_shard_limit", "shard_byte_limit",
        "task_id", "agent_type", "agent_instance_id", "shard_index", "shard_count",
    )


def valid_ids(cited: Column | str, packed: Column | str) -> Column:
    """Cited ids that were packed, or else the first three packed."""
    packed = column(packed)
    kept = F.filter(column(cited), lambda x: F.array_contains(packed, x))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(packed, 1, 3))
