"""A training corpus in five stages, each reading what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import decontaminate, mixing, neardup, quality, suffix_dedup
from stratum.llm.common import cut, maybe_broadcast, new_path


def _whole(docs: DataFrame) -> Column:
    """A row's columns as one, so that no name of theirs meets one that a stage uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def choose_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the importance-resampling classifier doesn't sample.

    Null and empty texts weigh 0. Each row is judged by its own text, whatever its doc_id, so equal texts are kept or
    dropped alike. Long texts are scored whole. Further columns are carried; an empty table stays empty.
    """
    selector = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = cut(selector.score(docs))
    return selector.choose(scores).keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked at a similarity of 0.8 on five-word shingles, and all rows without words.

    It is the row of the least doc_id, null after all others; of several texts that of the least md5, of equal texts the
    row whose columns come first. Groups are told apart by doc_id and text, for doc_ids may be null or repeated. Null
    and empty texts have no words; long ones are compared whole. An empty table stays empty.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), digest.alias("digest"))
    groups = neardup.near_duplicates(docs.select(row.alias("doc_id"), "text"), k=5, percent=80, trees=20, block_trees=10)
    kept = cut(groups.where("kept").groupBy(F.col("doc_id").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles")))
    held = docs.select(_whole(docs).alias("held"), row.alias("at"))
    once = held.join(kept.where("n = 1 OR n_shingles = 0"), "at", "left_semi")
    repeated = kept.where("n > 1 AND n_shingles > 0").select("at")
    n_repeated = repeated.count()
    if n_repeated:
        first = held.join(maybe_broadcast(repeated, n_repeated), "at").groupBy("at").agg(F.min("held").alias("held"))
        once = once.select("held").unionByName(first.select("held"))
    return once.select("held.*")


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated byte strings out of the texts, with the whole of the characters at their ends.

    Null stays null, and texts of under 100 bytes stay as they are; long ones are dealt over several tasks. Rows that
    share a doc_id are judged each by its own text. ``n_chars``, if there is one, follows the text; other columns are
    carried. An empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(F.col("text").isNull().alias("no_text"), *([_whole(docs.select(*[f"`{c}`" for c in rest])).alias("rest")] if rest else []))
    stripped = suffix_dedup.strip_repeats(docs.select("doc_id", "text", carried.alias("carried_row")), ["carried_row"], whole_chars=True)
    text = F.when(~F.col("carried_row.no_text"), F.col("kept").cast("string"))
    columns = {c: F.col("carried_row.rest").getField(c) for c in rest} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.size("removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return stripped.select(*[columns[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lies in windows of benchmark items.

    Each row is judged by its own text, so of rows that share a doc_id, null included, only the contaminated ones go.
    Null and empty texts are clean; long ones are read whole. An empty table stays empty.
    """
    digest = F.xxhash64("text")
    found = decontaminate.contamination(docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("at")).distinct()
    held = docs.select(_whole(docs).alias("held"), F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("at"))
    return held.join(bad, held["at"].eqNullSafe(bad["at"]), "left_anti").select("held.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document: doc_id, source, size, source_size, target, taken.

    A null text has size 0, a null source is one of its own; equal rows are told apart by nothing, so which of them is
    cut is arbitrary. An empty table stays empty; further columns are left out.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", choose_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated passage removal", strip_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
]

#: Classifier, forest and suffix arrays have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
