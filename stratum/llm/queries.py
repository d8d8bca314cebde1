"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, hard_negatives, html_extract, mixing, neardup, quality, quality_rules, suffix_dedup, toxicity, urlgraph, warc, whitening
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read_warc(spark, path))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = suffix_dedup.strip_repeats(_table(spark, sf_dir, "documents"))
    width = F.aggregate(F.sequence(F.lit(1), F.size("removed") - 1, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.element_at("removed", i + 1) - F.element_at("removed", i))
    return stripped.select(
        "doc_id",
        "n_bytes",
        F.when(F.size("removed") > 0, width).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("posterior")


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_extract_text, op3_nearest, op4_decontaminate, op5_url_filter, op6_mix_sources, op7_toxicity, op8_warc, op9_suffix_dedup, op10_quality, op11_hard_negatives, op12_quality_rules, op13_whiten)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": neardup.ORACLE, "op3_nearest": ann.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op5_url_filter": urlgraph.ORACLE, "op6_mix_sources": mixing.ORACLE, "op8_warc": warc.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_quality_rules": quality_rules.ORACLE}
