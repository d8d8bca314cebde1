"""Artifacts by what they hold: equal kind and content have one id, and what an id holds never changes.

The table is partitioned by the first digits of the hash, so that a lookup of some ids reads only their partitions, and
new content is compared only with what may equal it. Its size is bounded by nothing on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import content_id

ROWS = "artifact_id string, kind string, content string, metadata map<string,string>, written timestamp, prefix string"
DIGITS = 2


def prefix_of(artifact_id: Column) -> Column:
    """The first digits of an id's hash."""
    return F.left(F.substring_index(artifact_id, "_", -1), F.lit(DIGITS))


@dataclass(frozen=True)
class ArtifactStore:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """All that was written. Two writers may have added the same content at once, so an id may stand twice."""
        try:
            return self.spark.read.schema(ROWS).parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], ROWS)

    def put(self, artifacts: DataFrame) -> DataFrame:
        """Add (kind, content[, metadata]) that isn't there yet; the ids of all: (kind, content, artifact_id).

        Null content is empty content. Of equal content that comes with different metadata, that of the least counts.
        """
        metadata = F.col("metadata") if "metadata" in artifacts.columns else F.lit(None)
        content = F.coalesce("content", F.lit(""))
        rows = artifacts.select("kind", content.alias("content"), metadata.cast("map<string,string>").alias("metadata")).withColumn("artifact_id", content_id("kind", F.col("content")))
        once = rows.groupBy("artifact_id").agg(F.min_by(F.struct("kind", "content", "metadata"), F.coalesce(F.to_json("metadata"), F.lit(""))).alias("a")).select("artifact_id", "a.*").withColumn("prefix", prefix_of(F.col("artifact_id")))
        fresh = once.join(self.rows().select("prefix", "artifact_id"), ["prefix", "artifact_id"], "left_anti").withColumn("written", F.current_timestamp())
        fresh.select(*[c.split()[0] for c in ROWS.split(", ")]).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)
        return rows.select("kind", "content", "artifact_id")

    def get(self, ids: DataFrame) -> DataFrame:
        """(artifact_id, kind, content, metadata) of those of ``ids`` (artifact_id) that there are, once each."""
        asked = ids.select("artifact_id").distinct().withColumn("prefix", prefix_of(F.col("artifact_id")))
        return self.rows().join(asked, ["prefix", "artifact_id"], "left_semi").dropDuplicates(["prefix", "artifact_id"]).select("artifact_id", "kind", "content", "metadata")

    def missing(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (artifact_id) that there aren't."""
        asked = ids.select("artifact_id").distinct().withColumn("prefix", prefix_of(F.col("artifact_id")))
        return asked.join(self.rows().select("prefix", "artifact_id"), ["prefix", "artifact_id"], "left_anti").select("artifact_id")

    def describe(self) -> DataFrame:
        """(artifact_id, kind, characters, bytes, metadata) of every artifact; contents aren't returned."""
        sized = self.rows().select("prefix", "artifact_id", "kind", F.length("content").alias("characters"), F.octet_length("content").alias("bytes"), "metadata")
        return sized.dropDuplicates(["prefix", "artifact_id"]).drop("prefix")
