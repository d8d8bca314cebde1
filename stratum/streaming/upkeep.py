"""An index kept up with a stream of changes, or with a folder whose files come, change and go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.operators.segments import Index
from stratum.sources.files import parse_files


def maintain(changes: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Carry a stream of changes (document, text, changed_at) into the index in ``folder``; a null text removes.

    Each batch is one version of the index, which also says that the batch is in it; a batch that is repeated after a
    failure is known by that and changes nothing.
    """

    def carry(batch: DataFrame, number: int) -> None:
        index = Index.of(batch.sparkSession, folder)
        if number > index.applied(checkpoint):
            index.changed(batch, checkpoint, number).committed()

    writer = changes.writeStream.foreachBatch(carry).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folder_changes(spark: SparkSession, files: str, index: Index) -> DataFrame:
    """What to change in ``index`` so that it holds the files under ``files``: (document, text, changed_at, source_bytes, stamp).

    A file is known by its name, and has changed if its time or length has. Only new and changed files are opened.
    One that can't be parsed has no text, so what was indexed of it before is removed.
    """
    stamp = F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp")
    listed = spark.read.format("binaryFile").load(files).select("path", F.element_at(F.split("path", "/"), -1).alias("document"), stamp)
    known = index.spans().select("document", "stamp")
    fresh = listed.join(known, ["document", "stamp"], "left_anti").collect()  # paths, which the driver has listed
    gone = known.join(listed, "document", "left_anti").select("document", F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("source_bytes"), F.lit(None).cast("string").alias("stamp"))
    found = gone
    if fresh:
        names = spark.createDataFrame([(r.document, r.stamp) for r in fresh], "document string, stamp string")
        parsed = parse_files(spark.read.format("binaryFile").load([r.path for r in fresh])).select(F.col("name").alias("document"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.col("source_bytes").cast("long").alias("source_bytes"))
        found = parsed.join(names, "document").select(*gone.columns).unionByName(gone)
    return found.withColumn("changed_at", F.lit(0))


def synchronised(spark: SparkSession, files: str, folder: str) -> Index:
    """The index in ``folder``, made to hold the files under ``files`` and committed if anything has changed."""
    index = Index.of(spark, folder)
    now = index.changed(folder_changes(spark, files, index))
    return index if now.entries == index.entries else now.committed()


def watch(spark: SparkSession, files: str, folder: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Look at the files anew in each interval."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: synchronised(batch.sparkSession, files, folder) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
