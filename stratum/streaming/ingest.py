"""Files that arrive in a folder, parsed, cut into chunks and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratum.operators import segment
from stratum.operators.index import postings_table, term_table
from stratum.sources.files import parse_files

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_key, document, section_title, text) of the files in ``folder``; keys follow from names and places, so a
    file that is read again gives the same rows."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    parsed = parse_files(files).where("error IS NULL")
    sections = parsed.select(F.col("name").alias("document"), F.posexplode(segment.sections("text")).alias("section_index", "s"))
    chunks = sections.select("document", "section_index", F.col("s.title").alias("section_title"), F.posexplode(segment.chunked("s.text")).alias("part_index", "text"))
    return chunks.select(F.xxhash64("document", "section_index", "part_index").alias("chunk_ord"), "document", "section_title", "text")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append chunks and postings of new files under ``out``. A batch that is repeated replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        postings_table(batch).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        batch.unpersist()

    writer = chunk_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def document_frequencies(spark: SparkSession, out: str) -> DataFrame:
    """Document frequencies over all batches so far."""
    return term_table(spark.read.parquet(f"{out}/postings"))
