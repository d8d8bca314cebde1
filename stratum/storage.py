"""Tables in the folder that driver and executors share: computed once, read by plans that know nothing of how."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local run gets a folder of its own, removed at exit."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="stratum-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own. Unlike a cached plan it survives lost executors and keeps later plans short."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables made by ``stored``; others are left alone."""
    for table in tables:
        if at := getattr(table, "_stored_at", None):
            removed_path(table.sparkSession, at)


def removed_path(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
