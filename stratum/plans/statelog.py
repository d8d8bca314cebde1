"""The state of question runs as an append-only table, from which a run goes on where it stopped.

A row is what a run knew after one superstep: (run, seq, iteration, node, state). Rows are only ever added. Of a
superstep that was written twice, by a writer that was taken for dead, the states are equal up to the model, and the
one that sorts last counts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "run string, seq int, iteration int, node string, state string"


def latest(rows: DataFrame) -> DataFrame:
    """The last superstep of each run: (run, seq, iteration, node, state)."""
    last = F.max_by(F.struct("seq", "iteration", "node", "state"), F.struct("seq", "state")).alias("last")
    return rows.groupBy("run").agg(last).select("run", "last.*")


@dataclass(frozen=True)
class StateLog:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROWS).parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], ROWS)

    def append(self, run: str, seq: int, iteration: int, node: str, state: dict) -> None:
        row = (run, seq, iteration, node, json.dumps(state, ensure_ascii=False))
        self.spark.createDataFrame([row], ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def last(self, run: str) -> tuple[int, str, dict] | None:
        """seq, node and state of a run's last superstep."""
        found = latest(self.rows().where(F.col("run") == run)).collect()
        return (found[0].seq, found[0].node, json.loads(found[0].state)) if found else None
