"""Model calls on executors, with a ledger of their answers.

Calls are dealt to tasks by weight, heavy ones first, one to a task while there are no more calls than tasks may be.
What a call's task gives is its answer or its error. Both are appended to the ledger, a table in which a call is known
by the hash of role and messages; calls that it answers aren't made again, whether in another round, after a restart or
for another question. A call that fails doesn't fail the job, so answers of others are never lost with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.plans.models import Model, ModelError, Reply

#: Tasks of one round, at most; rounds for calls that fail.
MOST_TASKS, ROUNDS = 10_000, 3
CALLS = "key string, role string, messages string, weight bigint"
ANSWERS = "key string, role string, answer string, prompt_tokens int, error string"


@dataclass(frozen=True)
class Call:
    role: str
    messages: tuple[tuple[str, str], ...]
    weight: int = 1

    @staticmethod
    def of(role: str, messages: list[dict[str, str]], weight: int = 1) -> Call:
        return Call(role, tuple((m["role"], m["content"]) for m in messages), weight)

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.role, self.messages], ensure_ascii=False).encode()).hexdigest()


def call_table(spark: SparkSession, calls: list[Call]) -> DataFrame:
    return spark.createDataFrame([(c.key, c.role, json.dumps(c.messages, ensure_ascii=False), c.weight) for c in calls], CALLS)


def dealt(calls: DataFrame, slots: int) -> DataFrame:
    """``calls`` (key, weight) plus slot: in the order of falling weight, a slot takes calls until it has its share of the
    whole weight. With as many slots as calls, each has one."""
    order = W.orderBy(F.col("weight").desc(), "key")
    if calls.count() <= slots:
        return calls.withColumn("slot", F.row_number().over(order) - 1)
    share = F.sum("weight").over(W.partitionBy()) / slots
    before = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1))
    return calls.withColumn("slot", F.least(F.lit(slots - 1), F.floor(F.coalesce(before, F.lit(0)) / share)).cast("int"))


def answered(spark: SparkSession, calls: DataFrame, model: Model, ledger: str, rounds: int = ROUNDS, tasks: int = MOST_TASKS) -> DataFrame:
    """The ledger's answers (key, role, answer, prompt_tokens, error) to ``calls`` (key, role, messages, weight), after
    making those that it lacks. A call that failed in every round has its last error and no answer."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for call in batch.to_pylist():
                answer, tokens, error = None, None, None
                try:
                    said = model(call["role"], [{"role": r, "content": c} for r, c in json.loads(call["messages"])])
                    reply = said if isinstance(said, Reply) else Reply(said)
                    answer, tokens = reply.text, reply.prompt_tokens
                except Exception as e:  # noqa: BLE001 - whatever a model raises is that call's outcome
                    error = f"{type(e).__name__}: {e}"[:500]
                row = (call["key"], call["role"], answer, tokens, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["key", "role", "answer", "prompt_tokens", "error"])

    once = calls.dropDuplicates(["key"])
    for _ in range(rounds):
        known = _ledger(spark, ledger)
        pending = once if known is None else once.join(known.where("error IS NULL"), "key", "left_anti")
        n = pending.count()
        if n == 0:
            break
        slots = min(n, tasks)
        # One row a slot where there are as many; else hashes deal slots to tasks evenly enough.
        placed = dealt(pending, slots).repartitionByRange(slots, "slot").select("key", "role", "messages")
        placed.mapInArrow(made, ANSWERS).write.mode("append").parquet(ledger)
    known = _ledger(spark, ledger)
    if known is None:
        return spark.createDataFrame([], ANSWERS)
    best = F.max(F.struct(F.col("error").isNull().alias("good"), *[c.split()[0] for c in ANSWERS.split(", ")[1:]])).alias("best")
    return known.join(once.select("key"), "key", "left_semi").groupBy("key").agg(best).select("key", "best.role", "best.answer", "best.prompt_tokens", "best.error")


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException:  # no call was made yet
        return None


class Dealer:
    """Makes a round of calls on executors and then answers as a model does, from the ledger; what it lacks, as a
    request for better JSON, is asked of the model where it is needed."""

    def __init__(self, spark: SparkSession, model: Model, ledger: str):
        self.spark, self.model, self.ledger, self.replies = spark, model, ledger, {}

    def make(self, calls: list[Call]) -> None:
        for r in answered(self.spark, call_table(self.spark, calls), self.model, self.ledger).collect():  # one a call
            if r.error is None:
                self.replies[r.key] = Reply(r.answer, r.prompt_tokens)
            else:
                raise ModelError(f"{r.role}: {r.error}")

    def __call__(self, role: str, messages: list[dict[str, str]]) -> str | Reply:
        found = self.replies.get(Call.of(role, messages).key)
        return found if found is not None else self.model(role, messages)
