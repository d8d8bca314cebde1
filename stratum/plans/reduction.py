"""Findings, their tree reduction, deterministic checks and call accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.plans.config import CONTEXT_LIMIT, OUTPUT_RESERVE, SAFETY_MARGIN, SPECIALISTS

CLAIMS, EVIDENCE, SUMMARY_CHARS = 8, 12, 1_500
CHECKS = ("unique_task_ids", "all_tasks_have_findings", "artifacts_and_evidence_valid", "reducer_evidence_closed", "all_calls_within_context_limit")


def latest(findings: DataFrame) -> DataFrame:
    """The last finding of each task, at the place of its first; those without a task id are dropped."""
    rest = [c for c in findings.columns if c != "task_id"]
    grouped = findings.where("task_id <> ''").groupBy("task_id").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct(*rest), "seq").alias("last"))
    return grouped.select("task_id", "first_seq", *[F.col(f"last.{c}").alias(c) for c in rest])


def ordered_ids(findings: DataFrame) -> DataFrame:
    """Evidence ids in the order of their first mention, once each: (position, artifact_id)."""
    mentioned = findings.select("first_seq", F.posexplode("evidence_ids").alias("at", "artifact_id"))
    once = mentioned.groupBy("artifact_id").agg(F.min(F.struct("first_seq", "at")).alias("place"))
    return once.select(F.row_number().over(W.orderBy("place")).alias("position"), "artifact_id")


def grouped(rows: DataFrame, fan_in: int) -> DataFrame:
    """One level of the tree: groups of ``fan_in`` consecutive rows (position, ...), in order; a last group may be smaller."""
    columns = [c for c in rows.columns if c != "position"]
    group = F.floor(F.col("position") / fan_in).cast("long")
    members = F.array_sort(F.collect_list(F.struct("position", *columns)))
    return rows.groupBy(group.alias("group_no")).agg(members.alias("members"))


def levels(rows: DataFrame, fan_in: int) -> DataFrame:
    """(level, n_nodes) of the tree over consecutive positions from 0, down to one node.

    The tree's depth is the logarithm of the rows, so the levels come from their number alone.
    """
    spark = rows.sparkSession
    n, out = rows.count(), []
    while True:
        out.append((len(out), n))
        if n <= 1:
            return spark.createDataFrame(out, "level int, n_nodes bigint")
        n = -(-n // fan_in)


def reduced(rows: DataFrame, fan_in: int, merge) -> DataFrame:
    """The tree as a whole: level by level, ``merge`` turns an array of members into their one result, down to one row.

    ``rows`` hold (position, value), positions from 0 on. Each level is a shuffle of a ``fan_in``-th of the one before.
    """
    current, n = rows, rows.count()
    while n > 1:
        current = grouped(current, fan_in).select(F.col("group_no").alias("position"), merge(F.transform("members", lambda m: m["value"])).alias("value"))
        n = -(-n // fan_in)
    return current


def role_counts(tasks: DataFrame, *by: str) -> DataFrame:
    """How many tasks each specialist has."""
    return tasks.groupBy(*by, F.coalesce("agent_type", F.lit("unknown")).alias("agent_type")).agg(F.count(F.lit(1)).alias("n_tasks"))


def missing_terms(answers: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, term) of the ``terms`` that the case's answer (case_id, answer) doesn't hold; without an answer, all."""
    met = terms.join(answers, "case_id", "left")
    return met.where(~F.coalesce(F.contains(F.col("answer"), F.col("term")), F.lit(False))).select("case_id", "term")


def failures(found: DataFrame) -> DataFrame:
    """(case_id, primary_reason, reason_count) of the reasons (case_id, seq, code) of cases that failed."""
    return found.groupBy("case_id").agg(F.min_by("code", "seq").alias("primary_reason"), F.count(F.lit(1)).alias("reason_count"))


def retried(tasks: DataFrame, retry: DataFrame) -> DataFrame:
    """The tasks whose ids are asked for again; ids of no task are ignored."""
    return tasks.join(retry.select("task_id"), "task_id", "left_semi")


def measured():
    """Prompt tokens of a call: the actual ones if they are known and not 0, else the estimate."""
    return F.coalesce(F.nullif("actual", F.lit(0)), F.col("estimated"))


def calls_by_role(calls: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    return calls.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.max(measured()).alias("max_prompt_tokens"), F.bool_and(measured() + OUTPUT_RESERVE + SAFETY_MARGIN <= limit).alias("within_limit"))


def call_totals(calls: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    most = F.coalesce(F.max(measured()), F.lit(0))
    return calls.agg(F.count(F.lit(1)).alias("calls"), most.alias("max_prompt_tokens"), F.coalesce(F.bool_and(measured() + OUTPUT_RESERVE + SAFETY_MARGIN <= limit), F.lit(True)).alias("within_limit"), F.round(most * 100.0 / limit, 2).alias("utilisation_percent"))


def hard_checks(tasks: DataFrame, findings: DataFrame, artifacts: DataFrame, reduced_ids: DataFrame, calls: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """One row: passed, checks (name to outcome), missing_task_ids, violations.

    ``findings`` are the latest of each task with their artifact_id; ``reduced_ids`` (artifact_id) what the reducer cites.
    """
    known = tasks.select("task_id")
    unknown = findings.join(known, "task_id", "left_anti").select(F.concat(F.lit("unknown_task:"), "task_id").alias("v"))
    own = findings.join(known, "task_id", "left_semi")
    mentioned = own.select("task_id", F.explode("evidence_ids").alias("artifact_id"))
    valid = artifacts.where("kind = 'evidence'").select("artifact_id")
    made = artifacts.where("kind = 'finding'").select("artifact_id")
    violations = (
        unknown.unionByName(own.where(~F.col("agent_type").isin(*SPECIALISTS)).select(F.concat(F.lit("invalid_agent_type:"), "task_id").alias("v")))
        .unionByName(own.where(F.trim(F.coalesce("summary", F.lit(""))) == "").select(F.concat(F.lit("empty_summary:"), "task_id").alias("v")))
        .unionByName(mentioned.join(valid, "artifact_id", "left_anti").select(F.concat(F.lit("invalid_evidence:"), "task_id").alias("v")))
        .unionByName(own.join(made, "artifact_id", "left_anti").select(F.concat(F.lit("invalid_finding_artifact:"), "task_id").alias("v")))
    )
    new_ids = reduced_ids.join(findings.select(F.explode("evidence_ids").alias("artifact_id")).distinct(), "artifact_id", "left_anti")
    missing = known.join(findings.select("task_id"), "task_id", "left_anti").unionByName(own.where(F.size("evidence_ids") == 0).select("task_id")).distinct()
    each = [
        violations.agg(F.array_sort(F.collect_list("v")).alias("found")),
        missing.agg(F.array_sort(F.collect_list("task_id")).alias("missing_task_ids")),
        new_ids.agg((F.count(F.lit(1)) == 0).alias("closed")),
        tasks.agg((F.count(F.lit(1)) == F.count_distinct("task_id")).alias("distinct_ids"), F.coalesce(F.bool_and(F.col("task_id") != ""), F.lit(True)).alias("named")),
        call_totals(calls, limit).select("within_limit"),
    ]
    row = each[0]
    for other in each[1:]:
        row = row.crossJoin(other)  # one row each
    listed = F.concat("found", F.when(~F.col("closed"), F.array(F.lit("reducer_introduced_unknown_evidence"))).otherwise(F.array().cast("array<string>")), F.when(~F.col("within_limit"), F.array(F.lit("context_budget_exceeded"))).otherwise(F.array().cast("array<string>")))
    row = row.withColumn("violations", listed)
    outcome = dict(zip(CHECKS, (F.col("distinct_ids") & F.col("named"), F.size("missing_task_ids") == 0, F.size("violations") == 0, F.col("closed"), F.col("within_limit")), strict=True))
    checks = F.create_map(*[x for name, passed in outcome.items() for x in (F.lit(name), passed)])
    return row.withColumn("checks", checks).select(F.forall(F.map_values("checks"), lambda x: x).alias("passed"), "checks", "missing_task_ids", "violations")


def projected(findings: DataFrame) -> DataFrame:
    """What validators and reducers are shown of a finding."""
    return findings.select("task_id", "agent_type", F.left("summary", F.lit(SUMMARY_CHARS)).alias("summary"), F.slice("claims", 1, CLAIMS).alias("claims"), F.slice("evidence_ids", 1, EVIDENCE).alias("evidence_ids"), "confidence", "artifact_id")
