"""The acceptance corpus, its cases and gates, and reasons for failures."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import token_estimate
from stratum.operators.index import Corpus
from stratum.plans.config import Limits
from stratum.plans.engine import Answer, Engine
from stratum.plans.models import Model, extractive_model
from stratum.sources.files import text_source

WINDOW = 65_536
# Codes of failures with the stage that they belong to, whether another try can help, and what they say.
FAILURES = {
    "expected_terms_missing": ("Finalizer", True, "回答里没有这些预期内容：{}"),
    "citations_missing": ("Evidence", True, "结果没有引用"),
    "missing_task_findings": ("Specialists", True, "这些任务没有结果：{}"),
    "hard_policy_violations": ("Validator / 硬校验", False, "违反规则：{}"),
    "validator_invalid_json": ("Validator / 语义校验", True, "验证者没有给出有效 JSON{}"),
    "validator_missing_tasks": ("Validator / 语义校验", True, "验证者认为有任务缺少结论{}"),
    "validator_contradictions": ("Validator / 语义校验", False, "验证者发现矛盾{}"),
    "validator_semantic_rejected": ("Validator / 语义校验", False, "验证者没有通过语义检查{}"),
    "validator_rejected_unknown": ("Validator", False, "验证者没有通过，也没有说明原因"),
}
HARD_FAILURES = {
    "unique_task_ids": "任务编号为空或重复", "all_tasks_have_findings": "有任务没有结论或证据", "artifacts_and_evidence_valid": "结论或证据的记录无效",
    "reducer_evidence_closed": "归并用了没有给出的证据", "all_calls_within_context_limit": "有调用超出上下文预算",
}
GATES = ("document_over_window", "calls_under_window", "specialist_isolation", "supervisor_no_raw", "validator_approved", "cases_and_citations")


def generated(spark: SparkSession, sections: int, needles: dict[int, str], title: str, intro: str, paragraphs: list[str]) -> DataFrame:
    """A long Markdown text (document, text) of numbered sections from templates; ``{n}`` stands for the number.

    ``needles`` adds a paragraph to some sections.
    """
    rows = spark.range(1, sections + 1).select(F.col("id").cast("int").alias("n"))
    extra = spark.createDataFrame(list(needles.items()) or [(0, "")], "n int, needle string")
    number = F.format_string("%04d", "n")
    body = F.concat_ws("\n\n", *[F.replace(F.lit(p), F.lit("{n}"), number) for p in paragraphs], "needle")
    joined = rows.join(F.broadcast(extra), "n", "left").select("n", body.alias("body"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n\n")
    return joined.agg(text.alias("t")).select(F.lit("generated.md").alias("document"), F.concat(F.lit(f"# {title}\n\n{intro}\n\n"), "t", F.lit("\n")).alias("text"))


def reasons(answer: Answer, missing_terms: list[str]) -> list[dict]:
    """Stable codes for everything that failed, in the order of the checks, each with stage, message and whether to retry."""
    hard, semantic = answer.validation.get("hard_checks", {}), answer.validation.get("semantic_checks", {})
    out = []

    def add(code: str, detail: str = "") -> None:
        stage, retry, says = FAILURES.get(code, ("Validator / 语义校验", False, code + "{}"))
        out.append({"code": code, "stage": stage, "message": says.format(detail), "retryable": retry})

    if missing_terms:
        add("expected_terms_missing", "、".join(missing_terms))
    if not answer.citations:
        add("citations_missing")
    for name, passed in hard.get("checks", {}).items():
        if not passed:
            out.append({"code": f"hard_check_{name}", "stage": "Validator / 硬校验", "message": HARD_FAILURES.get(name, name), "retryable": name == "all_tasks_have_findings"})
    for code, found in (("missing_task_findings", hard.get("missing_task_ids")), ("hard_policy_violations", hard.get("violations"))):
        if found:
            add(code, ", ".join(map(str, found)))
    if not semantic.get("passed", False):
        said = [("缺少任务", ", ".join(semantic.get("missing_task_ids") or [])), ("矛盾", "；".join(semantic.get("contradictions") or [])), ("说明", str(semantic.get("notes") or "").strip())]
        detail = "".join(f"；{k}：{v}" for k, v in said if v)
        for code in semantic.get("failure_codes") or ["validator_semantic_rejected"]:
            add(code, detail)
    if not out and not answer.validation.get("approved", False):
        add("validator_rejected_unknown")
    return out


def failure_summary(results: list[dict]) -> dict:
    """How many cases failed, and of each the first reason and the number of all."""
    failed = [{"id": r["id"], "primary_reason": r["reasons"][0] if r["reasons"] else None, "reason_count": len(r["reasons"])} for r in results if not r["passed"]]
    return {"failed_case_count": len(failed), "failed_cases": failed}


def accounting(answers: list[Answer]) -> dict[str, dict]:
    """Calls and the largest prompt of each role over several answers, the largest first."""
    roles: dict[str, dict] = {}
    for answer in answers:
        for role, own in answer.metrics["by_role"].items():
            sum_ = roles.setdefault(role, {"calls": 0, "max_prompt_tokens": 0})
            sum_["calls"] += own["calls"]
            sum_["max_prompt_tokens"] = max(sum_["max_prompt_tokens"], own["max_prompt_tokens"])
    return dict(sorted(roles.items(), key=lambda r: -r[1]["max_prompt_tokens"]))


def run(spark: SparkSession, text: str, cases: list[dict], model: Model = extractive_model, limits: Limits | None = None, name: str = "document.md") -> dict:
    """A report on cases (id, question, expected_terms) over one index: each passes if no term is missing, something is
    cited and the answer is approved; six gates judge the whole."""
    began = time.perf_counter()
    limits = limits or Limits()
    sources = text_source(spark, text, name)
    size = sources.select(token_estimate("text").alias("tokens"), F.octet_length("text").alias("bytes")).collect()[0]
    corpus = Corpus.build(sources)
    results, n_chunks = [], corpus.n_chunks
    try:
        engine = Engine(corpus, model, limits)
        for case, answer in zip(cases, engine.answers([c["question"] for c in cases]), strict=True):
            missing = [t for t in case["expected_terms"] if t not in answer.answer]
            passed = not missing and bool(answer.citations) and answer.validation["approved"]
            results.append({"id": case["id"], "question": case["question"], "passed": passed, "missing": missing, "answer": answer, "reasons": [] if passed else reasons(answer, missing)})
    finally:
        corpus.release()
    each = [r["answer"] for r in results]
    most = max((a.metrics["max_prompt_tokens"] for a in each), default=0)
    n_passed, within = sum(r["passed"] for r in results), all(a.metrics["within_limit"] for a in each)
    outcome = (
        (size.tokens > WINDOW, f"{size.tokens} tokens"),
        (within, f"{most} tokens at most"),
        (all(a.metrics["isolated_specialists"] for a in each), "each call shows its own task's evidence"),
        (not any(a.metrics["supervisor_saw_evidence"] for a in each), "the supervisor is shown no evidence"),
        (all(a.validation["approved"] for a in each), f"{sum(a.validation['approved'] for a in each)} / {len(each)}"),
        (n_passed == len(results) and all(a.citations for a in each), f"{n_passed} / {len(results)}"),
    )
    gates = {k: passed for k, (passed, _) in zip(GATES, outcome, strict=True)}
    proof = {"logical_document_tokens": size.tokens, "physical_context_limit_tokens": limits.context_limit, "max_prompt_tokens": most, "all_calls_within_limit": within, "passed_cases": n_passed, "total_cases": len(results), "divide_and_conquer_verified": gates["document_over_window"] and within and n_passed == len(results)}
    return {
        "cases": results, "gates": gates, "assertions": [{"id": k, "passed": passed, "actual": actual} for k, (passed, actual) in zip(GATES, outcome, strict=True)], "passed": n_passed, "total": len(results), "ok": all(gates.values()),
        "failure_summary": failure_summary(results), "accounting": accounting(each), "context_proof": proof, "duration_ms": round((time.perf_counter() - began) * 1000),
        "document_stats": {"document": name, "bytes": size.bytes, "estimated_tokens": size.tokens, "chunks": n_chunks, "exceeds_window": size.tokens > WINDOW},
        "configuration": {"max_workers": limits.max_workers, "fan_in": limits.fan_in, "max_replans": limits.max_replans, "context_limit_tokens": limits.context_limit},
    }
