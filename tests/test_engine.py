import json

import pytest

from stratum.operators.index import Corpus
from stratum.plans import acceptance, reduction
from stratum.plans.config import Limits
from stratum.plans.engine import BudgetError, Engine, RoutingError, content_key, first_object
from stratum.plans.models import ModelError, Reply, chat_model, extractive_model
from stratum.sources.files import text_source

FACTS = {"项目代号": "青峦-7429", "验收口令": "银杏-5813", "归档校验值": "HF-90617-Z"}


@pytest.fixture(scope="module")
def corpus_text(spark):
    needles = {5: "本文的项目代号是青峦-7429。", 60: "中期验收口令是银杏-5813。", 110: "最终归档校验值是 HF-90617-Z。"}
    paragraphs = ["## 第 {n} 节 常规记录", "记录编号 R-{n}，本节说明背景与流程。" * 40, "结论：按计划执行，编号 {n}。"]
    return acceptance.generated(spark, 120, needles, "长文档", "背景与目标说明。", paragraphs).collect()[0].text


@pytest.fixture(scope="module")
def engine(spark, corpus_text):
    return Engine(Corpus.build(text_source(spark, corpus_text)))


def test_corpus_has_a_section_for_each_heading(engine):
    assert engine.totals.parent_sections == 121 and engine.corpus.n_chunks >= 121


def test_a_fact_is_found_and_cited(engine):
    answer = engine.answer("项目代号是什么？")
    assert FACTS["项目代号"] in answer.answer and answer.stop_reason == "validated" and answer.citations
    assert len(answer.findings) == len(answer.tasks) == answer.metrics["allocated_agents"]
    assert answer.metrics["max_prompt_tokens"] < 16_000
    ranges = [(t["chunk_start"], t["chunk_end"]) for t in answer.tasks]
    assert ranges[0][0] == 0 and ranges[-1][1] == engine.corpus.n_chunks and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert all(f["artifact_id"].startswith("finding_") and all(i.startswith("evidence_") for i in f["evidence_ids"]) for f in answer.findings)


def test_all_facts_survive_a_narrow_tree(spark, corpus_text):
    case = [{"id": "all", "question": "同时给出项目代号、验收口令以及归档校验值", "expected_terms": list(FACTS.values())}]
    report = acceptance.run(spark, corpus_text, case, limits=Limits(fan_in=2))
    result = report["cases"][0]
    assert result["passed"], result["reasons"]
    assert result["answer"].metrics["reducer_levels"] >= 2
    assert all(on for name, on in report["gates"].items() if name != "document_over_window")
    assert list(report["gates"]) == list(acceptance.GATES) and report["failure_summary"]["failed_case_count"] == 0
    assert report["context_proof"]["passed_cases"] == 1 and list(report["accounting"].values())[0]["max_prompt_tokens"] == report["context_proof"]["max_prompt_tokens"]


def test_bad_json_is_repaired_once(engine, spark):
    asked = []

    def model(role, messages):
        asked.append(role)
        return "not-json" if role == "fact_extractor" and asked.count(role) == 1 else extractive_model(role, messages)

    answer = Engine(engine.corpus, model).answer("项目代号是什么？")
    assert answer.validation["approved"] and asked.count("fact_extractor") == answer.metrics["allocated_agents"] + 1
    assert answer.metrics["json_retries"] == 1


def test_repair_names_keys_and_shows_the_former_answer(engine):
    prompts = []

    def model(role, messages):
        if role == "reducer":
            prompts.append(messages[-1]["content"])
            if len(prompts) == 1:
                return "no json at all " + "z" * 3000
        return extractive_model(role, messages)

    Engine(engine.corpus, model).answer("项目代号是什么？")
    assert prompts[1].startswith(prompts[0]) and "summary、evidence_ids" in prompts[1] and "no json at all" in prompts[1] and prompts[1].count("z") < 1000


def test_metrics_account_for_every_call(engine):
    answer = Engine(engine.corpus, lambda r, m: Reply(extractive_model(r, m), 7 if r == "reducer" else None), threads=4).answer("同时给出项目代号以及验收口令", "用户：前面说到项目")
    m = answer.metrics
    assert m["calls"] == len(answer.calls) == sum(r["calls"] for r in m["by_role"].values()) and m["by_role"]["reducer"]["max_prompt_tokens"] == 7
    assert {c["source"] for c in answer.calls if c["role"] == "reducer"} == {"api"} and {c["source"] for c in answer.calls if c["role"] != "reducer"} == {"estimate"}
    assert sum(m["specialist_counts"].values()) == m["task_count"] == len(answer.tasks) and m["planning_source"] == "model_supervisor"
    assert m["isolated_specialists"] and not m["supervisor_saw_evidence"] and m["memory"]["enabled"] and m["retrieval_strategies"]


def test_calls_as_a_table(engine):
    own = Engine(engine.corpus)
    m = own.answer("项目代号是什么？").metrics
    by_role = {r.role: (r.calls, r.max_prompt_tokens) for r in reduction.calls_by_role(own.call_table()).collect()}
    assert by_role == {k: (v["calls"], v["max_prompt_tokens"]) for k, v in m["by_role"].items()}
    kinds = [a["kind"] for a in own.describe()]
    assert {"evidence", "finding", "reduction"} <= set(kinds)


def test_memory_reaches_the_supervisor(engine):
    shown = []

    def model(role, messages):
        if role == "supervisor":
            shown.append(messages[-1]["content"])
        return extractive_model(role, messages)

    Engine(engine.corpus, model).answer("同时说明它的代号以及口令", "用户：项目")
    assert "用户：项目" in shown[0]


def test_a_task_of_another_role_is_refused(engine):
    with pytest.raises(RoutingError):
        engine._specialist({"task_id": "task_01", "agent_type": "analyst"}, "comparator", [], "")


@pytest.mark.parametrize(("answer", "value"), [('x {"a": 1} y', {"a": 1}), ('```json\n{"a": 2}\n```', {"a": 2}), ('```json\n{"a": }\n``` {"b": 1}', None), ("[1]", None), ("", None), ('{"a": {"b": 1}}', {"a": {"b": 1}})])
def test_first_object(answer, value):
    assert first_object(answer) == value


def test_content_keys_are_those_of_tables(spark):
    from pyspark.sql import functions as F

    from stratum.functions.text import content_id

    assert spark.range(1).select(content_id(F.lit("finding"), F.lit("文 x"))).collect()[0][0] == content_key("finding", "文 x")


def test_chat_model_speaks_to_an_endpoint():
    seen = []

    def fetch(url, headers, body, timeout):
        seen.append((url, headers, json.loads(body)))
        return 200, json.dumps({"choices": [{"message": {"content": " hi "}}], "usage": {"prompt_tokens": 12}}).encode()

    reply = chat_model("http://x/v1/", "sk-abc", "m", fetch=fetch)("general", [{"role": "user", "content": "q"}])
    assert reply == Reply("hi", 12, None) and seen[0][0] == "http://x/v1/chat/completions" and seen[0][2]["messages"][0]["content"] == "q"
    for status, body, says in ((401, b'{"error": {"message": "bad key sk-abc"}}', "[redacted]"), (200, b"{}", "no chat completion"), (200, b'{"choices": [{"message": {"content": " "}}]}', "empty")):
        with pytest.raises(ModelError) as e:
            chat_model("http://x", "sk-abc", "m", fetch=lambda *a, s=status, b=body: (s, b))("general", [])
        assert says in str(e.value) and "sk-abc" not in str(e.value)


def test_rejection_is_retried_within_bounds_and_labelled(engine):
    def model(role, messages):
        if role == "validator":
            return json.dumps({"semantic_pass": False, "missing_task_ids": ["task_01", "task_99"], "contradictions": [], "notes": "n"})
        return extractive_model(role, messages)

    answer = Engine(engine.corpus, model, Limits(max_replans=1)).answer("项目代号是什么？")
    assert answer.stop_reason == "validation_failed_closed" and answer.metrics["replans"] == 1
    found = acceptance.reasons(answer, [])
    assert [r["code"] for r in found] == ["validator_missing_tasks"] and "task_01" in found[0]["message"] and found[0]["retryable"]
    codes = [r["code"] for r in acceptance.reasons(answer, ["x"])]
    assert acceptance.failure_summary([{"id": "c", "passed": False, "reasons": acceptance.reasons(answer, ["x"])}, {"id": "d", "passed": True, "reasons": []}])["failed_cases"] == [{"id": "c", "primary_reason": acceptance.reasons(answer, ["x"])[0], "reason_count": len(codes)}]


def test_oversized_questions_are_refused(engine):
    with pytest.raises(BudgetError):
        engine.answer("同时分析问题" * 4000)


def test_small_text_still_gets_the_default_workers(spark):
    answer = Engine(Corpus.build(text_source(spark, "项目代号是青峦-7429。"))).answer("项目代号是什么？")
    assert answer.metrics["allocated_agents"] == 3 and answer.validation["approved"]


def test_limits_are_checked():
    assert Limits(max_workers=2).default_agents == 2
    for bad in ({"fan_in": 1}, {"max_workers": 33}, {"context_limit": 10}, {"max_replans": 4}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_tree_groups_are_consecutive(spark):
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(10)], "position int, summary string")
    groups = {r.group_no: [m.summary for m in r.members] for r in reduction.grouped(rows, 4).collect()}
    assert groups == {0: ["s0", "s1", "s2", "s3"], 1: ["s4", "s5", "s6", "s7"], 2: ["s8", "s9"]}


def test_tree_is_reduced_to_one_row(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, [f"s{i}"]) for i in range(23)], "position bigint, value array<string>")
    got = reduction.reduced(rows, 4, F.flatten).collect()
    assert len(got) == 1 and got[0].value == [f"s{i}" for i in range(23)]
