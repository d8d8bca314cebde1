"""The long acceptance text, built from its template: sizes, sections, ranks and the four cases."""

import pytest

from stratum.operators import search
from stratum.operators.index import Corpus
from stratum.plans import acceptance, routing
from stratum.sources.files import text_source

# The template, its planted facts, the cases, and what must come out.
TITLE, INTRO = "企业项目调研长上下文测试文档", "本文档用于验证多 Agent 分治与上下文隔离。大部分内容为确定性填充记录，少量关键信息分布在开头、中部和末部。"
PARAGRAPHS = [
    "## 第 {n} 节 常规项目调研记录",
    "本节记录编号为 R-{n}，用于构造稳定、可重复的企业调研语料。常规内容包括流程责任、会议安排、风险等级、数据范围、审批状态和后续行动。",
    "调研人员应记录来源、更新时间和责任部门，并在引用结论前回到原始材料核验。本节中的普通序号 {n} 不代表业务结论。",
    "如果资料之间存在冲突，应保留各方原文并标记冲突，不得通过摘要擅自覆盖较早记录。",
]
NEEDLES = {
    55: "【测试针 ALPHA】项目代号：青峦-7429。该代号是本次长上下文测试的唯一有效项目代号。",
    550: "【测试针 BETA】中期验收口令：银杏-5813。任何其他口令都是无效填充内容。",
    1045: "【测试针 GAMMA】最终归档校验值：HF-90617-Z。该值用于确认文档末部信息被成功检索。",
}
CASES = [
    ("needle_beginning", "本次长上下文测试的唯一有效项目代号是什么？", ["青峦-7429"]),
    ("needle_middle", "中期验收口令是什么？", ["银杏-5813"]),
    ("needle_end", "用于确认文档末部信息的最终归档校验值是什么？", ["HF-90617-Z"]),
    ("multi_hop_all_positions", "请同时给出唯一有效项目代号、中期验收口令和最终归档校验值。", ["青峦-7429", "银杏-5813", "HF-90617-Z"]),
]
TOP = {
    "项目代号": [(55, 15.278689), (1, 6.082949), (2, 6.031746)],
    "验收口令": [(550, 15.278689), (1, 3.746832), (2, 3.697192)],
    "归档校验值": [(1045, 15.278689), (0, 4.114695), (1, 3.594246)],
    "本次长上下文测试的唯一有效项目代号是什么？": [(55, 6.868432), (0, 4.764268), (550, 4.507937)],
    "中期验收口令是什么？": [(550, 6.102218), (55, 3.931689), (1, 3.596351)],
    "R-0042": [(42, 15.278689)],
    "HF-90617-Z": [(1045, 15.278689)],
}
SHARDS = [(0, 137), (137, 275), (275, 412), (412, 550), (550, 688), (688, 825), (825, 963), (963, 1101)]


@pytest.fixture(scope="module")
def text(spark):
    return acceptance.generated(spark, 1100, NEEDLES, TITLE, INTRO, PARAGRAPHS).collect()[0].text


@pytest.fixture(scope="module")
def corpus(spark, text):
    return Corpus.build(text_source(spark, text))


def test_sizes(corpus, text):
    assert (len(text.encode()), len(text)) == (572_535, 213_615)
    totals = corpus.totals().collect()[0]
    assert (totals.parent_sections, totals.raw_chunks) == (1101, 1101)
    assert corpus.terms.count() == 2_622 and corpus.sections.agg({"estimated_tokens": "max"}).collect()[0][0] == 196
    assert abs(corpus.stats.agg({"length": "avg"}).collect()[0][0] - 297.9909173) < 1e-6


def test_best_chunks(spark, corpus):
    queries = spark.createDataFrame(list(enumerate(TOP)), "query_id int, query string")
    got = {}
    for r in search.hybrid(corpus, queries, 3).orderBy("query_id", "rank").collect():
        got.setdefault(list(TOP)[r.query_id], []).append((r.chunk_ord, round(r.score, 6)))
    assert got == TOP


def test_ranges_of_shards(spark, corpus):
    rows = routing.slots(spark.createDataFrame([(8,)], "allocated_agents int"), corpus.n_chunks).orderBy("slot").collect()
    assert [(r.chunk_start, r.chunk_end) for r in rows] == SHARDS


def test_all_cases_and_gates_pass(spark, text):
    report = acceptance.run(spark, text, [{"id": i, "question": q, "expected_terms": t} for i, q, t in CASES], name="long.md")
    assert [r["passed"] for r in report["cases"]] == [True] * 4, [r["reasons"] for r in report["cases"]]
    assert report["ok"] and [a["id"] for a in report["assertions"]] == list(acceptance.GATES)
    assert report["document_stats"] == {"document": "long.md", "bytes": 572_535, "estimated_tokens": 177_420, "chunks": 1101, "exceeds_window": True}
    assert report["context_proof"]["divide_and_conquer_verified"] and report["context_proof"]["max_prompt_tokens"] < 16_000


def test_one_retrieval_serves_all_cases(spark, monkeypatch):
    from stratum.operators import evidence
    from stratum.operators.index import Corpus
    from stratum.plans.engine import Engine
    from stratum.sources.files import text_source

    made = []
    whole = evidence.retrieve
    monkeypatch.setattr(evidence, "retrieve", lambda *args: made.append(1) or whole(*args))
    corpus = Corpus.build(text_source(spark, "\n\n".join(f"## 第{i}节\n\n第{i}节的项目代号是 CODE-{i:02d}。" for i in range(8)), "a.md"))
    questions = ["第3节的项目代号是什么？", "第5节的项目代号是什么？", "列出所有项目代号"]
    alone = [Engine(corpus).answer(q) for q in questions]
    n, made[:] = len(made), []
    together = Engine(corpus).answers(questions)
    assert n == 3 and len(made) == 1
    for a, b in zip(alone, together, strict=True):
        assert (a.answer, a.citations, a.tasks, a.findings, a.validation, a.metrics, a.calls) == (b.answer, b.citations, b.tasks, b.findings, b.validation, b.metrics, b.calls)
    assert Engine(corpus).answers([]) == []
    corpus.release()
