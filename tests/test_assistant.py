"""One entry for all that can be asked: general chat, reading as it is, research over the whole or over pages."""

import json

import pytest

from stratum.plans.assistant import Assistant, RequestError, compacted, stored_turns
from stratum.plans.models import extractive_model
from stratum.sources import web
from stratum.sources.files import text_source

PAGES = "\n\n".join(["前言。"] + [f"## 第 {n} 页\n\n这是第{n}页独有的内容：代码 P-{n:03d}。" for n in range(1, 21)])
RESULTS = [(1, "题目", "https://a.example/x", "网页说明代号是 WEB-77。"), (2, "另一", "https://b.example", "")]


@pytest.fixture(scope="module")
def assistant(spark):
    search = lambda q, n: spark.createDataFrame(RESULTS[:n], "position int, title string, url string, snippet string")
    return Assistant(spark, text_source(spark, PAGES, "pages.md"), live=lambda role, messages: json.dumps({"role": role, "n": len(messages)}) if role == "general" else extractive_model(role, messages), search=search)


def test_pages_are_read_as_they_are(assistant):
    got = assistant.ask("输出第 16-20 页的原文内容")
    assert got["answer"].startswith("## 第 16 页") and got["answer"].endswith("P-020。") and "P-015" not in got["answer"]
    assert got["stop_reason"] == "direct_page_read" and got["metrics"]["calls"] == 0 and got["validation"]["approved"]
    read = got["document_read"]
    assert PAGES[read["start_character"] : read["end_character"]].strip() == got["answer"] and (read["requested_start_page"], read["requested_end_page"]) == (16, 20)
    assert got["citations"][0]["chunk_id"] == "pages_16_20" and got["citations"][0]["section"] == "第 16–20 页"


def test_missing_and_wrong_pages_are_refused(assistant):
    with pytest.raises(RequestError, match="page 21 and others are not in the text; pages there: 1–20"):
        assistant.ask("输出第 19-22 页的原文内容")
    for question in ("读取第9至2页的内容", "输出第 1-200 页的内容"):
        with pytest.raises(RequestError):
            assistant.ask(question)


def test_the_text_is_read_window_by_window(spark):
    text = "第一行\n" + "长" * 20_000
    long = Assistant(spark, text_source(spark, text, "long.txt"))
    first = long.ask("请输出全文")
    assert first["stop_reason"] == "direct_document_read" and first["answer"] == text[:12_000] and first["document_read"]["has_more"]
    rest = long.ask("请输出全文", read_offset=first["document_read"]["next_offset"])
    assert first["answer"] + rest["answer"] == text and not rest["document_read"]["has_more"]
    assert rest["citations"][0]["section"] == f"原文字符 12001–{len(text)}"
    with pytest.raises(RequestError):
        long.ask("请输出全文", read_offset="x")


def test_research_keeps_to_the_pages_asked_about(assistant):
    got = assistant.ask("第 3 页讲了什么代码是什么？")
    assert got["page_scope"]["retrieval_restricted_to_requested_pages"] and "P-003" in got["answer"]
    assert all("第3-3页" in c["document"] for c in got["citations"]) and got["capacity_report"]["document_tokens_estimate"] > 0


def test_web_results_are_indexed_beside_the_document(assistant):
    got = assistant.ask("网页说明代号是什么？", mode="live", web_search=True)
    assert got["execution_mode"] == "live_multi_agent" and "WEB-77" in got["answer"] and [w["position"] for w in got["web_sources"]] == [1, 2]
    assert [c["artifact_id"] for c in got["citations"]][-2:] == ["web_search_01", "web_search_02"]
    with pytest.raises(RequestError):
        assistant.ask("网页说明代号是什么？", web_search=True)


def test_general_chat_has_a_bounded_memory(assistant, spark):
    history = [{"role": "user", "content": "问" * 7_000}, {"role": "assistant", "content": "答" * 7_000}, {"role": "tool", "content": "x"}, {"role": "user", "content": "后" * 7_000}, "junk"]
    got = assistant.ask("你好，介绍一下自己", mode="live", history=history)
    assert json.loads(got["answer"]) == {"role": "general", "n": 5} and got["stop_reason"] == "direct_llm_answer"
    assert got["metrics"]["max_prompt_tokens"] <= 24_000 and got["metrics"]["memory"]["messages"] == 3
    longer = assistant.ask("你好", mode="live", history=[{"role": "user", "content": "问" * 8_000}] * 6)
    assert json.loads(longer["answer"])["n"] == 4
    with pytest.raises(RequestError):
        assistant.ask("你好")
    with pytest.raises(RequestError):
        Assistant(spark).ask("项目代号是什么？", scope="document")


@pytest.mark.parametrize("bad", [{"question": " "}, {"question": "q", "mode": "x"}, {"question": "q", "scope": "x"}])
def test_bad_requests_are_refused(assistant, bad):
    with pytest.raises(RequestError):
        assistant.ask(**bad)


def test_search_dispatch(spark):
    body = json.dumps({"results": [{"title": "t", "url": "https://x", "content": "c"}, {"url": "ftp://y"}]})
    assert [tuple(r) for r in web.searcher(spark, json_fetch=lambda q: body)(" a  b ").collect()] == [(1, "t", "https://x", "c")]
    for search in (web.searcher(spark), web.searcher(spark, html_fetch=lambda q: "<html></html>")):
        with pytest.raises(web.SearchError):
            search("q")


def test_reports_and_inspection(assistant, spark):
    assert assistant.report()[0]["document"] == "pages.md" and not assistant.report()[0]["exceeds_window"]
    seen = assistant.inspect(text_source(spark, "# A\n\nx\n\n# B\n\ny", "i.md"))
    assert (seen["sections"], seen["chunks"], seen["bytes"]) == (2, 2, 14) and assistant.report()[0]["document"] == "pages.md"


def test_stored_results_are_bounded(spark):
    kept = compacted({"answer": "a" * 100_000, "tasks": [{"task_id": i, "objective": "o"} for i in range(50)], "citations": [{"excerpt": "e" * 2000}] * 60, "trace": [{"node": "n", "detail": "d" * 2000}] * 100})
    assert len(kept["answer"]) == 80_000 and (len(kept["tasks"]), len(kept["citations"]), len(kept["trace"])) == (32, 40, 80)
    assert len(kept["citations"][0]["excerpt"]) == 1_200 and len(kept["trace"][0]["detail"]) == 1_500 and "objective" not in kept["tasks"][0]
    turns = spark.createDataFrame([(1, t, "x" * 100) for t in range(40)] + [(2, 1, "y" * 900)], "conv_id int, turn int, body string")
    got = stored_turns(turns, 30, 550).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == [(1, t) for t in range(35, 40)] + [(2, 1)]
