"""Runs that stop after any superstep and go on from the log; artifacts by content."""

import json

import pytest

from stratum.operators.index import Corpus
from stratum.plans.artifacts import ArtifactStore
from stratum.plans.engine import Engine
from stratum.plans.models import extractive_model
from stratum.plans.statelog import StateLog
from stratum.sources.files import text_source


class Stop(Exception):
    pass


class Stopping(StateLog):
    """A log whose writer is lost right after each superstep."""

    def append(self, *row):
        super().append(*row)
        raise Stop


def impatient(role, messages):
    """Rejects the first validation, so that tasks are tried again."""
    if role == "validator":
        told = json.loads(messages[-1]["content"])
        first = told["hard_validation"] and not any("again" in f["summary"] for f in told["findings"])
        return json.dumps({"semantic_pass": not first, "missing_task_ids": [told["tasks"][0]["task_id"]] if first else [], "contradictions": [], "notes": ""})
    said = extractive_model(role, messages)
    if role not in ("supervisor", "reducer", "finalizer"):
        impatient.seen += 1
        if impatient.seen > impatient.first:
            return json.dumps(json.loads(said) | {"summary": "again " + json.loads(said)["summary"]})
    return said


@pytest.fixture(scope="module")
def corpus(spark):
    made = Corpus.build(text_source(spark, "\n\n".join(f"## 第{i}节\n\n第{i}节的项目代号是 CODE-{i:02d}。" for i in range(6)), "a.md"))
    yield made
    made.release()


@pytest.mark.parametrize("patient", [True, False])
def test_a_run_goes_on_after_each_superstep(spark, corpus, tmp_path, patient):
    question = "第3节的项目代号是什么？"
    model = extractive_model if patient else impatient
    impatient.seen, impatient.first = 0, 10**9
    if not patient:
        impatient.first = len(Engine(corpus, extractive_model).plan(question)[0])
    whole = Engine(corpus, model).answer(question)
    impatient.seen = 0
    path, stops = str(tmp_path / "log"), 0
    while True:
        try:
            got = Engine(corpus, model).answer(question, log=Stopping(spark, path))
            break
        except Stop:
            stops += 1
    assert stops == (5 if patient else 8)
    assert (got.answer, got.citations, got.findings, got.tasks, got.validation, got.metrics, got.calls, got.trace, got.stop_reason) == (whole.answer, whole.citations, whole.findings, whole.tasks, whole.validation, whole.metrics, whole.calls, whole.trace, whole.stop_reason)
    log = StateLog(spark, path)
    assert [r.node for r in log.rows().orderBy("seq").collect()][-2:] == ["validator", "finalizer"] and log.last("unknown") is None

    def silent(role, messages):
        raise AssertionError("a finished run asks nothing")

    assert Engine(corpus, silent).answer(question, log=log).answer == whole.answer


def test_artifacts_are_known_by_what_they_hold(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    shape = "kind string, content string, metadata map<string,string>"
    rows = [("evidence", "a", {"n": "1"}), ("evidence", "a", {"n": "0"}), ("finding", "a", None), ("evidence", None, None), ("evidence", "漢字", {})]
    ids = {(r.kind, r.content): r.artifact_id for r in store.put(spark.createDataFrame(rows, shape)).collect()}
    store.put(spark.createDataFrame([("evidence", "a", {"n": "9"}), ("evidence", "b", None)], shape))
    held = {r.artifact_id: r for r in store.describe().collect()}
    assert len(held) == 5 and held[ids["evidence", "a"]].metadata == {"n": "0"} and (held[ids["evidence", "漢字"]].characters, held[ids["evidence", "漢字"]].bytes) == (2, 6)
    asked = spark.createDataFrame([(ids["finding", "a"],), (ids["evidence", ""],), ("evidence_0000000000000000",)], "artifact_id string")
    assert sorted((r.kind, r.content) for r in store.get(asked).collect()) == [("evidence", ""), ("finding", "a")]
    assert [r.artifact_id for r in store.missing(asked).collect()] == ["evidence_0000000000000000"]
