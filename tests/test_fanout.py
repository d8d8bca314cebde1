"""Model calls on executors: each made once, failed ones again, answers from the ledger."""

import os

import pytest
from pyspark.sql import functions as F

from stratum.operators.index import Corpus
from stratum.plans import fanout
from stratum.plans.engine import Engine
from stratum.plans.fanout import Call
from stratum.plans.models import ModelError, extractive_model
from stratum.sources.files import text_source


def counting(folder, failing=""):
    """A model that leaves a file for each call; the first call about ``failing`` fails."""

    def model(role, messages):
        said = messages[-1]["content"]
        mark = os.path.join(folder, f"{abs(hash(said)) % 10**12}-{os.urandom(4).hex()}")
        open(mark, "w").write(said)
        if failing and failing in said and sum(open(os.path.join(folder, f)).read() == said for f in os.listdir(folder)) == 1:
            raise RuntimeError("lost")
        return f"{role}: {said}"

    return model


def calls(n):
    return [Call.of("analyst", [{"role": "system", "content": "s"}, {"role": "user", "content": f"question {i}"}], i + 1) for i in range(n)]


def test_each_call_is_made_once_and_failed_ones_again(spark, tmp_path):
    made, ledger = tmp_path / "made", str(tmp_path / "ledger")
    made.mkdir()
    model = counting(str(made), "question 3")
    got = fanout.answered(spark, fanout.call_table(spark, calls(6) + calls(2)), model, ledger).collect()
    assert sorted(r.answer for r in got) == [f"analyst: question {i}" for i in range(6)] and all(r.error is None for r in got)
    asked = sorted(p.read_text() for p in made.iterdir())
    assert asked == sorted([f"question {i}" for i in range(6)] + ["question 3"])
    again = fanout.answered(spark, fanout.call_table(spark, calls(8)), model, ledger).count()
    assert again == 8 and len(list(made.iterdir())) == 9


def test_a_call_that_always_fails_has_its_error(spark, tmp_path):
    def model(role, messages):
        if "question 1" in messages[-1]["content"]:
            raise ValueError("no")
        return "yes"

    got = {r.key: r for r in fanout.answered(spark, fanout.call_table(spark, calls(3)), model, str(tmp_path / "l"), rounds=2).collect()}
    assert [got[c.key].answer for c in calls(3)] == ["yes", None, "yes"] and got[calls(3)[1].key].error == "ValueError: no"
    with pytest.raises(ModelError, match="ValueError"):
        fanout.Dealer(spark, model, str(tmp_path / "m")).make(calls(2))


def test_calls_are_dealt_by_weight(spark):
    table = fanout.call_table(spark, calls(20))
    assert sorted(r.slot for r in fanout.dealt(table, 20).collect()) == list(range(20))
    load = {r.slot: r.w for r in fanout.dealt(table, 4).groupBy("slot").agg(F.sum("weight").alias("w")).collect()}
    assert set(load) == {0, 1, 2, 3} and max(load.values()) <= 210 / 4 + 20


def test_an_answer_from_executors_is_that_of_the_driver(spark, tmp_path):
    text = "\n\n".join(f"## 第{i}节\n\n第{i}节的项目代号是 CODE-{i:02d}。" for i in range(12))
    corpus = Corpus.build(text_source(spark, text, "a.md"))
    question = "第7节的项目代号是什么？"
    plain = Engine(corpus, extractive_model).answer(question)
    ledger = str(tmp_path / "ledger")
    for _ in range(2):
        dealt = Engine(corpus, extractive_model, ledger=ledger).answer(question)
        assert (dealt.answer, dealt.citations, dealt.findings) == (plain.answer, plain.citations, plain.findings)
        n = spark.read.parquet(ledger).count()
        assert n == len({f["task_id"] for f in plain.findings}) == spark.read.parquet(ledger).select("key").distinct().count()
    corpus.release()
