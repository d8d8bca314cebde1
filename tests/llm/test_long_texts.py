"""Texts of a megabyte and more, read whole by every operator on documents."""

import hashlib
import random
import re

import pytest

from stratum.llm import decontaminate, mixing, neardup, quality, suffix_dedup, toxicity

SHAPE = "doc_id bigint, text string, source string"


def vocabulary(seed, n=4000):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def long():
    r = random.Random(1)
    words = r.choices(vocabulary(2), k=200_000)
    assert len(" ".join(words)) > 1_200_000
    return words


@pytest.fixture(scope="module")
def docs(spark, long):
    r = random.Random(3)
    changed = list(long)
    for _ in range(2_000):  # a word in a hundred: some 94 of 100 shingles of three stay
        changed[r.randrange(len(changed))] = "changed" + str(r.randrange(10**6))
    rows = [(i, " ".join(r.choices(vocabulary(4), k=60)), "small") for i in range(10, 40)]
    return spark.createDataFrame([(1, " ".join(long), "big"), (2, " ".join(changed), "big"), (3, "x" * 1_500_000, None), *rows], SHAPE).repartition(4)


def shingles(words, k=3):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_near_duplicates_of_long_texts(docs, long):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    assert got[1].n_shingles == len(shingles(long)) and got[3].n_shingles == 1


def test_contamination_deep_in_a_long_text(spark, docs, long):
    items = spark.createDataFrame([(7, " ".join(long[150_000:150_030])), (8, " ".join(long[-20:])), (9, "not in there")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (200_000, 50, 2, False)
    assert got[1].items_sha256 == hashlib.sha256(b"7,8").hexdigest() and got[3].n_words == 1


def test_sizes_of_long_texts_are_mixed(docs):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert (got[1].size, got[2].size, got[3].size) == (200_000, 200_000, 1) and all(r.taken <= 3 * r.size for r in got.values())
    assert sum(r.taken for r in got.values()) > 0.9 * sum(r.size for r in got.values())


def test_passages_deep_in_a_long_text_are_cut(spark, docs, long):
    text = " ".join(long)
    passage = text[1_000_000:1_000_700]
    only = docs.where("doc_id IN (1, 3)").unionByName(spark.createDataFrame([(50, "front " + passage + " back", "s")], SHAPE))
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(only).collect()}
    assert bytes(got[1].kept) == text.encode()  # no two places of it are alike
    assert bytes(got[3].kept) == b"x"  # each string of a run of one letter also starts one byte earlier, but the first
    assert len(got[50].kept) <= len("front  back") and re.fullmatch(rb"front.? ?back", bytes(got[50].kept).replace(b"  ", b" "))


def test_long_texts_are_scored_whole(spark, docs):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, i % 2) for i in range(10, 40)], "doc_id bigint, quality int, toxic int")
    weights = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert set(weights) == {1, 2, 3, *range(10, 40)}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert set(scores) == set(weights) and all(0 <= s <= 1 for s in scores.values())
