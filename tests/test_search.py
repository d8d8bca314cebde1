"""Hybrid search through blocks and ranges against plain loops over all chunks."""

import math
import random
from collections import Counter

import pytest

from stratum.operators import index, search
from stratum.operators.index import Corpus


def plain_hybrid(chunks, queries, limit):
    """``chunks`` are (chunk_ord, words, text), ``queries`` (id, words, phrase)."""
    counts = {o: Counter(w) for o, w, _ in chunks}
    texts = {o: t for o, _, t in chunks}
    df = Counter(t for c in counts.values() for t in c)
    n, average = len(chunks), sum(len(w) for _, w, _ in chunks) / len(chunks)
    idf = lambda t: math.log((n + 1) / (df[t] + 1)) + 1
    out = []
    for query, words, phrase in queries:
        asked = Counter(words)
        norm = math.sqrt(sum(((1 + math.log(f)) * idf(t)) ** 2 for t, f in asked.items()))
        hits = {}
        for o, c in counts.items():
            met = [t for t in asked if t in c]
            if met:
                length = sum(c.values())
                b = sum(asked[t] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * max(1, length) / average)) for t in met)
                own = math.sqrt(sum(((1 + math.log(f)) * idf(t)) ** 2 for t, f in c.items()))
                hits[o] = (round(b, 9), round(sum((1 + math.log(asked[t])) * idf(t) * (1 + math.log(c[t])) * idf(t) for t in met) / (norm * own), 9), len(met) / len(asked))
        places = [{o: r for r, o in enumerate(sorted(hits, key=lambda o: (-hits[o][k], o)), 1)} for k in (0, 1)]
        score = {o: round(100 / (60 + places[0][o]) + 100 / (60 + places[1][o]) + 4 * hits[o][2] + (8 if phrase in texts[o].lower() else 0), 6) for o in hits}
        out += [(query, r, o, score[o]) for r, o in enumerate(sorted(score, key=lambda o: (-score[o], o))[:limit], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def shelf(spark):
    """Short documents, a chunk each: common words everywhere, rare ones in a few places, many equal texts."""
    r = random.Random(11)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(120)]
    texts = []
    for i in range(1500):
        words = r.choices(common, k=r.randint(2, 12)) + r.choices(rare[: 20 + i // 15], k=r.randint(0, 4))
        r.shuffle(words)
        texts.append("c1 c2" if i % 7 == 0 else " ".join(words))
    for i in (3, 444, 900):
        texts[i] += " r5 r6 r7"
    return texts


QUERIES = [(1, "r5 r6 r7"), (2, "c1"), (3, "c1 c2"), (4, "r100 c0 c3 r101"), (5, "unseen"), (6, "r3 r3 c5 r77 r8 r9 c1"), (7, "c0 c1 c2 c3 c4 c5")]


@pytest.mark.parametrize(("block", "first"), [(1024, 64), (16, 2)])
def test_search_equals_plain_loops(spark, monkeypatch, shelf, block, first):
    for module in (index, search):
        monkeypatch.setattr(module, "BLOCK_CHUNKS", block)
    monkeypatch.setattr(search, "FIRST_BLOCKS", first)
    monkeypatch.setattr(search, "RANGE_HITS", 200)
    opened = []
    whole = search.matched

    def watched(corpus, q, blocks=None):
        opened.append(blocks.count())
        return whole(corpus, q, blocks)

    monkeypatch.setattr(search, "matched", watched)
    corpus = Corpus.build(spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(shelf)], "source_ord bigint, document string, text string"))
    chunks = [(r.chunk_ord, r.text.split(), r.text) for r in corpus.chunks.collect()]
    assert len(chunks) == len(shelf)
    got = search.hybrid(corpus, spark.createDataFrame(QUERIES, "query_id int, query string"), 10).collect()
    want = plain_hybrid(chunks, [(i, t.split(), t) for i, t in QUERIES], 10)
    assert sorted((r.query_id, r.rank, r.chunk_ord, r.score) for r in got) == want
    held = search.potentials(corpus, search.asked(corpus, spark.createDataFrame(QUERIES, "query_id int, query string"))).count()
    assert sum(opened) <= held and (block == 1024 or sum(opened) < held)  # some blocks stay closed
    corpus.release()


def test_no_task_ranks_all_hits_of_a_query(spark, monkeypatch):
    monkeypatch.setattr(search, "RANGE_HITS", 100)
    hits = spark.range(1000).selectExpr("1 AS query_id", "id AS chunk_ord", "CAST(id % 3 AS double) AS bm25")
    ranked = search.ranked(search.in_ranges(hits, "bm25"), "bm25", "rank")
    want = {o: n for n, o in enumerate(sorted(range(1000), key=lambda o: (-(o % 3), o)), 1)}
    assert {r.chunk_ord: r["rank"] for r in ranked.collect()} == want


def test_thresholds_are_reached_by_enough_hits(spark):
    hits = spark.createDataFrame([(1, v / 100) for v in range(100)] + [(2, 1.0)] * 3, "query_id int, v double")
    got = {r.query_id: r.threshold for r in search.thresholds(hits, hits["v"], 10).collect()}
    assert set(got) == {1} and 0.85 < got[1] <= 0.90


@pytest.mark.parametrize("hits", [1 << 21, 700])
def test_many_queries_are_scored_by_matrices(spark, monkeypatch, shelf, hits):
    monkeypatch.setattr(search, "PROMISED_TERMS", 0)
    monkeypatch.setattr(search.batch, "SLAB_HITS", hits)
    monkeypatch.setattr(search, "matched", None)  # no row for each hit
    corpus = Corpus.build(spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(shelf)], "source_ord bigint, document string, text string"))
    chunks = [(r.chunk_ord, r.text.split(), r.text) for r in corpus.chunks.collect()]
    got = search.hybrid(corpus, spark.createDataFrame(QUERIES, "query_id int, query string"), 10).collect()
    assert sorted((r.query_id, r.rank, r.chunk_ord, r.score) for r in got) == plain_hybrid(chunks, [(i, t.split(), t) for i, t in QUERIES], 10)
    corpus.release()


def test_too_many_weights_are_left_to_rows(spark, monkeypatch, shelf):
    monkeypatch.setattr(search.batch, "WEIGHTS", 3)
    corpus = Corpus.build(spark.createDataFrame([(0, "d", shelf[1])], "source_ord bigint, document string, text string"))
    q = search.asked(corpus, spark.createDataFrame([(7, shelf[1])], "query_id int, query string"))
    assert search.batch.ranked(corpus, q.terms, q.averages, 1.2, 0.75, 10, search._share_of, 4, 8.0, 2e-6, search.thresholds) is None
    corpus.release()
