"""Hard negatives, whitening and quality rules against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import hard_negatives as hn
from stratum.llm import quality_rules as rules
from stratum.llm import whitening as wt

SCHEMA = "vec_id bigint, embedding array<float>, label int, class string, n bigint, x string, bucket int"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with further columns of names that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(np.float32(c)) for c in v)


def odd_vectors():
    return [(None, [1.0, 2.0, 3.0, 4.0], 1), (9001, None, 1), (9002, [], 1), (9003, [1.0, None, 0.0, 0.0], 2), (9004, [float("nan"), 0.0, 0.0, 0.0], 2), (9005, [float("inf"), 0.0, 0.0, 0.0], 2), (9050, [1.0, 2.0, 3.0, 4.0], None), (9100, [0.0, 0.0, 0.0, 0.0], 3), (9150, [0.5, 0.25], 1), (9151, [0.5, 0.5], 1), (9152, [0.5, 0.3], 2)]


# Hard negatives


def brute_negatives(rows, positives=5, negatives=3, band=(50, 95)):
    kept = sorted({(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()), y) for i, v, y in rows if i is not None and y is not None and usable(v)})
    out = []
    for a in kept:
        if a[0] % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(a[1], c[1], strict=True)), c[0], c) for c in kept if len(c[1]) == len(a[1]))
            alike = [(-s, i) for s, i, c in scored if c[2] == a[2] and i != a[0]][:positives]
            other = [(-s, i) for s, i, c in scored if c[2] != a[2]]
            for p, i in alike:
                fit = [(s, j) for s, j in other if band[0] * p <= 100 * s <= band[1] * p][:negatives]
                out += [(a[0], i, n, j, p, s) for n, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    got = hn.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("decay", [0.0, 0.4])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, decay):
    monkeypatch.setattr(hn, "LEAST_ROWS", 40)
    r = np.random.default_rng(3)
    scale = np.exp(-decay * np.arange(12))
    rows = [(i, [float(c) for c in r.normal(size=12) * scale + 0.3], int(r.integers(0, 4))) for i in range(700)]
    rows += [(i + 1000, rows[i][1], rows[i][2]) for i in range(0, 200, 5)]  # copies of other ids
    rows += [rows[i] for i in range(0, 100, 10)]  # repeated rows
    assert mined(spark, rows + odd_vectors()) == brute_negatives(rows + odd_vectors())


def test_hard_negatives_among_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_ROWS", 10)
    r = np.random.default_rng(4)
    common = [1.0, 2.0, -3.0, 0.5]
    rows = [(i, common if i % 3 == 0 else [float(c) for c in r.normal(size=4)], 1 if i % 2 else 0) for i in range(900)]
    rows += [(i, [c * 0.8 for c in common], 2) for i in range(900, 1000)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_few_and_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [-1.0], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_large_components_are_held(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 2)]
    assert mined(spark, rows, band=(-100, 100)) == [(0, 1, 1, 2, hn.REACH**2, -(hn.REACH**2))]


def test_survivors_hold_all_that_score_between(spark):
    r = np.random.default_rng(5)
    whole = np.floor(100 * r.normal(size=(500, 16)) * np.exp(-0.2 * np.arange(16))).astype(np.int64)
    basis = hn.rotation(whole[:300].astype(float))
    assert np.abs(basis[0].T @ basis[0] - np.eye(16)).max() < 1e-12 and basis[1]
    anchors, rows = hn.Rotated(whole[:20], basis), hn.Rotated(whole, basis)
    score = whole[:20] @ whole.T
    least, most = np.quantile(score, 0.9, axis=1), np.quantile(score, 0.99, axis=1)
    a, b, s = hn.survivors(anchors, np.arange(20), rows, 0, 500, least, most, np.ones((20, 500), bool))
    assert (s == score[a, b]).all()
    want = set(zip(*np.nonzero((score >= least[:, None]) & (score <= most[:, None])), strict=True))
    assert want <= set(zip(a, b, strict=True)) and len(a) < 20 * 500 / 2


# Whitening


def plain_whitening(vecs, components=16):
    """(n, deviation by vector, projections up to sign, shares) of vectors of one length, with Python's whole numbers."""
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vecs]
    fit = sorted(set(x))
    n, width = len(fit), len(x[0])
    total = [sum(r[j] for r in fit) for j in range(width)]
    centred = np.array([[(n * r[j] - total[j]) / n for j in range(width)] for r in fit])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    there = values > values[0] * 1e-11
    projected = np.array([[(n * r[j] - total[j]) / n for j in range(width)] for r in x]) @ vectors_[:, there] / np.sqrt(values[there])
    return n, [sum((n * r[j] - total[j]) ** 2 for j in range(width)) for r in x], projected, values[there] / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("width", "tile"), [(5, 32), (40, 16), (40, 32)])
def test_whitening_equals_plain_numbers(spark, width, tile):
    r = np.random.default_rng(6)
    scale = np.exp(-0.1 * np.arange(width))
    rows = [(i, [float(c) for c in r.normal(size=width) * scale], 0) for i in range(300)]
    rows += [(i + 500, rows[i][1], 0) for i in range(150)] + [rows[7], rows[7]]  # copies weigh nothing
    got = wt.whiten(vectors(spark, rows + [o for o in odd_vectors() if o[0] is None or not usable(o[1])][1:]), tile_width=tile).collect()
    n, deviation, projected, shares = plain_whitening([v for _, v, _ in rows])
    assert len(got) == len(rows) * len(shares) and {x.n for x in got} == {n}
    by_id = {}
    for x in got:
        by_id.setdefault(x.vec_id, {})[x.component] = x
    signs = {}
    for (i, _, _), d, p in zip(rows, deviation, projected, strict=True):
        for c, w in enumerate(p, 1):
            x = by_id[i][c]
            assert x.deviation == d and abs(x.explained - shares[c - 1]) < 1e-10 and x.identity_error < 1e-9
            assert abs(abs(x.whitened) - abs(w)) < 1e-8
            if abs(w) > 1e-6:
                assert signs.setdefault(c, x.whitened * w > 0) == (x.whitened * w > 0)


def test_each_length_is_whitened_by_itself(spark):
    r = np.random.default_rng(7)
    short, long = [[float(c) for c in r.normal(size=2)] for _ in range(40)], [[float(c) for c in r.normal(size=3)] for _ in range(60)]
    got = wt.whiten(vectors(spark, [(None, v, 0) for v in short] + [(1, v, 0) for v in long])).collect()
    assert sorted({(x.vec_id is None, x.n) for x in got}) == [(False, 60), (True, 40)] and len(got) == 40 * 2 + 60 * 3
    n, deviation, projected, _ = plain_whitening(short)
    assert sorted(x.deviation for x in got if x.vec_id is None and x.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(x.whitened) for x in got if x.vec_id is None and x.component == 2), sorted(abs(projected[:, 1])))


def test_components_without_variance_are_left_out(spark):
    assert wt.whiten(vectors(spark, [])).collect() == []
    assert wt.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    got = wt.whiten(vectors(spark, [(1, [1.0, 2.0, 0.5], 0), (2, [1.5, 2.0, 0.5], 0)])).collect()
    assert sorted((x.vec_id, x.component, x.deviation, round(abs(x.whitened), 12), x.explained) for x in got) == [(1, 1, 32**2, 1.0, 1.0), (2, 1, 32**2, 1.0, 1.0)]


def test_large_components_are_whitened(spark):
    got = wt.whiten(vectors(spark, [(i, [v, 0.0], 0) for i, v in enumerate([1e30, -1e30, 1e9, -3e8])])).collect()
    assert len(got) == 4 and all(np.isfinite(x.whitened) and x.deviation > 0 and x.identity_error < 1e-6 for x in got)


# Quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def rule_docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "doc_id bigint, text string, words int, pattern string, n_words int")


def prose(r, n, vocabulary):
    return " ".join(r.choices(vocabulary, k=n))


def rule_rows(seed, n=240):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéñ", k=r.randint(3, 8))) for _ in range(900)]
    rows = []
    for i in range(n):
        text = "\n".join(prose(r, r.randint(5, 30), vocabulary) for _ in range(r.randint(2, 8)))
        kind = i % 12
        if kind == 1:
            text = " ".join(w + "&&&" for w in text.split(" "))
        if kind == 2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 3:
            text = text.replace(" ", " | ")
        if kind == 4:
            text = " ".join(f"{w} " * 15 for w in text.split()[:12])
        if kind == 5:  # one passage twice: a seventh of the text at most
            text += "\n" + prose(r, 60, vocabulary) + "\n" + " ".join(text.split()[:6])
        rows.append((i, text))
    return rows


def test_counts_and_base_rules_equal_plain_ones(spark):
    r = random.Random(1)
    rows = rule_rows(2, 60) + [(1000, None), (1001, ""), (1002, " \t\n\v\f\r "), (None, "a b c d e a b c d e"), (None, None), (3, "a b c d e f"), (3, "a a a a a a"), (1003, "a\x0bb c d 漢字 é # | <>\nx\nx\n\nx "), (1004, "x y z w v " * 3), (1005, "a b c d e")]
    rows += [(2000 + i, " ".join(r.choices("ab", k=r.randint(0, 40)))) for i in range(40)]
    got = rules.judge(rule_docs(spark, rows)).collect()
    key = lambda x: tuple(str(v) for v in x)
    have = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=key)
    assert have == sorted(((i, *plain_counts(t)) for i, t in rows), key=key)
    assert all(not x.kept for x in got if x.base_failed)


def test_a_text_of_megabytes_is_counted_whole(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(300_000)]
    text = " ".join(words + words[:100])
    got = rules.judge(rule_docs(spark, [(1, text), (2, "a" * 3_000_000)])).orderBy("doc_id").collect()
    assert [(x.n_words, x.word_chars, x.n_repeat_words) for x in got] == [(300_100, 6 * 300_100, plain_counts(text)[4]), (1, 3_000_000, 0)]


def plain_estimate(patterns, n_rules, rounds):
    digits = np.array([[p // 3**j % 3 for j in range(n_rules)] for p, _ in patterns]).reshape(-1, n_rules)
    n, k = np.array([c for _, c in patterns], float), rules.PSEUDO_VOTES
    prior, g, b = rules.PRIOR, np.full(n_rules, rules.RIGHT_ON_GOOD), np.full(n_rules, rules.RIGHT_ON_BAD)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + ((digits == 2) * np.log(g / (1 - b)) + (digits == 0) * np.log((1 - g) / b)).sum(1)
        good = n / (1 + np.exp(-odds))
        bad, voted = n - good, digits != 1
        prior = (good.sum() + k * rules.PRIOR) / (n.sum() + k)
        g = np.maximum(rules.LEAST_RIGHT_ON_GOOD, ((good[:, None] * (digits == 2)).sum(0) + k * rules.RIGHT_ON_GOOD) / ((good[:, None] * voted).sum(0) + k))
        b = ((bad[:, None] * (digits == 0)).sum(0) + k * rules.RIGHT_ON_BAD) / ((bad[:, None] * voted).sum(0) + k)
    return prior, g, b


@pytest.mark.parametrize("rounds", [1, 12])
def test_estimate_equals_plain_expectation_maximisation(spark, rounds):
    r = random.Random(4)
    patterns = [(p, r.randint(1, 500)) for p in r.sample(range(3**5), 60)]
    got = rules.estimated(spark.createDataFrame(patterns, "pattern int, n bigint"), 5, rounds).first().model
    prior, g, b = plain_estimate(sorted(patterns), 5, rounds)
    assert abs(got.prior - prior) < 1e-9 and np.allclose(got.on_good, g, atol=1e-9) and np.allclose(got.on_bad, b, atol=1e-9)


def test_rules_outvote_each_other(spark):
    rows = rule_rows(5)
    got = {x.doc_id: x for x in rules.judge(rule_docs(spark, rows)).collect()}
    junk, clean = [i for i, _ in rows if i % 12 in (1, 2, 3, 4)], [i for i, _ in rows if i % 12 not in (1, 2, 3, 4)]
    assert np.mean([not got[i].kept for i in junk]) >= 0.95
    assert np.mean([got[i].kept for i in clean]) >= 0.98


def test_rules_on_an_empty_table(spark):
    assert rules.judge(rule_docs(spark, [])).collect() == []
    only = rules.judge(rule_docs(spark, [(None, None)])).collect()
    assert [(x.doc_id, x.n_words, x.base_failed, x.kept) for x in only] == [(None, 0, True, False)]


def test_quality_rules_run_no_python(spark):
    plan = rules.judge(rule_docs(spark, rule_rows(6, 12)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
