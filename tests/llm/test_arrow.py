"""Operators over Arrow batches against brute force, exact round trips or held-out labels."""

import gzip
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.llm import ann, html_extract, quality, suffix_dedup, toxicity, warc
from stratum.llm import wordhash as wh


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kept string, h bigint")


# Suffix arrays


def brute_strip(rows):
    texts = [(i if i is not None else -(1 << 70), (t or "").encode(), n) for n, (i, t) in enumerate(rows)]
    first = {}
    for i, b, _ in sorted(texts, key=lambda x: x[0]):
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, b, _ in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\x01" * 100
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def repeated_rows(seed):
    r = random.Random(seed)
    letters = lambda n: "".join(r.choices("abcde é漢", k=n))
    passages = [letters(n) for n in (80, 100, 130, 400, 900)]
    rows = []
    for i in range(60):
        parts = [letters(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts += [p[a:] if r.random() < 0.5 else p, letters(r.randint(0, 60))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "z" * 250), (102, rows[5][1]), (103, None), (104, ""), (105, "x" * 99), (None, rows[7][1]), (106, rows[8][1]), (106, rows[8][1]), (106, passages[4])]
    return rows


@pytest.mark.parametrize(("seed", "shard", "hot"), [(1, 1 << 19, 4096), (2, 700, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, shard, hot):
    rows = repeated_rows(seed)
    for name, value in (("SHARD", shard), ("HOT_ROWS", hot)):
        monkeypatch.setattr(suffix_dedup, name, value)
    got = []
    for r in suffix_dedup.strip_repeats(docs(spark, rows), ["h"]).collect():
        spans = list(zip(r.removed[::2], r.removed[1::2], strict=True))
        got.append((str(r.doc_id), r.n_bytes, sum(b - a for a, b in spans), len(spans), hashlib.sha256(r.kept).hexdigest()))
        assert r.h == 1
    want = [(str(i), *x) for (i, _), x in zip(rows, brute_strip(rows), strict=True)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_told_apart(spark, doc_id):
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passage = words(25)
    rows = [(-5 if doc_id else None, passage)] + [(doc_id, (words(20) + passage if i % 2 else words(30)) + str(i)) for i in range(5_000)]
    got = {}
    for x in suffix_dedup.strip_repeats(docs(spark, rows)).collect():
        got.setdefault(x.n_bytes, []).append((len(x.removed), bytes(x.kept)))
    kept = {k for v in got.values() for _, k in v}
    clean = [t.encode() for i, (_, t) in enumerate(rows[1:]) if i % 2 == 0]
    assert all(t in kept for t in clean)
    if doc_id:
        assert not any(passage.encode() in k for k in kept if k != passage.encode())


def test_suffix_order_is_sorted():
    data = np.frombuffer(("abracadabra " * 30 + "xyz").encode(), np.uint8)
    order, proved = suffix_dedup.suffix_order(data)
    raw = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw)))
    assert all(raw[a:][:100] <= raw[b:][:100] for a, b in zip(order, order[1:], strict=False))
    shared = suffix_dedup.common_prefixes(data, order, proved, 0, 100)
    for k in range(1, len(order)):
        a, b = raw[order[k] :], raw[order[k - 1] :]
        true = next((i for i in range(min(len(a), len(b), 100)) if a[i] != b[i]), min(len(a), len(b), 100))
        assert shared[k] <= true and (shared[k] == true or true < 100)


def test_no_repeats_in_an_empty_table(spark):
    assert suffix_dedup.strip_repeats(docs(spark, [])).count() == 0


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id bigint, embedding array<float>, score double")


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 16))
    data = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.3 * r.normal(size=16)]) for i in range(1500)]
    data += [(2000, data[50][1]), (2001, data[50][1]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [1.0, None] + [1.0] * 14), (2006, [float("inf")] + [1.0] * 15), (None, data[3][1]), (2050, [1.0, 2.0])]
    got = ann.nearest(vectors(spark, data), F.col("vec_id") % 50 == 0, shard_rows=300).collect()
    good = [(i, np.array(v)) for i, v in data[:1502]]
    ids = np.array([i for i, _ in good])
    m = np.stack([v for _, v in good])
    want = set()
    for q, v in good:
        if q % 50 == 0:
            score = ann.cosines(v, m)
            score[ids == q] = -2
            for rank, k in enumerate(np.lexsort((ids, -score))[:5], 1):
                want.add((int(q), rank, int(ids[k]), round(float(score[k]), 12)))
    assert {(x.query_id, x.rank, x.vec_id, round(x.score, 12)) for x in got} == want


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (0.8, 0.95), (0.4, 0.9)])
def test_relaxed_search_keeps_recall(spark, factor, least):
    """Through pivots, shards and trees, against all pairs."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 12))
    data = [(i, [float(x) for x in centres[i % 12] + 0.5 * r.normal(size=12)]) for i in range(3000)]
    m = np.array([np.float32(v) for _, v in data], float)
    units = m / np.linalg.norm(m, axis=1)[:, None]
    found = {}
    for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 50 == 0, factor=factor, shard_rows=300, pivots=10).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    recall = []
    for q in range(0, 3000, 50):
        score = units @ units[q]
        score[q] = -2
        recall.append(len(found[q] & set(np.argsort(-score)[:5].tolist())) / 5)
    assert len(recall) == 60 and np.mean(recall) >= least


def test_neighbours_among_very_many_copies(spark):
    r = np.random.default_rng(8)
    common = [1.0, 2.0, -3.0, 0.5]
    data = [(i, common if i % 3 == 0 else [float(x) for x in r.normal(size=4)]) for i in range(600)]
    data += [(0, common)] * 50 + [(700, [1e200, 1.0, 0.0, 0.0]), (750, [1e-200, 1e-300, 0.0, 0.0])]
    got = {}
    for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 50 == 0, shard_rows=16, pivots=9).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, round(x.score, 9)))
    rows = dict(data)
    ids, m = np.array(sorted(rows)), np.array([np.float32(rows[i]) for i in sorted(rows)], float)
    usable = np.isfinite(m).all(1) & (m != 0).any(1)
    ids, m = ids[usable], m[usable]
    for q, v in zip(ids, m, strict=True):
        if q % 50 == 0:
            score = ann.cosines(v, m)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
            assert sorted(got[q]) == [(n, int(ids[k]), round(float(score[k]), 9)) for n, k in enumerate(order, 1)]
    assert set(got) == {int(i) for i in ids if i % 50 == 0}


def test_rows_of_one_id_and_other_vectors_are_others(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = sorted((x.query_id, x.rank, x.vec_id) for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]


def test_neighbours_of_few_vectors(spark):
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in got] == [(0, 1, 1)] and abs(got[0].score - 0.5**0.5) < 1e-12


# WARC


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(2)
    big = ["".join(r.choices("abc <>é", k=5000)) for _ in range(4)]
    rows = [(i, f"http://h/{i}\nx", r.choice([*big, "small", "", None])) for i in range(80)] + [(200, None, "y" * 1000), (201, "u", "y" * 1000), (202, "u", "y" * 999), (203, "u", "y" * 999)]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, payload int")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = {x.page_id: x for x in warc.pages_of(warc.read_warc(spark, path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        x = got[i]
        assert (x.payload_bytes, x.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = len(raw) >= 1000 and last[h] != i
        assert (x.record_type, x.refers_to) == (("revisit", last[h]) if revisit else ("response", None))


def test_reader_survives_chance_magics(spark, tmp_path):
    (tmp_path / "w").mkdir()
    payloads, members = [], []
    for i in range(12):
        payload = (b"\x1f\x8b\x08" + bytes([i]) * 300) * 3
        record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(payload)) + payload + b"\r\n\r\n"
        stored = zlib.compressobj(0, zlib.DEFLATED, 31)
        members.append(stored.compress(record) + stored.flush())
        payloads.append(payload)
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(members))
    for size in ("250", "700", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {r.fields["warc-record-id"]: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {f"<urn:page:{i}>": p for i, p in enumerate(payloads)}, size


@pytest.mark.parametrize("name", ["a.warc.gz", "0.gz", "é !.gz", "a.warc"])
def test_archives_of_any_name_are_read_in_ranges(spark, tmp_path, name):
    (tmp_path / "w").mkdir()
    r = random.Random(3)
    payloads = {f"<urn:x:{i}>": bytes(r.choices(range(256), k=r.choice([0, 50, 3000]))) for i in range(30)}
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {}\r\nContent-Length: {}\r\n\r\n"
    (tmp_path / "w" / name).write_bytes(b"".join(gzip.compress(head.format(k, len(p)).encode() + p + b"\r\n\r\n") for k, p in payloads.items()))
    for size in ("4000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            records = warc.read_warc(spark, f"file://{tmp_path}/w")
            got = {x.fields["warc-record-id"]: bytes(x.payload) for x in records.collect()}
            tasks = spark.read.options(**warc._raw_options(spark)).text(f"file://{tmp_path}/w").rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == payloads
        assert size != "4000" or tasks > 5


def test_archive_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.pages_of(warc.read_warc(spark, path)).count() == 0


# Pages


def test_main_text_of_a_page(spark):
    long = "The quick story goes on, and on. " * 12
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var x='<p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>A &amp; B</h1><p>{long}<p>Fo<b>ur</b>&nbsp;  words<br>here, then. {long}</article><div id=comments><div class=comment><p>I agree.</p></div></div><footer>&copy; us</footer>"
    rows = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(rows).collect()}
    once = " ".join(long.split())
    assert got[1].text == f"A & B {once} Four words here, then. {once}"
    assert (got[1].n_chars, got[2].text, got[2].n_chars, got[3].text) == (len(got[1].text), "", 0, "")
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    model = html_extract.trained()
    for page in html_extract.training_pages(20, seed=5):
        nodes, _ = html_extract.parse(page)
        for node, logit in zip(nodes, model.predict(html_extract.node_features(nodes, model)), strict=True):
            node.logit = float(logit)
        kept = html_extract.decode(nodes)
        for node in nodes:
            if node.own == 0 and id(node) in kept and all(id(c) in kept for c in node.children) and node.children:
                stack = list(node.children)
                assert all(id(c) in kept for c in stack)


@pytest.mark.parametrize("odd", ["<", "x <b ", '<a "', "<a '\">", "<!x", "<svg>", "</svg ", "<div>", "</p>", "<p><li>", "<a<", "<!--", "<a b", "&", '<a ">" '])
def test_odd_pages_are_read_in_linear_time(odd):
    model = html_extract.trained()
    began = time.process_time()
    html_extract.texts_of(["<p>Words of a page.</p>" + odd * (300_000 // len(odd))], model)
    short = time.process_time() - began
    assert short < 25
    nodes, pieces = html_extract.parse("<p>One two.</p>" + odd * 5 + "<p>Three four.</p>")
    assert "One two." in "".join(t for _, t in pieces)


def test_a_page_of_five_megabytes_of_open_brackets():
    nodes, pieces = html_extract.parse("<p>text</p>" + "<" * 5_000_000)
    assert len(nodes) == 2 and sum(len(t) for _, t in pieces) >= 5_000_000


@pytest.mark.parametrize("tag", ["noscript", "template", "svg", "iframe", "title", "textarea", "math"])
def test_what_follows_an_unclosed_element_is_kept(tag):
    _, pieces = html_extract.parse(f"<div><{tag}><p>The story goes on.</p></div>")
    assert "The story goes on." in "".join(t for _, t in pieces)


@pytest.mark.parametrize(("source", "text"), [
    ("<p>a</p><script>x='<p>no</p>'</script><style>p{}</style>b", "a b"), ("a<!-- <p>no</p> -->b", "ab"), ('<p title="x > y">a</p>', "a"), ("<P CLASS='a'>A&amp;B&#33;<br/>c", "A&B! c"),
    ("a < b and c > d", "a < b and c > d"), ("<p>a<p>b<li>c<li>d", "a b c d"), ("x<![CDATA[<y>&amp;]]>z", "x<y>&amp;z"), ("<p>a</p", "a</p"), ("a<b>b</b>c", "abc"), ("<!doctype html><?x y?>a", "a"), ('<p a="b>c', '<p a="b>c'),
])
def test_pieces_of_small_pages(source, text):
    _, pieces = html_extract.parse(source)
    assert " ".join("".join(t for _, t in pieces).split()) == text


def test_unseen_pages_of_known_layouts():
    model, right, extra, lost = html_extract.trained(), 0, 0, 0
    for page in html_extract.training_pages(60, seed=77):
        nodes, pieces = html_extract.parse(page)
        inside, want = False, []
        for _, piece in pieces:
            for part in piece.replace("\ue000", "\x00\ue000").replace("\ue001", "\x00\ue001").split("\x00"):
                if part[:1] in "\ue000\ue001" and part:
                    inside, part = part[0] == "\ue000", part[1:]
                if inside:
                    want += part.split()
        got = html_extract.texts_of([page.replace("\ue000", "").replace("\ue001", "")], model)[0].split()
        a, b = len(got), len(want)
        same = sum(min(got.count(w), want.count(w)) for w in set(got))
        right, extra, lost = right + same, extra + a - same, lost + b - same
    assert right / (right + extra) > 0.97 and right / (right + lost) > 0.97


# Toxicity and quality


def labelled(spark, n=600, seed=9):
    r = random.Random(seed)
    bad = ["grubwort", "mudface", "nitwitz"]
    rows, labels = [], []
    for i in range(n):
        w = [f"t{r.randint(0, 800)}" for _ in range(r.randint(1, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randint(0, len(w)), r.choice(bad) + r.choice(["", ".", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_generalises_and_finds_spans(spark):
    rows, labels = labelled(spark)
    rows += [(9000, None), (9001, ""), (None, "t1 Mudface t2")]
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    by_id = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert by_id[9000].predicted == by_id[9001].predicted == 0 and 0 <= by_id[9000].score <= 1
    text = "t1 Mudface t2"
    assert [text[s.start : s.end] for s in by_id[None].spans] == ["Mudface"]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 7):
        scores, chain = r.normal(size=n), r.normal(size=5)
        weights = np.zeros(n)
        total = 0.0
        for code in range(1 << n):
            s = [(code >> t) & 1 for t in range(n)]
            w = np.exp(chain[4] * s[0] + sum(scores[t] * s[t] for t in range(n)) + sum(chain[2 * s[t] + s[t + 1]] for t in range(n - 1)))
            total += w
            weights += w * np.array(s)
        p = weights / total
        assert np.allclose(toxicity.log_odds(scores, np.array([0, n]), chain), np.log(p / (1 - p)))


@pytest.mark.parametrize("chain", [(0.0, -2.0, -1.0, 0.5, -2.0), (0.0, -6.0, -6.0, 0.0, -6.0), (6.0, -6.0, -6.0, 6.0, 6.0), (-6.0, 6.0, 6.0, -6.0, 0.0)])
def test_long_chains_are_exact_across_chunks(chain):
    r = np.random.default_rng(2)
    first = np.array([0, 3000, 3000, 3001, 3257, 3513, 4500])
    scores, chain = r.normal(size=4500), np.array(chain)
    a, b, c, d, start = np.exp(chain)
    emit = np.exp(scores)
    f, q = np.empty(4500), np.ones(4500)
    for low, high in zip(first, first[1:], strict=False):
        for t in range(low, high):
            f[t] = emit[t] * (start if t == low else (b + d * f[t - 1]) / (a + c * f[t - 1]))
        for t in range(high - 2, low - 1, -1):
            x = emit[t + 1] * q[t + 1]
            q[t] = (c + d * x) / (a + b * x)
    assert np.allclose(toxicity.log_odds(scores, first, chain), np.log(f * q), atol=1e-8)


def log_likelihood(scores, first, chain, label):
    total = 0.0
    for low, high in zip(first, first[1:], strict=False):
        weigh = lambda z: chain[4] * z[0] + sum(scores[low + t] * z[t] for t in range(len(z))) + sum(chain[2 * x + y] for x, y in zip(z, z[1:], strict=False))  # noqa: E731, B023
        if n := high - low:
            total += weigh(label[low:high].tolist()) - np.log(sum(np.exp(weigh([(code >> t) & 1 for t in range(n)])) for code in range(1 << n)))
    return total


def test_gradients_equal_numeric_ones():
    r = np.random.default_rng(0)
    first = np.array([0, 3, 3, 8, 9])
    scores, chain, label = r.normal(size=9), 2 * r.normal(size=5), r.integers(0, 2, 9)
    p, expected = toxicity.expectations(scores, first, chain)
    seen = np.zeros(5)
    for t in range(9):
        seen[4 if t in (0, 3, 8) else 2 * label[t - 1] + label[t]] += 1 if t not in (0, 3, 8) else label[t]
    for j, step in enumerate(1e-5 * np.eye(5)):
        slope = (log_likelihood(scores, first, chain + step, label) - log_likelihood(scores, first, chain - step, label)) / 2e-5
        assert abs(slope - (seen - expected)[j]) < 1e-6
    for j, step in enumerate(1e-5 * np.eye(9)):
        slope = (log_likelihood(scores + step, first, chain, label) - log_likelihood(scores - step, first, chain, label)) / 2e-5
        assert abs(slope - (label - p)[j]) < 1e-6


def test_toxicity_learns_from_long_texts_and_of_repeated_ids(spark):
    rows, labels = labelled(spark, 300)
    filler = " ".join(f"t{i % 800}" for i in range(30_000))
    rows = [(i, f"{filler} {t}" if i % 40 == 0 else t) for i, t in rows] + [(0, rows[0][1])] * 500
    tagger = toxicity.fit(docs(spark, rows), labels, ~toxicity.held_out(), sample_rows=200, sample_chars=400_000)
    got = {r.doc_id: r for r in tagger.tag(docs(spark, rows)).collect()}
    assert all(got[i].spans for i in range(0, 300, 40))


def test_quality_drops_junk_and_keeps_the_rest(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(3, 80))]
        junk = i % 7 == 0
        if junk:
            w = r.choice([[x.upper() + "!!" for x in w], [w[0]] * 40, [y for x in w for y in (x, "|")]])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), 0))
    rows += [(900, None), (901, ""), (3, rows[3][1]), (None, "w1 w2 w3 w4")]
    table = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality int, toxic int")
    got = quality.quality(docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    assert len({r.kept for r in got if r.doc_id in (900, 901)}) == 1
    kept = {r.doc_id for r in got if r.kept}
    good = sum(i % 7 > 0 for i in range(1, 500, 2)) / 250
    keys = sorted({r.text_hash: r.key for r in got}.values(), reverse=True)
    k = math.ceil((good + (good * (1 - good) / 250) ** 0.5) * len(keys))
    assert {r.key for r in got if r.kept} == set(keys[:k])
    assert all(i in kept for i in range(500) if i % 7) and sum(i in kept for i in range(0, 500, 7)) <= k - 428 <= 16
    noise = np.array([r.key - r.log_weight for r in got if r.doc_id is not None and r.doc_id < 500])
    assert abs(noise.mean() - 0.5772) < 0.2 and abs(noise.std() - 1.2825) < 0.2
    assert quality.quality(docs(spark, []), table).count() == 0


def test_quality_keeps_a_clean_text_of_many_copies(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(30, 80)))) for i in range(400)]
    rows += [(500 + i, " ".join(f"j{r.randint(0, 50)}".upper() + "!!" for _ in range(40))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 460, 2)], "doc_id bigint, quality int, toxic int")
    copies = [(1000 + i, rows[at][1]) for at in (6, 7) for i in range(at * 3000, at * 3000 + 3000)]  # of a labelled text and of one without label
    plain = quality.fit(docs(spark, rows), labels)
    selector = quality.fit(docs(spark, rows + copies), labels)
    assert np.array_equal(plain.ratio, selector.ratio)
    got = quality.quality(docs(spark, rows + copies), labels).collect()
    assert all(x.kept and x.log_weight >= 0 for x in got if x.doc_id in (6, 7) or x.doc_id >= 1000)
    assert all(x.log_weight < -20 for x in got if 500 <= x.doc_id < 560)


def plain_ngrams(text):
    """The n-grams of a text as strings: words, forms, pairs of words, pairs and triples of forms."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
    forms = []
    for i, w in enumerate(words):
        b = w.encode()
        marks = [bytes(b[-k : len(b) - k + 1]) if k <= len(b) and 32 < b[-k] < 127 and not chr(b[-k]).isalnum() else b"" for k in (1, 2, 3)]
        forms.append((min(sum(65 <= c <= 90 for c in b), 2), any(97 <= c <= 122 for c in b), any(48 <= c <= 57 for c in b), 65 <= b[0] <= 90, *marks, i > 0 and low[i] == low[i - 1]))
    runs = lambda x, k: list(zip(*(x[j:] for j in range(k)), strict=False))
    return [("w", *x) for x in runs(low, 1)] + [("f", *x) for x in runs(forms, 1)] + [("w", *x) for x in runs(low, 2)] + [("f", *x) for n in (2, 3) for x in runs(forms, n)]


def test_ngram_weights_equal_plain_counts(spark):
    r = random.Random(12)
    parts = ["Word", "word", "WORD!!", "a1", "B2b", "été.", "x..", "|", "q?!.", "漢字", "end"]
    rows = [(i, " ".join(r.choices(parts, k=r.randint(0, 25)))) for i in range(60)] + [(100, None), (101, " \t"), (102, "one"), (5, "word word")]
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    bucket = {}
    for _, text in rows:
        (first, _, data, offsets), = wh.slices(pa.array([text], pa.string()))
        buckets, _ = quality.ngrams(data, offsets)
        plain = plain_ngrams(text)
        assert len(plain) == len(buckets)
        for gram, b in zip(plain, buckets.tolist(), strict=True):
            assert bucket.setdefault(gram, b) == b
    assert len(set(bucket.values())) >= 0.98 * len(bucket)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)] + [(200, 1, 0), (None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    good = {i for i in range(0, 60, 2) if i % 3} | {200, 999}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for text in {t for _, t in rows if t is not None}:
        for gram in plain_ngrams(text):
            raw[bucket[gram]] += 1
            target[bucket[gram]] += any(t == text and i in good for i, t in rows)
    share = target.sum() / raw.sum()
    ratio = np.log(target + quality.PRIOR) - np.log(share * raw + quality.PRIOR)
    selector = quality.fit(docs(spark, rows), labels)
    assert np.allclose(selector.ratio, ratio)
    for x in selector.score(docs(spark, rows)).collect():
        options = [plain_ngrams(t) for i, t in rows if i == x.doc_id]
        assert any(x.n_grams == len(o) and abs(x.log_weight - sum(ratio[bucket[g]] for g in o)) < 1e-9 for o in options)


def test_keep_is_what_the_scores_say(spark):
    rows, labels = labelled(spark, 120)
    table = docs(spark, rows)
    selector = quality.fit(table, labels)
    scored = selector.score(table)
    selector.choose(scored)
    assert {r.doc_id for r in selector.keep(table).collect()} == {r.doc_id for r in scored.where(F.col("key_order") >= selector.cut_key).collect()}


def test_word_hashes_see_words_alone():
    texts = ["a bc  Def", "", "bc\tdef", None, "x" * 5000 + " a"]
    seen = []
    for _, _, data, offsets in wh.slices(pa.array(texts)):
        s, e, first = wh.word_spans(data, offsets, wh.SPACE)
        h = wh.hash_spans(wh.LOWER[data], s, e)
        seen += [h[first[i] : first[i + 1]].tolist() for i in range(len(first) - 1)]
    assert [len(x) for x in seen] == [3, 0, 2, 0, 2]
    assert seen[0][1:] == seen[2] and seen[4][1] == seen[0][0]
