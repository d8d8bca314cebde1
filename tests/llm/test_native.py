"""Operators of DataFrame operations: decontamination, mixing, URL rules, near duplicates and components."""

import hashlib
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratum import storage
from stratum.llm import common, decontaminate, mixing, neardup, urlgraph
from stratum.llm.components import connected_components

DOCS = "doc_id bigint, text string, source string, kept string, h bigint, cls string"


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns of names that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def contaminated(rows, items):
    windows = [(str(i) if i is not None else "null", tuple(w[s : s + m])) for i, t in items if (w := words_of(t)) for m in [min(13, len(w))] for s in range(len(w) - m + 1)]
    out = []
    for doc_id, text, _ in rows:
        w, hit, found = words_of(text), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "x1"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(3, None), (20, ""), (None, "Solo item")]
    rows = []
    for i in range(40):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 40)))]
        for _, text in r.sample(items, 2):
            w = words_of(text)
            if w:
                a = r.randint(0, len(w) - 1)
                parts.append(r.choice([", ", " ", "\n"]).join(w[a : a + 25]).upper() if r.random() < 0.5 else " ".join(w))
        rows.append((i, " -- ".join(parts), "s"))
    rows += [(100, None, None), (101, "", "s"), (None, items[5][1], "s"), (7, rows[3][1], "s"), (7, rows[3][1], "s")]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(contaminated(rows, items), key=key)


def test_contamination_of_empty_tables(spark):
    none = docs(spark, [])
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(none, items).count() == 0
    row = decontaminate.contamination(docs(spark, [(1, "a b c", "s")]), items).collect()[0]
    assert (row.n_words, row.n_hit, row.contaminated) == (3, 0, False)


def test_mix_cuts_at_the_budget(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "b", "c", "c", "c", None])) for i in range(400)] + [(None, None, None), (5, "x y", "b"), (5, "x y", "b")]
    out = mixing.mix(docs(spark, rows), rows_per_bucket=16).collect()
    assert len(out) == len(rows)
    again = mixing.mix(docs(spark, rows[::-1]), rows_per_bucket=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    total = sum(x.size for x in out)
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    targets = {x.source: x.target for x in out}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    sizes = {x.source: x.source_size for x in out}
    level = max(targets[s] / weights[s] for s in targets if targets[s] < 3 * sizes[s] - 1e-9)
    for s, target in targets.items():
        assert abs(target - min(3 * sizes[s], level * weights[s])) < 1e-6
        own = [x for x in out if x.source == s]
        assert sum(x.taken for x in own) == int(target + 1e-9)
        assert all(0 <= x.taken <= 3 * x.size for x in own)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    row = mixing.mix(docs(spark, [(1, None, None)])).collect()[0]
    assert (row.size, row.target, row.taken) == (0, 0.0, 0)


def brute_components(rows, k, percent):
    sets = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)], least[find(i)] == rows[i][0]) for i in range(len(rows))]


def family_rows(seed, n, families):
    r = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{r.randint(0, 400)}" for _ in range(r.randint(60, 150))]
        for _ in range(n):
            w = base[:]
            for _ in range(r.randint(0, 4)):
                w[r.randint(0, len(w) - 1)] = f"n{r.randint(0, 10**6)}"
            rows.append((len(rows) * 3 + 5, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize(("n", "families", "block"), [(6, 12, 64), (90, 2, 16)])
def test_near_duplicates_equal_brute_force(spark, n, families, block):
    rows = family_rows(2, n, families)
    rows += [(1, None, None), (2, "", "s"), (3, "Two Words", "s"), (4, "two  words", "s"), (9001, "two", "s"), (9002, rows[0][1].upper(), "s"), (9002, rows[0][1], "s"), (9003, "lone text of six words here", "s"), (None, rows[1][1], "s")]
    got = neardup.near_duplicates(docs(spark, rows), block=block).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, 3, 85), key=key)


def test_near_duplicates_of_the_pipeline_equal_brute_force(spark):
    rows = family_rows(6, 40, 4)
    got = neardup.near_duplicates(docs(spark, rows), k=5, percent=80, trees=20, block=16, block_trees=10).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 5, 80))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert [r.component_id for r in neardup.near_duplicates(docs(spark, [(4, None, None)])).collect()] == [4]


@pytest.mark.parametrize("last", [1 << 18, 40, 0])
def test_components_of_chains_and_stars(spark, last):
    chain = list(range(301))
    random.Random(8).shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), last).collect()}
    assert connected_components(spark.createDataFrame([(3, 3)], "a bigint, b bigint"), last).count() == 0
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5001] == 5000


@pytest.mark.parametrize("copies", [1000, 7])
def test_mix_of_very_many_equal_and_null_ids(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rows = [(None, "a b c", "x")] * 1200 + [(None, "w " * (i % 50), "x") for i in range(300)] + [(5, "one two", "x")] * 40 + [(i, "v " * 30, ["y", None][i % 2]) for i in range(60)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda x: tuple(map(str, x))
    size = lambda t: len(t.split())
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=key) == sorted(((i, size(t), s) for i, t, s in rows), key=key)
    for source in ("x", "y", None):
        own = [r for r in got if r.source == source]
        whole = sum(size(t) for _, t, s in rows if s == source)
        assert {r.source_size for r in own} == {whole} and len({r.target for r in own}) == 1
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 3 * r.size for r in own)


def test_hosts_of_many_pages_beyond_the_broadcast(spark, monkeypatch):
    pages = [(i, f"http://h{0 if i % 2 else i}.com/{'de' if i % 10 == 1 else 'x'}/", f'<a href="http://h{i + 2}.com/de/q">l</a>', 1) for i in range(120)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, n int")
    want = sorted(map(tuple, urlgraph.judge(table).collect()))
    monkeypatch.setattr(urlgraph, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(map(tuple, urlgraph.judge(table).collect())) == want


def test_hot_classes_are_named_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = family_rows(4, 12, 5) + [(2000 + i, "the same text of many copies here", "s") for i in range(40)] + [(None, None, None)] * 9
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, neardup.near_duplicates(docs(spark, rows), block=8).collect()), key=key) == sorted(brute_components(rows, 3, 85), key=key)


def test_url_rules(spark):
    urls = ["HTTPS://A.Example.ORG/en/1x?q#f", "http://example.org/es/", "x://notexample.org/es/", "http://org", "http://b.com/de/z", "http://com/fr/", None, "no scheme/org/", "http://u.net?x=1", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id bigint, url string, html string, trust int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge(pages).collect()}
    assert got[0] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[1][2:] == ("example.org/es/", "block")
    assert got[2][2:] == ("org/", "allow")
    assert got[3][:3] == ("org", "", None)
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][:2] == ("u.net", "") and got[9][:2] == ("b:", "//c/d")
    assert urlgraph.judge(pages.limit(0)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    seeds = spark.createDataFrame([("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("near", 0.0, 0.0), ("shady", 0.0, 0.0)], "host string, trust double, distrust double")
    links = spark.createDataFrame([("good", "near", 2), ("good", "good", 9), ("shady", "bad", 1), ("near", "good", 1)], "a string, b string, n bigint")
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.host_scores(seeds, links).collect()}
    trust = {"good": 1.0, "near": 0.0}
    for _ in range(urlgraph.ROUNDS):
        trust = {"good": 1.0 + 0.85 * trust["near"], "near": 0.85 * trust["good"]}
    assert abs(got["near"][0] - trust["near"]) < 1e-9 and abs(got["good"][0] - trust["good"]) < 1e-9
    assert got["shady"] == (0.0, pytest.approx(0.85)) and got["bad"] == (0.0, 1.0)


def test_a_host_that_links_to_blocked_pages_is_blocked(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", "", ), (2, "http://hub.net/a", '<a href="http://x.com/de/1">x</a>'), (3, "http://lone.net/", "<p>")], "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urlgraph.judge(pages).orderBy("page_id").collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_a_ring_of_hosts_is_carried_to_the_end_in_time(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{(i + 1) % 6}.net/">x</a>') for i in range(6)]
    rows += [(6, "http://x.com/de/1", '<a href="http://h0.net/">x</a>'), (7, "http://y.com/fr/1", '<a href="http://h3.net/">x</a>')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = Path(storage.shared_folder(spark).removeprefix("file:"))
    before, began = set(folder.iterdir()), time.time()
    got = {r.page_id: r for r in urlgraph.judge(pages).collect()}
    assert time.time() - began < 30 and len(set(folder.iterdir()) - before) <= 5
    trust = {h: 0.0 for h in range(6)}
    for _ in range(400):
        trust = {h: 0.85 * trust[(h - 1) % 6] + (0.85 if h == 3 else 0.0) for h in range(6)}
    assert all(got[h].trust == pytest.approx(trust[h], rel=1e-7) and got[h].distrust == 0 for h in range(6))


@pytest.mark.parametrize("last", [1 << 18, 0])
def test_scores_are_carried_to_the_end(spark, monkeypatch, last):
    monkeypatch.setattr(urlgraph, "LAST_EDGES", last)
    page = lambda i, host, to: (i, f"http://{host}/", "".join(f'<a href="http://{t}/">x</a>' for t in to))
    chain = [page(i, f"h{i}.net", [f"h{i + 1}.net"]) for i in range(12)] + [page(12, "h12.net", ["x.com"]), (13, "http://x.com/de/1", "")]
    # A loop whose far side hears of both seeds: all that goes round counts, however little it is.
    loop = [page(20, "p.net", ["q.net", "x.com"]), page(21, "q.net", ["p.net"]), (22, "http://y.com/fr/1", '<a href="http://p.net/">x</a><a href="http://x.com/de/1">x</a>')]
    got = {r.host: r for r in urlgraph.judge(spark.createDataFrame(chain + loop, "page_id bigint, url string, html string")).collect()}
    links, trust, distrust = {}, {"y.com": 1.0}, {"x.com": 1.0}
    for _, url, html in chain + loop:
        for to in re.findall(r"http://([^/]+)/", html):
            links[url.split("/")[2], to] = 1
    out, into = ({h: sum(k[side] == h for k in links) for h in got} for side in (0, 1))
    for _ in range(500):
        trust, distrust = (
            {h: (h == "y.com") + 0.85 * sum(trust.get(a, 0) / out[a] for a, b in links if b == h) for h in got},
            {h: (h == "x.com") + 0.85 * sum(distrust.get(b, 0) / into[b] for a, b in links if a == h) for h in got},
        )
    for h, r in got.items():
        assert r.trust == pytest.approx(trust[h], rel=1e-7) and r.distrust == pytest.approx(distrust[h], rel=1e-7)
    assert all(got[f"h{i}.net"].verdict == "block" for i in range(13)) and got["h0.net"].distrust > 0


def test_native_plans_hold_no_python(spark):
    rows = docs(spark, [(1, "a b c", "s")])
    for frame in (mixing.mix(rows), decontaminate.contamination(rows, spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert rows.select(F.lit(1)).count() == 1
