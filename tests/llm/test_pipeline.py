"""The stages of the corpus pipeline, one by one, against plain Python."""

import hashlib
import random
import re

import pytest
from test_native import contaminated

import corpus_pipeline
from stratum.llm import quality

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
key = lambda row: tuple(map(str, row))


def row(doc_id, text, source="web"):
    return (doc_id, text, "en", source, None if text is None else len(text))


def texts(seed, n, words=60):
    r = random.Random(seed)
    return [" ".join(f"w{r.randint(0, 400)}" for _ in range(words)) for _ in range(n)]


def near(text, seed):
    r, w = random.Random(seed), text.split()
    w[r.randint(0, len(w) - 1)] = f"n{seed}"
    return " ".join(w)


def odd_rows():
    """Groups of copies and near copies under repeated and null ids, rows without words, and odd characters."""
    t = texts(1, 8)
    rows = [row(i, x) for i, x in enumerate(t)]
    rows += [row(20, t[6]), row(21, near(t[6], 1)), row(5, t[5]), row(5, t[5]), row(5, t[5], "books")]
    rows += [row(30, near(t[0], 2)), row(30, x := texts(2, 1)[0]), row(30, near(x, 3)), row(30, texts(3, 1)[0])]
    rows += [row(None, near(t[1], 4)), row(None, x := texts(4, 1)[0]), row(None, x), row(None, near(x, 5)), row(None, texts(5, 1)[0])]
    rows += [row(40, None), row(40, None), row(41, ""), row(41, ""), row(None, None), row(42, " \t"), row(43, "two words"), row(44, "Two  words")]
    return rows


def one_of_each_group(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for g in set(group):
        own = [r for r, x in zip(rows, group, strict=True) if x == g]
        out.append(min(own, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest(), *r[2:4])))
    return out


def test_one_row_of_each_group_is_kept(spark):
    rows = odd_rows()
    got = STAGES["near-duplicate removal"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(tuple, got), key=key) == sorted(one_of_each_group(rows), key=key)


def stripped(rows):
    texts = sorted(((-(1 << 70) if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows)
    first = {}
    for i, b in texts:
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (i, p)), (i, p))
    out = []
    for r in rows:
        b, i = (r[1] or "").encode(), -(1 << 70) if r[0] is None else r[0]
        gone = set()
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone.update(range(p, p + 100))
        left, at = [], 0
        for c in r[1] or "":
            n = len(c.encode())
            left += [] if gone & set(range(at, at + n)) else [c]
            at += n
        text = "".join(left)
        out.append((r[0], None if r[1] is None else text, r[2], r[3], len(text) if gone else r[4]))
    return out


def test_repeats_go_with_whole_characters_alone(spark):
    r = random.Random(7)
    passage = "".join(r.choices("ab漢é𝄞�", k=90))
    rows = odd_rows() + [row(50, "x" + passage + "� end"), row(51, "� keep �" + passage[:-1] + "字 �"), row(52, "é字" + passage[1:] + passage[2:40]), row(53, "� alone")]
    # Cuts within a character: 漢 and 漣 share their first two bytes, 漢 and 𝄞's neighbours their last.
    rows += [row(60, "漢" + "q" * 40 + passage + "漢"), row(61, "字漣" + "q" * 40 + passage + "漣 and � more")]
    got = STAGES["repeated passage removal"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(tuple, got), key=key) == sorted(stripped(rows), key=key)


def test_quality_stage_keeps_what_the_scores_say(spark, tmp_path):
    rows = odd_rows() + [row(100 + i, x) for i, x in enumerate(texts(9, 150))] + [row(300 + i, " ".join([x.split()[0].upper() + "!!"] * 40)) for i, x in enumerate(texts(10, 20))]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(100, 250, 2), *range(300, 320, 2)]], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    got = STAGES["quality classifier"](spark, docs, f"file://{tmp_path}").collect()
    verdicts = [(r.doc_id, r.n_grams, r.kept) for r in quality.quality(docs, labels).collect()]
    assert len(got) == sum(v[2] for v in verdicts)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(v[0]) for v in verdicts if v[2])
    assert not {tuple(r) for r in got} - set(rows) and {r.doc_id for r in got} >= set(range(100, 250))
    assert sum(r.doc_id is not None and r.doc_id >= 300 for r in got) <= 10  # what the share leaves room for


def test_contaminated_rows_are_dropped(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(20))
    rows = odd_rows() + [row(70, "so " + item.upper()), row(71, item + " " + " ".join(texts(11, 12))), row(None, item)]
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = STAGES["benchmark decontamination"](spark, spark.createDataFrame(rows, DOCS), f"file://{tmp_path}").collect()
    clean = [not x[-1] for x in contaminated([r[:3] for r in rows], [(1, item)])]
    assert {r[0] for r, c in zip(rows, clean, strict=True) if not c} == {70, None} and sum(clean) == len(rows) - 2
    assert sorted(map(tuple, got), key=key) == sorted((r for r, c in zip(rows, clean, strict=True) if c), key=key)


def test_mix_has_every_row(spark):
    rows = odd_rows()
    got = STAGES["source mixing"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r.doc_id), r.source) for r in got) == sorted((str(r[0]), r[3]) for r in rows)
    assert sum(r.size for r in got) == sum(len((r[1] or "").split()) for r in rows)


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert STAGES[name](spark, spark.createDataFrame([], DOCS), f"file://{tmp_path}").count() == 0


CLASHING = "kept found kept_id bad_id at held rest carried carried_row no_text removed n_bytes cls tag component size copies key h text_hash n w item good digest none log_weight key_order".split()


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_of_clashing_names_are_carried(spark, tmp_path, name):
    item = " ".join(f"b{i}" for i in range(20))
    rows = odd_rows() + [row(70, item), row(71, texts(1, 8)[2] + " and some more of it")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame(rows, DOCS)
    want = STAGES[name](spark, plain, f"file://{tmp_path}").collect()
    wide = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], DOCS + "".join(f", `{c}` string" for c in CLASHING))
    got = STAGES[name](spark, wide, f"file://{tmp_path}")
    assert got.columns == wide.columns
    got = got.collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(map(tuple, want), key=key)
    assert all(set(r[5:]) == {"x"} for r in got)
