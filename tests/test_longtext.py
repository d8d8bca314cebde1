"""Texts cut by many tasks against the folds of the whole text."""

import os
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.operators import longtext, segment
from test_segment import random_texts


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def whole(spark, texts, target, overlap, parent):
    """Chunks by the folds, with other sizes than the library's own."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    normal = df.select("i", segment.newlines("t").alias("t"), segment.sections("t").alias("s"))
    plain = F.transform(segment.chunked("t", parent, 0), lambda p, i: F.struct(F.concat(F.lit(segment.SECTION), (i + 1).cast("string")).alias("title"), p.alias("text")))
    parts = normal.select("i", F.posexplode(F.when(F.get("s", F.lit(0))["title"] == segment.SECTION + "1", plain).otherwise(F.col("s"))).alias("section", "s"))
    rows = parts.select("i", "section", "s.title", F.posexplode(segment.chunked("s.text", target, overlap)).alias("part", "text")).collect()
    return {(r.i, r.section, r.part): (r.title, r.text) for r in rows}


def by_blocks(spark, folder, texts, *sizes):
    for i, text in enumerate(texts):
        with open(os.path.join(folder, f"{i:05d}.txt"), "w", newline="") as out:
            out.write(text)
    rows = longtext.chunks(longtext.lines_of(spark, str(folder)), *sizes).collect()
    got = {(int(r.document[-9:-4]), r.section_index, r.part_index): (r.section_title, r.text) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_texts():
    r = random.Random(8)
    words = ["ab", "cdef", "ghi jkl", "长文本", "，句。", " ", "x" * 40]

    def prose(n):
        return "".join(r.choices(words, k=n))

    return [
        "  # Indented first\n\ntext\n## ",
        "#\n##\n###\n\n# real\ntail\n##",
        "##\n\n\n## twice\n   \n\n" + prose(900),
        "\n".join(prose(9) for _ in range(900)),  # one paragraph over many blocks
        "\n\n".join(prose(r.randint(1, 60)) for _ in range(700)),
        "# one section\n\n" + "\n\n".join(prose(r.randint(1, 60)) for _ in range(700)),
        "# one section\n" + "\n".join(prose(20) for _ in range(500)) + "   \n \n   \n\n" + prose(3),
        "\n\n".join(["ab", prose(2000)] * 12),  # chunks shorter than the overlap
        "pre\n" + "\n".join("# " + prose(2).strip() + "x\n" + prose(r.randint(0, 80)) for _ in range(120)),
        prose(4000),  # a single line
        "a" + "\n" * 4000 + "b\n" + " \n" * 3000 + "##\n" + "\n" * 4000,
        "#" * 7 + " seven\n\n#no space\n\n" + "x\n\n" * 3000 + "# end",
        "\n" * 9000,
    ]


@pytest.mark.parametrize(("target", "overlap", "parent", "chars"), [(300, 12, 500, 3000), (100, 300, 100, 9000)])
def test_blocks_give_the_chunks_of_the_whole_text(spark, tmp_path, small_splits, target, overlap, parent, chars):
    texts = random_texts(6, seed=target) + odd_texts()
    want = whole(spark, texts, target, overlap, parent)
    got = by_blocks(spark, tmp_path, texts, target, overlap, parent, chars)
    assert got.keys() == want.keys()
    assert not [k for k in want if got[k] != want[k]]


def test_no_lines_give_no_chunks(spark):
    assert longtext.chunks(spark.createDataFrame([], "document string, split bigint, line string")).count() == 0
    assert longtext.chunks(spark.createDataFrame([("a", 0, None), ("a", 0, "  ")], "document string, split bigint, line string")).count() == 0


def test_the_reader_shuffles_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    plan = longtext.blocks(longtext.lines_of(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_blocks_are_read_one_at_a_time():
    texts = ["# A\n\nx\n", "y\n\n# B\n\nz\n", "w\n"]
    batch = pa.RecordBatch.from_pydict({"document": ["d"] * 3, "split": pa.array([0] * 3, pa.int64()), "seq": pa.array(range(3), pa.int64()), "text": texts})
    made = list(longtext._outlines(iter([batch])))
    assert [b.num_rows for b in made] == [1, 1, 1] and [b["seq"][0].as_py() for b in made] == [0, 1, 2]
    assert [pickle.loads(b["payload"][0].as_py())[0] for b in made] == [len(t) for t in texts]
