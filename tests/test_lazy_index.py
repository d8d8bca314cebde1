"""What the index makes, and when."""

from collections import Counter

from pyspark.sql import functions as F

from stratum.functions.text import lexical_tokens
from stratum.operators import segment
from stratum.operators.index import Corpus, postings_table


def test_tables_are_made_when_read_and_rows_numbered_in_order(spark):
    texts = [(50 - i, f"d{i}", None if i == 7 else "" if i == 9 else "\n\n".join(f"# T{k}\n\nword{i} " + "x y " * 900 * k for k in range(i % 3 + 1))) for i in range(40)]
    corpus = Corpus.build(spark.createDataFrame(texts, "source_ord bigint, document string, text string"))
    assert "parent_ord" in corpus.sections.columns and not corpus._made
    sections = corpus.sections.select("parent_ord", "source_ord", "section_index").collect()
    assert [r.parent_ord for r in sorted(sections, key=lambda r: (r.source_ord, r.section_index))] == list(range(len(sections)))
    assert corpus.n_chunks > 0 and set(corpus._made) == {"n_chunks", "chunks"}
    chunks = sorted(corpus.chunks.select("source_ord", "parent_ord", "part_index", "chunk_ord", "chunk_index").collect())
    assert [r.chunk_ord for r in chunks] == list(range(corpus.n_chunks))
    first = {s: min(r.chunk_ord for r in chunks if r.source_ord == s) for s in {r.source_ord for r in chunks}}
    assert all(r.chunk_index == r.chunk_ord - first[r.source_ord] for r in chunks)
    plan = corpus.chunks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    corpus.release()


def test_postings_count_the_lexical_tokens(spark):
    texts = ["A.b a.b -c- --d.-e \u00c9t\u00e9 \u0130x \u212ag \u03a3\u03c3", "\u9879\u76ee x \u4ee3\u53f7 X\u9879\u76ee", "", None, "\u00e9\u00e8", "_a __ 9-9."]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_ord bigint, text string")
    plain = {r.chunk_ord: r.t or [] for r in chunks.select("chunk_ord", lexical_tokens("text").alias("t")).collect()}
    want = {(o, term, tf, len(t)) for o, t in plain.items() for term, tf in Counter(t).items()}
    plan = postings_table(chunks)
    assert {(r.chunk_ord, r.term, r.tf, r.length) for r in plan.collect()} == want
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()


def test_short_texts_are_cut_as_the_fold_cuts_them(spark):
    rows = [(f"{w}\n\n\n " * k + w * n,) for w in ("a", "word ", "\u9879", "\u00e9", "\n") for k in (0, 1, 40, 700) for n in (1, 200, 1190, 1210, 2390, 2500)]
    cut = spark.createDataFrame(rows, "text string").select(segment.newlines("text").alias("t")).where("t <> ''").select(segment._cut(F.col("t"), 1200, 160).alias("a"), segment._chunked(F.col("t"), 1200, 160).alias("b"))
    assert all(r.a == r.b for r in cut.collect())
