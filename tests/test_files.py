import base64
import io
import zipfile

import pytest

from stratum.sources import files, web
from stratum.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def docx():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some</w:t><w:tab/><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    return package(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx():
    return package(**{"ppt__slides__slide1.xml": f"<p {A}><a:t>Hello</a:t></p>", "ppt__slides__slide10.xml": f"<p {A}><a:t>Last</a:t></p>", "ppt__slides__slide2.xml": f"<p {A}><a:t>Next</a:t></p>", "ppt__notesSlides__notesSlide1.xml": f"<p {A}><a:t>1</a:t><a:t>say this</a:t></p>"})


def test_docx_keeps_headings_and_tables():
    parsed = files.parse_file("x.DOCX", docx())
    assert parsed.text.split("\n\n")[0] == "# Title" and "Some\ttext" in parsed.text and "## 表格 1" in parsed.text and "a | b" in parsed.text
    assert parsed.metadata == {"paragraphs": 2, "tables": 1}


def test_pptx_orders_slides_and_keeps_notes():
    text = files.parse_file("deck.pptx", pptx()).text
    assert text == "## 第 1 页\n\nHello\n\n### 演讲者备注\n\nsay this\n\n## 第 2 页\n\nNext\n\n## 第 3 页\n\nLast"


@pytest.mark.parametrize(("name", "data"), [("a.exe", b"x"), ("a.docx", b"no zip"), ("a.txt", b""), ("a.txt", b"  "), ("a.doc", b"x"), ("noext", b"x")])
def test_bad_files_are_refused(name, data):
    with pytest.raises(files.ParseError):
        files.parse_file(name, data)


def test_text_encodings():
    assert files.parse_file("a.md", "﻿hé".encode()).text == "hé"
    assert files.parse_file("a.txt", "abc".encode("utf-16")).text == "abc"


def test_files_and_uploads_as_tables(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"zip?")
    rows = {r.name: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["one.docx"].error is None and rows["one.docx"].metadata["tables"] == 1
    assert rows["bad.docx"].text is None and "damaged" in rows["bad.docx"].error
    sent = spark.createDataFrame([("t.txt", base64.b64encode(b"hello").decode()), ("u.txt", "%%%")], "name string, content_base64 string")
    rows = {r.name: r for r in files.uploads(sent).collect()}
    assert rows["t.txt"].text == "hello" and rows["u.txt"].error


def test_stream_ingests_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nfirst body\n\n# B\n\nsecond body")
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 2
    assert {r.term: r.df for r in ingest.document_frequencies(spark, str(tmp_path / "out")).collect()}["body"] == 2


def test_web_results(spark):
    page = '<ol><li class="b_algo" x><h2><a href="https://a/?x=1&amp;y=2">第一条 <b>结果</b></a></h2><p>text &amp; more</p></li><li class="b_algo"><h2><a href="https://a/?x=1&amp;y=2">again</a></h2></li><li class="b_algo"><h2><a href="ftp://b">no</a></h2></li></ol>'
    rows = web.html_results(spark.createDataFrame([(1, page)], "query_id int, html string")).collect()
    assert [(r.position, r.title, r.url, r.snippet) for r in rows] == [(1, "第一条 结果", "https://a/?x=1&y=2", "text & more")]
    body = '{"results": [{"title": "", "url": "http://c", "content": "s"}, {"title": "t", "url": "x:"}, {"title": "t2", "url": "http://c"}]}'
    rows = web.json_results(spark.createDataFrame([(1, body)], "query_id int, body string")).collect()
    assert [(r.title, r.url) for r in rows] == [("http://c", "http://c"), ("t2", "http://c")]
    assert web.as_sources(web.json_results(spark.createDataFrame([(1, body)], "query_id int, body string"))).count() == 2


def test_many_files_are_passed_on_together(spark):
    files_ = spark.createDataFrame([(f"/d/{i}.txt", b"" if i % 5 == 0 else b"x" * i) for i in range(300)], "path string, content binary").coalesce(1)
    parsed = files.parse_files(files_, 200)
    assert "MapInArrow" in parsed._jdf.queryExecution().executedPlan().toString()
    got = {r.name: (r.text, r.source_bytes, r.metadata, r.error is None) for r in parsed.collect()}
    assert got == {f"{i}.txt": ("x" * i if i % 5 and i <= 200 else None, i if i % 5 else 0, {}, bool(i % 5) and i <= 200) for i in range(300)}
