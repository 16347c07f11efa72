import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from actmill.sources import corpus as co


def test_lines_round_trip(spark, tmp_path):
    p = tmp_path / "x.jsonl.gz"
    with gzip.open(p, "wt", encoding="utf-8") as f:
        f.write('{"doc_id": 1, "title": "Çështje"}\n\n{"doc_id": 2}\n')
    df = co.read_lines(spark, str(p), "doc_id long, title string")
    assert sorted((r.doc_id, r.title) for r in df.collect()) == [(1, "Çështje"), (2, None)]
    co.write_lines(df, str(tmp_path / "out"))
    assert co.read_lines(spark, str(tmp_path / "out"), "doc_id long, title string").count() == 2


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "w.csv")
    co.write_workbook(spark.createDataFrame([("a", "një; dy\ntre", None)], "id string, question string, note string"), p, ("udhëzime", ""))
    assert open(p, "rb").read()[:3] == b"\xef\xbb\xbf"
    r = co.read_workbook(spark, p, "id").collect()
    assert (r[0].id, r[0].question, r[0].note) == ("a", "një; dy\ntre", "")
    with pytest.raises(ValueError):
        co.read_workbook(spark, p, "missing")


def test_office_files_and_magic(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Neni 1</w:t></w:p><w:p><w:t>A &amp; B</w:t></w:p>")
    df = spark.createDataFrame([("a.docx", bytearray(b.getvalue())), ("b.docx", bytearray(b"junk")), ("c.pdf", bytearray(b"%PDF-1"))], "path string, content binary")
    r = {x.path: (x.text, x.error is None) for x in co.office_text(df).collect()}
    assert r["a.docx"] == ("Neni 1\nA &amp; B", True) and r["b.docx"] == (None, False)
    assert {x.path: x.k for x in df.select("path", co.sniff(F.col("content")).alias("k")).collect()} == {"a.docx": "docx", "b.docx": "unknown", "c.pdf": "pdf"}


def test_links_keep_the_longest_title(spark):
    html = '<a href="/d/1">Ligj</a> <A class=x href=\'/d/1\'><b>Ligji i plotë</b></A><a href="/d/2"> </a>'
    a = co.anchors(spark.createDataFrame([("p", html), ("q", None)], "page string, html string"))
    assert [(r.href, r.title) for r in co.longest_title(a, ["href"]).collect()] == [("/d/1", "Ligji i plotë")]


def test_package_checks(spark, tmp_path):
    p = str(tmp_path)
    spark.createDataFrame([(1, "m")], "x int, model string").write.parquet(f"{p}/vectors")
    spark.createDataFrame([], "x int").write.parquet(f"{p}/none")
    assert co.verify_package(spark, p, ("vectors",), "m").first().rows == 1
    for tables, model in ((("vectors",), "other"), (("none",), "m")):
        with pytest.raises(ValueError):
            co.verify_package(spark, p, tables, model)


def test_ingest_is_incremental(spark):
    m = spark.createDataFrame([(1,)], "doc_id long")
    b = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (4, "b")], "doc_id long, cat string")
    assert sorted(r.doc_id for r in co.unseen(b, m, "doc_id").collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in co.unseen(b, m, "doc_id", "cat", 1).collect()) == [2, 4]


def test_every_unseen_document_of_every_batch_is_taken(spark, tmp_path):
    rows = [(1, 0, 1, "a"), (2, 1, 1, "a"), *[(3 + i, 1, 10 + i, "a") for i in range(8)], (20, 2, 10, "a"), (21, 2, 30, "b"), (22, 2, 30, "c")]
    r = spark.createDataFrame(rows, "record_no long, batch_no int, doc_id long, category string")
    r.write.parquet(str(tmp_path / "records.parquet"))
    got = sorted((x.batch_no, x.category, x.doc_id) for x in co.manifest_unseen(spark, str(tmp_path)).collect())
    assert got == [(0, "a", 1), *[(1, "a", 10 + i) for i in range(8)], (2, "b", 30)]
    for b in (0, 1, 2):  # the same as the step for one batch
        assert {d for n, _, d in got if n == b} == {x.doc_id for x in co.unseen(r.filter(f"batch_no = {b}"), r.filter(f"batch_no < {b}"), "doc_id").collect()}
