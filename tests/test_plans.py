import pytest
from pyspark.sql import functions as F

from actmill.functions import restoration as re_
from actmill.operators import evaluation as ev
from actmill.plans import index as ix


def test_restoration(spark):
    t = spark.createDataFrame([("për për për per",), ("akt akt akt",), ("faturë",), ("është ËSHTË është eshte eshte",), (None,)], "text string")
    m = re_.learn(t)
    assert {tuple(r) for r in m.collect()} == {("per", "për")}
    q = spark.createDataFrame([(1, "Per kë, PER akt; për?"), (2, None), (3, "")], "id int, q string")
    assert {r.id: r.q for r in re_.restore(q, m, "id", "q").collect()} == {1: "Për kë, PËR akt; për?", 2: None, 3: ""}
    assert {r.id: r.q for r in re_.restore(q, m.limit(0), "id", "q").collect()}[1] == "Per kë, PER akt; për?"


def test_index_package(spark, tmp_path):
    text = "".join(f"Neni {i}\nTitulli {i}\n{'Subjekti paguan tatimin e vlerës ' + str(i) + ' në afat. ' * 8}\n" for i in range(1, 5))
    d = spark.createDataFrame([(1, text), (2, "Prozë pa strukturë për doganat. " * 20), (3, None)], "doc_id long, text string")
    ix.build_index(d, str(tmp_path))
    q = spark.createDataFrame([("q", "doganat")], "qid string, question string")
    hits = ix.search_index(spark, str(tmp_path), q, mode="bm25").collect()
    assert [(h.doc_id, h.unit) for h in hits] == [(2, "Pjesa 1/1")]
    context = ix.context_blocks(ix.search_index(spark, str(tmp_path), q)).first().context
    assert context.startswith("[S1] Pjesa 1/1 — \nBurimi: 2\nProzë")
    # The stored index gives what a search that makes its own gives, also with expanded query vectors.
    chunks = spark.read.parquet(f"{tmp_path}/chunks").filter("strategy = 'article'")
    for mode in ("bm25", "dense", "hybrid"):
        rows = lambda d: [(r.qid, r.chunk_id, r.rank) for r in d.orderBy("qid", "rank").collect()]
        ask = spark.createDataFrame([("a", "tatimin e vlerës"), ("b", "doganat"), ("c", "e"), ("d", None)], "qid string, question string")
        assert rows(ix.search_index(spark, str(tmp_path), ask, mode=mode, expand=True)) == rows(ix.rt.retrieve(chunks, ask, mode, expand=True))
    stored = ix.rt._postings(spark, f"{tmp_path}/lexical")
    asked = stored.filter(stored.bucket == 3).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("bucket=3/" in r.f for r in asked)


def test_saved_map(spark, tmp_path):
    m = spark.createDataFrame([("per", "për"), ("kete", "këtë")], "skeleton string, form string")
    re_.save(m, str(tmp_path / "m"))
    re_.save(m.limit(1), str(tmp_path / "m"))
    assert [tuple(r) for r in re_.load(spark, str(tmp_path / "m")).collect()] == [("per", "për")]


def test_verdict_margin(spark):
    r = spark.createDataFrame([(30.0, 40.0), (30.0, 39.9), (40.0, 10.0)], "a double, b double").select(ev.verdict(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == ["second", "no clear difference", "first"]


def test_review(spark):
    c = spark.createDataFrame([("a", "vjetër", "Neni 1"), ("b", "x", "Neni 2"), ("c", None, None)], "qid string, question string, gold_article string")
    e = spark.createDataFrame([("a", " e re ", "  ", True), ("b", "y", "z", False), ("c", "", "", True), ("zz", "y", "z", True)], "qid string, question string, gold_article string, reviewed boolean")
    assert [tuple(r) for r in ev.apply_review(c, e).collect()] == [("a", "e re", "Neni 1")]


@pytest.mark.parametrize(("q", "a", "form"), [("Çfarë ndodh nëse vonoj?", "pa asgjë", "pasojë"), ("Kur paguaj?", "brenda muajit", None), ("Sa kushton?", "shërbimi falas", "shumë"), (None, None, None)])
def test_forms(spark, q, a, form):
    df = spark.createDataFrame([(q, a)], "q string, a string")
    assert df.select(ev.unsupported_form(F.col("q"), F.col("a"))).first()[0] == form


def test_review_keeps_questions_out_of_scope_and_counts_what_it_leaves_out(spark):
    q = "qid string, question string, gold_doc_id long, gold_article string"
    c = spark.createDataFrame([("a", "vjetër", 1, "Neni 1"), ("b", "x", 2, "Neni 2"), ("c", "y", 3, "Neni 3")], q)
    o = spark.createDataFrame([("o", "moti?", None, None), ("p", "futboll?", None, None)], q)
    e = spark.createDataFrame([("a", " e re ", " ", True), ("b", "y", "z", False), ("c", " ", "", True), ("zz", "y", "z", True), ("o", "y", "z", True), (" ", "y", "z", True)], "qid string, question string, gold_article string, reviewed boolean")
    assert sorted(tuple(r) for r in ev.import_review(c, e, o).collect()) == [("a", "e re", 1, "Neni 1", False), ("o", "moti?", None, None, True), ("p", "futboll?", None, None, True)]
    assert tuple(ev.import_counts(c, e, o).first()) == (3, 2, 1, 1, 2)
    assert tuple(ev.import_counts(c.limit(0), e.limit(0), o.limit(0)).first()) == (0, 0, 0, 0, 0)
