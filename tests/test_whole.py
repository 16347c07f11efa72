from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.operators import evaluation as ev
from actmill.operators import retrieval as rt
from actmill.plans import answers as an
from actmill.plans import index as ix


def root(spark, path, n=40):
    """A folder of chunks, each there twice, and questions about them, of which two have a number divisible by 20."""
    text = [f"fjala{i} tatimi paguhet nga subjekti brenda afatit fjala{i % 7}." for i in range(n)]
    c = [(f"{i}:article:0", i, "article", f"Neni {i}", f"Neni {i}", "Titulli", t, len(t), 0) for i, t in enumerate(text)]
    spark.createDataFrame(c + c, "chunk_id string, doc_id long, strategy string, label string, cite string, heading string, text string, chars int, part_order int").write.parquet(f"{path}/chunks.parquet")
    q = [(f"q-{i:03}", f"tatimi fjala{i}", i, f"Neni {i}", True) for i in range(n)]
    spark.createDataFrame(q, "id string, question string, gold_doc_id long, gold_article string, answerable boolean").write.parquet(f"{path}/questions.parquet")
    spark.createDataFrame([("a1", "q-020", "Sipas [1].")], "answer_id string, question_id string, answer string").write.parquet(f"{path}/answers.parquet")
    return str(path)


def test_grid_takes_every_question(spark, tmp_path):
    got = ev.eval_grid(spark, root(spark, tmp_path)).collect()
    assert {r["mode"] for r in got} == set(ev.MODES) and all(r.total == 40 for r in got)
    assert all(r.article_hits == r.doc_hits == 40 for r in got if r["mode"] == "bm25")


def test_grid_searches_once(spark, tmp_path, monkeypatch):
    calls, own = [], rt.searched
    monkeypatch.setattr(rt, "searched", lambda *a: calls.append(a[3]) or own(*a))
    assert ev.eval_grid(spark, root(spark, tmp_path)).count() == 3 and calls == ["hybrid"]


def test_compare_searches_once(spark, tmp_path, monkeypatch):
    calls, own = [], rt.searched
    monkeypatch.setattr(rt, "searched", lambda *a: calls.append(a[3]) or own(*a))
    assert ev.eval_compare(spark, root(spark, tmp_path)).count() == 3 and calls == ["hybrid"]


def test_failures_read_no_texts(spark, tmp_path):
    r = root(spark, tmp_path)
    got = ev.failures(spark.read.parquet(f"{r}/chunks.parquet"), rt.asked(spark, r))
    assert {(x.qid, x.verdict, x["rank"]) for x in got.collect()} == {("q-000", "hit", 1), ("q-020", "hit", 1)}
    assert got._jdf.queryExecution().executedPlan().toString().count("text#") == 0


def test_totals_over_chunks_with_copies(spark, tmp_path):
    r = ev.failure_summary(spark, root(spark, tmp_path)).first()
    assert (r.total, r.hit, r.overlap_hit) == (2, 2, 1.0)


def test_rerank_searches_once(spark, tmp_path, monkeypatch):
    calls, own = [], rt.searched
    monkeypatch.setattr(rt, "searched", lambda *a: calls.append(a[3]) or own(*a))
    assert tuple(ev.rerank_ab(spark, root(spark, tmp_path)).first()) == (2, 2, 2, 0, 0) and calls == ["bm25"]


def test_hybrid_takes_both_arms_of_one_search(spark, tmp_path):
    r = root(spark, tmp_path)
    c, q = spark.read.parquet(f"{r}/chunks.parquet"), rt.asked(spark, r)
    arms = rt.searched(c, q, rt.POOL, "hybrid")
    want = rt.rrf(arms.select("qid", "strategy", "arm", "chunk_id", "rank"), ["qid", "strategy"], "chunk_id", rt.TOP)
    rows = lambda d: sorted((x.qid, x["rank"], x.chunk_id) for x in d.collect())
    assert rows(rt.cited(c, q, "hybrid")) == rows(want)


def test_shared_terms_are_the_overlap(spark):
    d = spark.createDataFrame([("Tatimi mbi pagën", "pagat dhe tatimet"), ("tjeter", "x"), (None, None), ("akti", "akti akti"), ("akti i ri", None)], "q string, t string")
    got = d.select(rt.shared_terms(F.col("q"), F.col("t")).alias("a"), rt.overlap(tx.tokens(F.col("q")), tx.tokens(F.col("t"))).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got]


def test_extracts_over_chunks_with_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rt, "store_postings", None)
    got = rt.answers_extractive(spark, root(spark, tmp_path)).collect()
    assert len(got) == len({(x.qid, x["rank"]) for x in got}) > 0


def test_contexts_without_stored_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rt, "store_postings", None)
    assert {x.qid for x in ix.answer_contexts(spark, root(spark, tmp_path)).collect()} == {"q-000", "q-020"}


def test_responses_without_stored_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rt, "store_postings", None)
    assert {x.qid: x.state for x in an.answers_responded(spark, root(spark, tmp_path)).collect()} == {"q-000": "extract", "q-020": "generated"}
