from pyspark.sql import functions as F

from actmill.operators import evaluation as ev
from actmill.plans import answers as an

HITS = "qid string, rank int, doc_id long, cite string, unit string, heading string, text string"
TEXT = "Tatimpaguesi deklaron tatimin brenda 20 ditëve pas mbylljes së muajit."


def responses(spark):
    q = spark.createDataFrame([("e", "  "), ("n", "moti nesër"), ("l", "x" * 501), ("g", "tatimi"), ("r", "tatimi"), ("x", "Kur e deklaron tatimpaguesi tatimin?"), ("y", "???")], "qid string, question string")
    rows = [(i, k, 10 + k, f"Neni {k}", "u", "Afati" if k == 1 else f"Neni {k}", TEXT + (" <b" if k == 2 else "")) for i in ("e", "l", "g", "r", "x", "y") for k in (1, 2)]
    g = spark.createDataFrame([("g", "Deklaro [S2] dhe [S7]."), ("r", "Nuk e gjej përgjigjen."), ("x", None), ("n", "Shpikje [S1]."), ("l", "Gjatë [S1].")], "qid string, text string")
    return {r.qid: r for r in an.respond(q, spark.createDataFrame(rows, HITS), g).collect()}


def test_every_question_gets_its_response(spark):
    got = responses(spark)
    assert {k: (r.state, r.refused) for k, r in got.items()} == {"e": ("empty", False), "l": ("too_long", False), "n": ("no_hits", True), "g": ("generated", False), "r": ("generated", True), "x": ("extract", False), "y": ("extract", False)}
    assert got["n"].answer == an.REFUSAL and all(got[k].sources == "" for k in ("e", "l", "n", "r"))
    assert got["g"].answer == f"Deklaro [[S2]]({an.ADDRESS}12) dhe [S7]."
    assert got["g"].sources == f"### Burimet\n\n**[S2] Neni 2**  \n<span class='law'>{TEXT} &lt;b</span>  \n[Shkarko dokumentin zyrtar]({an.ADDRESS}12)"
    assert f"> {TEXT}" in got["x"].answer and f"### Neni 1 — Afati  [[S1]]({an.ADDRESS}11)" in got["x"].answer and "[S1]" in got["x"].sources and "[S2]" in got["x"].sources
    assert got["y"].answer.endswith(an.NOTHING_FITS)


def test_earlier_verdicts_are_kept(spark):
    s = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t")], "id string, t string")
    p = spark.createDataFrame([("a", " po ", "mirë"), ("b", " ", "pa vendim"), ("z", "jo", None)], "id string, verdict string, note string")
    assert sorted(tuple(r) for r in ev.carried_over(s, p, "id").collect()) == [("a", "t", "po", "mirë"), ("b", "t", "", ""), ("c", "t", "", "")]


def test_overlap_and_ceiling_of_failures(spark):
    c = spark.createDataFrame([(f"{d}:article:0", d, "article", "u", f"Neni {d}", "titull", t, 0, len(t)) for d, t in ((1, "tatimi mbi pagat deklarohet"), (2, "dogana dhe akciza"), (3, "kontrolli i librave"), (4, "regjistrimi i subjektit"))], "chunk_id string, doc_id long, strategy string, label string, cite string, heading string, text string, part_order int, chars int")
    q = spark.createDataFrame([("a", "tatimi pagat", 1, "neni 1", True), ("b", "akciza zog", 9, "Neni 9", True), ("o", "moti", None, None, False)], "qid string, question string, gold_doc_id long, gold_article string, answerable boolean")
    r = ev.failure_totals(c, q).first()
    assert (r.total, r.hit, r.gold_article_not_in_index, r.overlap_hit, r.overlap_miss, r.ceiling, r.ceiling_rate) == (2, 1, 1, 1.0, 0.0, 1, 50.0)
    assert ev.failure_totals(c, q.filter(F.lit(False))).first().total == 0
