import numpy as np
import pytest

from actmill.llm import scans as sc
from actmill.llm.lines import noise_of

GOOD = "shqyrton tatimin kodit dhe udhëzimit njoftimi drejtoria magazinimit "


@pytest.mark.parametrize(("line", "kind"), [("Faqe 12", "page"), ("~3~", "page"), ("— 44 —", "page"), ("[19]", "page"), ("9 / 131", "page"), ("f. 41/137", "page"), ("ZYRA E BORAS Nr. Prot. 57", "header"), ("9 | Fletët e akteve, nr. 52 / 2016", "both"), ("Manuali i shlyerjes • botimi 3   12", "both"), ("Bora — Arkiva Qendrore", "header"), ("nenit 96.", ""), ("Neni 4", ""), ("810 200.", "")])
def test_lines(line, kind):
    assert noise_of(line) == kind


def tables(spark, rows):
    c = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id string, doc_id long, text string, heading string, word string")
    d = spark.createDataFrame([(1, "Për kufijtë e licencimit të pagave sezonale", "neni"), (2, None, "standard")], "doc_id long, title string, regime string")
    return c, d, spark.createDataFrame([(3, "Për metodikën e kompensimit të detyrimeve")], "doc_id long, subject string")


ROWS = [
    ("m", 1, "Drejtoria shqyrton tati¢in, tatirnin dhe koclit.", None), ("c", 1, "Kodi F424 dhe A-526, sipas nenit 96. Vetëm prozë.", "Objekti"), ("h", 1, "drejtoria shqy-\nrton tatimin", None),
    ("g", 1, "drejtoria shqy¬\n\nFaqe 3\n\nrton tatimin", None), ("t", 1, "drejtoria shqyrton\nPër kufijtë e licencimit të pagave sez\ntatimin sipas kodit.", None), ("s", 1, "tatimin sipas kodit.\nPër metodikën e kompensimit të   12", None),
    ("p", 1, "drejtoria shqyrton\n\n44\n\ntatimin", None), ("n", 2, "9\nDrejtoria shqyrton tatimin.", None), ("2:fixed:0", 2, "Mbaroi.\n10\nDrejtoria.", None), ("k", 1, "Tekst.", "Njof-\ntimi"), ("0", 1, None, None), ("e", 1, "", ""),
    ("h", 1, "drejtoria shqy-\nrton tatimin", None), *[(f"v{i}", 1, GOOD * 3, None) for i in range(20)],
]


def test_kinds_of_noise(spark):
    got = {tuple(r) for r in sc.noise(*tables(spark, ROWS)).collect()}
    assert got == {("m", "misread"), ("h", "hyphen"), ("g", "hyphen"), ("g", "page_no"), ("t", "header"), ("s", "header"), ("s", "page_no"), ("p", "page_no"), ("k", "hyphen")}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    want = {tuple(r) for r in sc.noise(*tables(spark, ROWS)).collect()}
    monkeypatch.setattr(sc, "_bitmap", lambda words: np.full(4096, 255, np.uint8))
    assert {tuple(r) for r in sc.noise(*tables(spark, ROWS)).collect()} == want and ("m", "misread") in want


def test_long_words_other_alphabets_and_many_confusions(spark):
    rare, right = "rnagaziriirn" + "e" * 60 + "rn", "magazinim" + "e" * 60 + "m"
    words = [(right, 500, 500), (rare, 1, 1), ("налог", 300, 300), ("на1ог", 1, 1), ("a1s1an¢l11sc11e", 1, 1), ("aislandlische", 400, 400), ("lire", 2, 2), ("me", 900, 900)]
    got = {r.word: r.right for r in sc.misread(spark.createDataFrame(words, "word string, n long, n_rows long")).collect()}
    assert got == {rare: right, "a1s1an¢l11sc11e": "aislandlische", "на1ог": None}


def test_headers_that_recur_in_a_document(spark):
    line = "Fletorja e njoftimeve të degës qendrore"
    rows = [(f"{d}:article:{i}", d, f"drejtoria shqyrton {i}\n{line}\ntatimin sipas kodit {i}.", None) for d, n in ((1, 3), (2, 1)) for i in range(n)]
    assert {tuple(r) for r in sc.noise(*tables(spark, rows)).collect()} == {(f"1:article:{i}", "header") for i in range(3)}


def test_repair(spark):
    t = {r.chunk_id: (r.heading, r.text) for r in sc.repaired(*tables(spark, ROWS)).collect()}
    assert t["g"][1] == "drejtoria shqyrton tatimin" and t["t"][1] == "drejtoria shqyrton tatimin sipas kodit." and t["k"] == ("Njoftimi", "Tekst.") and t["0"] == (None, None)
    assert "tatimin dhe kodit" in t["m"][1]


def test_empty(spark):
    assert sc.noise(*(x.limit(0) for x in tables(spark, ROWS))).count() == 0


def test_copies_do_not_make_a_misreading_frequent(spark):
    copies = [(f"c{i}", i, "drejtoria shqyrton tatirnin", "Njoftirni") for i in range(20)]
    other = [(f"o{i}", 100 + i, f"{GOOD}numri {i} njoftimi", None) for i in range(40)]
    rows = tables(spark, copies + other)
    assert {tuple(r) for r in sc.noise(*rows).collect()} == {(c[0], "misread") for c in copies}
    assert {(r.heading, r.text) for r in sc.repaired(*rows).filter("chunk_id like 'c%'").collect()} == {("Njoftimi", "drejtoria shqyrton tatimin")}
