from pyspark.sql import functions as F

from actmill.llm import lookalikes as lk


def right(spark, *words):
    v = spark.createDataFrame([(w, n) for w, n in words], "word string, n long")
    return {r.word: r.canonical for r in lk.classes(v).collect()}


def test_every_kind_of_disguise(spark):
    clean = [("tatimor", 9), ("Blerësi", 9), ("verifikon", 9), ("shlyerjes", 9), ("Group", 9), ("resume", 5), ("résumé", 4), ("a", 9)]
    odd = {
        "ｔａｔｉｍｏｒ": "tatimor", "Blerësi": "Blerësi", "veriﬁkon": "verifikon", "shlye​rjes": "shlyerjes", "Ｇｒｏｕｐ": "Group", "tаtimor": "tatimor", "16\xa0muajve": "16 muajve",
        "résumé": "résumé", "а": "a", "１２": "12", "ka­pitull": "kapitull",
    }
    got = right(spark, *clean, *[(w, 1) for w in odd])
    assert {w: got[w] for w in odd} == odd


def test_words_rightly_in_another_alphabet_stay(spark):
    got = right(spark, ("Ταμείο", 3), ("Εισφορών", 3), ("Москва", 1), ("tatimi", 2))
    assert all(w == c for w, c in got.items())


def test_case_and_ties_are_kept_apart(spark):
    got = right(spark, ("Neni", 5), ("neni", 9), ("Ｎｅｎｉ", 1), ("ｎｅｎｉ", 1), ("NENI", 1), ("ＮＥＮＩ", 1))
    assert got == {"Ｎｅｎｉ": "Neni", "ｎｅｎｉ": "neni", "ＮＥＮＩ": "NENI"}


def test_ordinary_signs_are_no_cases(spark):
    df = spark.createDataFrame([("“ad valorem” – 5° … «ne»\nrresht",), ("një fjalë",), (None,), ("",)], "t string")
    assert [bool(r[0]) for r in df.select(F.col("t").rlike(lk.ODD_SQL)).collect()] == [False, True, False, False]


def test_queries_on_small_tables(spark, tmp_path):
    c = spark.createDataFrame([("1:a:0", "tatimi​ paguhet"), ("1:a:0", "tatimi​ paguhet"), ("1:a:1", None), ("1:a:2", ""), ("1:a:3", "tatimi paguhet")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "ｋｕｒ paguhet?"), ("r", "kur?")], "id string, question string")
    c.write.parquet(str(tmp_path / "chunks.parquet"))
    q.write.parquet(str(tmp_path / "questions.parquet"))
    assert {tuple(r) for r in lk.p3_found(spark, str(tmp_path)).collect()} == {("chunk", "1:a:0"), ("question", "q")}
    t = {r.row_key: (r.text, r.n_words) for r in lk.p3_text(spark, str(tmp_path)).collect()}
    assert t["1:a:0"] == ("tatimi paguhet", 1) and t["q"] == ("kur paguhet?", 1) and t["1:a:1"] == (None, 0) and t["1:a:2"] == ("", 0)


def test_letters_that_resemble_none_and_long_words(spark):
    long = "Aa" * 30
    v = spark.createDataFrame([("tatiмit", 1), ("налог", 5), ("\u13d9ax", 1), ("tatimi", 9), (long + "xyZ", 3), (long + "xy\uff3a", 1), (long + "xyz", 9)], "word string, n long")
    got = {r.word: (r.canonical, r.mixed) for r in lk.classes(v).collect()}
    found = {r.word for r in lk.disguised(v).collect()}
    assert found == {"tatiмit", "\u13d9ax", long + "xy\uff3a"} and got["tatiмit"][1] and got["налог"] == ("налог", False)
    assert got[long + "xy\uff3a"][0] == long + "xyZ"
