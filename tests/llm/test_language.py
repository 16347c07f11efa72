from pyspark.sql import functions as F

from actmill.llm import language as lg

SQ = "Tatimpaguesi duhet të deklarojë të ardhurat për muajin mars. Subjekti mban dokumentet për pesë vjet me radhë. "
EN = "The taxpayer must declare the income for the month of March. The employer keeps the documents for five years. "
SAMPLES = [(0, "sq", SQ * 2), (1, "en", EN * 2), (2, "sq", None)]


def test_phrases():
    a = lg.SuffixAutomaton("abcab")
    assert a.phrases("abcab") == 1 and a.phrases("abab") == 2 and a.phrases("xy") == 2 and a.phrases("xabc") == 2 and a.phrases("") == 0


def test_many_texts_at_once_match_one_walk_each(monkeypatch):
    """Phrases run across words; figures and punctuation are blanks; unknown letters are phrases of their own."""
    monkeypatch.setattr(lg, "LETTERS", 70)
    samples = {"sq": SQ, "en": EN}
    model = lg.CrossParser(samples)
    texts = [SQ, EN, "", "12 34", "ждаж tatim 5%", "Subjekti, mban -- dokumentet  për", "a", "the income\nfor\t\tthe month", "x" * 40]
    walks = {k: lg.SuffixAutomaton(" " + " ".join(lg._WORD.findall(t.lower())) + " ") for k, t in samples.items()}
    got = model.costs(texts)
    for t, row in zip(texts, got):
        words = lg._WORD.findall(t.lower())
        want = [walks[k].phrases(" " + " ".join(words) + " ") if words else 0 for k in model.langs]
        assert row[-1] == len(words) and [round(x) for x in row[:-1] / model.weight] == want
    assert walks["en"].phrases(" keeps the documents for ") == 1
    # A stretch longer than PIECE is parsed in pieces: at most a phrase more for each.
    monkeypatch.setattr(lg, "PIECE", 16)
    assert (0 <= (model.costs([SQ]) - got[:1])[0, :-1]).all() and round((model.costs([SQ]) - got[:1])[0, 1] / model.weight[1]) <= len(SQ) // 16 + 1


def run(spark, tmp_path, docs):
    spark.createDataFrame(SAMPLES, "sample_id int, lang string, text string").write.parquet(str(tmp_path / "lang_samples.parquet"))
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, lang string, text string, words int").write.parquet(str(tmp_path / "documents.parquet"))
    return {tuple(r) for r in lg.p10_found(spark, str(tmp_path)).collect()}


def test_found(spark, tmp_path):
    docs = [(1, "sq", SQ), (2, " SQI ", SQ), (3, "sq-AL", SQ), (4, "en", SQ), (5, None, EN), (6, "??", EN), (7, "sq", SQ * 2 + "\n\n" + EN), (8, "sq", SQ + "The taxpayer must declare the income. " + SQ), (9, "en", None), (10, None, ""), (11, "und", "12 34"), (12, "de", EN), (12, "de", EN)]
    assert run(spark, tmp_path, docs) == {(4, "sq"), (5, "en"), (6, "en"), (7, "sq"), (7, "en"), (12, "en")}


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == set()


def test_held_out_samples(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").collect()]
    model = lg.CrossParser({k: " ".join(r.text for r in rows if r.lang == k and r.sample_id % 2 == 0) for k in {r.lang for r in rows}})
    test = [r for r in rows if r.sample_id % 2]
    winner, _ = lg.best(model.costs([r.text for r in test])[:, :-1])
    assert sum(model.langs[w] == r.lang for w, r in zip(winner, test)) / len(test) >= 0.97


def test_labels(spark):
    df = spark.createDataFrame([("SQ",), (" eng",), ("de_AT",), ("",), (None,), ("xx",)], "l string")
    assert [r[0] for r in df.select(lg.label_code(F.col("l"))).collect()] == ["sq", "en", "de", None, None, None]
