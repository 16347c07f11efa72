from pyspark.sql import functions as F

from actmill.operators import acts as ac
from actmill.operators import obligations as ob


def parse(spark, *titles, category="x"):
    d = spark.createDataFrame([(i, t, category, None, None, None, None) for i, t in enumerate(titles)], "doc_id long, title string, category string, domain string, authority string, n_articles int, regime string")
    return ac.parse_acts(d).orderBy("doc_id").collect()


def test_titles(spark):
    r = parse(spark, "VKM Nr.783 datë 10.11.2011 “Për procedurat e regjistrimit”", "Ligj nr. 92/2014 për TVSH-në", "Udhëzim nr. 5 datë 40.13.2011", "Për disa ndryshime në ligjin nr.9920 datë 19.5.2008", None)
    assert (r[0].act_type, r[0].number, r[0].date, r[0].subject) == ("VKM", 783, "2011-11-10", "Për procedurat e regjistrimit")
    assert (r[1].act_type, r[1].number, r[1].year) == ("Ligj", 92, 2014)
    assert r[2].date is None and r[2].year == 2011
    assert r[3].number is None and r[3].amends == [9920] and r[3].is_amendment
    assert r[4].act_type is None and r[4].subject == "" and r[4].amends == []


def test_no_self_reference_and_category_fallback(spark):
    r = parse(spark, "Ligj nr. 9920 ndryshon ligjin nr. 9920", "Austri", category="marreveshje-kombetare")
    assert r[0].amends == [] and r[1].act_type == "Marrëveshje"


def obligations(spark, text, archival=False):
    c = spark.createDataFrame([("1:article:0", 1, "article", "Neni 1", "H", text, "z")], "chunk_id string, doc_id long, strategy string, cite string, heading string, text string, domain string")
    d = spark.createDataFrame([(1, None, "A", archival, "u")], "doc_id long, domain string, authority string, archival boolean, url string")
    return ob.extract(c, d).collect()


def test_duties(spark):
    t = "Çdo punëdhënës duhet të paraqesë formularin brenda dhjetë ditëve; gjobë 10 000 lekë ose 15% e shumës. " + "x " * 300 + "Ai duhet të shkojë."
    r = obligations(spark, t)
    assert len(r) == 1 and (r[0].subject, r[0].deadline_days, r[0].penalty, r[0].rates, r[0].amounts) == ("punëdhënësi", 10, "gjobë", ["15%"], ["10 000 lekë"])
    assert r[0].obligation_id == "1:Neni1:0" and "deadline_relative" in r[0].matched_by
    assert obligations(spark, "Tatimpaguesi duhet të deklarojë deri më 14 nëntor.")[0].deadline_date == "--11-14"
    assert obligations(spark, t, archival=True) == [] and obligations(spark, None) == [] and obligations(spark, "") == []


def test_units(spark):
    for words, days in (("brenda 3 javëve", 21), ("brenda dy muajve", 60), ("jo më vonë se 1 vit", None), ("brenda 2 viteve", 730)):
        r = obligations(spark, f"Tatimpaguesi duhet të paguajë {words} nga njoftimi.")
        assert r[0].deadline_days == days, words


def test_search_keeps_the_richest_of_an_article_and_needs_known_days(spark):
    schema = "obligation_id string, chunk_id string, doc_id long, cite string, heading string, domain string, subject string, duty_span string, deadline_text string, deadline_days int, rates array<string>, penalty string, form string"
    rows = [("a", "c", 1, "Neni 1", None, "d", None, "duhet", "brenda 5 ditëve", 5, [], "dënohet", None), ("b", "c", 1, "Neni 1", None, "d", "x", "duhet të përgatisë", "brenda 9 ditëve", 9, ["1%"], "gjobë", "f"), ("c", "c", 2, "Neni 1", None, "d", None, "duhet", None, None, [], None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r.obligation_id for r in ob.search(df).collect()] == ["b", "c"]
    assert [r.obligation_id for r in ob.search(df, max_days=30).collect()] == ["b"]
    assert [r.obligation_id for r in ob.search(df, with_penalty=True).collect()] == ["b"]
    assert [r.obligation_id for r in ob.search(df, text="PERGATISE").collect()] == ["b"]
    assert ob.search(df.limit(0)).count() == 0


def test_router(spark):
    q = spark.createDataFrame([("Cilat janë detyrime të mia?",), ("Çfarë është TVSH?",), (None,)], "q string")
    assert [r[0] for r in q.select(ob.is_table_question(F.col("q"))).collect()] == [True, False, False]
