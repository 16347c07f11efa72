from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.operators import retrieval as rt


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_folding_stemming_and_stopwords(spark):
    r = one(spark, tx.tokens(F.lit("Tatimet dhe tatimeve, TATIMI për ligje")))[0]
    assert r == ["tatim", "tatim", "tatim", "ligj"]
    assert one(spark, tx.tokens(F.lit(None).cast("string")))[0] == []


def test_a_short_word_keeps_its_ending(spark):
    assert [one(spark, tx.stem(F.lit(w)))[0] for w in ("akt", "neni", "nene", "eve")] == ["akt", "nen", "nen", "eve"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeëçiu tvrshm", max_size=40))
def test_accents_do_not_change_terms(t):
    assert rt.terms_of(t) == rt.terms_of(t.replace("ë", "e").replace("ç", "c"))


def test_column_and_python_terms_agree(spark):
    texts = ["Neni 12 i ligjit për tatimin mbi të ardhurat", "", "Çdo punëdhënës, SHËNIMET e kreditit 2024!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.tokens(F.col("t"))).collect()] == [rt.terms_of(t) for t in texts]


def test_sentences_keep_references_and_drop_fragments(spark):
    t = "Sipas ligjit nr. 92 datë 24.7.2014 subjekti paraqet deklaratën çdo muaj. Shkurt. Tatimpaguesi mban dokumentet për pesë vjet të plota."
    s = one(spark, tx.sentences(F.lit(t)))[0]
    assert len(s) == 2 and s[0].endswith("çdo muaj.")


def test_cleaning(spark):
    r = one(spark, tx.clean_title(F.lit("  Udhëzim  nr. 5 ;. ")), tx.normalise_text(F.lit("Neni12\nfjalë-\nve\nTel: 123\n12\n\n\n\nfund")), tx.normalise_cite(F.lit("Neni  4 (1/2)")), tx.escape_html(F.lit("a < b & c")))
    assert r[0] == "Udhëzim nr. 5" and r[1] == "Neni 12\nfjalëve\n\n12\n\nfund" and r[2] == "neni 4" and r[3] == "a &lt; b &amp; c"


def test_markers_become_links_only_for_known_ranks(spark):
    r = one(spark, tx.link_markers(F.lit("po [S1] jo [S9]"), F.array(F.lit(1)), F.array(F.lit("/u"))))[0]
    assert r == "po [[S1]](/u) jo [S9]"
