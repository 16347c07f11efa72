import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from actmill.operators import retrieval as rt

SCHEMA = "chunk_id string, doc_id long, strategy string, label string, cite string, heading string, text string, chars int, extra string"


def chunks(spark, texts):
    return spark.createDataFrame([(f"{i}:article:0", i, "article", f"Neni {i}", f"Neni {i}", None, t, len(t or ""), "x") for i, t in enumerate(texts)], SCHEMA)


def asked(spark, *qs):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(qs)], "qid string, question string")


def test_bm25_matches_the_formula(spark):
    texts = ["tatimi mbi vleren", "akti per tatimin dhe tatimin", "pagat e punes", "", None, "kontrolli i pagave"]
    got = {r.chunk_id: r.score for r in rt.bm25(chunks(spark, texts), asked(spark, "tatimi i pagave")).collect()}
    docs = [rt.terms_of(f"Neni {i}\n{t}" if t is not None else None) for i, t in enumerate(texts)]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    terms = {t for d in docs for t in d}
    raw = {t: math.log(n - sum(t in d for d in docs) + 0.5) - math.log(sum(t in d for d in docs) + 0.5) for t in terms}
    mean = sum(raw.values()) / len(raw)
    want = {}
    for i, d in enumerate(docs):
        s = sum((0.25 * mean if raw[t] < 0 else raw[t]) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in rt.terms_of("tatimi i pagave") if t in d)
        if s > 0:
            want[f"{i}:article:0"] = round(s, 9)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_agreement_wins_and_ties_prefer_the_first_arm(spark):
    arms = spark.createDataFrame([("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1), ("q", 1, "c", 2), ("q", 0, "d", 3), ("q", 1, "e", 3)], "qid string, arm int, key string, rank int")
    r = [x.key for x in rt.rrf(arms, ["qid"], "key", 5).orderBy("rank").collect()]
    assert r == ["b", "a", "c", "d", "e"]


def test_one_hit_per_citation(spark):
    c = chunks(spark, ["tatimi"] * 3).withColumn("doc_id", F.lit(1)).withColumn("cite", F.when(F.col("chunk_id") == "2:article:0", "Neni 9").otherwise("Neni 1"))
    r = rt.retrieve(c, asked(spark, "tatimi"), "dense", k=5).collect()
    assert sorted(x.rank for x in r) == [1, 2]


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vid long, v array<double>")
    got = rt.dense(df, df.filter("vid % 20 = 0").select(F.col("vid").alias("qid"), "v"), 3, "vid", "qid").collect()
    for q in (0, 20):
        s = v @ v[q]
        assert [r.vid for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [int(i) for i in np.argsort(-s)[:3]]


def test_degenerate_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="vector of length"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(rt.checked(F.col("v"))).collect()


def test_expansion_without_hits_changes_nothing(spark):
    q = spark.createDataFrame([("q", [0.6, 0.8])], "qid string, v array<double>")
    none = spark.createDataFrame([], "vid long, v array<double>")
    assert rt.expanded(none, q, "vid", "qid").first().v == pytest.approx([0.6, 0.8])


def test_empty_tables_and_unknown_modes(spark):
    none = chunks(spark, ["x"]).limit(0)
    for mode in ("dense", "bm25", "hybrid"):
        assert rt.retrieve(none, asked(spark, "tatimi"), mode).count() == 0
        assert rt.retrieve(chunks(spark, ["tatimi"]), asked(spark, "", None), mode).count() == 0
    with pytest.raises(ValueError):
        rt.retrieve(none, asked(spark, "x"), "other")


def test_passages_in_the_order_of_the_text(spark):
    t = "Tatimi paguhet nga subjekti brenda 10 ditëve nga njoftimi. Kjo fjali nuk flet për asgjë të ngjashme me të. Tatimi llogaritet çdo muaj nga subjekti vetë."
    c, q = chunks(spark, [t, "akti i pare", "pagat e punes", "kodi doganor"]), asked(spark, "kur paguhet tatimi nga subjekti")
    r = rt.passages(rt.retrieve(c, q, "bm25"), q).collect()
    assert [s[:15] for s in r[0].sentences] == ["Tatimi paguhet ", "Tatimi llogarit"]
