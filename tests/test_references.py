import pytest

from actmill.operators import references as rf

D = "doc_id long, added_at timestamp, x string"
Q = "id string, gold_doc_id long, gold_article string, created_at timestamp, extra int"


def test_null_masks(spark):
    refs = spark.createDataFrame([(1, "a"), (1, None), (9, None), (None, None), (None, "z"), (9, "a")], "k long, s string")
    keys = spark.createDataFrame([(1, "a"), (None, "b")], "kk long, ss string")
    got = lambda m: sorted((tuple(r) for r in rf.orphans(refs, keys, {"k": "kk", "s": "ss"}, m).collect()), key=str)
    assert got("simple") == [(9, "a")]
    assert got("partial") == sorted([(9, "a"), (9, None), (None, "z")], key=str)
    assert got("full") == sorted([(9, "a"), (1, None), (9, None), (None, "z")], key=str)
    with pytest.raises(ValueError):
        rf.orphans(refs, keys, {"k": "kk"}, "other")


def test_states(spark):
    from datetime import datetime as dt

    old, mid, new = dt(2024, 1, 1), dt(2024, 5, 1), dt(2025, 1, 1)
    docs = spark.createDataFrame([(1, old, None), (2, new, None), (3, None, None)], D)
    chunks = spark.createDataFrame([(1, "Neni 1"), (1, None)], "doc_id long, cite string")
    acts = spark.createDataFrame([(1, 10, [10, 11, 12, None], 2020), (1, 10, [10, 11, 12, None], 2020), (2, None, None, None)], "doc_id long, act_number int, amends array<int>, act_year int")
    gone = spark.createDataFrame([(7, 12), (8, None)], "doc_id long, act_number int")
    q = [("a", 1, "NENI  1", mid, 0), ("a", 1, "NENI  1", mid, 0), ("b", 1, "Neni 2", mid, 0), ("c", 2, None, mid, 0), ("d", 7, "Neni 1", mid, 0), ("e", 99, None, mid, 0), ("f", None, "Neni 5", mid, 0), ("g", 3, None, None, 0)]
    got = {tuple(r)[:4] for r in rf.reference_states(docs, chunks, acts, gone, spark.createDataFrame(q, Q)).collect()}
    assert got == {("gold_article", "b", "Neni 2", "missing"), ("gold_doc_id", "c", "2", "late"), ("gold_doc_id", "d", "7", "deleted"), ("gold_doc_id", "e", "99", "missing"), ("amends", "1", "11", "missing"), ("amends", "1", "12", "deleted")}
    empty = rf.reference_states(docs.limit(0), chunks.limit(0), acts.limit(0), gone.limit(0), spark.createDataFrame([], Q))
    assert empty.count() == 0
