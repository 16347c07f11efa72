from datetime import datetime, timedelta

from actmill.streaming import limits as li

T0 = datetime(2024, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame([(i, s, None if t is None else T0 + timedelta(seconds=t)) for i, (s, t) in enumerate(rows)], "call_id long, session string, ts timestamp")


def test_denied_calls_leave_no_trace(spark):
    r = {x.call_id: (x.allowed, x.wait) for x in li.admit(calls(spark, [("a", 0), ("a", 1), ("a", 2), ("a", 600), ("a", 601), ("b", 2), (None, 5), ("a", None)]), 2, 600).collect()}
    assert [r[i][0] for i in range(8)] == [True, True, False, False, True, True, True, False] and r[2][1] == 10


def test_common_limit_comes_first(spark):
    r = {x.call_id: (x.allowed, x.wait) for x in li.admit(calls(spark, [("a", 0), ("b", 1), ("c", 2), ("c", 3601)]), 5, 600, 2, 3600).collect()}
    assert r == {0: (True, 0), 1: (True, 0), 2: (False, -1), 3: (True, 0)}
    assert li.admit(calls(spark, [("a", 0)]).limit(0)).count() == 0


def test_the_stream_decides_as_the_batch(spark, tmp_path):
    rows = [(s, t) for t in range(0, 4000, 90) for s in ("a", "b")]
    df = calls(spark, rows)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = li.admit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 600)
    q = s.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(x.call_id, x.allowed) for x in li.admit(df, 3, 600).collect()}
    assert {(x.call_id, x.allowed) for x in spark.table("admitted").collect()} == want


def test_new_documents_once(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "doc_id long").write.parquet(str(tmp_path / "in"))
    s = li.new_documents(spark.readStream.schema("doc_id long").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("fresh").count() == 2
