import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from actmill.llm import history as h

S = "record_no long, batch_no int, sha256 string, url string, n_bytes long, fetched_at string, token string, hash string"


def found(spark, rows):
    return {r.record_no for r in h.duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], S)).collect()}


def test_spellings_of_a_download(spark):
    urls = [
        "https://a-b.example/akte/12.pdf", "http://WWW.A-B.example:443//akte/12.pdf?sid=9#top", "https://a-b.example/%61kte/12.pdf", " https://a-b.example/akte/12.pdf/ ",
        "https://a-b.example/merr?dok=12", "https://a-b.example/merr?v=2&dok=0012", "https://c.example/akte/12.pdf", "https://a-b.example/akte/13.pdf", "", None,
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", h.download_tokens(F.col("u")).alias("k"))
    k = {r.i: None if r.k is None else tuple(r.k) for r in df.collect()}
    assert k[0] == k[1] == k[2] == k[3] and k[4] == k[5] and len({k[0], k[4], k[6], k[7]}) == 4 and k[8] is None and k[9] is None


def test_rules(spark):
    u = "https://x.example/akte/1.pdf"
    rows = [
        (1, 0, "AA", u, 5, "2024-01-01T00:00:00Z"),
        (2, 0, " sha256:aa ", "https://y.example/akte/2.pdf", 5, "2024-01-01T00:00:00Z"),  # same hash
        (3, 0, "bb", u, 5, "2024-01-02T01:00:00+02:00"),  # 23 hours later
        (4, 0, "cc", u, 5, "2024-01-02T00:00:00+00:00"),  # 24 hours later: accepted
        (5, 1, None, u, 5, None),  # no hash, known download
        (6, 1, "dd", u, 0, "2030-01-01T00:00:00Z"),  # failed download: no hash
        (7, 1, "bb", "https://z.example/akte/3.pdf", 5, None),  # its twin was no accepted line
        (8, 1, None, None, 5, None), (9, 1, None, None, 5, None), (10, 1, "", "https://q.example/merr?dok=5", 5, "no time"),
        (11, 2, "  ", "https://www.q.example/merr?dok=5", None, None), (12, 2, "ee", u, 5, "bad"),
    ]
    assert found(spark, rows) == {2, 3, 5, 6, 11}


def test_hot_download_matches_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        hot = rng.random() < 0.5
        at = datetime.fromtimestamp(1_700_000_000 + rng.randrange(8 * 86400)).isoformat() + "+00:00"
        rows.append((i, i // 80, rng.choice([None, f"h{rng.randrange(60)}"]), f"https://x.example/akte/{1 if hot else rng.randrange(25)}.pdf", 3, at))
    hashes, times, want = set(), {}, set()
    for no, _, sha, url, _, at in rows:
        t = datetime.fromisoformat(at).timestamp()
        near = [x for x in times.get(url, []) if abs(x - t) < 86400]
        if (sha in hashes or near) if sha else url in times:
            want.add(no)
        else:
            hashes |= {sha} - {None}
            times.setdefault(url, []).append(t)
    assert found(spark, rows) == want


def test_empty(spark):
    assert h.duplicates(spark.createDataFrame([], S)).count() == 0


def numbered(spark, numbers, hash_of="h{}"):
    rows = [(i, 0, hash_of.format(i), f"https://x{i % 3}.example/akte/{i}.pdf", 3, "2024-01-01T00:00:00Z", "", "") for i in numbers]
    return h.lines(spark.createDataFrame(rows, S))


def bytes_of(df):
    read = [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    return sum(os.path.getsize(f.removeprefix("file://")) for f in read)


def test_a_new_batch_reads_its_own_buckets_and_the_index_outlives_the_caller(spark, tmp_path):
    first = numbered(spark, range(4000))
    index = h.Index.create(first, str(tmp_path / "index"), buckets=64)
    assert h.take(index, first).count() == 0
    index = h.Index(spark, str(tmp_path / "index"))
    read = {}
    for n in (2, 6):
        batch = numbered(spark, range(5000, 5000 + n), "h7")
        sets = index.prefixes(h.token_sets(batch), 1.0)
        asked, seen = index.buckets_of(sets, h.keyed(batch))
        read[n] = bytes_of(index.postings(asked)) + bytes_of(index.sightings(seen))
    every = bytes_of(index.postings(list(range(64)))) + bytes_of(index.sightings(list(range(64))))
    assert read[2] < read[6] < 0.25 * every
    assert sorted(r[0] for r in h.take(index, numbered(spark, [3, 9000, 9001], "h7")).collect()) == [3, 9000, 9001]
    assert [r[0] for r in h.take(index, numbered(spark, [9002, 9003], "new")).collect()] == [9003]
    assert [r[0] for r in h.take(index, numbered(spark, [9004], "new")).collect()] == [9004]


@pytest.mark.parametrize("overlap", [0.5, 0.6, 1.0])
def test_near_sets_match_brute_force_whatever_is_hot(spark, tmp_path, monkeypatch, overlap):
    monkeypatch.setattr(h, "RANKED", 2)
    monkeypatch.setattr(h, "HOT", 5)
    rng = random.Random(3)
    url = lambda: f"https://h{rng.randrange(3)}.example/p{rng.randrange(4)}?id={rng.randrange(1, 6)}"
    made = [[(i, 0, None, url(), 3, None, "", "") for i in range(n)] for n in (60, 30)]
    first, second = (h.lines(spark.createDataFrame(m, S)) for m in made)
    index = h.Index.create(first, str(tmp_path / "index"), overlap=overlap)
    h.take(index, first)
    old, new = ({r.url: set(r.url_tokens) for r in x.collect()} for x in (first, second))
    want = {(a, b) for a, x in new.items() for b, y in old.items() if len(x & y) >= overlap * len(x | y) - 1e-9}
    assert {tuple(r) for r in h.near_sets(index, second, overlap).collect()} == want


def test_a_hot_hash_and_rows_with_one_number(spark):
    u = "https://x.example/akte/{}.pdf"
    rows = [(i, i // 100, "same" if i % 3 else f"h{i}", u.format(i), 3, None) for i in range(300)] + [(300, 3, "same", u.format(7), 3, None)] * 2
    assert found(spark, rows) == {i for i in range(2, 300) if i % 3} | {300}


def test_plans_of_small_batches_are_not_compiled(spark, monkeypatch):
    """A small batch compiles no stages, a large one does; the cases are the same and the setting is given back."""
    seen, take, before = [], h.take, spark.conf.get(h.CODEGEN)
    monkeypatch.setattr(h, "take", lambda index, batch: seen.append(spark.conf.get(h.CODEGEN)) or take(index, batch))
    monkeypatch.setattr(h, "COMPILED", 3)
    u = "https://x.example/akte/{}.pdf"
    rows = [(1, 0, "aa", u.format(1), 5, None), (2, 0, "bb", u.format(2), 5, None), (3, 0, "cc", u.format(3), 5, None), (4, 1, "aa", u.format(4), 5, None), (5, 1, "dd", u.format(5), 5, None)]
    assert found(spark, rows) == {4} and seen == ["true", "false"] and spark.conf.get(h.CODEGEN) == before
