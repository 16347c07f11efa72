import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from actmill.operators import blocks
from actmill.operators import retrieval as rt

SCHEMA = "chunk_id string, doc_id long, strategy string, label string, cite string, heading string, text string, chars int"
WORDS = [f"fjale{i}x" for i in range(40)]


def corpus(spark, n=300):
    """Texts of frequent and rare words, every fifth like the one before, some empty; each chunk twice."""
    rng, texts = np.random.default_rng(5), []
    for i in range(n):
        t = " ".join(rng.choice(WORDS, rng.integers(0, 30), p=(p := 1 / np.arange(1, 41)) / p.sum()))
        texts.append(texts[-1] if i % 5 == 4 else None if i % 31 == 7 else t)
    rows = [(f"c{i:03}", i // 3, "fixed" if i % 7 == 0 else "article", None, None, None, t, 1) for i, t in enumerate(texts)]
    q = [("q0", " ".join(WORDS[:6])), ("q1", f"{WORDS[0]} {WORDS[0]} {WORDS[39]}"), ("q2", "tjeter"), ("q3", None), ("q4", " ".join(WORDS[30:]))]
    return spark.createDataFrame(rows + rows, SCHEMA).repartition(3), spark.createDataFrame(q, "qid string, question string")


def scored(chunks, queries, k):
    """Every score of the formula, and the first ``k``."""
    texts, out = {(r.strategy, r.chunk_id): rt.terms_of(r.text) for r in chunks.collect()}, []
    for strategy in ("article", "fixed"):
        docs = {c: d for (s, c), d in texts.items() if s == strategy}
        n, avg, df = len(docs), sum(map(len, docs.values())) / len(docs), Counter(t for d in docs.values() for t in set(d))
        raw = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
        idf = {t: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for t, x in raw.items()}
        for r in queries.collect():
            s = {c: round(sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in rt.terms_of(r.question) if t in d), 9) for c, d in docs.items()}
            best = sorted((-x, c) for c, x in s.items() if x > 0)[:k]
            out += [(r.qid, strategy, c, i + 1, round(-x, 8)) for i, (x, c) in enumerate(best)]
    return sorted(out)


def test_blocks_give_what_all_scores_give(spark, monkeypatch):
    """The best of a search that skips postings, over small blocks, equal those of every score, ties included."""
    c, q = corpus(spark)
    once = c.dropDuplicates(["chunk_id"])
    monkeypatch.setattr(blocks, "BLOCK_CHUNKS", 11)
    monkeypatch.setattr(blocks, "GROUP_CHUNKS", 150)
    rows = lambda d: sorted((r.qid, r.strategy, r.chunk_id, r["rank"], round(r.score, 8)) for r in d.collect())
    for k in (1, 4, 50):
        assert rows(rt.bm25(c, q, k)) == scored(c, q, k)
        assert rows(rt.searched(c, q, k, "dense")) == rows(rt.dense(rt.chunk_vectors(once), rt.query_vectors(q), k, "chunk_id", "qid", "strategy"))


def test_a_search_makes_no_row_of_a_question_and_a_chunk(spark, monkeypatch):
    """Only groups of questions and blocks of chunks are paired: no join of postings, no sum over pairs."""
    c, q = corpus(spark, 20)
    plans, cut = [], rt.cut
    monkeypatch.setattr(rt, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    before = spark.conf.get(blocks.BATCH)
    assert rt.bm25(c, q).count() > 0 and spark.conf.get(blocks.BATCH) == before
    assert "CartesianProduct" in plans[-1] and not any("postings" in p for p in plans)


def test_chunks_with_copies_are_joined_once(spark):
    c, q = corpus(spark, 20)
    hits = rt.retrieve(c, q, "bm25")
    assert hits.count() == hits.select("qid", "strategy", "rank").distinct().count() > 0
    assert hits.filter(F.col("text").isNull()).count() == 0


def made(dense=True, n=600):
    """A block of random texts with the row of its table, and the texts as terms."""
    rng, pending, texts = np.random.default_rng(3), blocks._Pending(dense), []
    for i in range(n):
        texts.append(" ".join(rng.choice(WORDS, rng.integers(0, 30), p=(p := 1 / np.arange(1, 41) ** 2) / p.sum())))
        pending.add((f"c{i:03}", i, "u", "c"), texts[-1])
    lists, names = pa.list_(pa.string()), ["strategy", "block", "n", "dl", "chunk_id", "doc_id", "unit", "cite", "lengths", "terms", "counts", "places", "tfs", "sums"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), lists, pa.list_(pa.int64()), lists, lists, pa.binary(), lists, pa.list_(pa.int32()), *[pa.binary()] * 3]
    batch = pending.block("article", pa.schema(list(zip(names, kinds))))
    return {c: batch.column(j)[0] for j, c in enumerate(names)}, [rt.terms_of(t) for t in texts]


def test_f3_a_search_encodes_no_chunk_again(monkeypatch):
    """The dense arm reads the encoder's sums from the block."""
    row, texts = made()
    monkeypatch.setattr(rt, "hashed_place", None)
    sums, norm = blocks._Block(row, 10.0).vectors()
    monkeypatch.undo()
    assert np.array_equal(sums / norm[:, None], np.array([rt.hashed_vector(" ".join(t)) for t in texts]))


def test_skipped_postings_change_no_hit(monkeypatch):
    """Rows of frequent terms or none, bounds looked at or not: the hits of every score."""
    row, texts = made(False)
    rng, names = np.random.default_rng(4), sorted({t for d in texts for t in d})
    asked = [[(int(t), float(rng.random() * (t + 1))) for t in rng.choice(len(names), 8, replace=False)] for _ in range(40)]
    part = np.array([[d.count(t) / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / 10)) if d else 0 for d in texts] for t in names])
    for kept, few in ((0, 0), (0, 10_000), (10**6, 0), (10**6, 10_000)):
        monkeypatch.setattr(blocks, "KEPT", kept)
        monkeypatch.setattr(blocks, "FEW", few)
        best = blocks._Best(len(asked), 5, lambda places: [f"c{p % 600:03}{p // 600}" for p in places])
        for offset in (0, 600):  # the second block is searched with bounds from the first
            blocks._lexical(best, blocks._Block(row, 10.0), offset, pa.array(names), asked)
        for q, terms in enumerate(asked):
            s = np.tile(sum(w * part[t] for t, w in terms), 2)
            got, places = best.ordered(q)
            assert np.allclose(got, np.sort(s)[::-1][: len(got)], atol=1e-8) and np.allclose(got, s[places], atol=1e-8) and len(got) == min(5, (s > 0).sum())


def test_f10_many_questions_at_once_change_no_hit():
    """Questions screened together, in both arms: the hits of every score, ties included."""
    row, texts = made()
    rng, names = np.random.default_rng(4), sorted({t for d in texts for t in d})
    asked = [[(int(t), float(rng.random() * (t + 1)) - (q % 9 == 0)) for t in rng.choice(len(names), 8, replace=False)] for q in range(40)] + [[], [(0, 2.0)]]
    part = np.array([[d.count(t) / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / 10)) if d else 0 for d in texts] for t in names])
    name = lambda places: [f"c{p % 600:03}{p // 600}" for p in places]
    vectors = np.array([rt.hashed_vector(" ".join(names[t] for t, _ in own)) for own in asked])
    block = blocks._Block(row, 10.0)
    all_dense = np.round(vectors @ np.array([rt.hashed_vector(" ".join(t)) for t in texts]).T, 9)
    all_lexical = np.array([np.round(sum((w * part[t] for t, w in own), np.zeros(600)), 9) for own in asked])
    for k in (1, 5, 50):
        lexical, dense = (blocks._Many(len(asked), k, name) for _ in range(2))
        for offset in (0, 600):
            blocks._lexical_many(lexical, block, offset, blocks._Asked(pa.array(names), asked))
            blocks._dense_many(dense, *block.vectors(), offset, vectors)
        for best, scores in ((lexical, all_lexical), (dense, all_dense)):
            q, got, places = best.rows()
            for i, s in enumerate(np.tile(scores, 2)):
                want = sorted((p for p in range(1200) if s[p] > 0), key=lambda p: (-s[p], name([p])[0]))[:k]
                assert np.allclose(got[q == i], s[want], atol=2e-9) and len(set(places[q == i])) == len(want)
                assert (np.round(s, 6)[places[q == i]] == np.round(s, 6)[want]).all()


def test_f10_hits_of_every_mode_leave_the_search(spark):
    """The search itself fuses and cites, with the hits that the arms give, whether a task sees all chunks or not."""
    c, q = corpus(spark)
    modes = ("dense", "bm25", "hybrid")
    arms = rt.searched(c, q, rt.POOL, "hybrid")
    rows = lambda d, m: sorted((m, r.qid, r.strategy, r["rank"], r.chunk_id, r.doc_id) for r in d.collect())
    want = [x for m in sorted(modes) for x in rows(rt.fused(arms, m, 5), m)]
    got = rt.searched(c, q, rt.POOL, "hybrid", modes, 5).collect()
    assert sorted((r.mode, r.qid, r.strategy, r["rank"], r.chunk_id, r.doc_id) for r in got) == want


def test_f10_hits_of_every_mode_over_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_CHUNKS", 150)
    test_f10_hits_of_every_mode_leave_the_search(spark)
