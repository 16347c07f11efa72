"""Ranked retrieval: lexical (BM25), dense (exact inner product), fused (reciprocal ranks), expanded, re-ranked and cited.

Queries are a table and are answered together.  Without a stored index both arms run over blocks of chunks (``blocks``), tokenised once.
Over a stored index the lexical arm joins the terms of the queries with the postings that hold them, so chunks without a query term are
never read, and the dense arm multiplies blocks of queries with blocks of vectors and keeps the best of each block.  Ties are broken by key everywhere, and scores are compared at nine decimals.

Texts without terms have no postings and a zero vector, which no query finds; queries without terms have no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.functions.restoration import restore
from actmill.session import cut, scratch, table

# Fixed values ---------------------------------------------------------------------------------------------------------
K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25
RRF_K, POOL, DEPTH, TOP = 60, 50, 25, 5
FEEDBACK, ALPHA, BETA = 3, 1.0, 0.4
NORM_LOW, NORM_HIGH = 0.99, 1.01
HITS_READ, PER_ARTICLE, LEAST_SCORE = 4, 2, 0.08
# ----------------------------------------------------------------------------------------------------------------------
#: Dimensions of the built-in encoder, a stand-in for a neural one: a text's terms hashed into signed sums.
DIMENSIONS = 64
#: Buckets of terms of the lexical index, and parts of a bucket.
BUCKETS, PARTS = 16, 4
#: Rows of a block of the dense arm.
BLOCK = 2048

_FOLD = str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)
_TOKEN = re.compile("[a-z0-9]+")
_STOP = frozenset(tx.STOPWORDS)


class _Stems(dict):
    """Word -> stem, empty for stopwords; kept per worker."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        out = "" if w in _STOP else next((w[: -len(s)] for s in tx.SUFFIXES if len(w) > tx.MIN_STEM and w.endswith(s) and len(w) - len(s) >= tx.MIN_STEM), w)
        self[w] = out
        return out


_STEMS = _Stems()


def terms_of(text: str | None) -> list[str]:
    """Stems of one text, repeated ones kept."""
    return [s for s in map(_STEMS.__getitem__, _TOKEN.findall((text or "").translate(_FOLD).lower())) if s]


def postings(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, terms, tfs, dl``: distinct terms of each text with their counts, and its length in terms."""
    cols = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = [pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array([sum(c.values()) for c in counts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*cols, "terms", "tfs", "dl"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    return df.select(*cols, text).mapInArrow(run, f"{fields}, terms array<string>, tfs array<int>, dl int")


def top(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows per group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def store_postings(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The lexical index of ``chunks`` in a folder: texts are tokenised once, here.

    ``postings``  ``strategy, term, chunk_id, dl, tf`` by bucket of the term;
    ``terms``     ``strategy, term, idf, avgdl``, what the score needs to know of a term, by the same buckets.
    """
    spark = chunks.sparkSession
    p = postings(chunks.withColumn("t", tx.embed_text(F.col("cite"), F.col("heading"), F.col("text"))), "chunk_id", "t", ("strategy",))
    flat = p.select("chunk_id", "strategy", "dl", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("z")).select("strategy", F.col("z.terms").alias("term"), "chunk_id", "dl", F.col("z.tfs").alias("tf"))
    flat = flat.withColumn("bucket", F.coalesce(_bucket(F.col("term")), F.lit(-1)))  # texts without terms count for the lengths only
    # Parts of a bucket, so that no frequent term makes a large task.
    flat.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    stored = _postings(spark, path)
    lengths = stored.groupBy("strategy", "chunk_id").agg(F.max("dl").alias("dl"))
    n = lengths.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # a row per strategy
    df = stored.filter("bucket >= 0").groupBy("strategy", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n), "strategy")
    raw = cut(df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.groupBy("strategy").agg(F.avg("raw").alias("mean"))
    idf = raw.join(F.broadcast(mean), "strategy").select("strategy", "term", "avgdl", F.when(F.col("raw") < 0, NEGATIVE_IDF * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    idf.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{path}/terms")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(spark, path: str) -> DataFrame:
    return spark.read.schema("strategy string, term string, chunk_id string, dl int, tf int, bucket int").parquet(f"{path}/postings")


def bm25_stored(spark, path: str, queries: DataFrame, k: int = POOL, strategy: str | None = None) -> DataFrame:
    """``qid, strategy, chunk_id, score, rank`` over a stored index, of whose postings only the buckets of the asked terms are read."""
    asked = queries.select("qid", F.explode(tx.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    buckets = [r.b for r in asked.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS numbers
    read = lambda d: d.filter(F.col("bucket").isin(buckets) & (F.col("strategy") == strategy if strategy else F.lit(True))).drop("bucket")
    terms = read(spark.read.schema("strategy string, term string, avgdl double, idf double, bucket int").parquet(f"{path}/terms"))
    weighted = terms.join(asked, "term").select("strategy", "term", "avgdl", "qid", (F.col("idf") * F.col("qtf") * (K1 + 1)).alias("w"))
    part = F.col("w") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = read(_postings(spark, path)).join(weighted, ["strategy", "term"]).groupBy("qid", "strategy", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    return top(scored.filter("score > 0"), ["qid", "strategy"], k, [F.desc("score"), F.asc("chunk_id")])


def bm25(chunks: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """``qid, strategy, chunk_id, score, rank``: best chunks with a positive score per query and strategy; the index is made for the call."""
    return searched(chunks, queries, k, "bm25").select("qid", "strategy", "chunk_id", "score", "rank")


def searched(chunks: DataFrame, queries: DataFrame, k: int, mode: str, modes: tuple[str, ...] = (), hits: int = TOP) -> DataFrame:
    """``qid, strategy, arm, chunk_id, doc_id, unit, cite, score, rank``: the best ``k`` chunks of each arm of a mode, over blocks made for the call;
    with ``modes``, whose arms must be among them: ``mode, qid, strategy, chunk_id, doc_id, rank``, the first ``hits`` cited hits of each."""
    from actmill.operators import blocks

    path = scratch(chunks.sparkSession, "blocks")
    blocks.write_blocks(chunks, path, mode != "bm25")
    return blocks.search(chunks.sparkSession, path, queries, k, tuple(x for x, alone in ((blocks.DENSE, "dense"), (blocks.LEXICAL, "bm25")) if mode in (alone, "hybrid")), modes, hits)


_HASHED: dict[str, tuple[int, float]] = {}


def hashed_place(term: str) -> tuple[int, float]:
    """Dimension and sign of a term."""
    at = _HASHED.get(term)
    if at is None:
        if len(_HASHED) > 500_000:
            _HASHED.clear()
        h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
        at = _HASHED[term] = (h % DIMENSIONS, 1.0 if h // DIMENSIONS % 2 == 0 else -1.0)
    return at


def hashed_vector(text: str | None) -> np.ndarray:
    """Unit vector of a text's hashed terms; zeros where it has none."""
    v = np.zeros(DIMENSIONS)
    for term in terms_of(text):
        at = hashed_place(term)
        v[at[0]] += at[1]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def encode(df: DataFrame, text: str, out: str = "v", encoder: Callable[[str | None], np.ndarray] = hashed_vector) -> DataFrame:
    """``df`` with the vector of ``text``; any encoder of one text can be plugged in."""

    @F.pandas_udf("array<double>")
    def vector(s):
        return s.map(lambda t: encoder(t).tolist())

    return df.withColumn(out, vector(F.col(text)))


def checked(v: Column) -> Column:
    """Vector of unit length; any other length is an error of the encoder."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm.between(NORM_LOW, NORM_HIGH), v).otherwise(F.raise_error(F.concat(F.lit("vector of length "), norm.cast("string"))))


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array of vectors of one length, from its buffer."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(vectors), -1)


def dense(vectors: DataFrame, queries: DataFrame, k: int, vector_key: str, query_key: str, group: str | None = None) -> DataFrame:
    """``query_key, (group,) vector_key, score, rank``: exact best inner products above 0, by blocks of queries and vectors."""
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((vectors, vector_key), (queries, query_key))}
    kind = vectors.schema[group].dataType.simpleString() if group else "int"
    spread = lambda d, c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-d.count() // BLOCK))))
    g = F.col(group) if group else F.lit(0)
    left = queries.groupBy(spread(queries, query_key).alias("qb")).agg(F.collect_list(query_key).alias("qs"), F.collect_list("v").alias("qv"))
    right = vectors.groupBy(g.alias("g"), spread(vectors, vector_key).alias("vb")).agg(F.collect_list(vector_key).alias("vs"), F.collect_list("v").alias("vv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qs, gr, vs = (batch.column(i)[r].as_py() for i in (0, 2, 3))
                qv, vv = (_matrix(batch.column(i)[r].values) for i in (1, 4))
                s = np.round(qv @ vv.T, 9)
                names = np.asarray(vs)
                order = np.argsort(names, kind="stable")
                s, names = s[:, order], names[order]
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(qs)), best.shape[1])
                score = s[rows, best.ravel()]
                keep = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qs[i] for i in rows[keep]]).cast(batch.schema.field(0).type.value_type), pa.array([gr] * len(keep), batch.schema.field(2).type), pa.array(names[best.ravel()[keep]].tolist(), batch.schema.field(3).type.value_type), pa.array(score[keep])],
                    names=[query_key, "g", vector_key, "score"],
                )

    blocks = left.select("qs", "qv").crossJoin(right.select("g", "vs", "vv"))  # rows are blocks, of a stated query set and of all vectors
    part = blocks.mapInArrow(run, f"`{query_key}` {kinds[query_key]}, g {kind}, `{vector_key}` {kinds[vector_key]}, score double")
    out = top(part, [query_key, "g"], k, [F.desc("score"), F.asc(vector_key)])
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def rrf(arms: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """``by, key, score, rank`` of ranked lists ``by, arm, key, rank`` fused by reciprocal ranks; ties prefer the first arm, then its rank."""
    rest = [F.first(c).alias(c) for c in arms.columns if c not in (*by, key, "arm", "rank", "score")]  # what belongs to the key
    fused = arms.groupBy(*by, key).agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"), F.min(F.struct("arm", "rank")).alias("first"), *rest)
    return top(fused, by, k, [F.desc("score"), F.asc("first.arm"), F.asc("first.rank")]).drop("first")


def one_per_citation(ranked: DataFrame, by: list[str], depth: int) -> DataFrame:
    """Ranked chunks with the first of each document and citation kept, and ranked anew."""
    first = top(ranked.withColumnRenamed("rank", "pos"), [*by, "doc_id", "unit"], 1, [F.asc("pos")]).drop("rank")
    return top(first, by, depth, [F.asc("pos")]).drop("pos")


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the ``heading, text, chars`` of their chunks."""
    c = chunks.select("chunk_id", "heading", "text", F.coalesce("chars", F.lit(0)).alias("chars"))
    return hits.join(c.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]), "chunk_id")


def overlap(question_terms: Column, text_terms: Column) -> Column:
    """Share of the distinct terms of a question in a text; 0 for a question without terms."""
    q = F.array_distinct(question_terms)
    return F.coalesce(F.size(F.array_intersect(q, text_terms)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def shared_terms(question: Column, text: Column) -> Column:
    """``overlap`` of the terms of a question and a text, tokenised in Python."""

    @F.pandas_udf("double")
    def share(questions, texts):
        asked: dict[str | None, set[str]] = {}
        last, found, out = None, set(), []
        for q, t in zip(questions, texts):
            if t != last:
                last, found = t, set(terms_of(t))
            own = asked.get(q)
            if own is None:
                own = asked[q] = set(terms_of(q))
            out.append(len(own & found) / len(own) if own else 0.0)
        return pd.Series(out, dtype=float)

    return share(question, text)


def rerank(hits: DataFrame, queries: DataFrame, by: list[str], k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Hits in the order of a pairwise score of question and text, by default the share of shared terms; stable."""
    scorer = scorer or shared_terms
    scored = hits.join(queries.select("qid", "question"), "qid").withColumn("pair", F.round(scorer(F.col("question"), F.col("text")), 9)).withColumnRenamed("rank", "before").drop("question")
    return top(scored, by, k, [F.desc("pair"), F.asc("before")])


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """``chunk_id, strategy, v``: the vector of each chunk's text with its citation."""
    text = chunks.withColumn("t", tx.embed_text(F.col("cite"), F.col("heading"), F.col("text")))
    return encode(text.select("chunk_id", "strategy", "t"), "t").select("chunk_id", "strategy", "v")


def query_vectors(queries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``qid, v`` of the questions, of unit length; moved towards their best hits among ``vectors`` where these are given."""
    v = encode(queries.select("qid", "question"), "question").select("qid", "v")
    v = v.filter(F.exists("v", lambda x: x != 0)).select("qid", checked(F.col("v")).alias("v"))  # a question without terms finds nothing
    return v if vectors is None else expanded(vectors, v, "chunk_id", "qid")


def retrieve(
    chunks: DataFrame, queries: DataFrame, mode: str = "dense", k: int = TOP, pool: int = POOL, reranked: bool = False, expand: bool = False, vectors: DataFrame | None = None, lexical: str | None = None, restoration: DataFrame | None = None, strategy: str | None = None,
) -> DataFrame:
    """Ranked, cited hits per query and strategy: ``qid, strategy, chunk_id, doc_id, unit, ..., score, rank``.

    Stored ``vectors`` and the folder of a stored ``lexical`` index are read where given and made for the call otherwise;
    ``expand`` moves the query vectors towards their best hits, of chunks of one strategy; a ``restoration`` map gives the dense arm questions with their accents.
    """
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    by = ["qid", "strategy"]
    if vectors is None and lexical is None and restoration is None and not (expand and mode != "bm25"):
        hits = cited(chunks, queries, mode, DEPTH if reranked else k, pool)
    else:
        arms = []
        if mode != "bm25":
            stored = chunk_vectors(chunks) if vectors is None else vectors
            asked = queries if restoration is None else restore(queries, restoration, "qid", "question")
            arms.append(dense(stored, query_vectors(asked, stored if expand else None), pool, "chunk_id", "qid", "strategy").withColumn("arm", F.lit(0)))
        if mode != "dense":
            found = bm25(chunks, queries, pool) if lexical is None else bm25_stored(chunks.sparkSession, lexical, queries, pool, strategy)
            arms.append(found.withColumn("arm", F.lit(1)))
        ranked = arms[0] if len(arms) == 1 else rrf(arms[0].select(*by, "arm", "chunk_id", "rank").unionByName(arms[1].select(*by, "arm", "chunk_id", "rank")), by, "chunk_id", pool)
        meta = chunks.select("chunk_id", "doc_id", F.coalesce(F.nullif("cite", F.lit("")), F.col("label"), F.lit("")).alias("unit"), "cite")
        hits = one_per_citation(ranked.select(*by, "chunk_id", "score", "rank").join(meta, "chunk_id"), by, DEPTH if reranked else k)
    hits = with_chunks(hits, chunks)
    return rerank(hits, queries, by, k) if reranked else hits


def fused(arms: DataFrame, mode: str, k: int, pool: int = POOL) -> DataFrame:
    """Cited hits of a mode from ``searched`` arms: ``qid, strategy, chunk_id, doc_id, unit, cite, score, rank``."""
    by = ["qid", "strategy"]
    own = {"dense": F.col("arm") == 0, "bm25": F.col("arm") == 1, "hybrid": F.lit(True)}[mode]
    ranked = rrf(arms, by, "chunk_id", pool) if mode == "hybrid" else arms.filter(own)
    return one_per_citation(ranked.select(*by, "chunk_id", "doc_id", "unit", "cite", "score", "rank"), by, k)


def cited(chunks: DataFrame, queries: DataFrame, mode: str, k: int = TOP, pool: int = POOL) -> DataFrame:
    """Cited hits without their texts: ``qid, strategy, chunk_id, doc_id, unit, cite, score, rank``."""
    return fused(searched(chunks, queries, pool, mode), mode, k, pool)


def passages(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Best sentences of the first hits in the order of the text: ``qid, rank, doc_id, cite, sentences``."""
    h = hits.filter(F.col("rank") <= HITS_READ).join(queries.select("qid", tx.tokens(F.col("question")).alias("terms")), "qid")
    s = h.select("qid", "rank", "doc_id", F.coalesce(F.nullif("cite", F.lit("")), F.col("unit")).alias("cite"), "terms", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("score", F.round(tx.sentence_score(F.col("terms"), F.col("sentence")), 9)).filter(F.col("score") >= LEAST_SCORE).withColumnRenamed("rank", "hit")
    best = top(s, ["qid", "hit"], PER_ARTICLE, [F.desc("score"), F.asc("pos")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    return best.groupBy("qid", F.col("hit").alias("rank"), "doc_id", "cite").agg(ordered.alias("sentences"))


def expanded(vectors: DataFrame, queries: DataFrame, vector_key: str, query_key: str, feedback: int = FEEDBACK, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Query vectors moved towards the centroid of their best hits; unchanged without hits."""
    near = dense(vectors, queries, feedback, vector_key, query_key)
    parts = near.join(vectors.select(vector_key, "v"), vector_key).select(query_key, F.posexplode("v").alias("i", "x"))
    centre = parts.groupBy(query_key, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(query_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    moved = F.zip_with(F.col("v"), F.col("c"), lambda a, b: alpha * a.cast("double") + beta * b)
    return queries.join(centre, query_key, "left").select(query_key, normalised(F.when(F.col("c").isNull(), F.transform("v", lambda x: x.cast("double"))).otherwise(moved)).alias("v"))


def asked(spark, root: str) -> DataFrame:
    """The stated query set: questions whose number is divisible by 20, once each."""
    q = table(spark, root, "questions").filter(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long") % 20 == 0)
    return q.dropDuplicates(["id"]).withColumnRenamed("id", "qid")


def stored(spark, root: str) -> DataFrame:
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


def _hits(mode: str, reranked: bool = False):
    def query(spark, root: str) -> DataFrame:
        c, q = table(spark, root, "chunks"), asked(spark, root)
        h = retrieve(c, q, mode, reranked=True) if reranked else cited(c, q, mode)
        return h.select("qid", "strategy", "rank", "chunk_id", "doc_id")

    query.__doc__ = f"Top cited hits of each question, {mode} mode{', re-ranked' if reranked else ''}."
    return query


def answers_extractive(spark, root: str) -> DataFrame:
    q = asked(spark, root)
    h = retrieve(table(spark, root, "chunks").filter("strategy = 'article'"), q, "bm25")
    return passages(h, q).select("qid", "rank", "doc_id", "cite", F.array_join("sentences", "\n").alias("sentences"))


def _vectors(spark, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("v"))


def _query_vectors(spark, root: str) -> DataFrame:
    return _vectors(spark, root).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "v")


def dense_topk(spark, root: str) -> DataFrame:
    return dense(_vectors(spark, root), _query_vectors(spark, root), 10, "vec_id", "qid").select("qid", "vec_id", "rank", F.round("score", 5).alias("score"))


def rocchio_topk(spark, root: str) -> DataFrame:
    v = _vectors(spark, root)
    q = expanded(v, _query_vectors(spark, root), "vec_id", "qid")
    return dense(v, q, 10, "vec_id", "qid").select("qid", "vec_id", "rank", F.round("score", 5).alias("score"))


def vector_norms(spark, root: str) -> DataFrame:
    """Vectors that pass the encoder's length guard, normalised, per label."""
    v = table(spark, root, "embeddings").select("label", normalised(checked(F.col("embedding"))).alias("v"))
    n = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(n), 4).alias("total"))


QUERIES = {
    "search_bm25": _hits("bm25"), "search_dense": _hits("dense"), "search_hybrid": _hits("hybrid"), "search_reranked": _hits("bm25", True), "answers_extractive": answers_extractive,
    "dense_topk": dense_topk, "rocchio_topk": rocchio_topk, "vector_norms": vector_norms,
}

# SQL counterparts -----------------------------------------------------------------------------------------------------
_EMBED = "case when trim(coalesce(cite, '') || '. ' || coalesce(heading, ''), ' .') = '' then text else trim(coalesce(cite, '') || '. ' || coalesce(heading, ''), ' .') || chr(10) || text end"
_UNIT = "coalesce(nullif(cite, ''), label, '')"
ASKED_SQL = "(select id qid, * exclude (id) from questions where try_cast(regexp_extract(id, '(\\d+)$', 1) as bigint) % 20 = 0 qualify row_number() over (partition by id) = 1)"
_DIM = f"cast(('0x' || left(md5(term), 8)) as bigint) % {DIMENSIONS}"
_SIGN = f"case when cast(('0x' || left(md5(term), 8)) as bigint) // {DIMENSIONS} % 2 = 0 then 1.0 else -1.0 end"
SEARCH_SQL = f"""
c as {tx.CHUNKS_SQL}, asked as {ASKED_SQL},
ct as (select chunk_id, strategy, unnest({tx.tokens_sql(_EMBED)}) term from c),
fl as (select chunk_id, strategy, term, count(*) tf from ct group by all),
dl as (select chunk_id, strategy, sum(tf) dl from fl group by all),
ns as (select strategy, count(*) n, (select sum(dl) from dl where dl.strategy = c.strategy) / count(*) avgdl from c group by 1),
rw as (select strategy, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw, n, avgdl from fl join ns using (strategy) group by strategy, term, n, avgdl),
idf as (select strategy, term, avgdl, case when raw < 0 then {NEGATIVE_IDF} * avg(raw) over (partition by strategy) else raw end idf from rw),
qt as (select qid, unnest({tx.tokens_sql('question')}) term from asked), qc as (select qid, term, count(*) qtf from qt group by all),
bs as (select qid, fl.strategy, chunk_id, round(sum(qtf * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 9) score from fl join qc using (term) join idf using (strategy, term) join dl using (chunk_id, strategy) group by all),
bm25 as (select *, row_number() over (partition by qid, strategy order by score desc, chunk_id) rank from bs where score > 0 qualify rank <= {POOL}),
cv as (select chunk_id, strategy, dim, sum(s) x from (select chunk_id, strategy, {_DIM} dim, {_SIGN} s from ct) group by all),
cn as (select chunk_id, strategy, dim, x / sqrt(sum(x * x) over (partition by chunk_id)) x from cv),
qv as (select qid, dim, sum(s) x from (select qid, {_DIM} dim, {_SIGN} s from qt) group by all),
qn as (select qid, dim, x / sqrt(sum(x * x) over (partition by qid)) x from qv),
ds as (select qid, strategy, chunk_id, round(sum(cn.x * qn.x), 9) score from cn join qn using (dim) where not isnan(cn.x) and not isnan(qn.x) group by all),
dense as (select *, row_number() over (partition by qid, strategy order by score desc, chunk_id) rank from ds where score > 0 qualify rank <= {POOL}),
fu as (select qid, strategy, chunk_id, round(sum(1.0 / ({RRF_K} + rank)), 9) score, min({{'arm': arm, 'rank': rank}}) f from (select qid, strategy, chunk_id, 0 arm, rank from dense union all select qid, strategy, chunk_id, 1, rank from bm25) group by all),
hybrid as (select qid, strategy, chunk_id, score, row_number() over (partition by qid, strategy order by score desc, f.arm, f.rank) rank from fu qualify rank <= {POOL})"""


def hits_sql(mode: str, depth: int) -> str:
    """CTE ``hits_<mode>``: cited hits of a mode."""
    return f"""hits_{mode} as (select qid, strategy, chunk_id, doc_id, {_UNIT} unit, cite, text, coalesce(chars, 0) chars, score, row_number() over (partition by qid, strategy order by pos) rank from
 (select r.qid, r.strategy, r.score, r.rank pos, c.* exclude (strategy) from {mode} r join c using (chunk_id) qualify row_number() over (partition by r.qid, r.strategy, doc_id, {_UNIT} order by r.rank) = 1) qualify rank <= {depth})"""


def _oracle(mode: str) -> str:
    return f"with {SEARCH_SQL}, {hits_sql(mode, TOP)} select qid, strategy, rank, chunk_id, doc_id from hits_{mode}"


_RERANK = f"""with {SEARCH_SQL}, {hits_sql('bm25', DEPTH)},
t as (select h.*, list_distinct({tx.tokens_sql('question')}) q, {tx.tokens_sql('h.text')} w from hits_bm25 h join asked using (qid)),
p as (select *, round(coalesce(len(list_intersect(q, w)) / nullif(len(q), 0), 0), 9) pair from t)
select qid, strategy, row_number() over (partition by qid, strategy order by pair desc, rank) as rank, chunk_id, doc_id from p qualify row_number() over (partition by qid, strategy order by pair desc, rank) <= {TOP}"""
_SPLIT = "regexp_replace(regexp_replace(regexp_replace(coalesce(h.text, ''), '([.!?;:])\\s+(\\d+[.)][\\s\\x1e])', '\\1' || chr(30) || '\\2', 'g'), '([.!?;:])\\s+(\\d+[.)][\\s\\x1e])', '\\1' || chr(30) || '\\2', 'g'), '([.!?;:])\\s+([A-ZËÇ«\"])', '\\1' || chr(30) || '\\2', 'g')"
_CONCRETE = r"(?i)(^|[^\p{L}\p{N}_])(\d+\s*(dit[ëe]|muaj|vit|vjet|përqind|lek[ëe]?)($|[^\p{L}\p{N}_])|\d+\s*%[\p{L}\p{N}_]|brenda($|[^\p{L}\p{N}_])|deri më($|[^\p{L}\p{N}_])|afat)"
_EXTRACT = f"""with {SEARCH_SQL}, {hits_sql('bm25', TOP)},
s as (select qid, rank hit, doc_id, coalesce(nullif(cite, ''), unit) cite, list_distinct({tx.tokens_sql('question')}) q, list_filter(list_transform(string_split({_SPLIT}, chr(30)), lambda x: {tx.squeeze_sql('x')}), lambda x: length(x) >= {tx.MIN_SENTENCE}) l from hits_bm25 h join asked using (qid) where strategy = 'article' and rank <= {HITS_READ}),
e as (select qid, hit, doc_id, cite, q, unnest(l) sentence, generate_subscripts(l, 1) pos from s),
g as (select *, {tx.tokens_sql('sentence')} w from e),
v as (select *, round(case when len(q) = 0 or len(w) = 0 then 0 else len(list_intersect(q, w)) / len(q) + case when regexp_matches(sentence, '{_CONCRETE}') then {tx.CONCRETE_BONUS} else 0 end end, 9) score from g),
b as (select * from v where score >= {LEAST_SCORE} qualify row_number() over (partition by qid, hit order by score desc, pos) <= {PER_ARTICLE})
select qid, hit as rank, doc_id, cite, string_agg(sentence, chr(10) order by pos) sentences from b group by qid, hit, doc_id, cite"""
_V = "v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), q as (select vec_id qid, v from v where vec_id % 20 = 0)"
_TOPK = "select qid, vec_id, row_number() over (partition by qid order by s desc, vec_id) as rank, round(s, 5) score from (select qid, vec_id, round(list_dot_product({q}.v, v.v), 9) s from {q}, v) where s > 0 qualify row_number() over (partition by qid order by s desc, vec_id) <= 10"

ORACLES = {
    "search_bm25": _oracle("bm25"), "search_dense": _oracle("dense"), "search_hybrid": _oracle("hybrid"), "search_reranked": _RERANK, "answers_extractive": _EXTRACT,
    "dense_topk": f"with {_V} {_TOPK.format(q='q')}",
    "rocchio_topk": f"""with {_V}, n as (select qid, vec_id, v.v from q, v where list_dot_product(q.v, v.v) > 0 qualify row_number() over (partition by qid order by round(list_dot_product(q.v, v.v), 9) desc, vec_id) <= {FEEDBACK}),
 x as (select qid, i, avg(v[i]) c from n, range(1, {DIMENSIONS + 1}) r(i) group by all), m as (select qid, list(v[i] * {ALPHA} + {BETA} * c order by i) u from x join q using (qid) group by qid),
 e as (select qid, list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))) v from m) {_TOPK.format(q='e')}""",
    "vector_norms": "with v as (select label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), u as (select label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from v where sqrt(list_dot_product(v, v)) between 0.99 and 1.01) select label, count(*) n, round(sum(list_dot_product(u, u)), 4) total from u group by 1",
}
