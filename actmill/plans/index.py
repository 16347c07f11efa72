"""An index package on disk, and answers over it.

``build_index`` writes the chunks, their vectors, the lexical index and the map of accents once, with the encoder's stamp; a search
reads the strategy it needs only, the stored vectors in dense mode and the postings of the asked terms in lexical mode.
Scores come from the same operators as the searches without a package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.functions import restoration as rs
from actmill.functions import text as tx
from actmill.operators import evaluation as ev
from actmill.operators import retrieval as rt
from actmill.operators import segments as sg
from actmill.sources.corpus import verify_package
from actmill.session import table

#: Stamp of the built-in encoder.
MODEL = f"hashed-terms-{rt.DIMENSIONS}"
#: What stands between the sources given to a generator.
RULE = "\n\n---\n\n"


def build_index(documents: DataFrame, path: str) -> None:
    """Chunks of the documents, flat ones included, with their vectors."""
    spark = documents.sparkSession
    chunks = sg.build_chunks(documents)
    flat = documents.select("doc_id", sg.regime(F.col("text")).alias("r")).filter("r = 'flat'")
    articles = sg.with_flat_documents(chunks, flat)
    every = articles.unionByName(chunks.filter("strategy = 'fixed'").withColumn("fallback", F.lit(False)))
    every.write.mode("overwrite").partitionBy("strategy").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks").withColumn("t", tx.embed_text(F.col("cite"), F.col("heading"), F.col("text")))
    rt.encode(stored, "t").select("chunk_id", "strategy", "v", F.lit(MODEL).alias("model")).write.mode("overwrite").partitionBy("strategy").parquet(f"{path}/vectors")
    chunks = spark.read.parquet(f"{path}/chunks")
    rt.store_postings(chunks, f"{path}/lexical")
    rs.save(rs.learn(chunks), f"{path}/accents")


def search_index(spark: SparkSession, path: str, queries: DataFrame, strategy: str = "article", mode: str = "dense", k: int = rt.TOP, expand: bool = False) -> DataFrame:
    """Cited hits of one strategy, after the package was verified."""
    verify_package(spark, path, ("chunks", "vectors", "lexical/postings", "lexical/terms"), MODEL)
    chunks, vectors = (spark.read.parquet(f"{path}/{t}").filter(F.col("strategy") == strategy) for t in ("chunks", "vectors"))
    lexical = f"{path}/lexical"
    return rt.retrieve(chunks, queries, mode, k, expand=expand, vectors=vectors, lexical=lexical, strategy=strategy, restoration=rs.load(spark, f"{path}/accents"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """``qid, context, chars``: the sources of each question as numbered blocks, in the order of their rank."""
    part = lambda c: F.coalesce(c, F.lit(""))
    block = F.concat(F.lit("[S"), F.col("rank"), F.lit("] "), part("cite"), F.lit(" — "), part("heading"), F.lit("\nBurimi: "), F.col("doc_id").cast("string"), F.lit("\n"), part("text"))
    b = hits.select("qid", "rank", block.alias("b"))
    return b.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), RULE).alias("context"))


def answer_contexts(spark, root: str) -> DataFrame:
    h = rt.retrieve(table(spark, root, "chunks").filter("strategy = 'article'"), rt.asked(spark, root), "bm25")
    return context_blocks(h).select("qid", F.md5("context").alias("digest"))


def redraft_targets(spark, root: str) -> DataFrame:
    """Drafted questions whose article cannot answer their form, without those reviewed already."""
    q = table(spark, root, "questions").dropDuplicates(["id"]).withColumnRenamed("id", "qid")
    reviewed = q.filter("notes = 'kontrolluar'").select("qid")
    d = ev.with_gold_text(q.filter("drafted_by_model and gold_doc_id is not null"), rt.stored(spark, root))
    return d.withColumn("form", ev.unsupported_form(F.col("question"), F.col("gold_text"))).filter("form is not null").join(reviewed, "qid", "left_anti").select("qid", "form")


QUERIES = {"answer_contexts": answer_contexts, "redraft_targets": redraft_targets}
_CIT = "coalesce(h.cite, '') || ' — ' || coalesce(c.heading, '') || chr(10) || 'Burimi: ' || h.doc_id"
ORACLES = {
    "answer_contexts": f"with {rt.SEARCH_SQL}, {rt.hits_sql('bm25', rt.TOP)} select qid, md5(string_agg('[S' || rank || '] ' || {_CIT} || chr(10) || coalesce(h.text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) digest from hits_bm25 h join c using (chunk_id) where h.strategy = 'article' group by 1",
    "redraft_targets": f"with {ev._GT} select id qid, {ev._FORM} form from qg where drafted_by_model and gold_doc_id is not null and coalesce(notes, '') <> 'kontrolluar' and {ev._FORM} <> '-'",
}
