"""Answers to questions over retrieved hits: the generator's text with the sources it cites, or the sentences of the hits.

The generator is outside Spark: its texts arrive as ``qid, text`` with markers ``[Sn]``, null where it failed.  Hits are those of one
strategy.  Sources keep the rank they were retrieved with, so that text and list agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.operators import retrieval as rt
from actmill.session import cut, table

# Fixed values ---------------------------------------------------------------------------------------------------------
LONGEST = 500
ADDRESS = "https://www.tatime.gov.al/shkarko.php?id="
EMPTY, TOO_LONG = "Shkruaj një pyetje.", "Pyetja është shumë e gjatë. Shkurtoje nën 500 karaktere."
REFUSAL = "Nuk e gjej përgjigjen në legjislacionin që kam në dispozicion."
REFUSED = "nuk e gjej përgjigjen"
NOT_GENERATED = "⚠️ **Përmbledhja nuk u prodhua**\n\n_Më poshtë janë nenet përkatëse, fjalë për fjalë._\n\n"
NOTHING_FITS = "Nuk gjeta një fjali që t'i përgjigjet drejtpërdrejt kësaj pyetjeje në nenet e gjetura. Nenet më të afërta janë renditur më poshtë — lexoji drejtpërdrejt."
BEFORE = "**Çdo fjali më poshtë është fjalë për fjalë nga neni i cituar**, pa riformulim — pra e verifikueshme drejtpërdrejt te burimi.\n\n"
AFTER = "---\n_Kjo mënyrë nuk e përmbledh ligjin dhe nuk e shpjegon me fjalë të tjera; ajo tregon se ku përgjigjja gjendet dhe ta jep të pandryshuar._"
# ----------------------------------------------------------------------------------------------------------------------


def _address(doc: str):
    return F.concat(F.lit(ADDRESS), F.col(doc).cast("string"))


def _joined(rows: DataFrame, name: str, between: str) -> DataFrame:
    """The blocks ``b`` of each question in the order of their rank."""
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), between).alias(name))


def cited_sources(generated: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits whose rank the text of their question cites, with that rank."""
    ranks = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[S(\d+)\]"), 1))
    cited = generated.select("qid", F.explode(ranks).alias("n")).select("qid", F.col("n").try_cast("int").alias("rank"))
    return hits.join(cited.distinct(), ["qid", "rank"], "left_semi")


def format_sources(hits: DataFrame) -> DataFrame:
    """``qid, sources``: the hits of each question as reference entries, each with its provision in full and its document."""
    cite, heading, text = F.coalesce(F.nullif("cite", F.lit("")), F.col("unit"), F.lit("")), F.trim(F.coalesce("heading", F.lit(""))), tx.escape_html(F.coalesce("text", F.lit("")))
    title = F.concat(F.lit("**[S"), F.col("rank"), F.lit("] "), cite, F.lit("**"), F.when((heading != "") & (heading != cite), F.concat(F.lit(" — "), heading)).otherwise(""))
    law = F.when(text != "", F.concat(F.lit("  \n<span class='law'>"), text, F.lit("</span>"))).otherwise("")
    block = F.concat(title, law, F.lit("  \n[Shkarko dokumentin zyrtar]("), _address("doc_id"), F.lit(")"))
    return _joined(hits.select("qid", "rank", block.alias("b")), "s", "\n\n").select("qid", F.concat(F.lit("### Burimet\n\n"), F.col("s")).alias("sources"))


def format_extract(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, answer``: the best sentences of the hits, word for word; only questions that have any."""
    p = rt.passages(hits, queries).join(hits.select("qid", "rank", F.coalesce("heading", F.lit("")).alias("heading")), ["qid", "rank"])
    title = F.when(F.col("heading") != "", F.concat_ws(" — ", F.coalesce("cite", F.lit("")), F.col("heading"))).otherwise(F.coalesce("cite", F.lit("")))
    quoted = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("> "), s)), "\n")
    block = F.concat(F.lit("### "), title, F.lit("  [S"), F.col("rank"), F.lit("]\n"), quoted, F.lit("\n[Shkarko dokumentin zyrtar]("), _address("doc_id"), F.lit(")\n"))
    return _joined(p.select("qid", "rank", block.alias("b")), "a", "\n").select("qid", F.concat(F.lit(BEFORE), F.col("a"), F.lit("\n" + AFTER)).alias("answer"))


def respond(queries: DataFrame, hits: DataFrame, generated: DataFrame) -> DataFrame:
    """``qid, state, refused, answer, sources`` of every question.

    States: ``empty`` and ``too_long`` questions are turned away; without hits the fixed refusal (``no_hits``); a generated text with
    the sources it cites (``generated``); where there is none, the sentences of the hits with all of them as sources (``extract``).
    """
    q = queries.select("qid", F.trim(F.coalesce("question", F.lit(""))).alias("question"))
    fine = q.filter(F.length("question").between(1, LONGEST))
    h, g = hits.join(fine.select("qid"), "qid", "left_semi"), generated.select("qid", "text")
    cited = cited_sources(g, h)
    linked = cited.groupBy("qid").agg(F.collect_list(F.struct("rank", _address("doc_id").alias("url"))).alias("links"))
    all_links = h.groupBy("qid").agg(F.collect_list(F.struct("rank", _address("doc_id").alias("url"))).alias("all_links"))
    d = q.join(all_links, "qid", "left").join(g, "qid", "left").join(linked, "qid", "left").join(format_extract(h, fine), "qid", "left")
    d = d.join(format_sources(h).withColumnRenamed("sources", "all_sources"), "qid", "left").join(format_sources(cited), "qid", "left")
    state = F.when(F.col("question") == "", "empty").when(F.length("question") > LONGEST, "too_long").when(F.col("all_links").isNull(), "no_hits").when(F.trim(F.coalesce("text", F.lit(""))) != "", "generated").otherwise("extract")
    d = d.withColumn("state", state)
    link = lambda text, links: F.when(F.col(links).isNull(), text).otherwise(tx.link_markers(text, F.col(f"{links}.rank"), F.col(f"{links}.url")))
    s = F.col("state")
    answer = (
        F.when(s == "empty", EMPTY).when(s == "too_long", TOO_LONG).when(s == "no_hits", REFUSAL).when(s == "generated", link(F.trim("text"), "links"))
        .otherwise(F.concat(F.lit(NOT_GENERATED), link(F.coalesce("answer", F.lit(NOTHING_FITS)), "all_links")))
    )
    sources = F.coalesce(F.when(s == "generated", F.col("sources")).when(s == "extract", F.col("all_sources")), F.lit(""))
    refused = (s == "no_hits") | (s == "generated") & F.contains(F.lower("text"), F.lit(REFUSED))
    return d.select("qid", "state", refused.alias("refused"), answer.alias("answer"), sources.alias("sources"))


def answers_responded(spark, root: str) -> DataFrame:
    """Responses to the asked questions, with the stored answers as the generator's texts."""
    q = rt.asked(spark, root)
    # Read many times below, found once.
    hits = cut(rt.retrieve(table(spark, root, "chunks").filter("strategy = 'article'"), q, "bm25"))
    last = rt.top(table(spark, root, "answers").filter("question_id is not null"), ["question_id"], 1, [F.desc("answer_id")])
    generated = last.select(F.col("question_id").alias("qid"), F.regexp_replace("answer", r"\[(\d+)\]", r"[S$1]").alias("text"))
    return respond(q, hits, generated).select("qid", "state", "refused", F.md5("answer").alias("answer"), F.md5("sources").alias("sources"))


QUERIES = {"answers_responded": answers_responded}
ORACLES: dict[str, str] = {}
