"""Segmentation of documents into citable units and fixed windows.

A document follows one of four conventions: article headings, decimal headings, paragraph numbers on their own line, or none
(flat).  Articles come from splitting before each heading; long ones are cut into parts at line ends; fixed windows overlap.
The cuts are found in one pass over a text, on Arrow batches.

Null and empty texts are flat and have no segment; text before the first heading is dropped; an article without a rubric has
an empty heading.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.functions.text import CHUNKS_SQL
from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
ARTICLE_WORDS = ("Neni", "Article", "Artikel", "Articolo", "Artículo")
DECIMAL = r"[ \t]*\d+(?:\.\d+){0,3}\.?[ \t]+[A-ZËÇ]"
NUMBER_LINE = r"[ \t]*\d{1,3}[ \t]*"
LEAST_ARTICLES, LEAST_DECIMALS, LEAST_NUMBERS = 3, 5, 8
WINDOW, OVERLAP, PART = 1400, 200, 1400
LEAST_CHARS = 120
HEADING_CHARS = 120
# ----------------------------------------------------------------------------------------------------------------------
ARTICLE = rf"[ \t]*(?:{'|'.join(ARTICLE_WORDS)})[ \t]*\d+(?:[/\-]\d+)?[a-zë]?[ \t]*"
LABEL = rf"^[ \t]*({'|'.join(ARTICLE_WORDS)})[ \t]*(\d+(?:[/\-]\d+)?[a-zë]?)"
MARK = "\x1e"


def regime(text: Column) -> Column:
    """Structural convention of a text: ``neni``, ``decimal``, ``standard`` or ``flat``."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(count(rf"(?dm)^{ARTICLE}$") >= LEAST_ARTICLES, "neni").when(count(rf"(?dm)^{DECIMAL}") >= LEAST_DECIMALS, "decimal")
        .when(count(rf"(?dm)^{NUMBER_LINE}$") >= LEAST_NUMBERS, "standard").otherwise("flat")
    )


def blocks(text: Column, kind: Column) -> Column:
    """Array of the blocks of a text, each beginning with its heading."""
    marked = [F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?dm)^({p})", f"{MARK}$1") for p in (ARTICLE + "$", DECIMAL, NUMBER_LINE + "$")]
    pick = F.when(kind == "neni", marked[0]).when(kind == "decimal", marked[1]).when(kind == "standard", marked[2])
    parts = F.split(pick, MARK)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda b: F.btrim(b, F.lit(" \n\t\r")))


def lines_of(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def rubric(lines: Column) -> Column:
    """First of lines 1 to 3 that is not a stray number, unless the body has begun with a numbered paragraph."""
    after = F.filter(F.slice(lines, 2, 3), lambda x: ~x.rlike(r"^[^\p{L}\p{M}]+$") | x.rlike(r"^\d+[.)]\s"))
    first = F.try_element_at(after, F.lit(1))
    return F.when(first.rlike(r"^\d+[.)]\s"), "").otherwise(F.coalesce(first, F.lit("")))


def label_of(block: Column, kind: Column) -> Column:
    return (
        F.when(kind == "neni", F.concat(F.regexp_extract(block, LABEL, 1), F.lit(" "), F.regexp_extract(block, LABEL, 2)))
        .when(kind == "decimal", F.regexp_extract(block, r"^(\d+(?:\.\d+){0,3})", 1)).otherwise(F.concat(F.lit("Paragrafi "), F.regexp_extract(block, r"^(\d+)", 1)))
    )


def heading_of(block: Column, kind: Column) -> Column:
    lines = lines_of(block)
    return F.when(kind == "neni", rubric(lines)).otherwise(F.left(F.coalesce(F.try_element_at(lines, F.when(kind == "decimal", 1).otherwise(2)), F.lit("")), F.lit(HEADING_CHARS)))


def cut_text(text: str, size: int, overlap: int) -> list[str]:
    """Stripped, non-empty pieces of at most ``size`` characters, ended at the last line end of the second half where there is one; one pass."""
    n, half, at, out = len(text), size // 2, 0, []
    while at < n:
        end = min(at + size, n)
        if end < n:
            line = text.rfind("\n", at + half, at + size)
            end = line if line >= 0 else end
        piece = text[at:end].strip(" \n\t\r")
        if piece:
            out.append(piece)
        at = n if end >= n else max(end - overlap, at + 1)
    return out


def pieces(text: Column, size: int, overlap: int) -> Column:
    """Array of the pieces of a text; null for null."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_text(t, size, overlap), na_action="ignore")

    return cut(text)


def articles(documents: DataFrame) -> DataFrame:
    """``doc_id, regime, no, label, heading, body`` of every article of ``doc_id, text``."""
    d = documents.select("doc_id", "text", regime(F.col("text")).alias("regime")).filter("regime <> 'flat'")
    b = d.select("doc_id", "regime", F.posexplode(blocks(F.col("text"), F.col("regime"))).alias("no", "body")).filter("body <> ''")
    return b.select("doc_id", "regime", "no", label_of(F.col("body"), F.col("regime")).alias("label"), heading_of(F.col("body"), F.col("regime")).alias("heading"), "body")


def parts(rows: DataFrame) -> DataFrame:
    """Articles with long ones in parts: ``doc_id, no, part, label, cite, heading, text``."""
    long = pieces(F.when(F.length("body") > PART, F.col("body")), PART, 0)  # short bodies are not looked at
    p = rows.withColumn("parts", F.coalesce(long, F.array("body"))).select("*", F.size("parts").alias("total"), F.posexplode("parts").alias("part", "piece"))
    label = F.when(F.col("total") > 1, F.concat("label", F.lit(" ("), F.col("part") + 1, F.lit("/"), F.col("total"), F.lit(")"))).otherwise(F.col("label"))
    text = F.when(F.col("part") > 0, F.concat_ws("\n", "label", "heading", "piece")).otherwise(F.col("piece"))
    return p.select("doc_id", "no", "part", label.alias("label"), F.col("label").alias("cite"), "heading", text.alias("text"))


def windows(documents: DataFrame) -> DataFrame:
    """``doc_id, no, text`` of the overlapping windows of each text; empty windows take no number."""
    return documents.select("doc_id", F.posexplode(pieces(F.coalesce("text", F.lit("")), WINDOW, OVERLAP)).alias("no", "text"))


def build_chunks(documents: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Chunks of both strategies; numbers count kept articles, but all windows."""
    kept = parts(articles(documents)).filter(F.length("text") >= least)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("no", "part")) - 1
    a = kept.select("doc_id", F.lit("article").alias("strategy"), order.alias("part_order"), "label", "cite", "heading", "text")
    w = windows(documents).filter(F.length("text") >= least)
    window = F.concat(F.lit("window "), F.col("no"))
    b = w.select("doc_id", F.lit("fixed").alias("strategy"), F.col("no").alias("part_order"), window.alias("label"), window.alias("cite"), F.lit("").alias("heading"), "text")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "strategy", F.col("part_order").cast("string"))
    return a.unionByName(b).select(key.alias("chunk_id"), "*", F.length("text").alias("chars"))


def with_flat_documents(chunks: DataFrame, flat: DataFrame) -> DataFrame:
    """Article chunks, and for each document of ``flat`` without any its windows as ``Pjesa i/n`` with a fallback flag."""
    have = chunks.filter("strategy = 'article'")
    missing = flat.select("doc_id").distinct().join(have.select("doc_id").distinct(), "doc_id", "left_anti")
    by_doc = Window.partitionBy("doc_id")
    i, n = F.row_number().over(by_doc.orderBy("part_order")), F.count(F.lit(1)).over(by_doc)
    label = F.concat(F.lit("Pjesa "), i, F.lit("/"), n)
    moved = chunks.filter("strategy = 'fixed'").join(missing, "doc_id", "left_semi").withColumn("label", label).withColumn("cite", F.col("label"))
    moved = moved.withColumn("strategy", F.lit("article")).withColumn("fallback", F.lit(True))
    return have.withColumn("fallback", F.lit(False)).unionByName(moved)


def _documents(spark, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text")


def _stored(spark, root: str) -> DataFrame:
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


def regime_counts(spark, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(regime(F.col("text")).alias("found"), "regime").agg(F.count(F.lit(1)).alias("n"))


def segment_articles(spark, root: str) -> DataFrame:
    return articles(_documents(spark, root)).select("doc_id", "label", "heading", F.md5("body").alias("digest"))


def segment_parts(spark, root: str) -> DataFrame:
    """Stored article chunks and windows joined to one text per document and cut into parts of a long article."""
    whole = _stored(spark, root).filter("strategy = 'article'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_order", "text"))), lambda x: x["text"]), "\n").alias("body"))
    rows = whole.select("doc_id", F.lit(0).alias("no"), F.lit("Neni 1").alias("label"), F.lit("Teksti").alias("heading"), "body")
    return parts(rows).select("doc_id", "label", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def segment_windows(spark, root: str) -> DataFrame:
    return windows(_documents(spark, root)).select("doc_id", "no", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def chunk_sizes(spark, root: str) -> DataFrame:
    """Chunks built from the documents per strategy: number, upper median, largest and mean size."""
    c = build_chunks(_documents(spark, root)).groupBy("strategy", "chars").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("strategy")  # one row per size, not per chunk
    run = c.withColumn("upto", F.sum("n").over(by.orderBy("chars"))).withColumn("all", F.sum("n").over(by))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("chars")))
    return run.groupBy("strategy").agg(F.sum("n").alias("n"), median.alias("median"), F.max("chars").alias("largest"), F.floor(F.sum(F.col("n") * F.col("chars")) / F.sum("n")).alias("mean"))


def flat_fallback(spark, root: str) -> DataFrame:
    flat = table(spark, root, "documents").filter("regime = 'flat'")
    return with_flat_documents(_stored(spark, root), flat).select("chunk_id", "strategy", "label", "fallback")


def flat_titles(spark, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("regime = 'flat'").select("doc_id", "title")


def articles_whole(spark, root: str) -> DataFrame:
    """Articles put together again from their parts, in order."""
    c = _stored(spark, root).filter("strategy = 'article'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_order", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("doc_id", "cite").agg(F.md5(text).alias("digest"), F.count(F.lit(1)).alias("n_parts"))


QUERIES = {
    "regime_counts": regime_counts, "segment_articles": segment_articles, "segment_parts": segment_parts, "segment_windows": segment_windows, "chunk_sizes": chunk_sizes,
    "flat_fallback": flat_fallback, "flat_titles": flat_titles, "articles_whole": articles_whole,
}

_WORDS = "|".join(ARTICLE_WORDS)
_T = "coalesce(text, '')"
_REGIME = rf"case when len(regexp_extract_all({_T}, '(?m)^{ARTICLE}$')) >= 3 then 'neni' when len(regexp_extract_all({_T}, '(?m)^{DECIMAL}')) >= 5 then 'decimal' when len(regexp_extract_all({_T}, '(?m)^{NUMBER_LINE}$')) >= 8 then 'standard' else 'flat' end"
_ARTICLES = rf"""
d as (select doc_id, text, {_REGIME} regime from documents),
b as (select doc_id, regime, unnest(list_slice(string_split(regexp_replace({_T}, case regime when 'neni' then '(?m)^({ARTICLE}$)' when 'decimal' then '(?m)^({DECIMAL})' else '(?m)^({NUMBER_LINE}$)' end, chr(30) || '\1', 'g'), chr(30)), 2, 100000)) x from d where regime <> 'flat'),
t as (select doc_id, regime, trim(x, ' ' || chr(10) || chr(9) || chr(13)) body from b where trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''),
l as (select *, list_filter(list_transform(string_split(body, chr(10)), lambda y: trim(y, ' ' || chr(9) || chr(13))), lambda y: y <> '') lines from t),
r as (select *, list_filter(lines[2:4], lambda y: not regexp_matches(y, '^[^\p{{L}}\p{{M}}]+$') or regexp_matches(y, '^\d+[.)]\s'))[1] first from l),
articles as (select doc_id, regime, body,
 case regime when 'neni' then regexp_extract(body, '^[ \t]*({_WORDS})[ \t]*(\d+(?:[/\-]\d+)?[a-zë]?)', 1) || ' ' || regexp_extract(body, '^[ \t]*({_WORDS})[ \t]*(\d+(?:[/\-]\d+)?[a-zë]?)', 2) when 'decimal' then regexp_extract(body, '^(\d+(?:\.\d+){{0,3}})', 1) else 'Paragrafi ' || regexp_extract(body, '^(\d+)', 1) end label,
 case regime when 'neni' then case when regexp_matches(first, '^\d+[.)]\s') then '' else coalesce(first, '') end when 'decimal' then left(coalesce(lines[1], ''), 120) else left(coalesce(lines[2], ''), 120) end heading from r)"""


def _cut_sql(source: str, overlap: int) -> str:
    """Recursive cuts of ``source`` (doc_id, t)."""
    back = "case when lo + 1400 < length(t) then length(regexp_extract(substr(t, lo + 701, 700), chr(10) || '[^' || chr(10) || ']*$')) else 0 end"
    end = f"case when {back} > 0 then lo + 1400 - {back} else least(lo + 1400, length(t)) end"
    return f"""w(doc_id, t, step, lo, hi) as (
 select doc_id, t, 0, lo, {end} from (select doc_id, t, 0 lo from {source} where length(t) > 0)
 union all
 select doc_id, t, step + 1, lo, {end} from (select doc_id, t, step, greatest(hi - {overlap}, lo + 1) lo from w where hi < length(t))),
p as (select doc_id, step, trim(substr(t, lo + 1, hi - lo), ' ' || chr(10) || chr(9) || chr(13)) x from w),
q as (select doc_id, row_number() over (partition by doc_id order by step) - 1 no, count(*) over (partition by doc_id) total, x from p where x <> '')"""


_WHOLE = f"s as (select doc_id, string_agg(text, chr(10) order by part_order) t from {CHUNKS_SQL} where strategy = 'article' group by 1)"
ORACLES = {
    "regime_counts": f"select {_REGIME} as found, regime, count(*) n from documents group by all",
    "segment_articles": f"with {_ARTICLES} select doc_id, label, heading, md5(body) digest from articles",
    "segment_parts": f"with recursive {_WHOLE}, {_cut_sql('s', 0)} select doc_id, case when total > 1 then 'Neni 1 (' || (no + 1) || '/' || total || ')' else 'Neni 1' end label, length(y) chars, md5(y) digest from (select *, case when no > 0 then 'Neni 1' || chr(10) || 'Teksti' || chr(10) || x else x end y from q)",
    "segment_windows": f"with recursive s as (select doc_id, {_T} t from documents), {_cut_sql('s', 200)} select doc_id, no, length(x) chars, md5(x) digest from q",
    "flat_fallback": f"with c as {CHUNKS_SQL}, m as (select doc_id from documents where regime = 'flat' except select doc_id from c where strategy = 'article') select chunk_id, strategy, label, false fallback from c where strategy = 'article' union all select chunk_id, 'article', 'Pjesa ' || row_number() over (partition by doc_id order by part_order) || '/' || count(*) over (partition by doc_id), true from c where strategy = 'fixed' and doc_id in (select doc_id from m)",
    "flat_titles": "select doc_id, title from documents where regime = 'flat'",
    "articles_whole": f"select doc_id, cite, md5(string_agg(text, chr(10) order by part_order)) digest, count(*) n_parts from {CHUNKS_SQL} where strategy = 'article' group by 1, 2",
    "chunk_sizes": f"""with recursive s as (select doc_id, {_T} t from documents), {_cut_sql('s', 200)}, {_ARTICLES},
a as (select row_number() over () k, label, heading, body from articles), v as (select k doc_id, body t from a),
{_cut_sql('v', 0).replace('w(', 'w2(').replace('from w ', 'from w2 ').replace('from w)', 'from w2)').replace('p as', 'p2 as').replace('q as', 'q2 as').replace('from p ', 'from p2 ')},
n as (select 'fixed' strategy, length(x) chars from q where length(x) >= {LEAST_CHARS} union all select 'article', length(y) from (select case when no > 0 then label || chr(10) || heading || chr(10) || x when total > 1 then x else body end y from q2 join a on k = doc_id) where length(y) >= {LEAST_CHARS})
select strategy, count(*) n, list_sort(list(chars))[count(*) // 2 + 1] median, max(chars) largest, cast(floor(sum(chars) / count(*)) as bigint) mean from n group by 1""",
}
