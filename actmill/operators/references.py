"""References to records that do not exist (problem 6).

A reference is a tuple of columns, some of which may be null.  Tuples are grouped by their null mask
and every mask is anti-joined on its own non-null columns, under a declared match semantics:

``simple``   a tuple with any null is never an orphan;
``partial``  the non-null columns must match some key, a tuple of nulls only is never an orphan;
``full``     a tuple of nulls only is never an orphan, a partly null tuple always is one.

Key sides are reduced to distinct tuples before the join; reference sides keep all their rows and columns
and are joined by shuffle, where adaptive execution splits a hot key.  Empty inputs give empty results,
repeated reference rows are kept (callers say whether they count once).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.session import table


def orphans(refs: DataFrame, keys: DataFrame, on: dict[str, str], match: str = "simple") -> DataFrame:
    """Rows of ``refs`` without a counterpart in ``keys``; ``on`` maps reference columns to key columns."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    cols = list(on)
    parts = []
    for mask in product((False, True), repeat=len(cols)):  # True: the column is null
        rows = refs
        for c, null in zip(cols, mask):
            rows = rows.filter(F.col(f"`{c}`").isNull() if null else F.col(f"`{c}`").isNotNull())
        present = [c for c, null in zip(cols, mask) if not null]
        if not present or (match == "simple" and any(mask)):
            continue
        if match == "full" and any(mask):
            parts.append(rows)
            continue
        side = keys.select(*[F.col(f"`{on[c]}`").alias(f"__key_{c}") for c in present]).dropna().distinct()
        cond = [rows[c] == side[f"__key_{c}"] for c in present]
        parts.append(rows.join(side, cond, "left_anti"))
    if not parts:
        return refs.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matched(refs: DataFrame, keys: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``refs`` whose full tuple has a counterpart in ``keys``."""
    side = keys.select(*[F.col(f"`{k}`").alias(f"__key_{c}") for c, k in on.items()]).dropna().distinct()
    return refs.join(side, [refs[c] == side[f"__key_{c}"] for c in on], "left_semi")


def same_spelling(c: Column) -> Column:
    """Citation without letter case and white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def reference_states(documents: DataFrame, chunks: DataFrame, acts: DataFrame, retired: DataFrame, questions: DataFrame) -> DataFrame:
    """``field, row_key, ref, status, source_table, period`` of every reference that is missing, deleted or late.

    Null references are no references; repeated rows count once; a null ``created_at`` or ``added_at`` is never late.
    """
    docs = documents.select(F.col("doc_id").alias("d_id"), "added_at").groupBy("d_id").agg(F.min("added_at").alias("d_added"))
    gone = retired.select(F.col("doc_id").alias("r_id"), F.col("act_number").alias("r_no"))
    q = questions.select(F.col("id").alias("row_key"), "gold_doc_id", "gold_article", F.col("created_at").alias("made")).distinct()
    period = F.date_format("made", "yyyy-MM")

    def shape(df: DataFrame, field: str, ref: Column, status: str, source: str, period: Column) -> DataFrame:
        return df.select(F.lit(field).alias("field"), F.col("row_key").cast("string").alias("row_key"), ref.cast("string").alias("ref"), F.lit(status).alias("status"), F.lit(source).alias("source_table"), period.alias("period"))

    by_doc = q.filter(F.col("gold_doc_id").isNotNull())
    absent = orphans(by_doc, docs, {"gold_doc_id": "d_id"})
    missing = orphans(absent, gone, {"gold_doc_id": "r_id"})
    deleted = matched(absent, gone, {"gold_doc_id": "r_id"})
    late = by_doc.join(docs, by_doc.gold_doc_id == docs.d_id).filter("d_added > made")

    cited = by_doc.withColumn("cite_key", same_spelling(F.col("gold_article"))).filter("cite_key is not null")
    known = matched(cited, docs, {"gold_doc_id": "d_id"})
    cites = chunks.select(F.col("doc_id").alias("c_doc"), same_spelling(F.col("cite")).alias("c_key"))
    no_article = orphans(known, cites, {"gold_doc_id": "c_doc", "cite_key": "c_key"}, "simple")

    edges = acts.select(F.col("doc_id").alias("row_key"), F.col("act_year").alias("made"), F.explode("amends").alias("no")).filter("no is not null").distinct()
    no_act = orphans(edges, acts.select("act_number"), {"no": "act_number"})
    no_trace = orphans(no_act, gone, {"no": "r_no"})
    retired_act = matched(no_act, gone, {"no": "r_no"})
    year = F.col("made").cast("string")

    ref, art, no = F.col("gold_doc_id"), F.col("gold_article"), F.col("no")
    parts = [
        shape(missing, "gold_doc_id", ref, "missing", "questions", period), shape(deleted, "gold_doc_id", ref, "deleted", "questions", period),
        shape(late, "gold_doc_id", ref, "late", "questions", period), shape(no_article, "gold_article", art, "missing", "questions", period),
        shape(no_trace, "amends", no, "missing", "acts", year), shape(retired_act, "amends", no, "deleted", "acts", year),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _states(spark, root: str) -> DataFrame:
    return reference_states(*(table(spark, root, t) for t in ("documents", "chunks", "acts", "retired_docs", "questions")))


def p6_found(spark, root: str) -> DataFrame:
    return _states(spark, root).select("field", "row_key", "ref", "status").distinct()


def p6_counts(spark, root: str) -> DataFrame:
    """Orphans per referring table, period, field and state."""
    rows = _states(spark, root).distinct()
    return rows.groupBy("source_table", "period", "field", "status").agg(F.count(F.lit(1)).alias("n"))


def p6_masks(spark, root: str) -> DataFrame:
    """Questions whose gold document and article together name no chunk, nulls included, under each match semantics.

    ``match, id, mask``; ``mask`` tells which part of the reference is null.
    """
    q = table(spark, root, "questions").select("id", F.col("gold_doc_id").alias("doc"), same_spelling(F.col("gold_article")).alias("art")).distinct()
    keys = table(spark, root, "chunks").select(F.col("doc_id").alias("c_doc"), same_spelling(F.col("cite")).alias("c_art"))
    mask = F.concat(F.when(F.col("doc").isNull(), "-").otherwise("d"), F.when(F.col("art").isNull(), "-").otherwise("a"))
    parts = [orphans(q, keys, {"doc": "c_doc", "art": "c_art"}, m).select(F.lit(m).alias("match"), "id", mask.alias("mask")) for m in ("simple", "partial", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p6_masks": p6_masks}

_STATES = r"""
with docs as (select doc_id d_id, min(added_at) d_added from documents group by 1),
q as (select distinct id row_key, gold_doc_id, gold_article, created_at made from questions where gold_doc_id is not null),
e as (select distinct doc_id row_key, act_year made, no from (select doc_id, act_year, unnest(amends) no from acts) where no is not null),
states as (
 select 'gold_doc_id' field, row_key, cast(gold_doc_id as varchar) ref,
  case when not exists (select 1 from docs where d_id = gold_doc_id) then
    case when exists (select 1 from retired_docs r where r.doc_id = gold_doc_id) then 'deleted' else 'missing' end
   when exists (select 1 from docs where d_id = gold_doc_id and d_added > made) then 'late' end status, 'questions' source_table, strftime(made, '%Y-%m') period from q
 union all
 select 'gold_article', row_key, gold_article, 'missing', 'questions', strftime(made, '%Y-%m') from q where gold_article is not null and exists (select 1 from docs where d_id = gold_doc_id)
  and not exists (select 1 from chunks c where c.doc_id = gold_doc_id and lower(regexp_replace(c.cite, '\s+', '', 'g')) = lower(regexp_replace(gold_article, '\s+', '', 'g')))
 union all
 select 'amends', cast(row_key as varchar), cast(no as varchar), case when exists (select 1 from retired_docs r where r.act_number = no) then 'deleted' else 'missing' end, 'acts', cast(made as varchar)
  from e where not exists (select 1 from acts a where a.act_number = no))
"""
ORACLES = {
    "p6_found": _STATES + "select distinct field, row_key, ref, status from states where status is not null",
    "p6_counts": _STATES + "select source_table, period, field, status, count(*) n from (select distinct * from states where status is not null) group by all",
    "p6_masks": r"""with q as (select distinct id, gold_doc_id doc, lower(regexp_replace(gold_article, '\s+', '', 'g')) art from questions),
k as (select distinct doc_id c_doc, lower(regexp_replace(cite, '\s+', '', 'g')) c_art from chunks),
m as (select id, doc, art, case when doc is null then '-' else 'd' end || case when art is null then '-' else 'a' end mask from q)
select 'simple' as "match", id, mask from m where mask = 'da' and not exists (select 1 from k where c_doc = doc and c_art = art)
union select 'partial', id, mask from m where mask <> '--' and not exists (select 1 from k where (doc is null or c_doc = doc) and (art is null or c_art = art))
union select 'full', id, mask from m where mask in ('d-', '-a') or mask = 'da' and not exists (select 1 from k where c_doc = doc and c_art = art)""",
}
