"""Sources and sinks of a corpus: manifests, link pages, office files, line-JSON, review workbooks, index packages.

Network access, PDF glyphs and neural encoders are outside Spark: pages arrive as a column of HTML, files as binary rows, and
vectors as a column.  Null HTML has no links; empty tables give no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actmill.functions.text import clean_title
from actmill.operators.retrieval import top
from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
MAGIC = (("25504446", "pdf"), ("504B0304", "docx"), ("D0CF11E0", "doc"))
ID_BASE, ID_SPAN = 900_000, 90_000
DEFAULT_DOMAIN = "tatime"
LEAST_TEXT, IDS_SHOWN = 200, 6
# ----------------------------------------------------------------------------------------------------------------------
#: An anchor: its address and its content.
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Line-JSON, plain or gzipped, blank lines skipped; fields that are missing are null."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Line-JSON in UTF-8, replacing what was there."""
    df.write.mode("overwrite").json(path)


def latest(manifest: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return top(manifest, [key], 1, [F.desc(order)]).drop("rank")


def domain_of(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` with the domain of its source, a default where the source is unknown."""
    s = sources.select(F.col("source").alias("s_key"), F.col("domain").alias("s_domain")).dropDuplicates(["s_key"])
    return df.join(s, F.col("source") == F.col("s_key"), "left").withColumn("source_domain", F.coalesce("s_domain", F.lit(DEFAULT_DOMAIN))).drop("s_key", "s_domain")


def is_document_link(href: Column, pattern: str) -> Column:
    return (F.coalesce(href, F.lit("")) != "") & F.coalesce(href.rlike("(?i)" + pattern), F.lit(False))


def strip_tags(html: Column) -> Column:
    """Markup without its tags; paragraph ends and line breaks become line ends, entities stay."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)</(?:w:)?p>|<(?:w:)?br[^>]*>", "\n"), "<[^>]+>", "")


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a row per anchor: ``pos, href, title``."""
    c = F.col(html)
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(c, F.lit(ANCHOR), 2).alias("inner"))
    rows = pages.select(*[x for x in pages.columns if x != html], F.posexplode(pairs).alias("pos", "a"))
    return rows.select("*", F.col("a.href").alias("href"), clean_title(strip_tags(F.col("a.inner"))).alias("title")).drop("a")


def longest_title(links: DataFrame, by: list[str]) -> DataFrame:
    """The longest title of each link, the earliest of equals; links without any title are left out."""
    return links.filter(F.length("title") > 0).groupBy(*by).agg(F.max_by("title", F.struct(F.length("title"), -F.col("pos"))).alias("title"))


def file_stem(url: Column) -> Column:
    """Name of a url's file without extension, hyphens as blanks."""
    return F.replace(F.regexp_replace(F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))


def stable_id(url: Column) -> Column:
    """Identifier from the hash of a url; collisions are possible."""
    return F.conv(F.left(F.sha2(url, 256), F.lit(8)), 16, 10).cast("long") % ID_SPAN + ID_BASE


def sniff(content: Column) -> Column:
    """File type by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(head == MAGIC[0][0], MAGIC[0][1])
    for magic, kind in MAGIC[1:]:
        out = out.when(head == magic, kind)
    return out.otherwise("unknown")


def unseen(batch: DataFrame, manifest: DataFrame, key: str, per: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key the manifest does not hold, optionally the first ``limit`` of each group."""
    new = batch.join(manifest.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return top(new, [per], limit, [F.asc(key)]).drop("rank") if per and limit else new


def unseen_by_batch(records: DataFrame, key: str, batch: str, order: str) -> DataFrame:
    """``unseen`` batch after batch, without a limit: the first row of each key in order of arrival."""
    return top(records.filter(F.col(key).isNotNull()), [key], 1, [F.asc(batch), F.asc(order)]).drop("rank")


def office_text(files: DataFrame) -> DataFrame:
    """``path, text, error`` of ``path, content``: paragraphs of word files; other types are an error, not a failure."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zipfile

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        xml = z.read("word/document.xml").decode("utf-8")
                    text = re.sub(r"<[^>]+>", "", re.sub(r"</w:p>|<w:br[^>]*>", "\n", xml))
                    out.append((path, text.strip(), None))
                except Exception as e:  # a broken file is a reported row
                    out.append((path, None, f"{type(e).__name__}"[:60]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def inclusion(documents: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """Why documents are left out: number and first ids per reason."""
    n = F.coalesce(F.length(F.trim("text")), F.lit(0))
    reason = F.when(F.col("text").isNull(), "unreadable").when(n == 0, "empty file").when(n < least, "no extractable text")
    r = documents.select("doc_id", reason.alias("reason")).filter("reason is not null")
    first = top(r, ["reason"], IDS_SHOWN, [F.asc("doc_id")]).groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ", ").alias("sample"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(first, "reason")


def write_workbook(df: DataFrame, path: str, notes: tuple[str, ...] = ()) -> None:
    """A review workbook for people: semicolons, a byte order mark, notes before the header.  Bounded by what one person reviews."""
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, delimiter=";")
        w.writerows([[n] for n in notes])
        w.writerow(df.columns)
        for row in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in row])


def read_workbook(spark: SparkSession, path: str, first: str) -> DataFrame:
    """The rows of a workbook below the line whose first cell is ``first``; short rows are filled up."""
    with Path(path).open(encoding="utf-8-sig", newline="") as f:
        rows = list(csv.reader(f, delimiter=";"))
    at = next((i for i, r in enumerate(rows) if r and r[0] == first), None)
    if at is None:
        raise ValueError(f"no header {first!r} in {path}")
    names = rows[at]
    body = [(r + [""] * len(names))[: len(names)] for r in rows[at + 1 :] if any(r)]
    return spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def verify_package(spark: SparkSession, path: str, tables: tuple[str, ...], model: str) -> DataFrame:
    """``table, rows`` of an index package; missing tables, empty ones and another model's stamp are errors."""
    parts = []
    for t in tables:
        df = spark.read.parquet(f"{path}/{t}")
        n = df.count()
        if not n:
            raise ValueError(f"{t} is empty")
        if "model" in df.columns and df.filter(F.col("model") != model).limit(1).count():
            raise ValueError(f"{t} was made by another model")
        parts.append((t, n))
    return spark.createDataFrame(parts, "table string, rows long")


def _records(spark, root):
    return table(spark, root, "records")


def manifest_latest(spark, root: str) -> DataFrame:
    return latest(_records(spark, root), "doc_id", "record_no").select("doc_id", "record_no", "title")


def manifest_new(spark, root: str) -> DataFrame:
    """Documents of the last batches that earlier ones did not bring, five per category."""
    r = _records(spark, root)
    return unseen(r.filter("batch_no >= 8"), r.filter("batch_no < 8"), "doc_id", "category", 5).select("category", "doc_id")


def manifest_unseen(spark, root: str) -> DataFrame:
    """Every document that a batch brings and no earlier batch held, with that batch: what incremental ingest takes."""
    return unseen_by_batch(_records(spark, root), "doc_id", "batch_no", "record_no").select("batch_no", "category", "doc_id")


def source_domains(spark, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "tjeter").otherwise(F.col("source")).alias("source"))
    return domain_of(d, table(spark, root, "sources")).groupBy("source_domain").agg(F.count(F.lit(1)).alias("n"))


def external_sources(spark, root: str) -> DataFrame:
    return table(spark, root, "sources").filter("strategy = 'pages'").select("source", "name")


def url_ids(spark, root: str) -> DataFrame:
    r = _records(spark, root)
    return r.select("record_no", stable_id(F.col("url")).alias("url_id"), file_stem(F.col("url")).alias("stem"), is_document_link(F.col("url"), r"\.pdf([?#]|$)").alias("is_pdf"))


def file_types(spark, root: str) -> DataFrame:
    """File types told by first bytes, made up for each declared type."""
    head = F.when(F.col("filetype") == "pdf", "255044462D").when(F.col("filetype") == "docx", "504B030414").when(F.col("filetype") == "doc", "D0CF11E0A1").otherwise("00")
    return _records(spark, root).groupBy("filetype", sniff(F.unhex(head)).alias("found")).agg(F.count(F.lit(1)).alias("n"))


def _pages(spark, root):
    a = F.concat(F.lit('<p><a class="x" href="'), F.col("url"), F.lit('"><b>'), F.coalesce("title", F.lit("")), F.lit("</b></a></p>"))
    r = _records(spark, root).select("batch_no", "category_id", (F.col("record_no") % 97).alias("page_no"), "record_no", a.alias("a"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "a"))), lambda x: x["a"]), "\n")
    return r.groupBy("batch_no", "category_id", "page_no").agg(html.alias("html"))


def category_links(spark, root: str) -> DataFrame:
    """Documents linked from the pages of a category: the longest title of each numbered download."""
    a = anchors(_pages(spark, root)).withColumn("doc", F.nullif(F.regexp_extract("href", r"(?:dok=|/akte/)(\d+)", 1), F.lit("")).try_cast("long")).filter("doc is not null")
    a = a.withColumn("pos", F.col("page_no") * 10000 + F.col("batch_no") * 1000 + F.col("pos"))
    return longest_title(a, ["category_id", "doc"])


def category_tree(spark, root: str) -> DataFrame:
    """Subcategories below their parents with the last name given to each."""
    r = _records(spark, root).filter("parent_category_id is not null")
    return r.groupBy("parent_category_id", "category_id").agg(F.max_by("category", "record_no").alias("name"))


def listing_with_children(spark, root: str) -> DataFrame:
    """Documents of a category and of its subcategories, by the longest title."""
    r = _records(spark, root).select("category_id", "parent_category_id", "doc_id", F.regexp_replace("title", r"\s+$", "").alias("title"), F.col("record_no").alias("pos"))
    up = r.filter("parent_category_id is not null").select(F.col("parent_category_id").alias("category_id"), "doc_id", "title", "pos")
    return longest_title(r.select("category_id", "doc_id", "title", "pos").unionByName(up), ["category_id", "doc_id"]).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("n_chars"))


def documents_left_out(spark, root: str) -> DataFrame:
    return inclusion(table(spark, root, "documents"))


def content_hashes(spark, root: str) -> DataFrame:
    """Texts that several chunks hold, by hash."""
    c = table(spark, root, "chunks").filter("text <> ''").select("chunk_id", F.sha2("text", 256).alias("sha256")).distinct()
    return c.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id")).filter("n > 1")


QUERIES = {
    "manifest_latest": manifest_latest, "manifest_new": manifest_new, "manifest_unseen": manifest_unseen, "source_domains": source_domains, "external_sources": external_sources, "url_ids": url_ids, "file_types": file_types,
    "category_links": category_links, "category_tree": category_tree, "listing_with_children": listing_with_children, "documents_left_out": documents_left_out, "content_hashes": content_hashes,
}

_STEM = "replace(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '\\.[^.]*$', ''), '-', ' ')"
ORACLES = {
    "manifest_latest": "select doc_id, record_no, title from records qualify row_number() over (partition by doc_id order by record_no desc) = 1",
    "manifest_new": "with n as (select distinct category, doc_id from (select * from records where batch_no >= 8 qualify row_number() over (partition by doc_id order by record_no) = 1) where doc_id not in (select doc_id from records where batch_no < 8)) select category, doc_id from n qualify row_number() over (partition by category order by doc_id) <= 5",
    "manifest_unseen": "select batch_no, category, doc_id from records r where doc_id is not null and not exists (select 1 from records e where e.doc_id = r.doc_id and (e.batch_no, e.record_no) < (r.batch_no, r.record_no))",
    "source_domains": "with d as (select case when doc_id % 10 = 0 then 'tjeter' else source end source from documents) select coalesce(s.domain, 'tatime') source_domain, count(*) n from d left join sources s using (source) group by 1",
    "external_sources": "select source, name from sources where strategy = 'pages'",
    "url_ids": f"select record_no, cast(('0x' || left(sha256(url), 8)) as bigint) % {ID_SPAN} + {ID_BASE} url_id, {_STEM} stem, regexp_matches(url, '(?i)\\.pdf([?#]|$)') is_pdf from records",
    "file_types": "select filetype, case when filetype in ('pdf', 'docx', 'doc') then filetype else 'unknown' end as found, count(*) n from records group by 1, 2",
    "category_links": "with r as (select category_id, try_cast(nullif(regexp_extract(url, '(?:dok=|/akte/)(\\d+)', 1), '') as bigint) doc, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' .;') title, record_no % 97 page_no, batch_no, record_no from records) select category_id, doc, arg_max(title, (length(title), -page_no * 10000 - batch_no * 1000, -record_no)) title from r where doc is not null and title <> '' group by all",
    "category_tree": "select parent_category_id, category_id, arg_max(category, record_no) as name from records where parent_category_id is not null group by 1, 2",
    "listing_with_children": "with r as (select category_id, parent_category_id, doc_id, regexp_replace(title, '\\s+$', '') title from records), u as (select category_id, doc_id, title from r union all select parent_category_id, doc_id, title from r where parent_category_id is not null), b as (select category_id, doc_id, max(length(title)) n from u where title <> '' group by all) select category_id, count(*) n, cast(sum(n) as bigint) n_chars from b group by 1",
    "documents_left_out": f"with r as (select doc_id, case when text is null then 'unreadable' when length(trim(text)) = 0 then 'empty file' when length(trim(text)) < {LEAST_TEXT} then 'no extractable text' end reason from documents) select reason, count(*) n, array_to_string(list_sort(list(doc_id))[1:{IDS_SHOWN}], ', ') sample from r where reason is not null group by 1",
    "content_hashes": "select sha256(text) sha256, count(distinct chunk_id) n, min(chunk_id) first_id from chunks where text <> '' group by 1 having count(distinct chunk_id) > 1",
}
