"""Acts read from the titles of documents, and reports over acts.

What a title does not say stays null.  A date needs day 1 to 31 and month 1 to 12 but is not checked against the calendar.
Titles that are null give a row of nulls with an empty subject and no amendments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
#: The first type whose pattern matches is taken.
ACT_TYPES = (
    ("Akt normativ", r"\bakt\s+normativ"), ("Udhëzim", r"\b(udh[ëe]zim|umf)\b"), ("VKM", r"\b(vkm|vendim\s+i?\s*k[ëe]shillit|vendim)\b"), ("Ligj", r"\bligj"),
    ("Urdhër", r"\burdh[ëe]r"), ("Marrëveshje", r"\bmarr[ëe]veshje|konvent"), ("Standard", r"\b(skk|snrf|snk)\b|standard"), ("Kod", r"\bkodi\b"),
)
CATEGORY_TYPES = {"marreveshje-nderkombetare": "Marrëveshje", "marreveshje-kombetare": "Marrëveshje", "kkk": "Standard", "akte-te-dpt": "Akt i DPT", "pune": "Legjislacion pune"}
NUMBER = r"\bnr\.?\s*(\d+)(?:\s*/\s*(\d{4}))?"
DATE = r"\bdat[ëe]\s*(\d{1,2})[./](\d{1,2})[./](\d{4})"
BARE_YEAR = r"\b(19[89]\d|20[0-3]\d)\b"
AMENDED = r"\bi\s+ndryshuar\b|\bt[ëe]\s+ndryshuar\b"
AMENDMENT = r"p[ëe]r\s+disa\s+ndryshime|ndryshime\s+n[ëe]|^ndryshim"
REPEAL = r"^shfuqizim|shfuqizohet"
#: Only definite accusative and genitive forms refer to another act.
REFERENCE = r"\b(?:ligjin|ligjit|vendimin|vendimit|udh[ëe]zimin|udh[ëe]zimit|aktin|aktit)\s+nr\.?\s*(\d+)"
QUOTED = "[\"“”«]([^\"“”«»]{10,200})[\"“”»]"
SUBJECT_CHARS, SINCE, BAR, TARGETS, NEWS, TYPES_SHOWN = 200, 2014, 20, 8, 12, 4
OUTSIDE = "(jashtë korpusit)"
# ----------------------------------------------------------------------------------------------------------------------
_I = "(?iu)"


def act_type(title, category):
    """Type by the title's first matching pattern, else by the category; null when neither tells."""
    out = F.when(F.coalesce(title, F.lit("")).rlike(_I + ACT_TYPES[0][1]), ACT_TYPES[0][0])
    for label, pattern in ACT_TYPES[1:]:
        out = out.when(F.coalesce(title, F.lit("")).rlike(_I + pattern), label)
    for value, label in CATEGORY_TYPES.items():
        out = out.when(category == value, label)
    return out


def parse_acts(documents: DataFrame) -> DataFrame:
    """One act per document."""
    t = F.coalesce(F.col("title"), F.lit(""))
    own = F.regexp_replace(t, _I + REFERENCE, "\x1e")
    d = documents.withColumn("t", t).withColumn("number", F.nullif(F.regexp_extract(own, _I + NUMBER, 1), F.lit("")).try_cast("int"))
    day, month, year = (F.regexp_extract("t", _I + DATE, i).try_cast("int") for i in (1, 2, 3))
    valid = day.between(1, 31) & month.between(1, 12)
    bare = F.array_min(F.transform(F.regexp_extract_all("t", F.lit(BARE_YEAR), 1), lambda y: y.cast("int")))
    slash = F.nullif(F.regexp_extract(own, _I + NUMBER, 2), F.lit("")).try_cast("int")
    refs = F.array_compact(F.transform(F.regexp_extract_all("t", F.lit(_I + REFERENCE), 1), lambda n: n.try_cast("int")))
    quoted = F.regexp_extract("t", QUOTED, 1)
    return d.select(
        "doc_id", act_type(F.col("title"), F.col("category")).alias("act_type"), "number", F.when(valid, year).otherwise(F.coalesce(slash, bare)).alias("year"),
        F.when(valid, F.format_string("%04d-%02d-%02d", year, month, day)).alias("date"), F.left(F.trim(F.when(quoted != "", quoted).otherwise(F.col("t"))), F.lit(SUBJECT_CHARS)).alias("subject"),
        F.coalesce("domain", F.lit("tatime")).alias("domain"), F.coalesce("authority", F.lit("")).alias("authority"),
        F.col("t").rlike(_I + AMENDED).alias("is_amended"), F.col("t").rlike(_I + AMENDMENT).alias("is_amendment"), F.col("t").rlike(_I + REPEAL).alias("is_repeal"),
        F.array_sort(F.array_distinct(F.filter(refs, lambda n: F.coalesce(n != F.col("number"), F.lit(True))))).alias("amends"),
        F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("regime", F.lit("")).alias("regime"),
    )


def acts_parsed(spark, root: str) -> DataFrame:
    a = parse_acts(table(spark, root, "documents"))
    return a.withColumn("amends", F.array_join(F.transform("amends", lambda n: n.cast("string")), ",")).withColumn("year", F.coalesce("year", F.lit(0))).withColumn("number", F.coalesce("number", F.lit(0)))


def _acts(spark, root: str) -> DataFrame:
    return table(spark, root, "acts").dropDuplicates(["doc_id"])


def acts_coverage(spark, root: str) -> DataFrame:
    """Acts with each attribute, and the share in whole percent; 0 and empty count as absent."""
    a = _acts(spark, root)
    have = {"type": F.coalesce(F.col("act_type"), F.lit("")) != "", "number": F.coalesce("act_number", F.lit(0)) != 0, "year": F.coalesce("act_year", F.lit(0)) != 0, "date": F.coalesce(F.col("act_date"), F.lit("")) != "", "subject": F.coalesce(F.col("subject"), F.lit("")) != ""}
    one = a.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in have.items()])
    rows = one.select("total", F.explode(F.create_map(*[x for k in have for x in (F.lit(k), F.col(k))])).alias("attribute", "present"))
    return rows.select("attribute", "present", "total", F.floor(100 * F.col("present") / F.greatest("total", F.lit(1))).alias("percent"))


def acts_by_type(spark, root: str) -> DataFrame:
    return _acts(spark, root).groupBy(F.coalesce("act_type", F.lit("(pa tip)")).alias("act_type")).agg(F.count(F.lit(1)).alias("n"))


def acts_by_year(spark, root: str) -> DataFrame:
    """Acts per year with the length of their bar."""
    y = _acts(spark, root).filter(F.col("act_year") >= SINCE).groupBy("act_year").agg(F.count(F.lit(1)).alias("n"))
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))  # a row per year
    return y.select("act_year", "n", F.greatest(F.lit(1), F.bround(BAR * F.col("n") / peak, 0).cast("int")).alias("bar"))


def acts_by_domain(spark, root: str) -> DataFrame:
    """Acts per domain with its most frequent types."""
    g = _acts(spark, root).groupBy("domain", F.coalesce("act_type", F.lit("?")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("domain")
    r = g.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "t")))
    shown = F.array_sort(F.collect_list(F.when(F.col("r") <= TYPES_SHOWN, F.struct("r", F.concat("t", F.lit(" "), F.col("n")).alias("s")))))
    return r.groupBy("domain").agg(F.sum("n").alias("total"), F.array_join(F.transform(shown, lambda x: x["s"]), ", ").alias("types"))


def amendment_activity(spark, root: str) -> DataFrame:
    """Acts amended most often, with the subject of the last act of that number where the collection has it."""
    a = _acts(spark, root)
    top = a.select(F.explode("amends").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "number").limit(TARGETS)
    names = a.filter("act_number is not null").groupBy(F.col("act_number").alias("number")).agg(F.max_by("subject", "doc_id").alias("subject"))
    return top.join(names, "number", "left").select("number", "n", F.coalesce("subject", F.lit(OUTSIDE)).alias("subject"))


def amendment_flags(spark, root: str) -> DataFrame:
    return _acts(spark, root).agg(*[F.count_if(F.col(c)).alias(c) for c in ("is_amended", "is_amendment", "is_repeal")])


def whats_new(spark, root: str, year: int = 2024) -> DataFrame:
    """First acts of a year by type and number, with the number of acts in that year."""
    a = _acts(spark, root).filter(F.col("act_year") == year)
    first = a.select("doc_id", F.coalesce("act_type", F.lit("")).alias("act_type"), F.coalesce("act_number", F.lit(0)).alias("act_number"), "subject").orderBy("act_type", "act_number", "doc_id").limit(NEWS)
    return first.crossJoin(a.agg(F.count(F.lit(1)).alias("total")))  # one row


QUERIES = {
    "acts_parsed": acts_parsed, "acts_coverage": acts_coverage, "acts_by_type": acts_by_type, "acts_by_year": acts_by_year, "acts_by_domain": acts_by_domain,
    "amendment_activity": amendment_activity, "amendment_flags": amendment_flags, "whats_new": whats_new,
}

_A = "(select * from acts qualify row_number() over (partition by doc_id) = 1)"
_OWN = f"regexp_replace(t, '(?i){REFERENCE}', chr(30), 'g')"
_TYPE = "case " + " ".join(f"when regexp_matches(t, '(?i){p}') then '{k}'" for k, p in ACT_TYPES) + " " + " ".join(f"when category = '{k}' then '{v}'" for k, v in CATEGORY_TYPES.items()) + " end"
ORACLES = {
    "acts_parsed": f"""
with d as (select *, coalesce(title, '') t from documents),
n as (select *, try_cast(nullif(regexp_extract({_OWN}, '(?i){NUMBER}', 1), '') as int) num, try_cast(nullif(regexp_extract({_OWN}, '(?i){NUMBER}', 2), '') as int) slash,
 try_cast(regexp_extract(t, '(?i){DATE}', 1) as int) dd, try_cast(regexp_extract(t, '(?i){DATE}', 2) as int) mm, try_cast(regexp_extract(t, '(?i){DATE}', 3) as int) yy,
 list_min(list_transform(regexp_extract_all(t, '{BARE_YEAR}', 1), lambda y: cast(y as int))) bare, list_filter(list_transform(regexp_extract_all(t, '(?i){REFERENCE}', 1), lambda r: try_cast(r as int)), lambda r: r is not null) refs from d),
v as (select *, dd between 1 and 31 and mm between 1 and 12 ok from n)
select doc_id, {_TYPE} act_type, coalesce(num, 0) number, coalesce(case when ok then yy else coalesce(slash, bare) end, 0) as year, case when ok then printf('%04d-%02d-%02d', yy, mm, dd) end as date,
 left(trim(coalesce(nullif(regexp_extract(t, '{QUOTED}', 1), ''), t)), {SUBJECT_CHARS}) subject, coalesce(domain, 'tatime') as domain, coalesce(authority, '') authority,
 regexp_matches(t, '(?i){AMENDED}') is_amended, regexp_matches(t, '(?i){AMENDMENT}') is_amendment, regexp_matches(t, '(?i){REPEAL}') is_repeal,
 coalesce(array_to_string(list_sort(list_distinct(list_filter(refs, lambda r: num is null or r <> num))), ','), '') amends, coalesce(n_articles, 0) n_articles, coalesce(regime, '') regime from v""",
    "acts_coverage": f"with a as {_A}, s as (select count(*) total, count(nullif(act_type, '')) t, count(nullif(act_number, 0)) n, count(nullif(act_year, 0)) y, count(nullif(act_date, '')) d, count(nullif(subject, '')) s from a), u as (select unnest(['type', 'number', 'year', 'date', 'subject']) as attribute, unnest([t, n, y, d, s]) present, total from s) select *, 100 * present // greatest(total, 1) as percent from u",
    "acts_by_type": f"select coalesce(act_type, '(pa tip)') act_type, count(*) n from {_A} group by 1",
    "acts_by_year": f"with y as (select act_year, count(*) n from {_A} where act_year >= {SINCE} group by 1) select act_year, n, greatest(1, cast(round_even({BAR} * n / max(n) over (), 0) as int)) bar from y",
    "acts_by_domain": f"with g as (select domain, coalesce(act_type, '?') t, count(*) n from {_A} group by all), r as (select *, row_number() over (partition by domain order by n desc, t) r from g) select domain, cast(sum(n) as bigint) total, string_agg(t || ' ' || n, ', ' order by r) filter (where r <= {TYPES_SHOWN}) types from r group by 1",
    "amendment_activity": f"with a as {_A}, e as (select number, count(*) n from (select unnest(amends) as number from a) group by 1 order by n desc, number limit {TARGETS}) select number, n, coalesce(subject, '{OUTSIDE}') subject from e left join (select act_number, arg_max(subject, doc_id) subject from a where act_number is not null group by 1) on act_number = number",
    "amendment_flags": f"select count_if(is_amended) is_amended, count_if(is_amendment) is_amendment, count_if(is_repeal) is_repeal from {_A}",
    "whats_new": f"with a as (select * from {_A} where act_year = 2024) select doc_id, coalesce(act_type, '') act_type, coalesce(act_number, 0) act_number, subject, (select count(*) from a) total from a order by 2, 3, 1 limit {NEWS}",
}
