"""Duties, deadlines, rates and penalties read from articles, and queries over them.

Every duty phrase of an article gives a window around it, cut at blanks; a row is kept when the window holds at least one
attribute.  Offsets come from marking the phrases and adding up the pieces between the marks, so all of it stays in the JVM.
Null texts have no duties; attributes that are not found stay null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.functions.text import CHUNKS_SQL, fold, squeeze, squeeze_sql
from actmill.operators.retrieval import top
from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
MONTHS = ("janar", "shkurt", "mars", "prill", "maj", "qershor", "korrik", "gusht", "shtator", "tetor", "nëntor", "dhjetor")
SUBJECTS = (
    ("punëdhënësi", r"\bpun[ëe]dh[ëe]n[ëe]s"), ("punëmarrësi", r"\bpun[ëe]marr[ëe]s"), ("i vetëpunësuari", r"\bi?\s*vet[ëe]pun[ëe]suar"), ("personi i tatueshëm", r"\bperson[a-zëç]*\s+i?\s*tatuesh[ëe]m"),
    ("tatimpaguesi", r"\btatimpagues"), ("subjekti i TVSH-së", r"\bsubjekt[a-zëç]*\s+i\s+TVSH"), ("njësia ekonomike", r"\bnj[ëe]si[a-zëç]*\s+ekonomike"), ("organi tatimor", r"\borgan[a-zëç]*\s+tatimor"),
    ("shoqëria tregtare", r"\bshoq[ëe]ri[a-zëç]*\s+tregtare"),
)
DUTY = r"detyroh[ea]n?|[ëe]sht[ëe]\s+i\s+detyruar|duhet\s+t[ëe]|ka\s+detyrimin"
NUMBER_WORDS = {"një": 1, "nje": 1, "dy": 2, "tre": 3, "tri": 3, "katër": 4, "kater": 4, "pesë": 5, "pese": 5, "gjashtë": 6, "gjashte": 6, "shtatë": 7, "shtate": 7, "tetë": 8, "tete": 8, "nëntë": 9, "nente": 9, "dhjetë": 10, "dhjete": 10}
UNIT_DAYS = {"dit": 1, "jav": 7, "muaj": 30, "vit": 365}
RELATIVE = r"\b(?:brenda|jo\s+m[ëe]\s+von[ëe]\s+se)\s+(\d+|nj[ëe]|dy|tre|tri|kat[ëe]r|pes[ëe]|gjasht[ëe]|shtat[ëe]|tet[ëe]|n[ëe]nt[ëe]|dhjet[ëe])\s*(dit[ëe](?:ve|sh)?|muaj[ie]?v?e?|jav[ëe](?:ve)?|vite?ve?)"
ABSOLUTE = r"\b(?:deri\s+m[ëe]|jo\s+m[ëe]\s+von[ëe]\s+se|brenda\s+dat[ëe]s)\s+(\d{1,2})\s+(" + "|".join(MONTHS).replace("ë", "[ëe]") + ")"
RATE = r"\b\d{1,2}(?:[.,]\d+)?\s?%"
AMOUNT = r"\b(?:\d[\d\.\s]{2,}\d|\d)\s*(?:lek[ëe]|milion[ëe]?\s+lek[ëe]?)"
PENALTY = r"gjob[ëeaèt]{1,3}|sanksion[a-zëç]*|d[ëe]nohet|d[ëe]nim\s+me|kamat[ëevo]{1,3}|interes[a-zëç]*\s+vonese"
FORM = r"formular[a-zëç]*(?:\s+nr\.?\s*\d+)?|deklarat[ëeaèn]{1,3}[a-zëç]*"
BARE_VERBS = ("sanksionon", "sanksionohet", "dënohet", "denohet", "ndëshkohet")
TABLE_QUESTIONS = (
    r"\bafat(e|et|eve)?\b.*\b(kam|kemi|ka|jan[ëe])", r"\bcilat\b.*\bdetyrime\b", r"\bçfar[ëe].*\bdetyrime\b.*\bkam\b", r"\bdetyrime(t|ve)?\b.*\bsi\b\s+(punëdhënës|tatimpagues)",
    r"\bbrenda\b\s*\d+\s*dit", r"\bku\b.*\bgjob[ëa]",
)
BEFORE, AFTER, KEPT, LIMIT, SUBJECTS_SHOWN = 160, 260, 4, 50, 6
# ----------------------------------------------------------------------------------------------------------------------
_I, _EDGE = "(?iu)", r"(?![\p{L}\p{N}_])"
_START = r"(?<![\p{L}\p{N}_])"


def marked(text: Column) -> Column:
    """Text cut before each duty phrase; every piece but the first starts with the phrase and a second mark."""
    return F.split(F.regexp_replace(text, f"{_I}{_START}({DUTY}){_EDGE}", "\x1e$1\x1f"), "\x1e")


def _window(text: Column, start: Column, end: Column) -> Column:
    """Up to BEFORE characters before and AFTER after a phrase, snapped to blanks, white space collapsed."""
    lo, hi = F.greatest(F.lit(0), start - BEFORE), F.least(F.length(text), end + AFTER)
    blank = F.locate(" ", F.substring(text, lo + 1, start - lo))
    lo = F.when((lo > 0) & (blank > 0), lo + blank).otherwise(lo)
    back = F.locate(" ", F.reverse(F.substring(text, end + 1, hi - end)))
    hi = F.when((hi < F.length(text)) & (back > 0), hi - back).otherwise(hi)
    return squeeze(F.substring(text, lo + 1, hi - lo))


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, _I + pattern, group), F.lit(""))


def extract(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Obligations of the article chunks of documents that are not archival."""
    a = chunks.filter("strategy = 'article'").select("chunk_id", "doc_id", "cite", "heading", "text")
    d = documents.select(F.col("doc_id").alias("d_id"), "domain", "authority", "archival", "url").dropDuplicates(["d_id"])
    p = a.withColumn("pieces", marked(F.col("text"))).filter(F.size("pieces") > 1).join(d, F.col("doc_id") == F.col("d_id"), "left").filter(~F.coalesce("archival", F.lit(False)))
    at = F.aggregate(F.slice("pieces", 1, F.col("i")), F.lit(0), lambda n, x: n + F.length(F.replace(x, F.lit("\x1f"), F.lit(""))))
    rows = p.select("*", F.posexplode("pieces").alias("i", "piece")).filter("i > 0").withColumn("start", at)
    rows = rows.withColumn("w", _window(F.col("text"), F.col("start"), F.col("start") + F.locate("\x1f", F.col("piece")) - 1))
    w = F.col("w")
    subject = F.coalesce(*[F.when(w.rlike(_I + pat), label) for label, pat in SUBJECTS])
    quantity, unit = F.lower(F.regexp_extract(w, _I + RELATIVE, 1)), F.lower(F.regexp_extract(w, _I + RELATIVE, 2))
    number = F.coalesce(quantity.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), quantity))
    factor = F.coalesce(*[F.when(unit.startswith(u), n) for u, n in UNIT_DAYS.items()])
    relative, absolute = squeeze(_first(w, RELATIVE)), squeeze(_first(w, ABSOLUTE))
    month = F.array_position(F.array(*[F.lit(m.replace("ë", "e")) for m in MONTHS]), fold(F.lower(F.regexp_extract(w, _I + ABSOLUTE, 2))))
    date = F.format_string("--%02d-%02d", month, F.regexp_extract(w, _I + ABSOLUTE, 1).try_cast("int"))
    rates, amounts = F.regexp_extract_all(w, F.lit(f"({RATE})"), 1), F.transform(F.regexp_extract_all(w, F.lit(f"{_I}({AMOUNT})"), 1), squeeze)
    rows = rows.select(
        F.replace(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("cite", F.lit("")), (F.col("i") - 1).cast("string")), F.lit(" "), F.lit("")).alias("obligation_id"), "chunk_id",
        "doc_id", "cite", "heading", F.coalesce("domain", F.lit("tatime")).alias("domain"), "authority", subject.alias("subject"), F.col("w").alias("duty_span"), F.coalesce(relative, absolute).alias("deadline_text"),
        F.when(relative.isNotNull(), number * factor).alias("deadline_days"), F.when(relative.isNull() & absolute.isNotNull(), date).alias("deadline_date"), rates.alias("rates"), amounts.alias("amounts"),
        _first(w, f"{_START}({PENALTY}){_EDGE}").alias("penalty"), _first(w, f"{_START}({FORM}){_EDGE}").alias("form"), (relative.isNotNull()).alias("_rel"), F.col("url").alias("source_url"),
    )
    trace = F.array_compact(F.array(
        F.lit("duty"), F.when(F.col("subject").isNotNull(), "subject"), F.when(F.col("_rel"), "deadline_relative"), F.when(F.col("deadline_date").isNotNull(), "deadline_absolute"),
        F.when(F.size("rates") > 0, "rate"), F.when(F.size("amounts") > 0, "amount"), F.when(F.col("penalty").isNotNull(), "penalty"), F.when(F.col("form").isNotNull(), "form"),
    ))
    out = rows.withColumn("matched_by", trace).filter(F.size("matched_by") > 1).drop("_rel")
    return out.withColumn("rates", F.slice("rates", 1, KEPT)).withColumn("amounts", F.slice("amounts", 1, KEPT))


def real_penalty(penalty: Column) -> Column:
    """Whether a penalty says more than a bare verb."""
    p = F.lower(F.trim(F.coalesce(penalty, F.lit(""))))
    return (p != "") & ~p.isin(*BARE_VERBS)


def richness() -> Column:
    have = (F.col("deadline_days").isNotNull(), F.size("rates") > 0, real_penalty(F.col("penalty")), F.coalesce(F.col("form"), F.lit("")) != "", F.col("subject").isNotNull())
    return sum(c.cast("int") for c in have)


def search(rows: DataFrame, domain: str | None = None, subject: str | None = None, with_deadline: bool = False, max_days: int | None = None, with_penalty: bool = False, text: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Obligations that meet every filter given, one per article, the richest first kept; those without days last."""
    tests = [F.lit(True)]
    if domain:
        tests.append(F.col("domain") == domain)
    if subject:
        tests.append(F.col("subject") == subject)
    if with_deadline:
        tests.append(F.coalesce(F.col("deadline_text"), F.lit("")) != "")
    if max_days is not None:
        tests.append(F.col("deadline_days") <= max_days)
    if with_penalty:
        tests.append(real_penalty(F.col("penalty")))
    if text:
        haystack = F.lower(fold(F.concat_ws(" ", "duty_span", F.coalesce("heading", F.lit("")), F.coalesce("cite", F.lit("")), F.coalesce("subject", F.lit("")))))
        tests.append(F.contains(haystack, F.lower(fold(F.lit(text)))))
    order = [F.col("deadline_days").isNull(), F.asc("deadline_days"), F.asc("cite"), F.asc("obligation_id"), F.asc("chunk_id")]
    one = top(rows.filter(reduce(and_, tests)).withColumn("rich", richness()), ["doc_id", "cite"], 1, [F.desc("rich"), *order]).drop("rank", "rich")
    return one.orderBy(*order).limit(limit)


def _rows(spark, root: str) -> DataFrame:
    return extract(table(spark, root, "chunks").dropDuplicates(["chunk_id"]), table(spark, root, "documents"))


def obligations(spark, root: str) -> DataFrame:
    r = _rows(spark, root)
    return r.select("obligation_id", "chunk_id", "domain", "subject", "duty_span", "deadline_text", F.coalesce("deadline_days", F.lit(-1)).alias("deadline_days"), "deadline_date", F.array_join("rates", "|").alias("rates"), F.array_join("amounts", "|").alias("amounts"), "penalty", "form", F.array_join("matched_by", "|").alias("matched_by"))


def obligations_search(spark, root: str) -> DataFrame:
    """Duties with a deadline of at most 60 days."""
    return search(_rows(spark, root), with_deadline=True, max_days=60).select("obligation_id", "chunk_id", "doc_id", "cite", "deadline_days")


def obligations_text(spark, root: str) -> DataFrame:
    """Duties that mention declarations, whatever the accents typed."""
    return search(_rows(spark, root), text="deklarojë").select("obligation_id", "chunk_id", "doc_id", "cite")


def obligations_coverage(spark, root: str) -> DataFrame:
    names = {"deadline": F.coalesce("deadline_days", F.lit(0)) != 0, "rate": F.size("rates") > 0, "amount": F.size("amounts") > 0, "penalty": F.col("penalty").isNotNull(), "real_penalty": real_penalty(F.col("penalty")), "form": F.col("form").isNotNull(), "subject": F.col("subject").isNotNull()}
    return _rows(spark, root).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in names.items()])


def obligations_report(spark, root: str) -> DataFrame:
    """Obligations per domain, and per subject for the most frequent subjects."""
    r = _rows(spark, root)
    d = r.groupBy(F.col("domain").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("domain").alias("by"), "value", "n")
    s = r.filter("subject is not null").groupBy(F.col("subject").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(SUBJECTS_SHOWN)
    return d.unionByName(s.select(F.lit("subject").alias("by"), "value", "n"))


def is_table_question(question: Column) -> Column:
    """Whether a question asks to list duties rather than to explain one."""
    q = F.coalesce(question, F.lit(""))
    return reduce(lambda a, b: a | b, [q.rlike(_I + p) for p in TABLE_QUESTIONS])


def table_questions(spark, root: str) -> DataFrame:
    q = table(spark, root, "questions").dropDuplicates(["id"])
    return q.groupBy("category", is_table_question(F.col("question")).alias("to_table")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "obligations": obligations, "obligations_search": obligations_search, "obligations_text": obligations_text, "obligations_coverage": obligations_coverage,
    "obligations_report": obligations_report, "table_questions": table_questions,
}

# SQL counterparts: word edges are written out, as \b knows ASCII letters only.
_E = r"($|[^\p{L}\p{N}_])"
_S = r"(^|[^\p{L}\p{N}_])"


def _x(p: str, group: int) -> str:
    return f"nullif(regexp_extract(w, '(?i){p}', {group}), '')"


_SUBJECT = "case " + " ".join(f"when regexp_matches(w, '(?i){p}') then '{k}'" for k, p in SUBJECTS) + " end"
_QTY, _UNIT = f"lower(regexp_extract(w, '(?i){RELATIVE}', 1))", f"lower(regexp_extract(w, '(?i){RELATIVE}', 2))"
_NUM = f"coalesce(try_cast({_QTY} as int), case {_QTY} " + " ".join(f"when '{k}' then {v}" for k, v in NUMBER_WORDS.items()) + " end)"
_FACTOR = "case " + " ".join(f"when starts_with({_UNIT}, '{k}') then {v}" for k, v in UNIT_DAYS.items()) + " end"
_MONTH = f"list_position([{', '.join(repr(m.replace('ë', 'e')) for m in MONTHS)}], translate(lower(regexp_extract(w, '(?i){ABSOLUTE}', 2)), 'ëËçÇ', 'eEcC'))"
_REAL = f"(lower(trim(coalesce(penalty, ''))) not in ('', {', '.join(repr(v) for v in BARE_VERBS)}))"
ROWS_SQL = f"""
a as (select chunk_id, doc_id, cite, heading, text, string_split(regexp_replace(text, '(?i){_S}({DUTY}){_E}', '\\1' || chr(30) || '\\2' || chr(31) || '\\3', 'g'), chr(30)) pieces from {CHUNKS_SQL} where strategy = 'article'),
p as (select a.*, coalesce(domain, 'tatime') domain from a left join documents d using (doc_id) where len(pieces) > 1 and not coalesce(archival, false)),
e as (select *, unnest(pieces) piece, generate_subscripts(pieces, 1) - 1 i from p),
o as (select *, list_sum(list_transform(pieces[1:i], lambda x: length(replace(x, chr(31), ''))))::int start, instr(piece, chr(31)) - 1 k from e where i > 0),
b as (select *, greatest(0, start - {BEFORE}) lo, least(length(text), start + k + {AFTER}) hi, start + k fin from o),
g as (select *, instr(substr(text, lo + 1, start - lo), ' ') bl, length(regexp_extract(substr(text, fin + 1, hi - fin), ' [^ ]*$')) bk from b),
h as (select *, case when lo > 0 and bl > 0 then lo + bl else lo end lo2, case when hi < length(text) and bk > 0 then hi - bk else hi end hi2 from g),
t as (select replace(doc_id || ':' || coalesce(cite, '') || ':' || (i - 1), ' ', '') obligation_id, chunk_id, doc_id, cite, heading, domain, {squeeze_sql('substr(text, lo2 + 1, hi2 - lo2)')} w from h),
u as (select *, {_SUBJECT} subject, {squeeze_sql(_x(RELATIVE, 0))} rel, {squeeze_sql(_x(ABSOLUTE, 0))} abs_, {_NUM} * {_FACTOR} as n_days, printf('--%02d-%02d', {_MONTH}, try_cast(regexp_extract(w, '(?i){ABSOLUTE}', 1) as int)) dt,
 regexp_extract_all(w, '{RATE}') rates, list_transform(regexp_extract_all(w, '(?i){AMOUNT}'), lambda x: {squeeze_sql('x')}) amounts, {_x(f'{_S}({PENALTY}){_E}', 2)} penalty, {_x(f'{_S}({FORM}){_E}', 2)} form from t),
m as (select *, w duty_span, coalesce(rel, abs_) deadline_text, case when rel is not null then n_days end deadline_days, case when rel is null and abs_ is not null then dt end deadline_date,
 list_filter(['duty', case when subject is not null then 'subject' end, case when rel is not null then 'deadline_relative' end, case when rel is null and abs_ is not null then 'deadline_absolute' end, case when len(rates) > 0 then 'rate' end, case when len(amounts) > 0 then 'amount' end, case when penalty is not null then 'penalty' end, case when form is not null then 'form' end], lambda x: x is not null) matched_by from u),
obl as (select * replace (rates[1:{KEPT}] as rates, amounts[1:{KEPT}] as amounts) from m where len(matched_by) > 1)"""
_RICH = f"(deadline_days is not null)::int + (len(rates) > 0)::int + {_REAL}::int + (coalesce(form, '') <> '')::int + (subject is not null)::int"
_ORDER = "deadline_days is null, deadline_days, cite, obligation_id, chunk_id"


def _search_sql(where: str, cols: str) -> str:
    return f"with {ROWS_SQL}, s as (select * from obl where {where} qualify row_number() over (partition by doc_id, cite order by {_RICH} desc, {_ORDER}) = 1) select {cols} from s order by {_ORDER} limit {LIMIT}"


ORACLES = {
    "obligations": f"with {ROWS_SQL} select obligation_id, chunk_id, domain, subject, duty_span, deadline_text, coalesce(deadline_days, -1) deadline_days, deadline_date, array_to_string(rates, '|') rates, array_to_string(amounts, '|') amounts, penalty, form, array_to_string(matched_by, '|') matched_by from obl",
    "obligations_search": _search_sql("deadline_text is not null and deadline_days <= 60", "obligation_id, chunk_id, doc_id, cite, deadline_days"),
    "obligations_text": _search_sql("contains(lower(translate(concat_ws(' ', duty_span, coalesce(heading, ''), coalesce(cite, ''), coalesce(subject, '')), 'ëËçÇ', 'eEcC')), 'deklaroje')", "obligation_id, chunk_id, doc_id, cite"),
    "obligations_coverage": f"with {ROWS_SQL} select count(*) total, count_if(coalesce(deadline_days, 0) <> 0) deadline, count_if(len(rates) > 0) rate, count_if(len(amounts) > 0) amount, count(penalty) penalty, count_if({_REAL}) real_penalty, count(form) form, count(subject) subject from obl",
    "obligations_report": f"with {ROWS_SQL} select 'domain' as by, domain as value, count(*) n from obl group by 2 union all select * from (select 'subject', subject, count(*) n from obl where subject is not null group by 2 order by n desc, subject limit {SUBJECTS_SHOWN})",
    "table_questions": "select category, " + " or ".join(f"regexp_matches(coalesce(question, ''), '(?i){p}')" for p in TABLE_QUESTIONS) + " to_table, count(*) n from (select * from questions qualify row_number() over (partition by id) = 1) group by all",
}
