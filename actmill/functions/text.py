"""Column functions for legal text: cleaning, folding, tokens, stems, sentences, citations and rendering.

Every function takes columns and gives a column and stays inside the JVM.  Null input gives null unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
FOLD_FROM, FOLD_TO = "ëËçÇ", "eEcC"
STOPWORDS = (
    "i", "e", "te", "se", "ne", "me", "per", "nga", "dhe", "ose", "qe", "si", "a", "as", "by", "ku", "kur", "cdo", "ky", "kjo", "keto", "keta", "ai", "ajo",
    "eshte", "jane", "ishte", "ishin", "jete", "behet", "behen", "ka", "kane", "duhet", "mund", "do", "nuk", "s", "u", "ta", "tjeter", "tjera", "kete", "ketij",
    "kesaj", "tij", "saj", "tyre", "yne", "sipas", "lidhur", "vetem", "gjithe", "gjitha", "cila", "cilat", "cili", "cilit", "cilen",
)
#: Tried in this order; at most one is taken off, and at least MIN_STEM characters stay.
SUFFIXES = (
    "ndeve", "ndeje", "eve", "ave", "ive", "uar", "uara", "ues", "uese", "sve", "shme", "shem", "et", "at", "it", "in", "un", "ur", "es", "en", "ve", "sh", "ja", "e", "a", "i", "u",
)
MIN_STEM = 3
TOKEN = "([a-z0-9]+)"
#: Lines of letterhead; a caller can add its own.
LETTERHEAD = (
    r"Adresa:.*", r"Web\s*site:.*", r"Tel:.*", r"Fax:.*", r"DREJTORIA E P[ËE]RGJITHSHME E TATIMEVE\s*", r"Nr\.?_{2,}\s*Prot\.?\s*", r"L[ëe]nda:.*", r"Tiran[ëe],?\s*m[ëe]?_+.*",
)
#: A sentence ends at these marks before a capital or a list number; shorter parts are fragments.
MIN_SENTENCE = 40
CONCRETE = r"(?iu)\b\d+\s*(dit[ëe]|muaj|vit|vjet|%|përqind|lek[ëe]?)\b|\bbrenda\b|\bderi më\b|\bafat"
CONCRETE_BONUS = 0.15
# ----------------------------------------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_title(c: Column) -> Column:
    """Title without padding and outer blanks, points and semicolons."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" .;"))


def normalise_text(c: Column, letterhead: tuple[str, ...] = LETTERHEAD) -> Column:
    """Extracted text without hard blanks, word breaks, letterhead lines and surplus blanks; bare numbers stay."""
    c = F.regexp_replace(F.translate(c, " ​", " "), r"\bNeni(\d)", "Neni $1")
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    for line in letterhead:
        c = F.regexp_replace(c, rf"(?dm)^\s*{line}$", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def stem(word: Column) -> Column:
    """Word without one inflectional suffix."""
    out = F.when(F.length(word) <= MIN_STEM, word)
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) - len(s) >= MIN_STEM), F.left(word, F.length(word) - F.lit(len(s))))
    return out.otherwise(word)


def tokens(text: Column, stopwords: bool = True, stemming: bool = True) -> Column:
    """Array of folded, lower-case tokens, repeated ones kept; null text gives an empty array."""
    out = F.regexp_extract_all(F.lower(fold(F.coalesce(text, F.lit("")))), F.lit(TOKEN), 1)
    if stopwords:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(out, stem) if stemming else out


def embed_text(cite: Column, heading: Column, text: Column) -> Column:
    """Text that is indexed: citation and heading on a line before it, where there are any."""
    prefix = F.btrim(F.concat(F.coalesce(cite, F.lit("")), F.lit(". "), F.coalesce(heading, F.lit(""))), F.lit(" ."))
    return F.when(prefix == "", text).otherwise(F.concat(prefix, F.lit("\n"), text))


def normalise_cite(c: Column) -> Column:
    """Citation up to its first bracket, in lower case, blanks collapsed; null becomes empty."""
    return squeeze(F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\("), 1)))


def sentences(text: Column) -> Column:
    """Array of sentences of at least MIN_SENTENCE characters."""
    parts = F.split(F.coalesce(text, F.lit("")), r'(?<=[.!?;:])\s+(?=[A-ZËÇ«"]|\d+[.)]\s)')
    return F.filter(F.transform(parts, squeeze), lambda s: F.length(s) >= MIN_SENTENCE)


def sentence_score(question_terms: Column, sentence: Column) -> Column:
    """Share of the question's terms in a sentence, with a bonus for a concrete fact; 0 where either has no term."""
    q, s = F.array_distinct(question_terms), F.array_distinct(tokens(sentence))
    share = F.size(F.array_intersect(q, s)) / F.nullif(F.size(q), F.lit(0))
    return F.when((F.size(q) == 0) | (F.size(s) == 0), 0.0).otherwise(share + F.when(sentence.rlike(CONCRETE), CONCRETE_BONUS).otherwise(0.0))


def escape_html(c: Column) -> Column:
    """Text on one line with the three characters of markup escaped."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, squeeze(c))


def citation(cite: Column, heading: Column) -> Column:
    """``cite — heading`` without dangling dashes."""
    return F.btrim(F.concat(F.coalesce(cite, F.lit("")), F.lit(" — "), F.coalesce(heading, F.lit(""))), F.lit(" —"))


def grouped(amount: Column) -> Column:
    """Whole number with blanks between thousands, rounded half to even."""
    return F.replace(F.format_number(F.bround(amount, 0), 0), F.lit(","), F.lit(" "))


def id_category(c: Column) -> Column:
    """Identifier without the part after its last hyphen."""
    return F.regexp_replace(c, r"-[^-]*$", "")


def human_bytes(n: Column) -> Column:
    """Size in the largest unit of 1024 steps that keeps it at 1 or more, without decimals."""
    out = F.when(n < 1024, F.concat(F.bround(n.cast("double"), 0).cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.bround(n / 1024**power, 0).cast("long").cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.bround(n / 1024**3, 0).cast("long").cast("string"), F.lit(" GB")))


def link_markers(text: Column, ranks: Column, urls: Column) -> Column:
    """Markers ``[Sn]`` as links where rank n was retrieved, unchanged elsewhere; ``ranks`` and ``urls`` run in parallel."""
    pairs = F.arrays_zip(ranks.alias("r"), urls.alias("u"))
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, F.concat(F.lit("[S"), p["r"].cast("string"), F.lit("]")), F.concat(F.lit("[[S"), p["r"].cast("string"), F.lit("]]("), p["u"], F.lit(")"))))


def session_key(session: Column, host: Column, has_request: Column) -> Column:
    """Session hash, else the client's host, else a shared key; ``local`` without a request."""
    return F.when(~has_request, "local").otherwise(F.coalesce(F.nullif(session, F.lit("")), F.nullif(host, F.lit("")), F.lit("anon")))


# SQL counterparts -----------------------------------------------------------------------------------------------------


def stem_sql(w: str) -> str:
    return f"case when length({w}) <= {MIN_STEM} then {w} " + " ".join(f"when ends_with({w}, '{s}') and length({w}) - {len(s)} >= {MIN_STEM} then left({w}, length({w}) - {len(s)})" for s in SUFFIXES) + f" else {w} end"


def raw_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(translate(coalesce({text}, ''), '{FOLD_FROM}', '{FOLD_TO}')), '[a-z0-9]+')"


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def tokens_sql(text: str) -> str:
    """List of tokens in DuckDB."""
    return f"list_transform(list_filter({raw_tokens_sql(text)}, lambda w: w not in {STOP_SQL}), lambda w: {stem_sql('w')})"


# Queries --------------------------------------------------------------------------------------------------------------


def _chunks(spark, root):
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


CHUNKS_SQL = "(select * from chunks qualify row_number() over (partition by chunk_id) = 1)"


def token_counts(spark, root: str) -> DataFrame:
    """Tokens of all chunks by stem, with their number of texts; words are counted before they are stemmed."""
    raw = _chunks(spark, root).select("chunk_id", F.explode(tokens(F.col("text"), stemming=False)).alias("w"))
    per = raw.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(stem(F.col("w")).alias("term")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_forms"))


def titles_clean(spark, root: str) -> DataFrame:
    t = table(spark, root, "documents")
    return t.select("doc_id", clean_title(F.col("title")).alias("title"), squeeze(fold(F.col("title"))).alias("folded"))


def texts_normalised(spark, root: str) -> DataFrame:
    t = table(spark, root, "documents").select("doc_id", normalise_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.coalesce(F.length("t"), F.lit(0)).alias("n_chars"), F.md5("t").alias("digest"))


def index_texts(spark, root: str) -> DataFrame:
    c = _chunks(spark, root)
    return c.select("chunk_id", F.md5(embed_text(F.col("cite"), F.col("heading"), F.col("text"))).alias("digest"), citation(F.col("cite"), F.col("heading")).alias("citation"), normalise_cite(F.col("label")).alias("cite_key"))


def sentence_counts(spark, root: str) -> DataFrame:
    c = _chunks(spark, root).select("chunk_id", sentences(F.col("text")).alias("s"))
    return c.select("chunk_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def rendered(spark, root: str) -> DataFrame:
    """Scalar renderings over the manifest: escaped titles, grouped and human sizes, identifier categories."""
    r = table(spark, root, "records")
    return r.select("record_no", escape_html(F.col("title")).alias("title"), grouped(F.col("n_bytes").cast("double")).alias("n_grouped"), human_bytes(F.col("n_bytes")).alias("size"), id_category(F.col("category")).alias("root"))


def marker_links(spark, root: str) -> DataFrame:
    """Citation markers of answers as links to their sources."""
    a = table(spark, root, "answers").dropDuplicates(["answer_id"])
    text = F.regexp_replace("answer", r"\[(\d+)\]", "[S$1]")
    ranks = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1), F.col("n_sources"))).otherwise(F.array().cast("array<int>"))
    urls = F.transform(ranks, lambda r: F.concat(F.lit("/source/"), r.cast("string")))
    return a.select("answer_id", F.md5(link_markers(text, ranks, urls)).alias("digest"))


def session_keys(spark, root: str) -> DataFrame:
    e = table(spark, root, "events")
    s, h = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.when(F.col("user_id") % 2 == 0, F.col("event_type"))
    keyed = e.select(session_key(s, h, F.col("user_id") % 7 != 0).alias("session"))
    return keyed.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "token_counts": token_counts, "titles_clean": titles_clean, "texts_normalised": texts_normalised, "index_texts": index_texts, "sentence_counts": sentence_counts,
    "rendered": rendered, "marker_links": marker_links, "session_keys": session_keys,
}

_WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b\x1c-\x1f]+"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


_NORMAL = "regexp_replace(translate(text, chr(160) || chr(8203), ' '), '\\bNeni(\\d)', 'Neni \\1', 'g')"
_NORMAL = f"regexp_replace({_NORMAL}, '([\\p{{L}}\\p{{N}}\\p{{M}}_])-\\n([\\p{{L}}\\p{{N}}\\p{{M}}_])', '\\1\\2', 'g')"
for _line in LETTERHEAD:
    _NORMAL = f"regexp_replace({_NORMAL}, '(?m)^\\s*{_line}$', '', 'g')"
_NORMAL = f"trim(regexp_replace(regexp_replace({_NORMAL}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"
_LINK = "list_reduce(list_prepend(regexp_replace(answer, '\\[(\\d+)\\]', '[S\\1]', 'g'), [cast(i as varchar) for i in range(1, n_sources + 1)]), lambda t, r: replace(t, '[S' || r || ']', '[[S' || r || ']](/source/' || r || ')'))"
_ROUND = "cast(round_even(n_bytes / {d}, 0) as bigint)"

ORACLES = {
    "token_counts": f"with r as (select unnest(list_filter({raw_tokens_sql('text')}, lambda w: w not in {STOP_SQL})) w from {CHUNKS_SQL}), p as (select w, count(*) n from r group by 1) select {stem_sql('w')} term, cast(sum(n) as bigint) n, count(*) n_forms from p group by 1",
    "titles_clean": f"select doc_id, trim(regexp_replace(title, '{_WS}', ' ', 'g'), ' .;') title, {squeeze_sql(f'''translate(title, '{FOLD_FROM}', '{FOLD_TO}')''')} folded from documents",
    "texts_normalised": f"select doc_id, coalesce(length(t), 0) n_chars, md5(t) digest from (select doc_id, {_NORMAL} t from documents)",
    "index_texts": f"select chunk_id, md5(case when p = '' then text else p || chr(10) || text end) digest, trim(coalesce(cite, '') || ' — ' || coalesce(heading, ''), ' —') citation, {squeeze_sql('''lower(split_part(coalesce(label, ''), '(', 1))''')} cite_key from (select *, trim(coalesce(cite, '') || '. ' || coalesce(heading, ''), ' .') p from {CHUNKS_SQL})",
    "rendered": f"select record_no, replace(replace(replace({squeeze_sql('title')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') title, replace(format('{{:,}}', n_bytes), ',', ' ') n_grouped, case when n_bytes < 1024 then {_ROUND.format(d=1)} || ' B' when n_bytes < 1048576 then {_ROUND.format(d=1024)} || ' KB' when n_bytes < 1073741824 then {_ROUND.format(d=1048576)} || ' MB' else {_ROUND.format(d=1073741824)} || ' GB' end size, regexp_replace(category, '-[^-]*$', '') root from records",
    "marker_links": f"select answer_id, md5({_LINK}) digest from (select * from answers qualify row_number() over (partition by answer_id) = 1)",
    "session_keys": "select case when user_id % 7 = 0 then 'local' else coalesce(case when user_id % 3 <> 0 then 'u' || user_id end, case when user_id % 2 = 0 then event_type end, 'anon') end session, count(*) n from events group by 1",
    # No look-around here: a separator is put before list numbers, twice for chained ones, and before capitals.
    "sentence_counts": f"""
with s as (select chunk_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])\\s+(\\d+[.)][\\s\\x1e])', '\\1' || chr(30) || '\\2', 'g'), '([.!?;:])\\s+(\\d+[.)][\\s\\x1e])', '\\1' || chr(30) || '\\2', 'g'), '([.!?;:])\\s+([A-ZËÇ«"])', '\\1' || chr(30) || '\\2', 'g') t from {CHUNKS_SQL}),
p as (select chunk_id, list_filter(list_transform(string_split(t, chr(30)), lambda x: {squeeze_sql('x')}), lambda x: length(x) >= {MIN_SENTENCE}) l from s)
select chunk_id, len(l) n_sentences, md5(array_to_string(l, '|')) digest from p""",
}
