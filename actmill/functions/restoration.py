"""Restoration of accents learnt from the corpus itself.

Every word is folded to its skeleton; a skeleton maps to the accented form that the texts use most, if it is frequent enough
and clearly ahead of the bare form.  Words typed with accents are never changed.  Ties go to the form that sorts first.
Null texts have no words; an empty map changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.functions.text import CHUNKS_SQL, FOLD_FROM, FOLD_TO, fold
from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
LEAST_COUNT, RATIO = 3, 3.0
WORD = "[a-zA-ZçÇëË0-9]+"
# ----------------------------------------------------------------------------------------------------------------------


def learn(texts: DataFrame, text: str = "text", least: int = LEAST_COUNT, ratio: float = RATIO) -> DataFrame:
    """``skeleton, form``: words are counted before anything else, so that only distinct words are grouped."""
    forms = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD})"), 1)).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    f = forms.withColumn("skeleton", fold(F.col("form")))
    best = f.groupBy("skeleton").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("form").alias("form"))).alias("b"), F.max(F.when(F.col("form") == F.col("skeleton"), F.col("n"))).alias("bare"))
    keep = (F.col("total") >= least) & (F.col("b.form") != F.col("skeleton")) & (F.col("bare").isNull() | (-F.col("b.m") >= ratio * F.col("bare")))
    return best.filter(keep).select("skeleton", F.col("b.form").alias("form"))


def _dressed(word: Column, form: Column) -> Column:
    """The form in the capitals of the word typed."""
    return F.when(word.rlike("[A-Z]") & (F.upper(word) == word), F.upper(form)).when(F.left(word, F.lit(1)).rlike("[A-Z]"), F.concat(F.upper(F.left(form, F.lit(1))), F.substring(form, F.lit(2), F.length(form)))).otherwise(form)


def restore(queries: DataFrame, mapping: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` with the words restored; everything between words stays."""
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({WORD}|[^a-zA-ZçÇëË0-9]+)"), 1)
    p = queries.select(key, F.posexplode(parts).alias("i", "part"))
    m = mapping.select(F.col("skeleton").alias("s"), "form")
    bare = fold(F.col("part")) == F.col("part")
    j = p.join(m, F.when(bare, F.lower("part")) == F.col("s"), "left").withColumn("part", F.coalesce(_dressed(F.col("part"), F.col("form")), F.col("part")))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "")
    done = j.groupBy(key).agg(ordered.alias("restored"))
    return queries.select(key, text).join(done, key, "left").select(key, F.coalesce("restored", F.col(text)).alias(text))


def save(mapping: DataFrame, path: str) -> None:
    """Write a map as lines of JSON, in place of one that is there."""
    mapping.select("skeleton", "form").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("skeleton string, form string").json(path)


def _chunks(spark, root):
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


def restoration_map(spark, root: str) -> DataFrame:
    return learn(_chunks(spark, root))


def questions_restored(spark, root: str) -> DataFrame:
    """Questions typed without accents, in the spelling of the corpus."""
    q = table(spark, root, "questions").dropDuplicates(["id"]).select("id", fold(F.col("question")).alias("question"))
    return restore(q, learn(_chunks(spark, root)), "id", "question")


QUERIES = {"restoration_map": restoration_map, "questions_restored": questions_restored}

_MAP = f"""f as (select form, translate(form, '{FOLD_FROM}', '{FOLD_TO}') skeleton, count(*) n from (select unnest(regexp_extract_all(lower(text), '{WORD}')) form from {CHUNKS_SQL}) group by 1),
g as (select skeleton, sum(n) total, arg_min(form, (-n, form)) form, max(n) m, max(n) filter (where form = skeleton) bare from f group by 1),
mp as (select skeleton, form from g where total >= {LEAST_COUNT} and form <> skeleton and (bare is null or m >= {RATIO} * bare))"""
_DRESS = "case when regexp_matches(p, '[A-Z]') and upper(p) = p then upper(form) when regexp_matches(left(p, 1), '[A-Z]') then upper(left(form, 1)) || substr(form, 2) else form end"
ORACLES = {
    "restoration_map": f"with {_MAP} select * from mp",
    "questions_restored": f"""with {_MAP}, q as (select id, translate(question, '{FOLD_FROM}', '{FOLD_TO}') question from (select * from questions qualify row_number() over (partition by id) = 1)),
x as (select id, unnest(l) p, generate_subscripts(l, 1) i from (select id, regexp_extract_all(question, '[a-zA-ZçÇëË0-9]+|[^a-zA-ZçÇëË0-9]+') l from q)),
r as (select id, string_agg(coalesce({_DRESS}, p), '' order by i) t from x left join mp on skeleton = lower(p) and translate(p, '{FOLD_FROM}', '{FOLD_TO}') = p group by 1)
select id, coalesce(t, question) question from q left join r using (id)""",
}
