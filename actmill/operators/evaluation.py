"""Evaluation of retrieval and answers: hit rates, failures, samples, reviews, citations.

Questions without a gold document are left out of hit rates; a null gold article counts as no article.  Empty tables give no
rows, or a row of zeros where a report has one row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.operators import retrieval as rt
from actmill.session import table

# Fixed values ---------------------------------------------------------------------------------------------------------
MARGIN, MUCH_SHARED = 10.0, 0.6
LEAST_CHARS, MOST_CHARS, PER_CATEGORY, SEED = 400, 3000, 12, 20260827
EXCLUDED = ("akte-te-dpt", "vendime-teknike")
ENDS = ".!?:;”\")"
DEFINITION = r"(?iu)^(për qëllime të këtij ligji|në kuptim të këtij ligji|përkufizime)"
BOILERPLATE = r"(?iu)(^\s*ngarkoh|hyn në fuqi|fletoren zyrtare|shfuqizoh|^\s*ky (vendim|ligj|udhëzim) )"
FORMS = (
    ("pasojë", r"^\s*[ÇC]far[ëe]\s+ndodh", r"\b(gjob|sanksion|d[ëe]noh|d[ëe]nim|kamat|p[ëe]rgjegj[ëe]si|shkelje|kund[ëe]rvajtje|mas[ëa]\s+administrative|nuk\s+njihet|refuzoh|humb)"),
    ("afat", r"^\s*(Kur|Deri\s+kur)(\s|$)", r"\b(brenda|deri m[ëe]|afat|dat[ëe]s|\d+\s*dit|\d+\s*muaj|çdo\s+muaj|vjetor)"),
    ("shumë", r"^\s*Sa(\s|$)", r"(\d+\s?%|\blek|\bshkall|\bnorm[ëa]|\bp[ëe]rqindj)"),
)
MARKERS = (
    "nuk e gjej përgjigjen", "nuk mund t'i përgjigjem", "nuk mund të jap", "nuk mund të llogaris", "nuk mund të bëj", "nuk mund të të ndihmoj", "nuk mund ta bëj këtë", "nuk mund ta ndryshoj",
    "nuk mund ta trajtoj", "jashtë fushës", "nuk lidhet me legjislacionin", "nuk ka të bëjë me përmbajtjen e legjislacionit", "premisa e pyetjes nuk", "nuk bëj vlerësime",
)
FEW_MARKERS = ("nuk e gjej përgjigjen", "nuk mund ta trajtoj", "jashtë fushës", "jashtë temës", "nuk lidhet me legjislacionin", "nuk përgjigjem")
# ----------------------------------------------------------------------------------------------------------------------
MODES = ("dense", "bm25", "hybrid")


def gold(questions: DataFrame) -> DataFrame:
    """Answerable questions with a gold document."""
    return questions.filter(F.coalesce("answerable", F.lit(True)) & F.col("gold_doc_id").isNotNull())


def grid(chunks: DataFrame, questions: DataFrame, k: int = rt.TOP) -> DataFrame:
    """``mode, strategy, article_hits, doc_hits, total, chars`` of every mode and strategy over one set of questions."""
    g = gold(questions).select("qid", F.col("gold_doc_id").alias("g_doc"), tx.normalise_cite(F.col("gold_article")).alias("g_cite"))
    hits = rt.searched(chunks, gold(questions), rt.POOL, "hybrid", MODES, k)  # of every mode, found once
    # Only the citations of the texts are compared, so only those are joined.
    unit = tx.normalise_cite(F.when(F.col("strategy") == "article", F.col("cite")).otherwise(F.col("text")))
    c = chunks.select("chunk_id", unit.alias("unit"), F.coalesce("chars", F.lit(0)).alias("chars")).dropDuplicates(["chunk_id"])
    same_doc = F.col("doc_id") == F.col("g_doc")
    same = F.when(F.col("strategy") == "article", F.col("unit") == F.col("g_cite")).otherwise((F.col("g_cite") != "") & F.contains("unit", "g_cite"))
    per = hits.join(c, "chunk_id").join(g, "qid").groupBy("mode", "strategy", "qid").agg(F.max((same_doc & same).cast("int")).alias("a"), F.max(same_doc.cast("int")).alias("d"), F.sum("chars").alias("chars"))
    per = per.groupBy("mode", "strategy").agg(F.sum("a").alias("article_hits"), F.sum("d").alias("doc_hits"), F.sum("chars").alias("chars"))
    total = g.agg(F.count(F.lit(1)).alias("total"))  # one row
    return per.crossJoin(total).select("mode", "strategy", "article_hits", "doc_hits", "total", "chars")


def rate(hits: Column, total: Column) -> Column:
    return 100 * hits / F.greatest(total, F.lit(1))


def verdict(low: Column, high: Column) -> Column:
    """Which of two rates is ahead; less than MARGIN points apart is no difference, exactly that much is one."""
    gap = high - low
    return F.when(F.abs(gap) < MARGIN, "no clear difference").when(gap > 0, "second").otherwise("first")


def failures(chunks: DataFrame, questions: DataFrame, mode: str = "bm25", k: int = rt.TOP, pool: int = rt.POOL) -> DataFrame:
    """``qid, verdict, rank, doc_rank``: why the gold article of each question is not among the first ``k`` hits."""
    article = chunks.filter("strategy = 'article'")
    g = gold(questions).select("qid", F.col("gold_doc_id").alias("g_doc"), tx.normalise_cite(F.col("gold_article")).alias("g_cite"))
    units = article.select(F.col("doc_id").alias("g_doc"), tx.normalise_cite(F.col("cite")).alias("g_cite"), F.lit(True).alias("indexed")).distinct()
    hits = rt.cited(article, gold(questions), mode, pool, pool).select("qid", "rank", "doc_id", tx.normalise_cite(F.col("cite")).alias("h_cite"))
    h = g.join(hits, "qid", "left").groupBy("qid", "g_doc", "g_cite").agg(
        F.min(F.when((F.col("doc_id") == F.col("g_doc")) & (F.col("h_cite") == F.col("g_cite")), F.col("rank"))).alias("rank"), F.min(F.when(F.col("doc_id") == F.col("g_doc"), F.col("rank"))).alias("doc_rank"))
    v = (
        F.when(F.col("indexed").isNull(), "gold_article_not_in_index").when(F.col("rank") <= k, "hit").when(F.col("rank").isNotNull(), "rankable")
        .when(F.col("doc_rank").isNotNull(), "wrong_article_right_doc").otherwise("unreachable")
    )
    return h.join(units, ["g_doc", "g_cite"], "left").select("qid", v.alias("verdict"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("doc_rank", F.lit(0)).alias("doc_rank"))


def failure_totals(chunks: DataFrame, questions: DataFrame, mode: str = "bm25", k: int = rt.TOP, pool: int = rt.POOL) -> DataFrame:
    """One row: questions, those per verdict, mean overlap of question and gold article of hits and of misses, and what a perfect re-ranker of the pool could reach."""
    q = gold(questions).select("qid", "question", "gold_doc_id", tx.normalise_cite(F.col("gold_article")).alias("g_cite"))
    first = chunks.filter("strategy = 'article'").groupBy(F.col("doc_id").alias("gold_doc_id"), tx.normalise_cite(F.col("cite")).alias("g_cite")).agg(F.min(F.struct("part_order", "chunk_id"))["chunk_id"].alias("chunk_id"))
    first = rt.with_chunks(first.join(q.select("gold_doc_id", "g_cite").distinct(), ["gold_doc_id", "g_cite"]), chunks).select("gold_doc_id", "g_cite", F.col("text").alias("gold_text"))  # the texts of the asked articles only
    o = q.join(first, ["gold_doc_id", "g_cite"], "left").select("qid", F.round(rt.shared_terms(F.col("question"), F.col("gold_text")), 3).alias("overlap"))
    v = failures(chunks, questions, mode, k, pool).join(o, "qid")
    hit, n = F.col("verdict") == "hit", lambda *names: F.count_if(F.col("verdict").isin(*names))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("overlap"))), F.lit(0.0)), 6)
    verdicts = ("hit", "rankable", "wrong_article_right_doc", "unreachable", "gold_article_not_in_index")
    t = v.agg(F.count(F.lit(1)).alias("total"), *[n(x).alias(x) for x in verdicts], mean(hit).alias("overlap_hit"), mean(~hit).alias("overlap_miss"), n("hit", "rankable").alias("ceiling"))
    return t.withColumn("ceiling_rate", F.round(rate(F.col("ceiling"), F.col("total")), 4))


def carried_over(sample: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """A sample exported again, with the ``verdict, note`` given to its rows before; blank where there was no verdict."""
    p = previous.filter(F.trim(F.coalesce("verdict", F.lit(""))) != "").groupBy(key).agg(F.max(F.struct(F.trim("verdict").alias("verdict"), F.trim(F.coalesce("note", F.lit(""))).alias("note"))).alias("p"))
    return sample.join(p, key, "left").select(*[sample[c] for c in sample.columns], F.coalesce("p.verdict", F.lit("")).alias("verdict"), F.coalesce("p.note", F.lit("")).alias("note"))


def with_gold_text(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with the text of their gold article, its parts joined."""
    a = chunks.filter("strategy = 'article'").groupBy(F.col("doc_id").alias("gold_doc_id"), tx.normalise_cite(F.col("cite")).alias("g_cite")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_order", "text"))), lambda x: x["text"]), "\n").alias("gold_text"))
    return questions.withColumn("g_cite", tx.normalise_cite(F.col("gold_article"))).join(a, ["gold_doc_id", "g_cite"])


def is_substantive(category: Column) -> Column:
    """Whether an article chunk makes a fair question: of fair length, finished, whole, with a heading, no definitions or boilerplate."""
    body = F.rtrim(F.regexp_replace("text", r"\s+$", ""))
    tests = (
        ~F.coalesce(category.isin(*EXCLUDED), F.lit(False)), F.coalesce(F.col("chars").between(LEAST_CHARS, MOST_CHARS), F.lit(False)), F.right(body, F.lit(1)).isin(*ENDS),
        ~F.contains(F.coalesce("label", F.lit("")), F.lit("(")), ~F.coalesce("heading", F.lit("")).rlike(DEFINITION), ~F.left("text", F.lit(300)).rlike(BOILERPLATE), F.coalesce("heading", F.lit("")) != "",
    )
    return F.coalesce(reduce(and_, tests), F.lit(False))


def stratified(rows: DataFrame, stratum: str, key: str, per: int = PER_CATEGORY, seed: int = SEED) -> DataFrame:
    """At most ``per`` rows of each stratum, in an order fixed by the seed."""
    return rt.top(rows, [stratum], per, [F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)])


def rich_and_plain(rows: DataFrame, rich: Column, key: str, n: int, seed: int = SEED) -> DataFrame:
    """Half of the sample from rows that are rich, the rest from the others, each in an order fixed by the seed."""
    order = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    r = rows.filter(rich).orderBy(order, key).limit(n // 2).withColumn("rich", F.lit(True))
    return r.unionByName(rows.filter(~rich).orderBy(order, key).limit(n - n // 2).withColumn("rich", F.lit(False)))


def unsupported_form(question: Column, article: Column) -> Column:
    """The first form that a question takes and its article cannot answer; null if none."""
    return F.coalesce(*[F.when(F.coalesce(question, F.lit("")).rlike("(?iu)" + q) & ~F.coalesce(article, F.lit("")).rlike("(?iu)" + a), name) for name, q, a in FORMS])


def has_marker(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers])


def apply_review(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """Candidates after review: an edit's question and gold article replace the old ones unless blank; unreviewed and empty ones are left out."""
    e = edits.select("qid", F.trim("question").alias("new_question"), F.trim("gold_article").alias("new_gold"), "reviewed")
    j = candidates.join(e, "qid", "inner").filter(F.col("reviewed"))
    blank = F.lit("")
    j = j.withColumn("question", F.coalesce(F.nullif("new_question", blank), F.col("question"))).withColumn("gold_article", F.coalesce(F.nullif("new_gold", blank), F.col("gold_article")))
    return j.filter(F.coalesce("question", blank) != "").drop("new_question", "new_gold", "reviewed")


def reviewed_edits(candidates: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with their ``state``: ``unknown`` (no such candidate), ``unreviewed``, ``empty`` (reviewed without a question) or ``kept``; those without an id are left out."""
    c = candidates.select("qid", "gold_doc_id", F.col("gold_article").alias("old_gold"), F.lit(True).alias("known"))
    e = edits.select(F.trim("qid").alias("qid"), F.trim("question").alias("question"), F.trim("gold_article").alias("new_gold"), "reviewed").filter("qid <> ''")
    state = F.when(F.col("known").isNull(), "unknown").when(~F.coalesce("reviewed", F.lit(False)), "unreviewed").when(F.coalesce("question", F.lit("")) == "", "empty").otherwise("kept")
    return e.join(c, "qid", "left").select("qid", "question", "gold_doc_id", F.coalesce(F.nullif("new_gold", F.lit("")), F.col("old_gold")).alias("gold_article"), state.alias("state"))


def import_review(candidates: DataFrame, edits: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """``qid, question, gold_doc_id, gold_article, out_of_scope``: candidates after review, and every out-of-scope question, which needs none."""
    columns = ["qid", "question", "gold_doc_id", "gold_article"]
    kept = reviewed_edits(candidates, edits).filter("state = 'kept'").select(*columns, F.lit(False).alias("out_of_scope"))
    return kept.unionByName(out_of_scope.select(*columns, F.lit(True).alias("out_of_scope")))


def import_counts(candidates: DataFrame, edits: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """One row: questions imported, out-of-scope ones among them, and edits left out as unreviewed, empty or unknown."""
    n = lambda state: F.count_if(F.col("state") == state)
    e = reviewed_edits(candidates, edits).agg(n("kept").alias("n_kept"), n("unreviewed").alias("n_unreviewed"), n("empty").alias("n_empty"), n("unknown").alias("n_unknown"))
    both = e.crossJoin(out_of_scope.agg(F.count(F.lit(1)).alias("n_out_of_scope")))  # one row each
    return both.select((F.col("n_kept") + F.col("n_out_of_scope")).alias("n_imported"), "n_out_of_scope", "n_unreviewed", "n_empty", "n_unknown")


def _asked(spark, root):
    return rt.asked(spark, root)


def eval_grid(spark, root: str) -> DataFrame:
    """Hit rates over every question."""
    g = grid(table(spark, root, "chunks"), _questions(spark, root))
    return g.select("*", F.round(rate(F.col("article_hits"), F.col("total")), 4).alias("article_rate"), F.round(rate(F.col("doc_hits"), F.col("total")), 4).alias("doc_rate"), F.floor(F.col("chars") / F.greatest("total", F.lit(1))).alias("mean_chars"))


def eval_compare(spark, root: str) -> DataFrame:
    """Article rates of two modes side by side, per strategy, with the rule for a clear difference."""
    g = grid(table(spark, root, "chunks"), _asked(spark, root)).select("mode", "strategy", rate(F.col("article_hits"), F.col("total")).alias("r"))
    w = g.groupBy("strategy").pivot("mode", list(MODES)).agg(F.max("r"))
    pairs = [(a, b) for i, a in enumerate(MODES) for b in MODES[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), verdict(F.col(a), F.col(b)).alias("verdict")) for a, b in pairs]
    return w.select("strategy", F.explode(F.array(*rows)).alias("x")).select("strategy", "x.*")


def failure_taxonomy(spark, root: str) -> DataFrame:
    return failures(table(spark, root, "chunks"), _asked(spark, root))


def failure_summary(spark, root: str) -> DataFrame:
    return failure_totals(table(spark, root, "chunks"), _asked(spark, root))


def rerank_ab(spark, root: str) -> DataFrame:
    """Questions whose gold article is found with and without re-ranking."""
    c, q = table(spark, root, "chunks").filter("strategy = 'article'"), gold(_asked(spark, root))
    g = q.select("qid", F.col("gold_doc_id").alias("g_doc"), tx.normalise_cite(F.col("gold_article")).alias("g_cite"))
    hit = ((F.col("doc_id") == F.col("g_doc")) & (tx.normalise_cite(F.col("cite")) == F.col("g_cite"))).cast("int")
    # The hits without re-ranking are the first of those that are re-ranked, which are found once.
    hits = rt.rerank(rt.with_chunks(rt.cited(c, q, "bm25", rt.DEPTH), c), q, ["qid", "strategy"], rt.DEPTH)
    j = hits.join(g, "qid").groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("before") <= rt.TOP, hit)), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(F.col("rank") <= rt.TOP, hit)), F.lit(0)).alias("b"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("baseline"), F.coalesce(F.sum("b"), F.lit(0)).alias("reranked"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("recovered"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("broken"))


def _questions(spark, root):
    return table(spark, root, "questions").dropDuplicates(["id"]).withColumnRenamed("id", "qid")


def question_overlap(spark, root: str) -> DataFrame:
    """Share of each question's terms in its gold article, and whether it is too close to it."""
    q = with_gold_text(_questions(spark, root).filter("gold_doc_id is not null"), rt.stored(spark, root))
    o = q.select("qid", F.round(rt.overlap(tx.tokens(F.col("question")), tx.tokens(F.col("gold_text"))), 6).alias("overlap"))
    return o.withColumn("needs_rewrite", F.col("overlap") > MUCH_SHARED)


def questions_unsupported(spark, root: str) -> DataFrame:
    q = with_gold_text(_questions(spark, root).filter("gold_doc_id is not null"), rt.stored(spark, root))
    form = F.coalesce(unsupported_form(F.col("question"), F.col("gold_text")), F.lit("-"))
    return q.groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


def _substantive(spark, root):
    d = table(spark, root, "documents").select(F.col("doc_id").alias("d_id"), F.col("category").alias("doc_category")).dropDuplicates(["d_id"])
    c = rt.stored(spark, root).filter("strategy = 'article'")
    return c.join(d, F.col("doc_id") == F.col("d_id"), "left").filter(is_substantive(F.col("doc_category"))).select("chunk_id", F.coalesce("doc_category", F.lit("unknown")).alias("category"))


def candidates_substantive(spark, root: str) -> DataFrame:
    return _substantive(spark, root).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def candidates_sample(spark, root: str) -> DataFrame:
    return stratified(_substantive(spark, root), "category", "chunk_id").select("category", "rank", "chunk_id")


def _answers(spark, root):
    return table(spark, root, "answers").dropDuplicates(["answer_id"])


def answers_sample(spark, root: str) -> DataFrame:
    """Sample for review: half of it answers with citation markers."""
    return rich_and_plain(_answers(spark, root), F.coalesce(F.col("n_markers"), F.lit(0)) > 0, "answer_id", 60).select("answer_id", "rich")


def answers_scored(spark, root: str) -> DataFrame:
    """Refusal accuracy, declined answers and fabricated citations per group; answers about retired documents are left out."""
    q = _questions(spark, root).select(F.col("qid").alias("question_id"), "gold_doc_id")
    gone = table(spark, root, "retired_docs").select(F.col("doc_id").alias("gold_doc_id")).distinct()
    a = _answers(spark, root).join(q, "question_id", "left").join(gone, "gold_doc_id", "left_anti")
    text = F.regexp_replace(F.lower(F.coalesce("answer", F.lit(""))), r"^[*# ]+", "")
    must = F.coalesce("should_refuse", F.lit(False))
    return a.groupBy("eval_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(must).alias("must_refuse"), F.count_if(must & F.coalesce("refused", F.lit(False))).alias("refused_right"), F.count_if(must & has_marker(F.col("answer"))).alias("refused_marked"),
        F.count_if(~must & text.startswith("nuk ")).alias("declined"), F.count_if(has_marker(F.col("answer"), FEW_MARKERS)).alias("marked_few"), F.count_if(F.col("n_markers") > F.col("n_sources")).alias("fabricated"),
    )


def citations_checked(spark, root: str) -> DataFrame:
    """Citation markers of each answer that point to no source."""
    a = _answers(spark, root)
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))))
    dangling = F.filter(cited, lambda n: (n > F.coalesce("n_sources", F.lit(0))) | (n < 1))
    text = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    return a.select("answer_id", text(cited).alias("cited"), text(dangling).alias("dangling"))


def answers_open(spark, root: str) -> DataFrame:
    """Questions that still have no answer: what a resumed run would ask."""
    q = _questions(spark, root)
    return q.join(_answers(spark, root).select(F.col("question_id").alias("qid")).distinct(), "qid", "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _edits(spark, root):
    a = _answers(spark, root).filter("eval_group = 'review'")
    last = rt.top(a, ["question_id"], 1, [F.desc("answer_id")])
    return last.select(F.col("question_id").alias("qid"), "question", "gold_article", F.coalesce(F.col("n_markers") > 0, F.lit(False)).alias("reviewed"))


def review_import(spark, root: str) -> DataFrame:
    r = apply_review(_questions(spark, root).filter("gold_doc_id is not null"), _edits(spark, root))
    return r.select("qid", "question", "gold_article")


def _review(spark, root):
    q = _questions(spark, root)
    return q.filter("gold_doc_id is not null"), _edits(spark, root), q.filter("gold_doc_id is null")


def review_merged(spark, root: str) -> DataFrame:
    """The question set after import of a review: reviewed questions and all out-of-scope ones."""
    return import_review(*_review(spark, root))


def review_counts(spark, root: str) -> DataFrame:
    return import_counts(*_review(spark, root))


def review_progress(spark, root: str) -> DataFrame:
    """Reviewed and open questions per category, and the first that is open: drafted ones come first."""
    done = F.coalesce(F.col("notes") == "kontrolluar", F.lit(False))
    drafted = F.coalesce("drafted_by_model", F.lit(False))
    return _questions(spark, root).groupBy("category").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("open"), F.coalesce(F.min(F.when(~done & drafted, F.col("qid"))), F.min(F.when(~done, F.col("qid")))).alias("next"))


def review_precision(spark, root: str) -> DataFrame:
    """Share of answers whose refusal was judged right, over the judged ones only."""
    a = _answers(spark, root).filter("refused is not null and should_refuse is not null")
    return a.groupBy("eval_group").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("refused") == F.col("should_refuse")).alias("right")).withColumn("precision", F.round(100 * F.col("right") / F.greatest("judged", F.lit(1)), 4))


QUERIES = {
    "eval_grid": eval_grid, "eval_compare": eval_compare, "failure_taxonomy": failure_taxonomy, "failure_summary": failure_summary, "rerank_ab": rerank_ab, "question_overlap": question_overlap, "questions_unsupported": questions_unsupported,
    "candidates_substantive": candidates_substantive, "candidates_sample": candidates_sample, "answers_sample": answers_sample, "answers_scored": answers_scored, "citations_checked": citations_checked,
    "answers_open": answers_open, "review_import": review_import, "review_merged": review_merged, "review_counts": review_counts, "review_progress": review_progress, "review_precision": review_precision,
}


def _cite(x: str) -> str:
    return tx.squeeze_sql(f"lower(split_part(coalesce({x}, ''), '(', 1))")


_GOLD = f"gold as (select qid, gold_doc_id g_doc, {_cite('gold_article')} g_cite from asked where coalesce(answerable, true) and gold_doc_id is not null)"
_GRID = f"""{rt.SEARCH_SQL}, {_GOLD}, {', '.join(rt.hits_sql(m, rt.TOP) for m in MODES)},
al as ({' union all '.join(f"select '{m}' as mode, * from hits_{m}" for m in MODES)}),
pq as (select mode, strategy, qid, max((doc_id = g_doc and case when strategy = 'article' then {_cite('cite')} = g_cite else g_cite <> '' and contains({_cite('text')}, g_cite) end)::int) a, max((doc_id = g_doc)::int) d, sum(chars) chars from al join gold using (qid) group by all),
gr as (select mode, strategy, sum(a)::bigint article_hits, sum(d)::bigint doc_hits, (select count(*) from gold) total, sum(chars)::bigint chars from pq group by all)"""
_Q = "(select * from questions qualify row_number() over (partition by id) = 1)"
_AN = "(select * from answers qualify row_number() over (partition by answer_id) = 1)"
#: All questions, as the asked ones.
EVERY_SQL = "(select id qid, * exclude (id) from questions qualify row_number() over (partition by id) = 1)"
_GT = f"gt as (select doc_id gold_doc_id, {_cite('cite')} g_cite, string_agg(text, chr(10) order by part_order) gold_text from {tx.CHUNKS_SQL} where strategy = 'article' group by all), qg as (select q.*, gold_text from (select *, {_cite('gold_article')} g_cite from {_Q}) q join gt using (gold_doc_id, g_cite))"
_SUB = f"""sb as (select chunk_id, coalesce(d.category, 'unknown') category from {tx.CHUNKS_SQL} c left join (select doc_id, any_value(category) category from documents group by 1) d using (doc_id) where strategy = 'article' and coalesce(d.category, '') not in {EXCLUDED} and chars between {LEAST_CHARS} and {MOST_CHARS}
 and contains('{ENDS}', right(regexp_replace(text, '\\s+$', ''), 1)) and right(regexp_replace(text, '\\s+$', ''), 1) <> '' and not contains(coalesce(label, ''), '(') and not regexp_matches(coalesce(heading, ''), '{DEFINITION.replace("iu", "i")}') and not regexp_matches(left(text, 300), '{BOILERPLATE.replace("iu", "i")}') and coalesce(heading, '') <> '')"""


def _any(text: str, markers) -> str:
    return "(" + " or ".join("contains(lower(coalesce({}, '')), '{}')".format(text, m.replace("'", "''")) for m in markers) + ")"


_FORM = "case " + " ".join(f"when regexp_matches(coalesce(question, ''), '(?i){q}') and not regexp_matches(coalesce(gold_text, ''), '(?i){a}') then '{n}'" for n, q, a in FORMS) + " else '-' end"
_FAIL = f"""with {rt.SEARCH_SQL}, {_GOLD}, {rt.hits_sql('bm25', rt.POOL)}, ix as (select distinct doc_id g_doc, {_cite('cite')} g_cite, true indexed from c where strategy = 'article'),
h as (select qid, g_doc, g_cite, min(case when doc_id = g_doc and {_cite('cite')} = g_cite then rank end) r, min(case when doc_id = g_doc then rank end) dr from gold left join (select * from hits_bm25 where strategy = 'article') using (qid) group by all)
select qid, case when indexed is null then 'gold_article_not_in_index' when r <= {rt.TOP} then 'hit' when r is not null then 'rankable' when dr is not null then 'wrong_article_right_doc' else 'unreachable' end verdict, coalesce(r, 0) as rank, coalesce(dr, 0) doc_rank from h left join ix using (g_doc, g_cite)"""
_AB = rt._RERANK.split("select qid, strategy, row_number()")[0]
_AB = f"""{_AB}, {_GOLD}, b as (select *, row_number() over (partition by qid, strategy order by pair desc, rank) nr from p where strategy = 'article'),
x as (select qid, max((doc_id = g_doc and {_cite('cite')} = g_cite and rank <= {rt.TOP})::int) a, max((doc_id = g_doc and {_cite('cite')} = g_cite and nr <= {rt.TOP})::int) b from b join gold using (qid) group by 1)
select count(*) n, coalesce(sum(a), 0)::bigint baseline, coalesce(sum(b), 0)::bigint reranked, count_if(a = 0 and b = 1) recovered, count_if(a = 1 and b = 0) broken from x"""
_PAIRS = " union all ".join(
    f"select strategy, '{a}' as first, '{b}' as second, case when abs(max(r) filter (where mode = '{b}') - max(r) filter (where mode = '{a}')) < {MARGIN} then 'no clear difference' when max(r) filter (where mode = '{b}') > max(r) filter (where mode = '{a}') then 'second' else 'first' end verdict from rr group by 1"
    for i, a in enumerate(MODES) for b in MODES[i + 1 :]
)

_REVIEW = f"""with e as (select trim(question_id) qid, trim(question) nq, trim(gold_article) ng, coalesce(n_markers > 0, false) reviewed from {_AN} where eval_group = 'review' qualify row_number() over (partition by question_id order by answer_id desc) = 1),
q as {_Q}, st as (select e.qid, nq question, gold_doc_id, coalesce(nullif(ng, ''), gold_article) gold_article, case when id is null then 'unknown' when not reviewed then 'unreviewed' when coalesce(nq, '') = '' then 'empty' else 'kept' end state from e left join (select * from q where gold_doc_id is not null) g on g.id = e.qid where e.qid <> '')"""

ORACLES = {
    "review_merged": f"{_REVIEW} select qid, question, gold_doc_id, gold_article, false out_of_scope from st where state = 'kept' union all select id, question, gold_doc_id, gold_article, true from q where gold_doc_id is null",
    "review_counts": f"{_REVIEW}, o as (select count(*) n from q where gold_doc_id is null) select count_if(state = 'kept') + (select n from o) n_imported, (select n from o) n_out_of_scope, count_if(state = 'unreviewed') n_unreviewed, count_if(state = 'empty') n_empty, count_if(state = 'unknown') n_unknown from st",
    "eval_grid": f"with {_GRID.replace(rt.ASKED_SQL, EVERY_SQL)} select *, round(100 * article_hits / greatest(total, 1), 4) article_rate, round(100 * doc_hits / greatest(total, 1), 4) doc_rate, chars // greatest(total, 1) mean_chars from gr",
    "eval_compare": f"with {_GRID}, rr as (select mode, strategy, 100 * article_hits / greatest(total, 1) r from gr) {_PAIRS}",
    "failure_taxonomy": _FAIL,
    "rerank_ab": _AB,
    "question_overlap": f"with {_GT}, t as (select id qid, list_distinct({tx.tokens_sql('question')}) q, {tx.tokens_sql('gold_text')} w from qg) select qid, round(coalesce(len(list_intersect(q, w)) / nullif(len(q), 0), 0), 6) as overlap, coalesce(round(len(list_intersect(q, w)) / nullif(len(q), 0), 6), 0) > {MUCH_SHARED} needs_rewrite from t",
    "questions_unsupported": f"with {_GT} select {_FORM} form, count(*) n from qg group by 1",
    "candidates_substantive": f"with {_SUB} select category, count(*) n from sb group by 1",
    "candidates_sample": f"with {_SUB} select category, row_number() over w as rank, chunk_id from sb window w as (partition by category order by md5('{SEED}' || chunk_id), chunk_id) qualify row_number() over w <= {PER_CATEGORY}",
    "answers_sample": f"with a as (select answer_id, coalesce(n_markers, 0) > 0 rich from {_AN}) select * from a qualify row_number() over (partition by rich order by md5('{SEED}' || answer_id), answer_id) <= 30",
    "answers_scored": f"with a as (select a.* from {_AN} a left join {_Q} q on a.question_id = q.id where coalesce(gold_doc_id not in (select doc_id from retired_docs), true)) select eval_group, count(*) n, count_if(coalesce(should_refuse, false)) must_refuse, count_if(should_refuse and coalesce(refused, false)) refused_right, count_if(coalesce(should_refuse, false) and {_any('answer', MARKERS)}) refused_marked, count_if(not coalesce(should_refuse, false) and starts_with(regexp_replace(lower(coalesce(answer, '')), '^[*# ]+', ''), 'nuk ')) declined, count_if({_any('answer', FEW_MARKERS)}) marked_few, count_if(n_markers > n_sources) fabricated from a group by 1",
    "citations_checked": f"with a as (select answer_id, coalesce(n_sources, 0) s, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[(\\d+)\\]', 1), lambda x: cast(x as int)))) c from {_AN}) select answer_id, coalesce(array_to_string(c, ','), '') cited, coalesce(array_to_string(list_filter(c, lambda x: x > s or x < 1), ','), '') dangling from a",
    "answers_open": f"select category, count(*) n from {_Q} where id not in (select question_id from answers where question_id is not null) group by 1",
    "review_import": f"with e as (select question_id, trim(question) nq, trim(gold_article) ng, coalesce(n_markers > 0, false) reviewed from {_AN} where eval_group = 'review' qualify row_number() over (partition by question_id order by answer_id desc) = 1) select id qid, coalesce(nullif(nq, ''), question) question, coalesce(nullif(ng, ''), gold_article) gold_article from {_Q} join e on id = question_id where reviewed and gold_doc_id is not null and coalesce(nullif(nq, ''), question, '') <> ''",
    "review_progress": f"select category, count_if(coalesce(notes = 'kontrolluar', false)) done, count_if(not coalesce(notes = 'kontrolluar', false)) as open, coalesce(min(id) filter (where not coalesce(notes = 'kontrolluar', false) and coalesce(drafted_by_model, false)), min(id) filter (where not coalesce(notes = 'kontrolluar', false))) as next from {_Q} group by 1",
    "review_precision": f"select eval_group, count(*) judged, count_if(refused = should_refuse) as right, round(100 * count_if(refused = should_refuse) / greatest(count(*), 1), 4) as precision from {_AN} where refused is not null and should_refuse is not null group by 1",
}
