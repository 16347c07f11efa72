"""Text cut off by field limits (problem 4).

The vocabulary is a trie: the tokens of all texts, figures alike, each continued by a blank where more text follows.  The
last token of a text is an unknown proper prefix when the trie goes on below it, with longer tokens or with further text, and
hardly knows it as an end: other texts end with it no more often than cuts that fall anywhere would make them.  Such a text
is cut; so is one that stops at a field limit, a length at which the corpus has far more unfinished texts than finished ones.

Complete forms are left out before: a text that closes with the end of a sentence, a closed bracket or a list item, and a last
line on its own whose shape recurs over different texts (table lines, signatures), unless that line's last token is a piece of
a word, which only cuts make.  Page marks after the text are taken off first, and so is a last line that repeats the opening
of a title.

The trie is a table of prefixes with the weight below each; only the prefixes that some last token asks for are kept.
All counts run over the whole corpus, and thresholds are shares, so that they mean the same at every size.

Defined results: null and empty texts are not cut; repeated rows count once; documents without a source count under
the source null.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.lines import BARE, ending, noise_of, split_header, without_mark
from actmill.llm.scans import LEAST_START, running_headers
from actmill.llm.words import word_counts
from actmill.session import cut, table

#: Characters of a title that a last line must repeat at least.
LEAST_TITLE = 8
#: A shape of last lines recurs when it makes up this share of all different texts.
RECURRING = 0.0005
#: A length is a field limit when so many times more of its texts are unfinished than over all lengths.
LIMIT_LIFT = 5.0
#: A token is known as an end when it ends other texts so many times more often than a cut falls on a token anywhere, and at least so many texts.
END_LIFT, LEAST_ENDS = 8.0, 2
_FIELDS = ("state", "shape", "token", "word")
_ENDS = ", ".join(f"{f} string" for n in ("", "2") for f in (f"{x}{n}" for x in _FIELDS)) + ", last string, length int"
_FIGURES = str.maketrans("123456789", "000000000")


def node_of(token: str) -> str:
    """The trie's form of a token."""
    return token.lower().translate(_FIGURES)


def _unmarked(text: str) -> str:
    return without_mark(text.rstrip()).translate(_FIGURES)


def _strip_noise(text: str) -> str:
    """Text without page numbers and header lines after it."""
    lines = text.rstrip().split("\n")
    while len(lines) > 1:
        s = lines[-1].strip()
        before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
        if s and not noise_of(s) and not (BARE.match(s) and re.search(r"[.!?;]\s*$", before)):
            break
        lines.pop()
    return "\n".join(lines)


def endings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, how each text ends, and how it would end without its last line."""

    def how(text: str) -> tuple[str, str, str, str]:
        found = ending(text)
        return (*found, node_of(found[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if not t or t.isspace():
                    rows.append(("empty", "", "", "", "empty", "", "", "", "", 0))
                    continue
                s = _strip_noise(t)
                first = how(s)
                if first[0] in ("open", "line") and "\n" in s:
                    rest, _, last = s.rpartition("\n")
                    rows.append((*first, *how(_strip_noise(rest)), split_header(last.strip())[0].lower(), len(t)))
                else:
                    rows.append((*first, *first, "", len(t)))
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.string()] * 9 + [pa.int32()]
            names = [*keys, *_FIELDS, *[f"{f}2" for f in _FIELDS], "last", "length"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{fields}, {_ENDS}")


def trie_nodes(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """``word, known, below``: of each asked token, its count as a token and the count of longer tokens that start with it."""
    asked = asked.select("word").distinct()
    lengths = F.sequence(F.lit(1), F.length("word"))
    prefixes = vocabulary.filter("word <> ''").select(F.explode(F.transform(lengths, lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("p"), "word", "n")
    same = F.col("p") == F.col("word")
    nodes = prefixes.groupBy("p").agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(same, 0).otherwise(F.col("n"))).alias("below"))
    return nodes.withColumnRenamed("p", "word").join(asked, "word", "left_semi")


def _texts(chunks: DataFrame, documents: DataFrame, acts: DataFrame) -> DataFrame:
    """``chunk_id, source, text_id, length, copies, state, shape, token, word`` of every chunk, title lines at the end taken off."""
    rows = endings(chunks.select("chunk_id", "doc_id", F.xxhash64("text").alias("text_id"), "text"), ["chunk_id", "doc_id", "text_id"], "text")
    rows = rows.groupBy("chunk_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "chunk_id"])).alias("r"), F.count(F.lit(1)).alias("copies")).select("chunk_id", "r.*", "copies")
    docs = documents.select("doc_id", "source", F.lower("title").alias("title")).dropDuplicates(["doc_id"])
    # The evidence reads these few columns many times, the texts only once.
    rows = cut(rows.join(docs, "doc_id", "left"))
    keep = ["chunk_id", "source", "text_id", "length", "copies"]
    lined = rows.filter(F.length("last") >= LEAST_TITLE)  # other last lines are no key
    headers = running_headers(lined.filter(F.length("last") >= LEAST_START).select("doc_id", "chunk_id", F.col("last").alias("arg")), documents, acts)
    titled = F.col("opens").isNotNull() | F.coalesce(F.contains("title", F.col("last")), F.lit(False))
    opens = headers.select("chunk_id", F.lit(True).alias("opens"))
    taken = lined.join(opens, "chunk_id", "left").select(*keep, *[F.when(titled, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in _FIELDS])
    return rows.filter(F.length("last") < LEAST_TITLE).select(*keep, *_FIELDS).unionByName(taken)


def truncated(chunks: DataFrame, documents: DataFrame, acts: DataFrame) -> DataFrame:
    """``chunk_id, source, cut, place, at_limit``: every chunk, whether its text breaks off, and where (word, number, sentence)."""
    rows = cut(_texts(chunks, documents, acts))
    unfinished = rows.filter(F.col("state").isin("open", "line", "cut"))
    open_ = F.count_if(F.col("state") == "open")
    totals = rows.agg(F.count(F.lit(1)).alias("all"), open_.alias("open"), F.countDistinct("text_id").alias("texts"))  # one row, as those below
    # Shapes recur over different texts; copies of one text are no evidence.
    shapes = rows.filter("state = 'line'").groupBy("shape").agg(F.countDistinct("text_id").alias("n")).crossJoin(totals)
    recurring = shapes.filter((F.col("n") >= 2) & (F.col("n") >= RECURRING * F.col("texts")) & F.col("shape").contains(" ")).select("shape", F.lit(True).alias("recurs"))
    by_length = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), open_.alias("o")).crossJoin(totals)
    limits = by_length.filter((F.col("o") > 1) & (F.col("o") / F.col("n") > LIMIT_LIFT * F.col("open") / F.col("all"))).select("length", F.lit(True).alias("limit"))

    vocabulary = cut(word_counts(chunks.select("text"), r"\S+", lower=True, clean=_unmarked))
    nodes = trie_nodes(vocabulary, unfinished)
    lines = unfinished.filter("state = 'line'").join(recurring, "shape", "left").withColumn("recurs", F.col("recurs").isNotNull())
    d = unfinished.filter("state <> 'line'").withColumn("recurs", F.lit(False)).unionByName(lines)
    # Lines that recur are complete forms, and no ends of running text.
    ends = d.groupBy("word").agg(F.countDistinct(F.when(~F.col("recurs"), F.col("text_id"))).alias("ends"), F.sum("copies").alias("end_rows"))
    # How often a cut falls on a token: unfinished texts in running text, for each token of the corpus.
    rate = vocabulary.agg(F.sum("n").alias("tokens")).crossJoin(totals).select((F.col("open") / F.col("tokens")).alias("rate"))
    evidence = nodes.join(ends, "word").crossJoin(rate)
    on = F.col("known") - F.col("end_rows") + F.col("below")  # what the trie has below the token
    others = F.col("ends") - 1
    is_end = (others >= LEAST_ENDS) & (others > END_LIFT * F.col("rate") * (on + others))
    evidence = evidence.select("word", (~is_end & (on > 0)).alias("prefix"), ((F.col("known") <= F.col("end_rows")) & (F.col("below") > 0)).alias("piece"))

    d = d.join(evidence, "word", "left").join(limits, "length", "left").withColumn("at_limit", F.coalesce("limit", F.lit(False)))
    prefix, piece = F.coalesce("prefix", F.lit(False)), F.coalesce("piece", F.lit(False))
    lower = F.col("token").rlike(r"(?U)^\p{Ll}")
    broken = F.when(F.col("recurs"), piece & (lower | F.col("at_limit"))).otherwise(prefix | F.col("at_limit"))
    place = F.when(F.col("token").rlike(r"\d$"), "number").when(piece, "word").otherwise("sentence")
    judged = d.select("chunk_id", "source", broken.alias("cut"), F.when(broken, place).alias("place"), "at_limit")
    whole = rows.filter(~F.col("state").isin("open", "line", "cut")).select("chunk_id", "source", F.lit(False).alias("cut"), F.lit(None).cast("string").alias("place"), F.lit(False).alias("at_limit"))
    return judged.unionByName(whole)


def _found(spark, root: str) -> DataFrame:
    return truncated(*(table(spark, root, t) for t in ("chunks", "documents", "acts")))


def p4_found(spark, root: str) -> DataFrame:
    return _found(spark, root).filter("cut").select("chunk_id")


def p4_sources(spark, root: str) -> DataFrame:
    """Share of cut chunks per source, by place of the cut."""
    n = F.count(F.lit(1))
    places = [F.sum((F.col("place") == p).cast("long")).alias(f"in_{p}") for p in ("word", "number", "sentence")]
    rows = _found(spark, root).withColumn("place", F.coalesce("place", F.lit("")))
    return rows.groupBy("source").agg(n.alias("n_chunks"), F.sum(F.col("cut").cast("long")).alias("n_cut"), *places, F.sum((F.col("cut") & F.col("at_limit")).cast("long")).alias("at_limit")).withColumn("share", F.col("n_cut") / F.col("n_chunks"))


QUERIES = {"p4_found": p4_found, "p4_sources": p4_sources}
ORACLES: dict[str, str] = {}
