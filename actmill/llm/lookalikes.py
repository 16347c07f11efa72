"""Visually identical text with different characters (problem 3).

The distinct words of the corpus are mapped from look-alike letters of other alphabets to Latin ones and grouped in SQL
under an accent-sensitive Unicode collation, which takes full-width and other compatibility forms, ligatures, split
accents, unusual spaces and invisible characters for the same as the ordinary ones.  Letter case is told apart by the
pattern of capitals beside the collation key.  The canonical member of a class is its most frequent member written in
ordinary characters, ties by code points; a class that has none gets its mapped, composed form.  Words are joined back to
the texts by their stored form.

A word is a case when it differs from its canonical member, or mixes Latin letters with others that resemble none.  A word wholly in another alphabet keeps its letters, unless
all of them look like Latin ones and the mapped word is in use in Latin letters.

Defined results: null and empty texts are no cases and stay as they are; repeated rows count once; line breaks, typographic
quotes, dashes and the degree sign are ordinary characters.  Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from actmill.llm.words import word_counts
from actmill.session import table

COLLATION = "UNICODE_CI"
#: Cyrillic, Greek and Armenian letters that look like Latin ones, and those.
FOREIGN = "АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһѵӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεινορυχκοօսհ"
LATIN = "ABESIJKMHOPCTYXaeijopcyxsdqwhvlABEZHIKMNOPTYXaeivopuxkoouh"
#: Characters that are ordinary though Unicode has a compatibility form for them, or that other problems deal with.
ORDINARY = "°ºª…‐‑‒–—―‘’‚‛“”„‟«»‹›•·¬†€¢£§©®™№´`¨¯¸¹²³¼½¾µ"
#: What may separate words: ASCII punctuation, plain white space, and typographic quotes, dashes and signs.
CUTS = r" \n\r\t\f\x0b!-/:-@\[-`{-~«»‹›“”„‟‘’‚‛‐‑‒–—―…•·¬†€¢§°"
WORD = rf"[^{CUTS}]+"
#: A character that can stand in for, or hide among, ordinary ones.
ODD = (
    r"[\u00a0\u00ad\u0300-\u1dff\u1e9a\u1f00-\u1fff\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2070-\u209c\u20d0-\u20ff\u2100-\u2115\u2117-\u2121\u2123-\u218f"
    r"\u2460-\u24ff\u2c00-\u2dff\u3000-\ua71f\ua800-\uab2f\uab70-\ud7ff\uf900-\ufaff\ufb00-\ufb4f\ufe00-\ufe0f\ufe20-\ufe2f\ufe30-\ufe6f\ufeff\uff00-\uffef\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff\U000e0000-\U000e01ef]"
)
_INVISIBLE = r"[\p{Cf}\x{034f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]"
_LATIN_LETTER, _OTHER_LETTER = r"\p{IsLatin}", r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]"


#: The same class for Java, which writes code points beyond four digits otherwise.
ODD_SQL = re.sub(r"\\U000([0-9a-f]{5})", r"\\x{\1}", ODD)


def mapped(word: Column) -> Column:
    """Look-alike letters as Latin ones, in words that hold Latin letters or figures, or consist of look-alikes only; invisible characters dropped."""
    seen = F.regexp_replace(word, _INVISIBLE, "")
    latin = F.translate(seen, FOREIGN, LATIN)
    mixed = seen.rlike(_LATIN_LETTER) | seen.rlike(r"[\x{ff21}-\x{ff5a}\d]") | ~latin.rlike(_OTHER_LETTER)
    return F.when(mixed, latin).otherwise(seen)


def capitals(word: Column) -> Column:
    """Pattern of capitals: runs of small letters and runs of capitals."""
    small = F.regexp_replace(F.regexp_replace(word, r"[\p{M}]", ""), r"(?U)[\p{Ll}\p{Lo}\p{Lm}]+", "l")
    return F.regexp_replace(small, r"\p{Lu}+", "U")


@F.pandas_udf(StringType())
def composed(words: pd.Series) -> pd.Series:
    """Composed compatibility form without invisible characters; ordinary compatibility characters stay."""

    def one(w: str) -> str:
        parts = (c if c in ORDINARY else unicodedata.normalize("NFKC", c) for c in w)
        return unicodedata.normalize("NFC", "".join(c for p in parts for c in p if unicodedata.category(c) != "Cf"))

    return words.map(one, na_action="ignore")


def classes(vocabulary: DataFrame) -> DataFrame:
    """``word, canonical, mixed`` of every word with an odd character; ``mixed``: letters of two alphabets that no look-alike explains.

    ``vocabulary`` has ``word, n``.
    """
    v = vocabulary.withColumn("odd", F.col("word").rlike(ODD_SQL)).withColumn("mapped", F.when(F.col("odd"), mapped(F.col("word"))).otherwise(F.col("word")))
    v = v.withColumn("pattern", capitals(F.col("mapped"))).withColumn("key", F.collate(F.col("mapped"), COLLATION))
    plain = F.when(~F.col("odd"), F.struct("n", F.col("word").alias("w")))
    members = v.groupBy("key", "pattern").agg(
        F.max(plain).alias("best"),
        F.collect_set(F.when(F.col("odd"), F.struct("word", "mapped"))).alias("odd_words"),  # spellings of one word
    )
    rows = members.filter(F.size("odd_words") > 0).select(F.explode("odd_words").alias("o"), F.col("best.w").alias("best")).select("o.word", "o.mapped", "best")
    foreign = ~F.col("word").rlike(_LATIN_LETTER) & F.col("word").rlike(_OTHER_LETTER) & ~F.col("word").rlike(r"\d")
    own = F.regexp_replace(F.col("word"), _INVISIBLE, "")
    canonical = F.when(foreign & F.col("best").isNull(), composed(own)).otherwise(F.coalesce("best", composed(F.col("mapped"))))
    mixed = F.col("mapped").rlike(_LATIN_LETTER) & F.col("mapped").rlike(_OTHER_LETTER)
    return rows.select("word", canonical.alias("canonical"), mixed.alias("mixed"))


def disguised(vocabulary: DataFrame) -> DataFrame:
    return classes(vocabulary).filter("word <> canonical or mixed")


def _items(spark, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("row_key"), "text")
    return chunks.unionByName(table(spark, root, "questions").select(F.lit("question").alias("item_kind"), F.col("id").alias("row_key"), F.col("question").alias("text")))


def _words(items: DataFrame) -> DataFrame:
    """A row per word with an odd character, of the texts that have any."""
    text = F.regexp_extract_all("text", F.lit(rf"([^{CUTS}]+)"), 1)
    return items.filter(F.col("text").rlike(ODD_SQL)).select("item_kind", "row_key", F.explode(F.array_distinct(F.filter(text, lambda w: w.rlike(ODD_SQL)))).alias("word"))


def p3_found(spark, root: str) -> DataFrame:
    items = _items(spark, root)
    found = disguised(word_counts(items.select("text"), WORD, keep=rf"[^\W\d_]|{ODD}"))
    return _words(items).join(found, "word", "left_semi").select("item_kind", "row_key").distinct()


def p3_text(spark, root: str) -> DataFrame:
    """Every text in its consistent form, with the number of words that were put right."""
    items = _items(spark, root).dropDuplicates(["item_kind", "row_key"])
    found = disguised(word_counts(items.select("text"), WORD, keep=rf"[^\W\d_]|{ODD}"))
    by_text = _words(items).join(found.filter("word <> canonical"), "word").groupBy("item_kind", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("right"))
    parts = F.regexp_extract_all("text", F.lit(rf"([^{CUTS}]+|[{CUTS}]+)"), 1)
    fixed = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("right", p), p)), "")
    df = items.join(by_text, ["item_kind", "row_key"], "left")
    return df.select("item_kind", "row_key", F.when(F.col("right").isNull(), F.col("text")).otherwise(fixed).alias("text"), F.coalesce(F.size("right"), F.lit(0)).alias("n_words"))


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
ORACLES: dict[str, str] = {}
