"""Noise in text from scanned pages (problem 7).

``hyphen``   a word broken across lines: a hyphen-like mark after a letter at the end of a line and a small letter at the start
             of the next line of text, whatever page marks stand between;
``page_no``  a page number on a line of its own or at the edge of a header line;
``header``   a running header: a line of one of the usual forms, or one that repeats a title or subject of the collection from
             its start, or recurs in chunks of one document, in the middle of, or after, a text;
``misread``  a word with wrongly recognised characters.  Each word has an anagram hash, the sum of hashes of its
             characters, so a confusion such as ``rn`` for ``m`` shifts it by a fixed difference.  In SQL, rare words shifted
             by up to three such differences are joined with the frequent words of the corpus, those with more confusions by
             their strokes; partners that are drawn with the same strokes are verified, and the best-ranked one is the correction.  A word with a foreign sign between its letters is misread even without a partner.

Words are counted after broken words are joined and page marks taken out, in two ways: over all texts and headings, which
tells how frequent the intended word is, and over the different texts and headings, which tells how often a misread word was
read, so that copies of one page cannot make a misreading frequent.  The
words of the texts are joined with the misread ones; a bitmap of fixed size drops most of the others before.

Repair joins lines into paragraphs, removes page marks and broken-word marks, and applies the corrections.

Defined results: null and empty texts and headings have no noise; repeated rows count once; a paragraph number on the first
line, or between paragraphs of a fixed window of regime ``standard``, is no page number.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.lines import BARE, noise_of, split_header
from actmill.llm.words import BITMAP, likely, weighted_counts
from actmill.session import cut, table

#: Signs read in place of letters, and the letters.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("0", "o"), ("€", "e"), ("†", "t"), ("¢", "c"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"),
    ("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "n"), ("ii", "u"), ("ri", "n"), ("vv", "w"), ("nn", "rm"),
)
SIGNS = "0-9|!†€¢"
#: How many times as frequent the intended word must be (all rows) as the misread one (different texts), for words of letters only and for words with signs.
RATIO_LETTERS, RATIO_SIGNS = 20, 1
#: Confusions per word that are looked for by differences of hashes; words with more are joined by their strokes.
DEEP = 3
#: Bits of a character's hash, so that sums stay within 64.
HASH_MASK = (1 << 40) - 1
#: Chunks of a document in which a line recurs that is a running header; overlapping windows share a line in two.
RECURRING = 2
#: Characters of a title that a header line must repeat at least; it must be the start of the title as a whole.
LEAST_START = 24
TOKEN = r"[\w|!†€¢]+"

_TOKEN = re.compile(TOKEN)
_BREAK = re.compile(r"[^\W\d_][-‐‑¬\u00ad]\s*$")
_LETTER = re.compile(r"[^\W\d_]")
_FIRST_LOWER = re.compile(r"\s*[«“\"'(]?([^\W\d_])")


def _starts_lower(line: str) -> bool:
    m = _FIRST_LOWER.match(line)
    return bool(m) and m[1].islower()


def _is_break(line: str, following: str) -> bool:
    if not _BREAK.search(line):
        return False
    if _starts_lower(following):
        return True
    word = re.search(r"([^\W\d_]+)[-‐‑¬\u00ad]\s*$", line)
    start = re.match(r"\s*([^\W\d_]+)", following)
    return bool(word and start and len(word[1]) > 1 and word[1].isupper() and start[1].isupper() and len(start[1]) > 1)


class Page:
    """The lines of a text, sorted into text, page marks and lines that may be running headers."""

    def __init__(self, text: str, extra: frozenset[str] | set[str] = frozenset()) -> None:
        self.kinds: set[str] = set()
        self.candidates: list[tuple[str, bool, str]] = []  # possible header, numbered, form as stored
        self.bare: list[tuple[str, bool]] = []  # bare numbers, and whether the text before had ended
        self.body: list[str] = []  # lines of text; an empty one between paragraphs that blank lines separate
        lines = text.split("\n")
        full = [x.strip() for x in lines]
        for i, s in enumerate(full):
            if not s:
                if self.body and self.body[-1]:
                    self.body.append("")
                continue
            kind = noise_of(s) if len(full) > 1 else ""
            if kind and (i or kind != "page"):
                self.kinds.update({"page": ("page_no",), "header": ("header",), "both": ("header", "page_no")}[kind])
                continue
            if s in extra:
                continue
            if i and BARE.match(s):
                before = next((x for x in reversed(full[:i]) if x), "")
                self.bare.append((s, bool(re.search(r"[.!?;:]$", before))))
                continue
            if i:
                body, numbered = split_header(s)
                if len(body) >= LEAST_START and body[:1].isupper() and not re.search(r"[.;:,]$", body):
                    self.candidates.append((body.lower(), numbered, s))
            self.body.append(lines[i])
        for i, line in enumerate(self.body):
            if _BREAK.search(line):
                rest = [x for x in self.body[i + 1 :] if x][:2]
                if rest and (_is_break(line, rest[0]) or len(rest) > 1 and any(c[2] == rest[0].strip() for c in self.candidates) and _is_break(line, rest[1])):
                    self.kinds.add("hyphen")
                    break

    def paragraphs(self) -> list[str]:
        """Continuous paragraphs: broken words joined, lines joined unless a sentence ended before a capital."""
        out: list[str] = []
        gap = False
        for line in self.body:
            s = line.strip()
            if not s:
                gap = True
                continue
            if out and _is_break(out[-1], s):
                out[-1] = re.sub(r"[-‐‑¬\u00ad]\s*$", "", out[-1]) + s
            elif out and (_starts_lower(s) or not re.search(r"[.!?:;)»”]$", out[-1])) and not (gap and re.search(r"[.!?:;]$", out[-1])):
                out[-1] += " " + s
            else:
                out.append(s)
            gap = False
        return out


def _clean(text: str | None) -> str:
    if not text:
        return ""
    return "\n".join(Page(text).paragraphs()) if "\n" in text else text


def _vocabulary(chunks: DataFrame) -> DataFrame:
    """``word, n, n_rows`` of texts and headings, broken words joined: occurrences in different texts and headings, and in all rows."""
    rows = F.count(F.lit(1)).alias("rows")
    texts = chunks.groupBy("text").agg(rows)
    headings = chunks.groupBy("heading", F.xxhash64("text").alias("of")).agg(rows)
    parts = texts.unionByName(headings.select(F.col("heading").alias("text"), "rows"))
    words = weighted_counts(parts.filter("text is not null").select("text", "rows"), TOKEN, lower=True, keep=r"[^\W\d_]", clean=_clean)
    return words.groupBy(F.rtrim(F.col("word"), F.lit("!")).alias("word")).agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")).filter("word <> ''")


def anagram(word: Column) -> Column:
    """Sum of the characters' hashes, the same for all orders of the characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.xxhash64(c).bitwiseAND(F.lit(HASH_MASK)))


def _strokes(word: Column) -> Column:
    """Word drawn in strokes, the same for all words that the confusions turn into each other."""
    w = F.translate(word, "1|!lr0€†¢59682", "iiiiioetcsgbbz")
    for letters, drawn in (("[hnu]", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv")):
        w = F.regexp_replace(w, letters, drawn)
    return w


def _hash(s: str) -> int:
    """``anagram`` of a plain string."""
    return sum(xxhash.xxh64_intdigest(c.encode(), seed=42) & HASH_MASK for c in s)


def misread(vocabulary: DataFrame) -> DataFrame:
    """``word, right``: misread words and what they stand for; ``right`` is null where no frequent word fits."""
    words = vocabulary.withColumn("hash", anagram(F.col("word")))
    letters = r"(?U)^\p{L}+$"
    sign = rf"[{SIGNS}]"
    n_letters = F.length(F.regexp_replace("word", r"(?U)[^\p{L}]", ""))
    odd = F.col("word").rlike("[|†€¢!]") & (n_letters >= 1) | F.col("word").rlike(r"\d") & (n_letters >= 2)
    double = "|".join(a for a, _ in CONFUSIONS if len(a) > 1)
    rare = words.filter(odd | (F.col("word").rlike(letters) & F.col("word").rlike(double) & (F.length("word") >= 4)))
    # A pair of letters may itself be misread, so it is also looked for with the signs read as letters.
    read = [F.col("word"), *[F.translate("word", "1|!0€†¢59682", f"{x}{x}{x}oetcsgbbz") for x in "il"]]
    there = lambda a: reduce(or_, [F.contains(w, F.lit(a)) for w in (read if len(a) > 1 else read[:1])])
    shifts = F.array(*[F.when(there(a), F.lit(_hash(b) - _hash(a))) for a, b in CONFUSIONS])
    rare = rare.withColumn("one", F.array_compact(shifts)).withColumn("odd", odd)
    level = F.col("one")
    sums = [level]
    for _ in range(DEEP - 1):
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.transform(F.col("one"), lambda y: x + y))))
        sums.append(level)
    probes = rare.select("word", "n", "odd", F.explode(F.array_distinct(F.concat(*sums))).alias("shift"), "hash").withColumn("key", F.col("hash") + F.col("shift"))
    right = words.filter(F.col("word").rlike(letters)).select(F.col("word").alias("right"), F.col("n_rows").alias("n_right"), F.col("hash").alias("key"))
    need = F.when(F.col("odd"), RATIO_SIGNS).otherwise(RATIO_LETTERS) * F.col("n")
    enough = (F.col("n_right") > F.greatest(need, F.lit(1))) & (F.col("word") != F.col("right"))
    pairs = cut(probes.join(right, "key").filter(enough & (_strokes(F.col("word")) == _strokes(F.col("right")))).select("word", "right", "n_right"))
    # Words with more confusions than DEEP are joined by their strokes, which are the same for any number of them.
    long = F.length("word") > F.when(F.col("odd"), DEEP).otherwise(2 * DEEP)  # room for so many
    deep = rare.filter(long).join(pairs.select("word").distinct(), "word", "left_anti").select("word", "n", "odd", _strokes(F.col("word")).alias("drawn"))
    pairs = pairs.unionByName(deep.join(right.select("right", "n_right", _strokes(F.col("right")).alias("drawn")), "drawn").filter(enough).select("word", "right", "n_right"))
    pairs = pairs.withColumn("apart", F.levenshtein("word", "right"))
    best = pairs.groupBy("word").agg(F.max_by("right", F.struct(-F.col("apart"), "n_right", "right")).alias("right"))
    # A sign between letters tells on its own: three letters at least, and a small letter on both sides of a figure.
    alone = odd & (n_letters >= 3) & F.col("word").rlike(rf"(?U)\p{{L}}[|†€¢!]+\p{{L}}|[†€¢|]\p{{L}}{{2}}|\p{{L}}{{2}}[†€¢|]|\p{{L}}{{2}}\d\p{{L}}|\p{{L}}\d\p{{L}}{{2}}") & ~F.col("word").rlike(r"\d{2}")
    return words.filter(alone).select("word").join(best, "word", "full").select("word", "right")


def _bitmap(words: DataFrame) -> np.ndarray:
    """BITMAP bits, set where a word of ``words`` falls; of that size whatever the number of words."""
    place = F.pmod(F.xxhash64("word"), F.lit(BITMAP)) + 1  # positions count from 1
    rows = words.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in rows:  # buckets begin at 1
        bits = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        out[(r.bucket - 1) * len(bits) : r.bucket * len(bits)] = bits
    return out


class _Maybe(dict):
    """Word -> whether the bitmap has it; kept per worker."""

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        at = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42) % (8 * len(self.bits))
        self[word] = out = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return out


def _marks(chunks: DataFrame, wrong: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, kind, arg, line`` of every mark of noise and of everything that may be one, each once.

    Kinds that begin with ``?`` are to be confirmed: lines by titles, bare numbers by the regime, words by a join with ``wrong``.
    Most words that are not wrong are dropped by a bitmap before.
    """
    bits = _bitmap(wrong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _Maybe(bits)
        for batch in batches:
            out: list[tuple[int, str, str | None, str | None]] = []
            _, _, texts, headings = (c.to_pylist() for c in batch.columns)
            for i, (t, h) in enumerate(zip(texts, headings)):
                kinds: set[str] = set()
                found: set[str] = set()
                for part in (t, h):
                    if not part:
                        continue
                    clean = part
                    if "\n" in part:
                        page = Page(part)
                        kinds |= page.kinds
                        out += [(i, "?numbered" if numbered else "?header", line, s) for line, numbered, s in page.candidates]
                        out += [(i, "?ended" if ended else "?bare", None, None) for _, ended in page.bare]
                        clean = "\n".join(page.paragraphs())
                    found.update(_TOKEN.findall(clean.lower()))
                out += [(i, k, None, None) for k in kinds]
                out += [(i, "?word", w, None) for w in {w.rstrip("!") for w in found} if maybe[w]]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([o[k] for o in out], pa.string()) for k in (1, 2, 3)]], names=["chunk_id", "doc_id", "kind", "arg", "line"])

    raw = chunks.select("chunk_id", "doc_id", "text", "heading").mapInArrow(run, "chunk_id string, doc_id long, kind string, arg string, line string")
    return cut(raw.distinct())  # marks and candidates only


def running_headers(lines: DataFrame, documents: DataFrame, acts: DataFrame) -> DataFrame:
    """The rows ``doc_id, chunk_id, arg, ...`` whose line ``arg`` is a running header: one that starts a title, or recurs in chunks of one document."""
    again = lines.groupBy("doc_id", "arg").agg(F.countDistinct("chunk_id").alias("n")).filter(F.col("n") >= RECURRING).select(F.col("doc_id").alias("d"), F.col("arg").alias("start"))
    titled = lines.join(title_starts(documents, acts, lines.select("arg")), F.col("arg") == F.col("start"), "left_semi")
    return titled.unionByName(lines.join(again, (F.col("doc_id") == F.col("d")) & (F.col("arg") == F.col("start")), "left_semi")).distinct()


def noise(chunks: DataFrame, documents: DataFrame, acts: DataFrame) -> DataFrame:
    """``chunk_id, noise``: a row per kind of noise in the text or heading of a chunk."""
    wrong = cut(misread(cut(_vocabulary(chunks))))
    rows = _marks(chunks, wrong)
    sure = rows.filter(~F.col("kind").startswith("?")).select("chunk_id", F.col("kind").alias("noise"))
    maybe = rows.filter(F.col("kind").isin("?header", "?numbered"))
    headers = running_headers(maybe, documents, acts).select("chunk_id", F.explode(F.when(F.col("kind") == "?numbered", F.array(F.lit("header"), F.lit("page_no"))).otherwise(F.array(F.lit("header")))).alias("noise"))
    numbers = rows.filter(F.col("kind").isin("?bare", "?ended")).join(documents.select("doc_id", "regime").dropDuplicates(["doc_id"]), "doc_id", "left")
    window = (F.coalesce("regime", F.lit("")) == "standard") & F.contains(F.col("chunk_id"), F.lit(":fixed:")) & (F.col("kind") == "?ended")
    pages = numbers.filter(~window).select("chunk_id", F.lit("page_no").alias("noise"))
    words = rows.filter("kind = '?word'").join(wrong, F.col("arg") == F.col("word"), "left_semi").select("chunk_id", F.lit("misread").alias("noise"))
    return sure.unionByName(headers).unionByName(pages).unionByName(words).distinct()


def title_starts(documents: DataFrame, acts: DataFrame, asked: DataFrame) -> DataFrame:
    """``start``: those of the asked lines, in lower case, that a title or subject of the collection starts with, as a whole or from its topic on."""
    t = F.lower(F.trim(F.col("t")))
    titles = documents.select(F.col("title").alias("t")).unionByName(acts.select(F.col("subject").alias("t"))).distinct()
    both = F.array(t, F.regexp_extract(t, r"^.*?[\s“\"\„«](për\s.*)$", 1))
    starts = titles.select(F.explode(both).alias("s")).filter(F.length("s") >= LEAST_START).distinct()
    lengths = F.sequence(F.lit(LEAST_START), F.length("s"))
    every = starts.select(F.explode(F.transform(lengths, lambda i: F.substring(F.col("s"), F.lit(1), i))).alias("start"))
    asked = cut(asked.select(F.col(asked.columns[0]).alias("start")).distinct())
    every = likely(every, F.xxhash64("start"), asked.select(F.xxhash64("start").alias("k")))
    return asked.join(every, "start", "left_semi")


def repaired(chunks: DataFrame, documents: DataFrame, acts: DataFrame) -> DataFrame:
    """``chunk_id, heading, text``: heading and text as continuous paragraphs, every chunk once."""
    wrong = cut(misread(cut(_vocabulary(chunks))).filter("right is not null"))

    def fix(words: dict[str, str]):
        def one(word: re.Match) -> str:
            w = word[0]
            core = w.rstrip("!")
            right = words.get(core.lower())
            if right is None:
                return w
            return (right.upper() if core.isupper() and len(core) > 1 else right.capitalize() if core[:1].isupper() else right) + w[len(core) :]

        return one

    def clean(text: str | None, words: dict[str, str], extra: set[str]) -> str | None:
        if text is None:
            return None
        whole = "\n".join(Page(text, extra).paragraphs())
        return _TOKEN.sub(fix(words), whole) if words else whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, headings, texts, extra, own = (c.to_pylist() for c in batch.columns)
            words = [{x["word"]: x["right"] for x in o or ()} for o in own]
            lines = [set(e or ()) for e in extra]
            fixed = [[clean(t, w, e) for t, w, e in zip(part, words, some)] for part, some in ((headings, [set()] * len(ids)), (texts, lines))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f, pa.string()) for f in fixed]], names=["chunk_id", "heading", "text"])

    rows = _marks(chunks, wrong)
    lines = rows.filter(F.col("kind").isin("?header", "?numbered"))
    headers = running_headers(lines, documents, acts).groupBy("chunk_id").agg(F.collect_set("line").alias("extra"))
    found = rows.filter("kind = '?word'").join(wrong, F.col("arg") == F.col("word")).groupBy("chunk_id").agg(F.collect_list(F.struct("word", "right")).alias("own"))  # of one chunk
    every = chunks.select("chunk_id", "heading", "text").dropDuplicates(["chunk_id"]).join(headers, "chunk_id", "left").join(found, "chunk_id", "left")
    return every.select("chunk_id", "heading", "text", "extra", "own").mapInArrow(run, "chunk_id string, heading string, text string")


def p7_found(spark, root: str) -> DataFrame:
    return noise(*(table(spark, root, t) for t in ("chunks", "documents", "acts")))


def p7_text(spark, root: str) -> DataFrame:
    """Heading and text of every chunk, repaired."""
    return repaired(*(table(spark, root, t) for t in ("chunks", "documents", "acts")))


QUERIES = {"p7_found": p7_found, "p7_text": p7_text}
ORACLES: dict[str, str] = {}
