"""Missing or wrong document language labels (problem 10).

Cross-parsing: the labelled samples of each language become one suffix automaton, and a text is cut greedily into the
fewest phrases that each occur in the samples.  The language that needs fewest phrases, normalised by the logarithm of
the size of its samples, wins; the confidence is how much more the runner-up needs.  Phrases run across words; figures
and punctuation count as blanks.

Texts are cut into sentences; two or more successive sentences of one language are a whole paragraph in it, and
successive sentences of one language form a segment.  Only labelled samples, at most
``SAMPLES`` a language, are sent to the workers.

Defined results: null, empty and letterless texts have no language and are never found; a label that is null, blank or
names no known language is missing; ties go to the language code that sorts first.  No samples or no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.session import table

#: Codes of ISO 639 (three letters, both kinds) and the two-letter code of each.
CODES = {
    "sqi": "sq", "alb": "sq", "eng": "en", "ita": "it", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "esl": "es",
}
#: A sentence counts on its own from this many words; shorter ones join the sentence before.
LEAST_WORDS = 4
#: Successive sentences that make a whole paragraph.
PARAGRAPH = 2
#: Share of phrases by which the runner-up must exceed the winner for a sentence to change the language.
CLEAR = 0.08
#: Labelled samples per language that the automata are made of; more would make them larger, not the corpus's results better.
SAMPLES = 2000
#: A stretch without the end of a sentence is parsed in pieces of so many letters, and so many letters are parsed at once.
PIECE, LETTERS = 512, 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-zëçàâäéèêëîïôöùûüßñáíóúìò])|\n\s*\n")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class SuffixAutomaton:
    """All substrings of a text; a walk from the start goes on as long as what was read occurs in it."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Fewest phrases, each a substring of the automaton's text or one unknown character, that make up ``text``."""
        n, node, walk = 0, None, self.next
        for c in text:
            following = walk[node].get(c) if node is not None else None
            if following is None:
                n += 1
                following = walk[0].get(c)
            node = following
        return n


class CrossParser:
    """The automata of all languages as tables, walked by many texts at once.

    A row of a table is a state, a column a letter; an entry holds the row of the next state and, in its lowest bit, whether
    a phrase begins.  The last row is where a text starts and where an unknown letter leads: whatever follows begins a phrase.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        texts = {k: " " + " ".join(_WORD.findall(samples[k].lower())) + " " for k in self.langs}
        letters = sorted(set("".join(texts.values())) - {" "})
        self.width = len(letters) + 2  # 0 unknown letter, 1 blank
        self.codes = np.where(_letters(), 0, 1).astype(np.uint8 if self.width < 256 else np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(2, self.width)
        code = {c: i for i, c in enumerate(letters, 2)} | {" ": 1}
        self.tables = [self._table(SuffixAutomaton(texts[k]).next, code) for k in self.langs]
        self.weight = np.array([log2(len(texts[k]) + 1) for k in self.langs]) if self.langs else np.zeros(0)

    def _table(self, states: list[dict[str, int]], code: dict[str, int]) -> tuple[np.ndarray, int]:
        fresh = len(states)
        root = np.full(self.width, fresh * self.width << 1 | 1, dtype=np.int64)
        for c, to in states[0].items():
            root[code[c]] = to * self.width << 1 | 1
        table = np.tile(root, (fresh + 1, 1))
        for i, row in enumerate(states):
            for c, to in row.items():
                table[i, code[c]] = to * self.width << 1
        return table.ravel().astype(np.int32), fresh * self.width

    def _batch(self, texts: list[str]) -> np.ndarray:
        lowered = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1
        points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[points]
        blank = codes == 1
        begins = ~blank[1:] & blank[:-1]  # first letters of words
        ends = np.cumsum(sizes)
        words = np.diff(np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], ends])])
        keep = np.concatenate([[True], ~(blank[1:] & blank[:-1])])  # runs of blanks become one
        place = np.cumsum(keep) - 1  # of each character, or of the blank it became
        at = place[np.concatenate([[0], ends])]
        codes = codes[keep].astype(np.int32)
        # Each text runs from the blank before it to the blank after it, in pieces of at most PIECE.
        lo, hi = at[:-1], at[1:] + 1
        number = np.maximum(-(-(hi - lo) // PIECE), 1)
        owner = np.repeat(np.arange(len(texts)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        start = lo[owner] + nth * PIECE
        length = np.minimum(hi[owner] - start, PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = len(length) - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1 if len(length) else 1), side="left")
        rows = [np.full(len(start), fresh, dtype=np.int32) for _, fresh in self.tables]
        counts = [np.zeros(len(start), dtype=np.int32) for _ in self.tables]
        for j, n in enumerate(active.tolist()):
            c = codes[start[:n] + j]
            for (table, _), row, count in zip(self.tables, rows, counts):
                step = table[row[:n] + c]
                count[:n] += step & 1
                np.right_shift(step, 1, out=row[:n])
        out = np.zeros((len(texts), len(self.langs) + 1))
        for k, count in enumerate(counts):
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)) * self.weight[k]
        out[:, -1] = words
        out[words == 0, :-1] = 0
        return out

    def costs(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases per text and language, and the number of words in the last column."""
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        parts, at = [np.zeros((0, len(self.langs) + 1))], 0
        while at < len(texts):  # so many letters at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
            parts.append(self._batch(texts[at:to]))
            at = to
        return np.concatenate(parts)


def best(costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner and its confidence, 0 to 1, per row of normalised phrases."""
    if costs.shape[1] < 2:
        return np.zeros(len(costs), dtype=int), np.ones(len(costs))
    winner = costs.argmin(axis=1)
    two = np.partition(costs, 1, axis=1)[:, :2]
    return winner, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)


def sentences(text: str) -> list[str]:
    """Sentences of a text; lines are joined, blank lines and ends of sentences separate."""
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


_PARSERS: dict[int, CrossParser] = {}


def parser(samples: dict[str, str]) -> CrossParser:
    """The parser of these samples, built once per worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _PARSERS:
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def labelled(samples: DataFrame) -> dict[str, str]:
    """Text per language of the labelled samples, of the first ``SAMPLES`` of each language."""
    one = samples.select("sample_id", F.lower(F.trim("lang")).alias("lang"), "text").dropna().distinct()
    rows = one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("sample_id", "text"))).filter(F.col("r") <= SAMPLES).orderBy("sample_id", "text").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.text)
    return {k: " ".join(v) for k, v in out.items()}


def segments_of(texts: list[str | None], model: CrossParser) -> list[list[tuple[int, float, int, int]]]:
    """Per text its segments ``(language, confidence, sentences, words)``."""
    parts = [sentences(t) if t else [] for t in texts]
    costs = model.costs(list(chain.from_iterable(parts)))
    winner, sure = best(costs[:, :-1]) if len(costs) else (np.zeros(0, dtype=int), np.zeros(0))
    sums = np.concatenate([np.zeros((1, costs.shape[1])), np.cumsum(costs, axis=0)])
    long = costs[:, -1] >= LEAST_WORDS
    counted = np.concatenate([[0], np.cumsum(long)]).tolist()
    # The language of each clear sentence; -1 where the sentence joins its neighbour.
    clear = np.where(long & (sure >= CLEAR), winner, -1).tolist()
    out, at = [], 0
    for p in parts:
        end = at + len(p)
        starts: list[int] = []  # first sentence of each run
        langs: list[int] = []
        for i in range(at, end):
            lang = clear[i]
            if lang >= 0 and (not langs or langs[-1] != lang):
                starts.append(i if langs else at)
                langs.append(lang)
        if not langs and end > at and sums[end, -1] > sums[at, -1]:
            starts, langs = [at], [int((sums[end, :-1] - sums[at, :-1]).argmin())]
        found = []
        for k, lang in enumerate(langs):
            lo, hi = starts[k], starts[k + 1] if k + 1 < len(starts) else end
            total = sums[hi, :-1] - sums[lo, :-1]
            others = np.delete(total, lang)
            found.append((lang, float(max(0.0, 1 - total[lang] / max(others.min(), 1e-9))) if len(others) else 1.0, counted[hi] - counted[lo], int(sums[hi, -1] - sums[lo, -1])))
        out.append(found)
        at = end
    return out


def segments(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, segment_no, lang, confidence, n_sentences, n_words``: successive sentences of one language, in order."""
    learnt = labelled(samples)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(learnt)
        for batch in batches:
            found = segments_of(batch.column(1).to_pylist(), model) if model.langs else [[]] * batch.num_rows
            sizes = [len(f) for f in found]
            flat = list(chain.from_iterable(found))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes), type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    keys, pa.array([i for n in sizes for i in range(n)], pa.int32()), pa.array([model.langs[f[0]] for f in flat], pa.string()),
                    pa.array([f[1] for f in flat], pa.float64()), pa.array([f[2] for f in flat], pa.int32()), pa.array([f[3] for f in flat], pa.int32()),
                ], names=[key, "segment_no", "lang", "confidence", "n_sentences", "n_words"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, segment_no int, lang string, confidence double, n_sentences int, n_words int")


def label_code(label):
    """Two-letter code that a label names; null when it names none of the known languages."""
    c = F.element_at(F.split(F.lower(F.regexp_replace(label, r"(?U)\s+", "")), "[-_]"), 1)
    known = sorted({*CODES.values()})
    whens = F.when(c.isin(known), c)
    for long, short in CODES.items():
        whens = whens.when(c == long, F.lit(short))
    return whens


def documents_by_language(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, main, langs``: language of most words, and the languages of whole paragraphs (the main one if there is none)."""
    seg = segments(documents.select("doc_id", "text"), samples)
    per = seg.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("words"), F.max("n_sentences").alias("longest"))
    whole = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("longest") >= PARAGRAPH, F.col("lang")))))
    docs = per.groupBy("doc_id").agg(F.max_by("lang", F.struct("words", "lang")).alias("main"), whole.alias("langs"))
    return docs.withColumn("langs", F.when(F.size("langs") > 0, F.col("langs")).otherwise(F.array("main")))


def p10_found(spark, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    found = documents_by_language(docs, table(spark, root, "lang_samples"))
    labels = docs.select("doc_id", label_code(F.col("lang")).alias("label"))
    bad = F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1)
    return labels.join(found, "doc_id").filter(bad).select("doc_id", F.explode("langs").alias("lang")).distinct()


def p10_segments(spark, root: str) -> DataFrame:
    """The language of each segment of each document with its confidence."""
    return segments(table(spark, root, "documents"), table(spark, root, "lang_samples"))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
ORACLES: dict[str, str] = {}
