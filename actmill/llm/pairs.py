"""Broken prompt and response pairs (problem 5).

Each answer gets at most one defect, tested in this order:

``empty``           null, or nothing but blanks, punctuation, citation markers or a placeholder;
``copy``            every shingle of the answer lies in the question and a longest common subsequence covers the question,
                    a lead-in and repetitions aside;
``refusal``         a clause aligns with a refusal template, composed or learnt (longest common subsequence), and ``should_refuse`` is false;
                    a refusal that should be one, or whose ``should_refuse`` is null, is no case of any kind;
``other_language``  cross-parsing puts the answer clearly into another language than the question;
``truncated``       the answer breaks off inside a word or sentence, citation markers at its end aside.

Whole texts are aligned, row by row, on the workers; only templates, at most ``LEARNT`` learnt ones, and bounded language samples are
sent there.  Templates are learnt from answers labelled with ``should_refuse``, whose texts need not refuse and whose
``refused`` is not read: a clause counts that is far more frequent among those that should refuse.

Defined results: repeated rows count once; a null question has no copy and no language; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.language import best, labelled, parser
from actmill.llm.lines import ending
from actmill.session import cut, table

#: What stands for no answer.
PLACEHOLDERS = {
    "n/a", "na", "n.a", "null", "none", "nil", "nan", "tbd", "todo", "pa përgjigje", "pa pergjigje", "ska", "no answer", "no response", "without answer",
    "unanswered", "unknown", "undefined", "nessuna risposta", "sin respuesta", "keine antwort", "sans réponse", "bosh", "empty",
}
#: Parts of refusals in the languages of the corpus; each first part goes with each second part.
COMPOSED = (
    (("nuk mund të", "nuk jam në gjendje të", "nuk jam në gjendje ta", "refuzoj të", "preferoj të mos", "nuk më lejohet të"), ("përgjigjem", "ndihmoj me këtë", "trajtoj këtë çështje", "këshilloj për këtë", "shprehem për këtë", "komentoj këtë")),
    (("duhet", "më duhet"), ("ta lë këtë pa përgjigje", "të refuzoj këtë pyetje")),
    (("i cannot", "i can t", "i am unable to", "i am not able to", "i must decline to", "i have no way to", "i would rather not"), ("answer this question", "help with this", "assist with this matter", "comment on this", "advise on this", "reply to this")),
    (("non posso", "non sono in grado di"), ("rispondere a questa domanda", "aiutare con questo", "commentare questo")),
    (("je ne peux pas", "je ne suis pas en mesure de"), ("répondre à cette question", "vous aider avec cela", "commenter cela")),
    (("ich kann", "ich darf"), ("diese frage nicht beantworten", "dabei nicht helfen", "mich dazu nicht äußern")),
    (("no puedo", "no estoy en condiciones de"), ("responder a esta pregunta", "ayudar con eso", "comentar esto")),
)
#: Templates are also learnt, from at most so many labelled answers of each kind: clauses of at least so many words, none of them a figure, that so many
#: answers which should refuse hold, and so many times the share of them than of the other answers.
LABELLED, CLAUSE_WORDS, CLAUSE_ROWS, LIFT = 50_000, 4, 3, 10.0
#: Learnt templates at most, the most frequent ones.
LEARNT = 5000
#: Share of a template that must appear, in order, in a stretch at most so many times as long.
ALIGNED, STRETCH = 0.85, 1.5
#: Share of the question that a copy must repeat in order, and share of the answer's shingles that must lie in it.
COPIED, CONTAINED = 0.85, 0.9
SHINGLE = 2
#: How much clearer than the question's language another one must be, and the least words to judge by.
CLEAR, LEAST_WORDS = 0.12, 5

_WORD = re.compile(r"\w+")
#: Three words in a row are neither blanks nor a placeholder, in a text that is longer than those with their dress.
_WORDS, LONGEST_PLACEHOLDER = re.compile(r"[^\W\d_]{2,}\s+[^\W\d_]{2,}\s+[^\W\d_]{2,}"), 60
_MARKER = re.compile(r"\[\s*\d+\s*\]")
#: Letters of other alphabets that look like Latin ones, and the Latin ones.
LOOKALIKES = str.maketrans("АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυ", "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXovaipu")


_HIDDEN = "".join(chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf")
_ODD = frozenset(_HIDDEN) | {chr(c) for c in LOOKALIKES}
_PLAIN = LOOKALIKES | {ord(c): None for c in _HIDDEN}
_CLAUSE = re.compile(r"(?<=[.!?;,])\s+|\n+")


def plain(text: str) -> str:
    """Text in ordinary characters."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFKC", text)
    return t if _ODD.isdisjoint(t) else t.translate(_PLAIN)


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a text whatever characters it is stored with."""
    return _WORD.findall(plain(text).lower()) if text else []


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per token of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


class Refusals:
    """Templates of refusals, found by their rarest words: of those that may be missing and one more, one must be there."""

    def __init__(self, learnt: list[str], usual: Counter[str] | None = None) -> None:
        """``usual`` counts words of any answers; it makes the search fast and changes no result."""
        composed = {f"{x} {y}" for first, second in COMPOSED for x in first for y in second}
        self.templates = [t.split() for t in sorted(composed | set(learnt))]
        n = usual if usual is not None else Counter(w for t in self.templates for w in set(t))
        self.by_word: dict[str, list[int]] = {}
        for i, t in enumerate(self.templates):
            words = sorted(set(t), key=lambda w: (n[w], w))
            for w in words[: len(words) - math.ceil(ALIGNED * len(words) - 1e-9) + 1]:
                self.by_word.setdefault(w, []).append(i)

    def match(self, words: list[str]) -> bool:
        """Whether the words of a clause align with a template."""
        have = set(words)
        for i in {i for w in have for i in self.by_word.get(w, ())}:
            t = self.templates[i]
            if len(words) <= STRETCH * len(t) + 3 and sum(w in have for w in t) >= ALIGNED * len(t) - 1e-9 and common(t, words) >= ALIGNED * len(t) - 1e-9:
                return True
        return False

    def among(self, answer: str) -> bool:
        """Whether a clause of a ``plain`` answer aligns with a template."""
        whole = answer.lower()
        if not any(w in self.by_word for w in _WORD.findall(whole)):
            return False
        return any(self.match(_WORD.findall(c)) for c in _CLAUSE.split(whole))


def clauses(answers: DataFrame) -> DataFrame:
    """``should_refuse, clause``: the clauses of each answer, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (_WORD.findall(c) for c in _CLAUSE.split(plain(a).lower()))
                out += [(s, c) for c in {" ".join(w) for w in words if len(w) >= CLAUSE_WORDS and not any(map(str.isdigit, w))}]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string())], names=["should_refuse", "clause"])

    return answers.select("answer", "should_refuse").mapInArrow(run, "should_refuse boolean, clause string")


def learn_refusals(answers: DataFrame) -> list[str]:
    """Clauses that answers which should refuse hold far more often than others: at most ``LEARNT``, from at most ``LABELLED`` answers of each kind."""
    rows = answers.filter("answer is not null and should_refuse is not null").select("answer_id", "answer", "should_refuse").distinct()
    order = F.xxhash64("answer_id", "answer")
    sample = rows.filter("should_refuse").orderBy(order).limit(LABELLED).unionByName(rows.filter("not should_refuse").orderBy(order).limit(LABELLED))
    sample = cut(sample)
    size = {r.should_refuse: r["count"] for r in sample.groupBy("should_refuse").count().collect()}
    if not size.get(True):
        return []
    yes, no = F.count_if("should_refuse"), F.count_if(~F.col("should_refuse"))
    counts = clauses(sample).groupBy("clause").agg(yes.alias("yes"), no.alias("no"))
    apart = F.col("yes") / size[True] >= LIFT * F.col("no") / max(size.get(False, 0), 1)
    return [r.clause for r in counts.filter((F.col("yes") >= CLAUSE_ROWS) & apart).orderBy(F.desc("yes"), "clause").limit(LEARNT).collect()]


def is_copy(question: list[str], answer: list[str], lead: int = 0) -> bool:
    """Whether the answer only repeats the question, with or without its first ``lead`` words."""
    n = len(question)
    if n < 2 or len(answer) < 2:
        return bool(n) and answer == question
    inside = {tuple(question[i : i + SHINGLE]) for i in range(n - SHINGLE + 1)} | {(question[-1], question[0])}
    for skip in dict.fromkeys((0, lead)):
        body = answer[skip:]
        shingles = [tuple(body[i : i + SHINGLE]) for i in range(len(body) - SHINGLE + 1)]
        contained = sum(s in inside for s in shingles) / len(shingles) if shingles else 0.0
        if contained >= CONTAINED and common(question, body) >= COPIED * n:
            return True
    return False


def lead_in(question: list[str], answer: str) -> int:
    """Words of a ``plain`` answer before the question begins, if no sentence ends among them."""
    if not question:
        return 0
    t = answer.lower()
    for m in _WORD.finditer(t):
        if m[0] == question[0]:
            return len(_WORD.findall(t[: m.start()])) if not re.search(r"[.!?]\s", t[: m.start()]) else 0
    return 0


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(answer) > LONGEST_PLACEHOLDER and _WORDS.search(answer):
        return False
    t = plain(_MARKER.sub(" ", answer)).strip().lower()
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", t)
    return not bare or bare in PLACEHOLDERS or t in PLACEHOLDERS


def defects(answers: DataFrame, samples: DataFrame) -> DataFrame:
    """``answer_id, defect`` of every defective pair."""
    learnt, wordings = labelled(samples), learn_refusals(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, refusals = parser(learnt), None
        for batch in batches:
            ids, questions, texts, should = (c.to_pylist() for c in batch.columns)
            refusals = refusals or Refusals(wordings, Counter(w for t in texts for w in tokens(t)))
            found: list[str | None] = [None] * len(ids)
            rest = []
            for i, (q, a, s) in enumerate(zip(questions, texts, should)):
                if is_empty(a):
                    found[i] = "empty"
                    continue
                text = plain(_MARKER.sub(" ", a))
                asked, given = tokens(q), _WORD.findall(text.lower())
                # A common subsequence cannot be longer than the words of the question that the answer has at all.
                if sum(map(set(given).__contains__, asked)) >= COPIED * len(asked) and is_copy(asked, given, lead_in(asked, text)):
                    found[i] = "copy"
                elif refusals.among(text):
                    found[i] = "refusal" if s is False else ""
                else:
                    rest.append(i)
            if rest and len(model.langs) > 1:
                q_cost = model.costs([plain(questions[i] or "") for i in rest])
                a_cost = model.costs([texts[i] for i in rest])
                q_lang, _ = best(q_cost[:, :-1])
                a_lang, a_sure = best(a_cost[:, :-1])
                for k, i in enumerate(rest):
                    own = a_cost[k, q_lang[k]]
                    if a_lang[k] != q_lang[k] and q_cost[k, -1] >= LEAST_WORDS and a_cost[k, -1] >= LEAST_WORDS and 1 - a_cost[k, a_lang[k]] / max(own, 1e-9) >= CLEAR:
                        found[i] = "other_language"
            for i in rest:
                if found[i] is None and ending(texts[i], markers=True)[0] in ("open", "line", "cut"):
                    found[i] = "truncated"
            keep = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())], names=["answer_id", "defect"])

    rows = answers.select("answer_id", "question", "answer", "should_refuse")
    return rows.mapInArrow(run, "answer_id long, defect string").dropDuplicates(["answer_id"])


def p5_found(spark, root: str) -> DataFrame:
    return defects(table(spark, root, "answers"), table(spark, root, "lang_samples"))


QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}
