"""What single lines of a scanned page look like, and how a text ends; plain functions used by several operators."""

from __future__ import annotations

import re

#: Words for "page" before a page number.
PAGE_WORDS = ("faqe", "faqja", "page", "seite", "pagina", "página", "pág", "pag", "f", "p", "s", "fq", "blatt", "folio")
_NUMBER = r"\d{1,4}(?:\s?/\s?\d{1,4})?"
#: A line that holds nothing but a page number, plain or dressed.
PAGE_LINE = re.compile(rf"^(?:(?:{'|'.join(PAGE_WORDS)})\.?\s*{_NUMBER}|\d{{1,4}}\s?/\s?\d{{1,4}}|[-–—~*•|·]+\s*{_NUMBER}\s*[-–—~*•|·]+|[\[(<]\s*{_NUMBER}\s*[\])>])$", re.IGNORECASE)
#: A bare number, which is a page number only where no paragraph number can stand.
BARE = re.compile(r"^\d{1,4}$")
#: Running headers: a dated or numbered series, an issued manual, an office with its protocol number, a place and its collection.
HEADER_LINE = re.compile(
    r"^(?:(?:\w+\s){1,4}\w+,\s(?:nr|no|n°|núm|n)\.?\s?\d+\s?/\s?\d{4}|.{3,60}\s•\s.{2,30}\d+|.{3,60}\sProt\.?\s?\d+|[A-ZÇËÄÖÜÉÈÀ][^\W\d_]+\s—\s\S.{2,50})$",
    re.IGNORECASE,
)
#: A page number before or after the words of a header line.
NUMBER_BEFORE = re.compile(rf"^{_NUMBER}\s*\|\s*(?=\S)")
NUMBER_AFTER = re.compile(rf"(?<=\S)(?:\s{{2,}}|\s*\|\s*|\t+){_NUMBER}$")


def split_header(line: str) -> tuple[str, bool]:
    """The words of a line without a page number at its edge, and whether there was one."""
    body = NUMBER_BEFORE.sub("", line, count=1)
    if body != line:
        return body.strip(), True
    body = NUMBER_AFTER.sub("", line, count=1)
    return body.strip(), body != line


def noise_of(line: str) -> str:
    """``page``, ``header``, ``both`` or an empty string for a line stripped of outer blanks."""
    if PAGE_LINE.match(line):
        return "page"
    body, numbered = split_header(line)
    if len(body) <= 90 and HEADER_LINE.match(body) and not re.search(r"[.;:,]$", body):
        return "both" if numbered else "header"
    return ""


_MARK = re.compile(r"\s*(?:[\[(]\s*(?:\.{2,}|…)\s*[\])]|…|\.{3,}|\.{2,}$)\s*$")
_CLOSERS = "\"”“»’')]"
#: Abbreviations after which a sentence goes on: fixed values in the languages of the corpus.
_OPEN_ABBREVIATION = re.compile(r"(?<![^\s(«“\"])(?:nr|no|n|núm|num|art|fq|sh|sh\.p|p|par|Abs|vgl|cfr|cf|dt|ca|z|bzw|n°)\.$")
_DATE_DOT = re.compile(r"\b(?:dem|zum|am|vom|den|der)\s\d{1,2}\.$")
_LIST = re.compile(r"^\s*(?:[a-zA-Zëç]{1,2}|\d{1,3}|[ivxIVX]{1,5})[).]\s+\S|^\s*[-–•*·]\s+\S")
_MARKERS = re.compile(r"(?:\s*\[\d+\])+(?=[.!?]?$)")


def is_closed(text: str) -> bool:
    """Whether a sentence ends where the text ends, closing quotes and brackets aside."""
    return text.rstrip(_CLOSERS)[-1:] in (".", "!", "?")


def without_mark(text: str) -> str:
    """Text without a mark of omission at its end."""
    inner = text[:-1].rstrip() if text[-1:] in (")", "]") else text
    return _MARK.sub("", text).rstrip() if inner.endswith(("…", "..")) else text


def open_bracket_closed(text: str) -> bool:
    """Whether the bracket that ends a text was opened before."""
    close = text[-1]
    start = {")": "(", "]": "["}[close]
    at = text.rfind(start)
    return at >= 0 and close not in text[at:-1] and not text[at + 1 : -1].isspace()


def shape(line: str) -> str:
    """Form of a line: numbers become 9 and capitalised words after the first X."""
    s = re.sub(r"\d+(?:[ .,]\d{3})*(?:[.,]\d+)?", "9", line.strip())
    return re.sub(r"(?<=\s)[A-ZÇËÄÖÜÉÈÀ][^\W\d_]+", "X", s)


def ending(text: str, markers: bool = False) -> tuple[str, str, str]:
    """How a text ends: state, last line's shape, last token.

    States: ``empty``; ``whole``; ``cut`` (a mark of omission or a broken character after an unfinished sentence, an
    abbreviation or a bracket that demands more); ``open`` (no sign of an end, in running text); ``line`` (no sign of an
    end, on a line of its own after a finished one: a table line, a signature or the start of a paragraph).
    """
    t = text.rstrip()
    if markers and "]" in t[-2:]:
        t = _MARKERS.sub("", t).rstrip()
    if not t:
        return "empty", "", ""
    broken = t.endswith("�")
    t = t.rstrip("�")
    if broken:
        return "cut", "", t.split()[-1] if t.split() else ""
    bare = without_mark(t)
    marked = bare != t
    if not bare:
        return "empty", "", ""
    token = bare.rsplit(None, 1)[-1]
    if is_closed(bare):
        if bare.endswith(")") and not open_bracket_closed(bare):
            return "cut", "", token
        if _OPEN_ABBREVIATION.search(bare) or _DATE_DOT.search(bare):
            return "cut", "", token
        return "whole", "", token
    lines = bare.split("\n")
    last = lines[-1]
    if bare[-1] in ")]" and open_bracket_closed(bare):
        return "whole", "", token
    if bare[-1] == ";" and _LIST.match(last):
        return "whole", "", token
    if marked:
        return "cut", "", token
    before = next((x.rstrip() for x in reversed(lines[:-1]) if x.strip()), "")
    if before and (is_closed(before) or before[-1] in ");:" or re.search(r"\d\s*[^\W\d_]{0,6}$", before) and len(before) < 45):
        return "line", shape(last), token
    return "open", "", token
