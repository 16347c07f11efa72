"""Encoding of the whole corpus with a public byte-level BPE (problem 8).

The bytes of a piece of text become Latin-1 characters, over which an Aho-Corasick automaton of the vocabulary lists
every token that starts at each byte.  The encoder walks left to right with the longest token, keeps it if it is
compatible with the token before (two tokens are compatible when merging the bytes of both by rank gives back just
these two, a memoised test that only follows the split of either), and backtracks to the next shorter token otherwise;
a byte position that led nowhere is never tried again, so the work is linear in the bytes.

Text is cut before every blank between two visible characters, where the pattern of the vocabulary always has a
boundary, and the ids of each cut piece are kept, so that repeated words cost one look-up.

Defined results: null and empty texts have an empty list of ids; strings of special tokens are ordinary text; lone
surrogates cannot occur in a Spark string.  Tables without rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from actmill.session import table

#: Folder of the public vocabularies and the file used when nothing else is asked for.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept per worker before the memory is emptied; only speed depends on it.
KEPT_PIECES = 1_000_000


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Exact BPE by backtracking over longest matches."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex
        from public_tokenizers import PATTERN

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        alphabet = _byte_alphabet()
        latin = {s: "".join(chr(alphabet[c]) for c in s) for s in model["vocab"] if all(c in alphabet for c in s)}
        vocab = model["vocab"]
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        singles = {i for s, i in vocab.items() if len(s) == 1}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {i: (i, i) for i in singles}
        self.rank: dict[int, int] = dict.fromkeys(singles, -1)
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            merged = vocab[a + b]
            self.pair.setdefault((vocab[a], vocab[b]), merged)
            self.halves.setdefault(merged, (vocab[a], vocab[b]))
            self.rank.setdefault(merged, n)
        for s, i in vocab.items():
            if s in latin and i in self.halves:
                self.automaton.add_word(latin[s], i)
                self.length[i] = len(latin[s])
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN)
        self.odd = regex.compile(r"\s\s+|^\s|\s$")
        self.cuts = regex.compile(r"(?<=\S) (?=\S)")
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of ``left + right`` encode to just these two tokens."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        rank, halves, pair = self.rank, self.halves, self.pair
        a, b, bound = left, right, len(rank) + 1
        good = True
        # Undo, latest first, the merges along the border; a merge across it that came earlier than the next one kept breaks the pair.
        while True:
            across = pair.get((a, b))
            if across is not None and rank[across] < bound:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # at equal rank the merge further left comes first, so the right token is undone first
                bound, a = ra, halves[a][1]
            else:
                bound, b = rb + 1, halves[b][0]
        self.fits[(left, right)] = good
        return good

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the pattern."""
        data = piece.encode("utf-8").decode("latin-1")
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(data):
            starts[end + 1 - self.length[token]].append(token)  # shorter tokens of a start end earlier
        out: list[int] = []
        tried = [len(s) for s in starts]  # candidates left per start, taken from the longest
        dead = bytearray(n + 1)
        at = 0
        while at < n:
            while tried[at]:
                tried[at] -= 1
                token = starts[at][tried[at]]
                end = at + self.length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {piece!r}")
                dead[at] = 1
                at -= self.length[out.pop()]
                continue
            if at < n:
                tried[at] = len(starts[at])
        return tuple(out)

    def _ids(self, part: str) -> tuple[int, ...]:
        found = self.kept.get(part)
        if found is None:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            pieces = self.pieces.findall(part)
            if len(pieces) == 1:
                found = self.encode_piece(part)
            else:
                found = tuple(chain.from_iterable(map(self._ids, pieces)))
            self.kept[part] = found
        return found

    def encode(self, text: str | None) -> list[tuple[int, ...]]:
        """Ids of a text, as a list of parts."""
        if not text:
            return []
        first, *rest = self.cuts.split(text) if self.odd.search(text) else text.split(" ")
        kept, ids = self.kept, self._ids
        return [ids(first), *[kept.get(p) or ids(p) for p in [" " + r for r in rest]]]


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR, lengths: bool = False) -> DataFrame:
    """``key`` and the ``ids`` of ``text``, or with ``lengths`` only their number ``n_tokens``."""
    path = f"{tokenizer_dir}/{vocabulary}"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            found = [coder.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((sum(map(len, f)) for f in found), dtype=np.int32, count=len(found))
            if lengths:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])
            else:
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(found)), dtype=np.int32, count=int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int" if lengths else f"`{key}` {kind}, ids array<int>")


def p8_ids(spark, root: str) -> DataFrame:
    return encode(table(spark, root, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
