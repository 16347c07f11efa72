"""Exact search of many questions at once over blocks of chunks.

``write_blocks`` tokenises the chunks once into rows of up to ``BLOCK_CHUNKS`` chunks of one strategy: keys, lengths and inverted postings, packed,
and for the dense arm the signed sums of the built-in encoder, so that no task encodes them again.
``search`` pairs each group of questions with each group of blocks; a task keeps the best chunks of its questions over all blocks it reads.
Lexical scores leave out postings that cannot reach the k-th best score so far (sum of the largest parts of their terms), dense scores are
screened in single precision and computed again in double: both give the scores of every chunk that can be among the best, ties included.

Nothing is sent to the driver but a row per strategy. Memory of a task: one block, and the keys of the chunks of its group.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.functions import text as tx
from actmill.operators import retrieval as rt
from actmill.session import discard

#: Chunks of a block (below 2^16), chunks of a group of blocks, questions of a packed group, questions multiplied at once.
BLOCK_CHUNKS, GROUP_CHUNKS, GROUP_QUESTIONS, TILE = 49152, 1_000_000, 12288, 128
#: Scores are compared at nine decimals; sums in another order differ by less than this.
SLACK = 1e-8
DENSE, LEXICAL = 0, 1
#: Numbers that the rows of frequent terms, kept for the questions of a block, may hold.
KEPT = 6_000_000
#: Chunks that are not worth another look at their bounds.
FEW = 128
#: Questions of a group from which they are screened together, chunks multiplied at once then, and the most terms of a question for that.
MANY, WIDE, MOST_TERMS = 1024, 1024, 1000
#: Bytes that the rows of frequent terms may hold in that case.
ROWS = 120_000_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
META = ("chunk_id", "doc_id", "unit", "cite")


def _small(x: np.ndarray, n: int) -> bytes:
    """Whole numbers in the fewest bytes that hold them; ``_whole`` finds their width by their number."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32).tobytes() if n else b""


def _whole(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"i{len(packed) // n}" if n else np.int8)


class _Words(dict):
    """Word -> number of its stem, -1 for stopwords."""

    def __init__(self) -> None:
        self.stems: dict[str, int] = {}
        self.hashed: list[tuple[int, float]] = []  # of the stems, as far as they were asked for

    def __missing__(self, w: str) -> int:
        stem = rt._STEMS[w]
        out = self[w] = self.stems.setdefault(stem, len(self.stems)) if stem else -1
        return out


class _Pending:
    """Chunks of one strategy that wait for their block."""

    def __init__(self, dense: bool) -> None:
        self.dense, self.words, self.rows, self.flat, self.lengths = dense, _Words(), [], [], []

    def add(self, row: tuple, text: str | None) -> None:
        before = len(self.flat)
        if text:
            words = rt._TOKEN.findall(text.lower().replace("ë", "e").replace("ç", "c"))
            self.flat.extend([i for i in map(self.words.__getitem__, words) if i >= 0])
        self.lengths.append(len(self.flat) - before)
        self.rows.append(row)

    def block(self, strategy: str | None, schema: pa.Schema) -> pa.RecordBatch:
        n, lengths = len(self.rows), np.array(self.lengths, np.int32)
        pair, tf = np.unique(np.array(self.flat, np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        number, first = np.unique(pair // n, return_index=True)
        names = list(self.words.stems)
        counts = np.diff(np.append(first, len(pair)))
        sums = b""
        if self.dense:
            hashed = self.words.hashed
            hashed += map(rt.hashed_place, names[len(hashed) :])
            at, sign = np.array([hashed[i] for i in number]).reshape(-1, 2).T
            place = (pair % n) * rt.DIMENSIONS + np.repeat(at.astype(np.int64), counts)
            sums = _small(np.bincount(place, np.repeat(sign, counts) * tf, n * rt.DIMENSIONS), n)
        values = [[strategy], [uuid.uuid4().hex], [n], [int(lengths.sum())], *([list(c)] for c in zip(*self.rows)), [lengths.tobytes()], [[names[i] for i in number]], [counts.tolist()], [(pair % n).astype(np.uint16).tobytes()], [_small(tf, len(tf))], [sums]]
        self.rows, self.flat, self.lengths = [], [], []
        if len(names) > 500_000:
            self.words = _Words()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


def write_blocks(chunks: DataFrame, path: str, dense: bool = True) -> None:
    """Blocks of the chunks, each chunk once, in a new folder; ``dense``: with what the dense arm needs."""
    unit = F.coalesce(F.nullif("cite", F.lit("")), F.col("label"), F.lit("")).alias("unit")
    source = chunks.select("strategy", "chunk_id", "doc_id", unit, "cite", tx.embed_text(F.col("cite"), F.col("heading"), F.col("text")).alias("t"))
    doc = source.schema["doc_id"].dataType.simpleString()
    lists = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str | None, _Pending] = {}
        seen: set[str] = set()  # copies of a chunk are in one partition
        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("strategy", pa.string()), ("block", pa.string()), ("n", pa.int32()), ("dl", pa.int64()), ("chunk_id", lists), ("doc_id", pa.list_(batch.schema.field("doc_id").type)), ("unit", lists), ("cite", lists), ("lengths", pa.binary()),
                ("terms", lists), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary()), ("sums", pa.binary()),
            ])
            strategies, *meta, texts = (c.to_pylist() for c in batch.columns)
            for strategy, row, text in zip(strategies, zip(*meta), texts):
                if row[0] in seen:
                    continue
                seen.add(row[0])
                p = pending.get(strategy) or pending.setdefault(strategy, _Pending(dense))
                p.add(row, text)
                if len(p.rows) >= BLOCK_CHUNKS:
                    yield p.block(strategy, schema)
        for strategy, p in pending.items():
            if p.rows:
                yield p.block(strategy, schema)

    kinds = f"strategy string, block string, n int, dl bigint, chunk_id array<string>, doc_id array<{doc}>, unit array<string>, cite array<string>, lengths binary, terms array<string>, counts array<int>, places binary, tfs binary, sums binary"
    source.repartition("chunk_id").mapInArrow(run, kinds).write.parquet(path)


class _Block:
    """A block as arrays; what its terms add to a score is computed for the terms that are asked."""

    def __init__(self, row: dict, avgdl: float) -> None:
        self.n = len(row["chunk_id"])
        self.terms = row["terms"].values
        self.ends = np.concatenate(([0], np.cumsum(row["counts"].values.to_numpy())))
        self.places, self.tfs = np.frombuffer(row["places"].as_py(), np.uint16), _whole(row["tfs"].as_py(), self.ends[-1])
        self.sums = row["sums"]
        lengths = np.frombuffer(row["lengths"].as_py(), np.int32)
        self.norm = rt.K1 * (1 - rt.B + rt.B * lengths / avgdl) if avgdl else np.ones(self.n)

    def parts(self, names: pa.Array) -> list[tuple[np.ndarray, np.ndarray, float] | None]:
        """Per name its chunks, what each adds for a weight of 1, and the most of that."""
        out, self.starts = [], []
        for at in pc.index_in(names, value_set=self.terms).to_pylist():
            self.starts.append(None if at is None else self.ends[at])
            if at is None:
                out.append(None)
                continue
            s, e = self.ends[at], self.ends[at + 1]
            places, tf = self.places[s:e].astype(np.int64), self.tfs[s:e]
            part = tf / (tf + self.norm[places])
            out.append((places, part, float(part.max())))
        return out

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Signed sums of the built-in encoder and their lengths, 1 for chunks without terms."""
        sums = _whole(self.sums.as_py(), self.n * rt.DIMENSIONS).reshape(self.n, rt.DIMENSIONS)
        single = sums.astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", single, single, dtype=float))
        return sums, np.where(norm > 0, norm, 1)


class _Best:
    """The best chunks so far of each question of a group; ties with the last one are kept until the end."""

    def __init__(self, n: int, k: int, name) -> None:
        self.k, self.name = k, name
        self.least = np.zeros(n)  # the k-th best score, 0 as long as there are fewer
        self.scores, self.places = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, places: np.ndarray) -> None:
        near = scores >= self.least[q] - SLACK
        if not near.all():
            scores, places = scores[near], places[near]
        scores = np.round(scores, 9)
        keep = (scores >= self.least[q]) & (scores > 0)
        if not keep.any():
            return
        s, p, k = np.concatenate((self.scores[q], scores[keep])), np.concatenate((self.places[q], places[keep])), self.k
        if len(s) >= k:
            self.least[q] = least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            s, p = s[keep], p[keep]
        self.scores[q], self.places[q] = s, p
        if len(s) > 4 * k:
            self.scores[q], self.places[q] = self.ordered(q)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, scores and places of the best, in order."""
        found = [(q, *self.ordered(q)) for q in range(len(self.scores)) if len(self.scores[q])]
        q = np.repeat([q for q, _, _ in found], [len(s) for _, s, _ in found]).astype(np.int64)
        return (q, *(np.concatenate(x) for x in list(zip(*found))[1:])) if found else (q, np.zeros(0), q)

    def ordered(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        names = self.name(self.places[q])
        order = sorted(range(len(names)), key=lambda i: (-self.scores[q][i], names[i]))[: self.k]
        return self.scores[q][order], self.places[q][order]


def _lexical(best: _Best, block: _Block, offset: int, names: pa.Array, asked: list[list[tuple[int, float]]]) -> None:
    """Scores of every chunk of a block that can be among the best of a question."""
    parts, total, spare, dense = block.parts(names), np.zeros(block.n), np.zeros(block.n), {}

    def row(t: int) -> np.ndarray | None:
        """What a frequent term adds to each chunk, none if it is rare or the place for such rows is full."""
        out = dense.get(t)
        if out is None and len(parts[t][0]) > block.n // 32 and (len(dense) + 1) * block.n <= KEPT:
            out = dense[t] = np.zeros(block.n)
            out[parts[t][0]] = parts[t][1]
        return out

    for q, terms in enumerate(asked):
        found = sorted((max(w, 0) * parts[t][2], t, w) for t, w in terms if parts[t] is not None)
        least = best.least[q]
        if not found or sum(x[0] for x in found) < least - SLACK:
            continue
        rest, first = 0.0, 0  # chunks that hold only the terms before the first cannot be among the best
        while rest + found[first][0] < least - SLACK:
            rest += found[first][0]
            first += 1
        size = 0
        for _, t, w in found[first:]:
            places, part, _ = parts[t]
            if len(places) > block.n // 16 and (each := row(t)) is not None:
                np.multiply(each, w, out=spare)
                np.add(total, spare, out=total)
            else:
                total[places] += w * part
            size += len(places)
        if size < block.n // 128:
            near = np.concatenate([parts[t][0] for _, t, _ in found[first:]])
            at = np.unique(near) if first < len(found) - 1 else near
            scores = total[at]
            total[near] = 0
        else:
            at = (total > (least - SLACK - rest if least else 0)).nonzero()[0]
            scores = total[at]
            total.fill(0)
        for step, (most, t, w) in enumerate(reversed(found[:first])):
            if len(at) > FEW and (step or size < block.n // 128):
                keep = (scores >= least - SLACK - rest).nonzero()[0]
                at, scores = at[keep], scores[keep]
            if not len(at):
                break
            places, part, _ = parts[t]
            if (each := row(t)) is not None:
                scores = scores + w * each[at]
            else:
                i = np.minimum(np.searchsorted(places, at), len(places) - 1)
                scores = scores + np.where(places[i] == at, w * part[i], 0)
            rest -= most
        if len(at):
            best.add(q, scores, at + offset)


def _dense(best: _Best, sums: np.ndarray, norm: np.ndarray, offset: int, asked: np.ndarray) -> None:
    single, questions = np.ascontiguousarray((sums * (1 / norm).astype(np.float32)[:, None]).T, np.float32), asked.astype(np.float32)
    slack = 2e-5  # of a product of unit vectors in single precision
    for s in range(0, len(asked), TILE):
        product = questions[s : s + TILE] @ single
        least = best.least[s : s + TILE]
        if (least == 0).any() and product.shape[1] > best.k:
            least = np.maximum(least, np.partition(product, -best.k, axis=1)[:, -best.k] - slack)
        q, at = np.divmod(np.flatnonzero(product >= np.maximum(least - slack, 0).astype(np.float32)[:, None]), product.shape[1])
        scores = np.einsum("ij,ij->i", asked[s + q], sums[at] / norm[at][:, None])
        for i, (a, b) in enumerate(zip(ends := np.searchsorted(q, np.arange(len(least))), [*ends[1:], len(q)])):
            if a < b:
                best.add(s + i, scores[a:b], at[a:b] + offset)


class _Many:
    """The best chunks so far of many questions at once: what ``_Best`` keeps, as rows in the order of questions and scores."""

    def __init__(self, n: int, k: int, name) -> None:
        self.n, self.k, self.name = n, k, name
        self.least = np.zeros(n)
        self.q, self.s, self.p = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        scores = np.round(scores, 9)
        keep = (scores >= self.least[q]) & (scores > 0)
        if not keep.any():
            return
        q, s, p = (np.concatenate(x) for x in ((self.q, q[keep]), (self.s, scores[keep]), (self.p, places[keep])))
        if s.max() < 2**43 / 1e9 and self.n < 2**19:
            order = np.argsort((q << 44) - np.rint(s * 1e9).astype(np.int64))
        else:
            order = np.lexsort((-s, q))
        q, s, p = q[order], s[order], p[order]
        first = np.searchsorted(q, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = s[first[full] + self.k - 1]
        keep = s >= self.least[q]
        self.q, self.s, self.p = q[keep], s[keep], p[keep]
        many = np.bincount(self.q, minlength=1) > 4 * self.k
        if many.any():
            rows = self._ordered(np.flatnonzero(many[self.q]))
            late = rows[_ranks(self.q[rows]) > self.k]
            self.q, self.s, self.p = (np.delete(x, late) for x in (self.q, self.s, self.p))

    def _ordered(self, rows: np.ndarray) -> np.ndarray:
        """Rows by question and score, ties in the order of their keys."""
        places, at = np.unique(self.p[rows], return_inverse=True)
        rank = np.empty(len(places), np.int64)
        rank[pc.sort_indices(pa.array(self.name(places), pa.string())).to_numpy()] = np.arange(len(places))
        return rows[np.lexsort((rank[at], -self.s[rows], self.q[rows]))]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, scores and places of the best, in order."""
        rows = self._ordered(np.arange(len(self.q)))
        rows = rows[_ranks(self.q[rows]) <= self.k]
        return self.q[rows], self.s[rows], self.p[rows]


class _Asked:
    """The weighted terms of many questions as arrays: distinct pairs of term and weight, and those of each question."""

    def __init__(self, names: pa.Array, asked: list[list[tuple[int, float]]]) -> None:
        self.names, self.counts = names, np.array([len(x) for x in asked])
        self.starts = np.cumsum(self.counts) - self.counts
        pairs: dict[tuple[int, float], int] = {}
        self.at = np.array([pairs.setdefault(x, len(pairs)) for own in asked for x in own], np.int64)
        self.term, self.w = np.array([t for t, _ in pairs], np.int64), np.array([w for _, w in pairs])
        self.own = [self.at[s : s + c].tolist() for s, c in zip(self.starts, self.counts)]
        self.below = np.zeros(len(asked), bool)  # with a weight below 0, so that bounds are no scores
        np.logical_or.at(self.below, np.repeat(np.arange(len(asked)), self.counts), self.w[self.at] < 0)


def _threshold(bounds: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least ``k`` of its entries reach, close to the k-th largest; 0 where rows are short."""
    rows, n = bounds.shape
    wide = n // 16
    if wide < 2 * k:
        return np.partition(bounds, n - k, axis=1)[:, n - k] if n >= k else np.zeros(rows, bounds.dtype)
    return np.partition(bounds[:, : 16 * wide].reshape(rows, 16, wide).max(axis=1), wide - k, axis=1)[:, wide - k]


def _nonzero(x: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of booleans of which few are true."""
    if (count := np.count_nonzero(x)) > FEW:
        return np.flatnonzero(x)
    packed, at, out = x.tobytes() if count else b"", -1, []
    for _ in range(count):
        out.append(at := packed.find(1, at + 1))
    return np.array(out, np.int64)


def _lexical_many(best: _Many, block: _Block, offset: int, asked: _Asked) -> None:
    """What ``_lexical`` does for many questions: sums of rounded-up whole numbers find the chunks whose scores are computed."""
    n, parts = block.n, block.parts(asked.names)
    most = np.array([max(w, 0.0) * parts[t][2] if parts[t] is not None else 0.0 for t, w in zip(asked.term, asked.w)])
    reach = np.bincount(np.repeat(np.arange(best.n), asked.counts), most[asked.at], minlength=best.n)
    if not reach.any():
        return
    scale = (65_000 - 2 * MOST_TERMS) / reach.max()
    wide = np.uint8 if block.tfs.max(initial=0) < 2**8 else np.int32
    found = [len(parts[t][0]) if parts[t] is not None else 0 for t in asked.term]
    room = ROWS // (n * (2 + np.dtype(wide).itemsize))
    frequent = [c for c in sorted(range(len(found)), key=lambda c: -found[c])[:room] if found[c] > n // 64]
    line = np.full(len(found), -1)
    line[frequent] = np.arange(len(frequent))
    rows, tfs = np.zeros((len(frequent), n), np.uint16), np.zeros((len(frequent), n), wide)
    ups: list = [None] * len(found)
    for c, (t, w) in enumerate(zip(asked.term, asked.w)):
        if found[c]:
            places, part, _ = parts[t]
            up = np.ceil(part * (max(w, 0.0) * scale)).astype(np.uint16)
            if line[c] >= 0:
                rows[line[c], places] = up
                s = block.starts[t]
                tfs[line[c], places] = block.tfs[s : s + len(places)]
                ups[c] = (rows[line[c]], None)
            else:
                ups[c] = (up, places)
    rare = [c for c in range(len(found)) if found[c] and line[c] < 0]
    keys = np.concatenate([np.zeros(0, np.int64), *[parts[asked.term[c]][0] + c * n for c in rare]])
    values = np.concatenate([np.zeros(0), *[parts[asked.term[c]][1] for c in rare]])

    def scores(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        counts = asked.counts[q]
        pair = np.repeat(np.arange(len(q)), counts)
        c = asked.at[np.arange(len(pair)) + np.repeat(asked.starts[q] - np.cumsum(counts) + counts, counts)]
        place, own = at[pair], line[c]
        out = np.zeros(len(c))
        often = np.flatnonzero(own >= 0)
        tf = tfs[own[often], place[often]]
        out[often] = tf / (tf + block.norm[place[often]])
        seldom = np.flatnonzero((own < 0) & some[c])
        if len(seldom):
            key = c[seldom] * n + place[seldom]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[seldom] = np.where(keys[i] == key, values[i], 0)
        return np.bincount(pair, out * asked.w[c], minlength=len(q))

    some = np.array(found) > 0
    total, over, waiting, held = np.zeros(n, np.uint16), np.zeros(n, bool), [], 0
    low = np.maximum(np.floor((best.least - SLACK) * scale), 1)

    def flush() -> None:
        nonlocal waiting, held
        if waiting:
            q, at = np.repeat([q for q, _ in waiting], [len(a) for _, a in waiting]), np.concatenate([a for _, a in waiting])
            got.append((q, scores(q, at), at + offset))
            keep = got[-1][1] >= best.least[q] - SLACK
            got[-1] = tuple(x[keep] for x in got[-1])
        waiting, held = [], 0

    got: list[tuple] = []
    for q in np.flatnonzero(reach > np.maximum(best.least - SLACK, 0)).tolist():
        own, least = asked.own[q], low[q]
        total.fill(0)
        for c in own:
            if (up := ups[c]) is not None:
                if up[1] is None:
                    np.add(total, up[0], out=total)
                else:
                    total[up[1]] += up[0]
        if best.least[q] == 0 and not asked.below[q]:
            least = max(1, int(_threshold(total[None], best.k)[0]) - len(own))
        np.greater_equal(total, np.uint16(min(least, 65_535)), out=over)
        at = _nonzero(over)
        if len(at):
            waiting.append((q, at))
            held += len(at)
            if held > 20_000:
                flush()
    flush()
    if got:
        best.add(*(np.concatenate(x) for x in zip(*got)))


def _dense_many(best: _Many, sums: np.ndarray, norm: np.ndarray, offset: int, asked: np.ndarray) -> None:
    """What ``_dense`` does for many questions, over pieces that stay in the cache."""
    n, slack, tile = len(norm), 2e-5, 256
    single, questions = np.ascontiguousarray((sums * (1 / norm).astype(np.float32)[:, None]).T, np.float32), asked.astype(np.float32)
    pieces = [np.ascontiguousarray(single[:, s : s + WIDE]) for s in range(0, n, WIDE)]
    space, over, whole = np.empty(tile * WIDE, np.float32), np.empty(tile * WIDE, bool), None
    got: list[tuple] = []
    for s in range(0, best.n, tile):
        own, least = questions[s : s + tile], best.least[s : s + tile] - slack
        if (least < 0).any() and n > best.k:
            whole = np.empty((tile, n), np.float32) if whole is None else whole
            least = np.maximum(least, _threshold(np.matmul(own, single, out=whole[: len(own)]), best.k) - 2 * slack)
        least = np.maximum(least, 1e-12).astype(np.float32)[:, None]
        found = []
        for j, piece in enumerate(pieces):
            shape = (len(own), piece.shape[1])
            product, reached = space[: shape[0] * shape[1]].reshape(shape), over[: shape[0] * shape[1]].reshape(shape)
            np.greater_equal(np.matmul(own, piece, out=product), least, out=reached)
            at = _nonzero(reached.reshape(-1))
            if len(at):
                q, at = np.divmod(at, shape[1])
                found.append((q + s, at + j * WIDE))
        if found:
            q, at = (np.concatenate(x) for x in zip(*found))
            for a in range(0, len(q), 65_536):
                qa, pa_ = q[a : a + 65_536], at[a : a + 65_536]
                scores = np.einsum("ij,ij->i", asked[qa], sums[pa_] / norm[pa_][:, None])
                keep = scores >= best.least[qa] - SLACK
                got.append((qa[keep], scores[keep], pa_[keep] + offset))
    if got:
        best.add(*(np.concatenate(x) for x in zip(*got)))


def _packed(questions: DataFrame, groups: int) -> DataFrame:
    """``group, questions``: groups of ``qid, question, terms`` (strategy, term, weight), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, GROUP_QUESTIONS):
                ids, texts, terms = (c.to_pylist() for c in batch.slice(s, GROUP_QUESTIONS).columns)
                by: dict[str | None, tuple[dict[str, int], list]] = {}
                for q, own in enumerate(terms):
                    for x in own or ():
                        names, asked = by.setdefault(x["strategy"], ({}, [[] for _ in ids]))
                        asked[q].append((names.setdefault(x["term"], len(names)), x["w"]))
                packed = pickle.dumps((ids, texts, {k: (list(names), asked) for k, (names, asked) in by.items()}))
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([packed], pa.binary())], names=["group", "questions"])

    return questions.repartition(groups, "qid").select("qid", "question", "terms").mapInArrow(run, "group string, questions binary")


class _Group:
    """A group of questions with the best chunks of each strategy so far."""

    def __init__(self, packed: bytes, k: int, name) -> None:
        self.ids, texts, self.lexical = pickle.loads(packed)
        self.lexical = {s: (pa.array(names, pa.string()), asked) for s, (names, asked) in self.lexical.items()}
        self.texts, self.k, self.name, self.best = texts, k, name, {}
        self.many = len(self.ids) >= MANY
        if self.many:  # a question with very many terms would make the bounds of all others coarse
            self.asked = {s: _Asked(*x) for s, x in self.lexical.items() if max(map(len, x[1])) <= MOST_TERMS}
        self._vectors: np.ndarray | None = None

    def vectors(self) -> np.ndarray:
        if self._vectors is None:
            self._vectors = np.array([rt.hashed_vector(t) for t in self.texts])
        return self._vectors

    def of(self, strategy: str | None, arm: int) -> _Best | _Many:
        if (strategy, arm) not in self.best:
            many = self.many and (arm == DENSE or strategy in self.asked)
            self.best[strategy, arm] = (_Many if many else _Best)(len(self.ids), self.k, self.name)
        return self.best[strategy, arm]

    def add_lexical(self, strategy: str | None, block: _Block, offset: int) -> None:
        best = self.of(strategy, LEXICAL)
        if isinstance(best, _Many):
            _lexical_many(best, block, offset, self.asked[strategy])
        else:
            _lexical(best, block, offset, *self.lexical[strategy])

    def add_dense(self, strategy: str | None, sums: np.ndarray, norm: np.ndarray, offset: int) -> None:
        best = self.of(strategy, DENSE)
        (_dense_many if isinstance(best, _Many) else _dense)(best, sums, norm, offset, self.vectors())


def _ranks(q: np.ndarray) -> np.ndarray:
    """Ranks within each question, of rows in the order of questions."""
    return np.arange(len(q)) - np.searchsorted(q, q) + 1


def _fused(arms: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], mode: str, pool: int, k: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``retrieval.fused`` makes of the arms of one strategy: questions, places and ranks. ``unit``: a number of each chunk's document and citation."""
    if mode == "hybrid":
        q, places = (np.concatenate([arms[a][i] for a in (DENSE, LEXICAL)]) for i in (0, 2))
        arm, rank = np.repeat((DENSE, LEXICAL), [len(arms[a][0]) for a in (DENSE, LEXICAL)]), np.concatenate([_ranks(arms[a][0]) for a in (DENSE, LEXICAL)])
        _, first, at = np.unique(q * (len(unit) + 1) + places, return_index=True, return_inverse=True)  # the first arm comes first
        score = np.round(np.bincount(at, 1 / (rt.RRF_K + rank), minlength=len(first)), 9)
        order = np.lexsort((rank[first], arm[first], -score, q[first]))
        q, places = q[first][order], places[first][order]
        keep = _ranks(q) <= pool
        q, places = q[keep], places[keep]
    else:
        q, _, places = arms[DENSE if mode == "dense" else LEXICAL]
    first = np.sort(np.unique(q * (unit.max(initial=0) + 1) + unit[places], return_index=True)[1])
    q, places = q[first], places[first]
    rank = _ranks(q)
    keep = rank <= k
    return q[keep], places[keep], rank[keep]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, arms: tuple[int, ...], modes: tuple[str, ...] = (), cited: int = 0) -> DataFrame:
    """Search over the blocks in a folder, which is deleted: ``qid, strategy, arm, chunk_id, doc_id, unit, cite, score, rank`` of the best ``k`` chunks with a positive score per question, strategy and arm.

    With ``modes``: ``mode, qid, strategy, chunk_id, doc_id, rank``, the first ``cited`` cited hits of each mode.
    """
    blocks = spark.read.parquet(path)
    sizes = {r.strategy: (r.n, r.dl) for r in blocks.groupBy("strategy").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()}  # a row per strategy
    avgdl, total = {s: dl / n for s, (n, dl) in sizes.items()}, sum(n for n, _ in sizes.values())
    asked = queries.select("qid", "question")
    if LEXICAL in arms:
        n = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(float(x))) for s, (x, _) in sizes.items() if s is not None], F.lit(0.0))
        df = blocks.filter("strategy is not null").select("strategy", F.explode(F.arrays_zip("terms", "counts")).alias("z")).groupBy("strategy", F.col("z.terms").alias("term")).agg(F.sum("z.counts").alias("df"))
        raw = rt.cut(df.select("strategy", "term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
        mean = {r.strategy: r.mean for r in raw.groupBy("strategy").agg(F.avg("raw").alias("mean")).collect()}  # a row per strategy
        low = F.coalesce(*[F.when(F.col("strategy") == s, F.lit(rt.NEGATIVE_IDF * m)) for s, m in mean.items()], F.lit(0.0))
        own = asked.select("qid", F.explode(tx.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
        weight = F.when(F.col("raw") < 0, low).otherwise(F.col("raw")) * F.col("qtf") * (rt.K1 + 1)
        own = own.join(raw, "term").groupBy("qid").agg(F.collect_list(F.struct("strategy", "term", weight.alias("w"))).alias("terms"))
        asked = asked.join(own, "qid", "left")
    else:
        asked = asked.withColumn("terms", F.lit(None).cast("array<struct<strategy:string,term:string,w:double>>"))
    number, parts = queries.count(), max(1, round(total / GROUP_CHUNKS))
    groups = max(1, min(number, max(-(-number // GROUP_QUESTIONS), -(-spark.sparkContext.defaultParallelism // parts))))
    pairs = blocks.drop("n", "dl").coalesce(parts).hint("shuffle_replicate_nl").crossJoin(rt.cut(_packed(asked, groups)))  # blocks are streamed, a group of questions is held
    fuse = modes if parts == 1 else ()  # a task has seen all chunks
    qid, doc = queries.schema["qid"].dataType.simpleString(), blocks.schema["doc_id"].dataType.elementType.simpleString()
    kinds = f"mode string, qid {qid}, strategy string, chunk_id string, doc_id {doc}, rank int" if fuse else f"qid {qid}, strategy string, arm int, chunk_id string, doc_id {doc}, unit string, cite string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets: dict[str, int] = {}
        kept: dict[str, list[pa.Array]] = {c: [] for c in META}
        whole: dict[str, pa.ChunkedArray] = {}
        groups: dict[str, _Group] = {}
        state: dict = {"end": 0, "id": None}

        def column(c: str) -> pa.Array:
            if c not in whole or len(whole[c]) < state["end"]:
                whole[c] = pa.chunked_array(kept[c])
            return whole[c]

        name = lambda places: column("chunk_id").take(pa.array(places)).to_pylist()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                strategy, key = row["strategy"].as_py(), row["block"].as_py()
                if (g := row["group"].as_py()) not in groups:
                    groups[g] = _Group(row["questions"].as_py(), k, name)
                if key not in offsets:
                    offsets[key] = state["end"]
                    state["end"] += len(row["chunk_id"])
                    for c in META:
                        kept[c].append(pa.concat_arrays([row[c].values, row[c].values[:0]]))  # a copy, so that the batch can go
                if state["id"] != key:
                    state |= {"id": key, "block": _Block(row, avgdl[strategy]), "v": None}
                if LEXICAL in arms and strategy in groups[g].lexical:
                    groups[g].add_lexical(strategy, state["block"], offsets[key])
                if DENSE in arms:
                    if state["v"] is None:
                        state["v"] = state["block"].vectors()
                    groups[g].add_dense(strategy, *state["v"], offsets[key])
        if fuse and groups:
            codes = [pc.dictionary_encode(pa.chunked_array(kept[c])).combine_chunks() for c in ("doc_id", "unit")]
            codes = [(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for c in codes]
            unit = codes[0] * (codes[1].max(initial=0) + 1) + codes[1]
            unit = np.unique(unit, return_inverse=True)[1]
        for group in groups.values():
            ids = pa.array(group.ids)
            rows = {key: best.rows() for key, best in group.best.items()}
            none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            if fuse:
                for strategy in {s for s, _ in rows}:
                    for mode in fuse:
                        q, places, rank = _fused({arm: rows.get((strategy, arm), none) for arm in (DENSE, LEXICAL)}, mode, k, cited, unit)
                        for s in range(0, len(q), 20_000):
                            at = pa.array(places[s : s + 20_000])
                            rest = [column(c).take(at).combine_chunks() for c in ("chunk_id", "doc_id")]
                            yield pa.RecordBatch.from_arrays([pa.array([mode] * len(at)), ids.take(pa.array(q[s : s + 20_000])), pa.array([strategy] * len(at), pa.string()), *rest, pa.array(rank[s : s + 20_000].astype(np.int32))], names=["mode", "qid", "strategy", "chunk_id", "doc_id", "rank"])
                continue
            for (strategy, arm), (q, scores, places) in rows.items():
                for s in range(0, len(q), 20_000):
                    at = pa.array(places[s : s + 20_000])
                    rest = [column(c).take(at).combine_chunks() for c in META]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[s : s + 20_000])), pa.array([strategy] * len(at), pa.string()), pa.array([arm] * len(at), pa.int32()), *rest, pa.array(scores[s : s + 20_000])], names=["qid", "strategy", "arm", *META, "score"])

    found = pairs.mapInArrow(run, kinds)
    if not fuse:
        found = rt.top(found, ["qid", "strategy", "arm"], k, [F.desc("score"), F.asc("chunk_id")])
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "4")  # rows are blocks: a batch of them must fit the memory beside the heap
        found = rt.cut(found)
    finally:
        spark.conf.set(BATCH, before)
        discard(spark, path)
    return found if fuse or not modes else reduce(DataFrame.unionByName, [rt.fused(found, m, cited, k).select(F.lit(m).alias("mode"), "qid", "strategy", "chunk_id", "doc_id", "rank") for m in modes])
