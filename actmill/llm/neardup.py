"""Near-duplicate records with small edits (problem 2).

Circulant MinHash: one permutation spreads the hashed features of a text over a universe, a second one, circularly shifted
by k, gives coordinate k of the signature; successive coordinates make bands of a few rows.  Texts that share a band are
candidates, a sketch of signature bits drops those that cannot be similar enough, and the exact Jaccard similarity of the
feature sets decides.

Exact copies are one class: the identity of a text is its hash, so copies meet as one entry and never as pairs.  Bands
travel as packed arrays, one blob per batch and part of the key space, with copies inside a batch already dropped, and each
part is sorted on its own; pairs leave a part in blocks.

At similarity s a pair is a candidate with probability 1 - (1 - s**rows)**bands: with 80 bands of 5 rows 0.92 at 0.5, 0.9985
at 0.6 and 0.99997 at 0.7, with 96 bands of 12 rows 0.9989 at 0.8; the sketch keeps all but 1 in 1000 of the pairs at the
threshold.  Before the texts of candidates are joined, a bitmap of fixed size drops the texts that cannot be one.

Where no pair may be missed, ``exact=True`` takes the candidates from the rarest features instead: two texts that reach the
threshold share one of the first ``n - ceil(threshold * n) + 1`` of each.  That is exact and shuffles every feature.

A band that very many different texts share leaves its part as blocks of ids, which other tasks pair.

Defined results: texts that are null or have no feature have no near-duplicates; shorter texts than a shingle have no
shingle; repeated rows count once.  Copies of one text are near-duplicates of each other and form a class, named by its
smallest key.  ``members`` gives each key its class and its number of links, ``links`` the classes that are near-duplicates
of each other; both hold every link.  ``near_duplicates`` writes them out in pairs of keys: a class of up to ``EXPANDED``
members in all pairs, with each other and with other texts; a larger one as pairs of its smallest key with every other member,
and a link of it to another text as pairs of every member with the smallest key of the other.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.words import likely
from actmill.session import cut, release, table

#: Rows of a band and number of bands, for long texts and for short ones that share most of their words anyway.
LONG, SHORT = (5, 80), (12, 96)
COORDINATES = max(r * b for r, b in (LONG, SHORT))
#: Size of the universe that features are hashed into, a power of two.
UNIVERSE = 1 << 20
#: Coordinates whose lowest bit makes the sketch, and how many deviations below its expected agreement a pair may fall.
SKETCH, DEVIATIONS = 256, 3.1
#: Members up to which a class of copies is written out in pairs; larger ones are given by members and links.
EXPANDED = 20
#: Texts of a band up to which its part pairs them at once, and ids of a block of larger bands.
GROUP, IDS = 64, 1000
#: Band keys that one part of the key space should hold; a part is sorted in one task.
PART = 4_000_000
#: Texts per batch of the signature, and pairs per block that leaves a part.
BATCH, BLOCK = 8192, 100_000
SEED = 20240131

_WORD = re.compile(r"\w+")
_STATE: dict[str, object] = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and windows of the shifted one: row i holds coordinates 0, 1, ... of position i."""
    if "windows" not in _STATE:
        rng = np.random.default_rng(SEED)
        first = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([second, second[:COORDINATES]])
        _STATE["first"] = first
        _STATE["windows"] = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)
    return _STATE["first"], _STATE["windows"]  # type: ignore[return-value]


class _Hashes(dict):
    """Word -> 64-bit hash, kept per worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


_HASHES = _Hashes()


def features(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``shingle``-word sequences of all texts, one after the other, and how many each text has; repeated ones stay."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))
    mixed = np.zeros(max(len(flat) - shingle + 1, 0), dtype=np.uint64)
    for j in range(shingle):
        mixed = (mixed ^ flat[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    counts = np.maximum(sizes - shingle + 1, 0)
    if shingle > 1 and len(mixed):  # sequences do not run from one text into the next
        inside = np.ones(len(flat), dtype=bool)
        ends = np.cumsum(sizes)
        for j in range(1, shingle):
            last = ends - j
            inside[last[last >= ends - sizes]] = False
        mixed = mixed[inside[: len(mixed)]]
    return mixed, counts


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant signatures, a row per text; texts without features have the largest value everywhere."""
    first, windows = _permutations()
    places = first[(hashes >> np.uint64(20)).astype(np.int64) & (UNIVERSE - 1)]
    out = np.full((len(counts), coordinates), UNIVERSE, dtype=np.int32)
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            windows[places[at : at + n], :coordinates].min(axis=0, out=out[i])
            at += n
    return out


def _key(text: Column) -> Column:
    """Identity of a text."""
    return F.xxhash64(text)


def _bands(texts: DataFrame, shingle: int, rows: int, bands: int, parts: int) -> DataFrame:
    """``part, blob``: packed band keys (4 bytes each) in the order of their texts, the text ids (8 bytes each), and the keys per text (1 byte each)."""
    rng = np.random.default_rng(SEED + 1)
    weights = (rng.integers(1, 1 << 62, rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, first = np.unique(ids, return_index=True)
                column = piece.column(1).take(pa.array(first)).to_pylist()
                hashes, counts = features(column, shingle)
                full = counts > 0
                sig = signatures(hashes, counts, bands * rows)[full].astype(np.uint64)
                keys = (sig.reshape(-1, bands, rows) * weights).sum(axis=2, dtype=np.uint64) ^ salt
                keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                keys = (keys ^ (keys >> np.uint64(32))).ravel()
                ids = ids[full]
                who = np.repeat(np.arange(len(ids)), bands)
                part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
                low = (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                who, out, begin = who[order], [], 0
                for p, end in enumerate(ends):
                    if end > begin:
                        per = np.bincount(who[begin:end], minlength=len(ids))
                        used = np.flatnonzero(per)
                        head = np.array([end - begin, len(used)], np.uint32)
                        out.append((p, head.tobytes() + low[begin:end].tobytes() + ids[used].tobytes() + per[used].astype(np.uint8).tobytes()))
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["part", "blob"])

    return texts.mapInArrow(run, "part int, blob binary")


def _candidates(bands: DataFrame) -> DataFrame:
    """``a, b`` with a < b: pairs of different texts that share a band key, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, who = [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                n, m = np.frombuffer(blob, dtype=np.uint32, count=2).tolist()
                keys.append(np.frombuffer(blob, dtype=np.uint32, count=n, offset=8))
                per = np.frombuffer(blob, dtype=np.uint8, count=m, offset=8 + 4 * n + 8 * m)
                who.append(np.repeat(np.frombuffer(blob, dtype=np.int64, count=m, offset=8 + 4 * n), per))
        if not keys:
            return
        key, ids = np.concatenate(keys), np.concatenate(who)
        del keys, who
        order = np.argsort(key, kind="stable")
        key, ids = key[order], ids[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        left, right, held = [], [], 0

        def rows(cross: bool, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cross] * len(pairs)), *[pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1)]], names=["across", "xs", "ys"])

        for n in np.unique(size[size > 1]).tolist():  # groups of one size at once
            starts = edge[:-1][size == n]
            if n <= GROUP:
                group = ids[starts[:, None] + np.arange(n)]
                for i in range(n - 1):
                    a = np.repeat(group[:, i], n - 1 - i)
                    b = group[:, i + 1 :].ravel()
                    left.append(np.minimum(a, b))
                    right.append(np.maximum(a, b))
                    held += len(a)
                    if held > BLOCK:
                        yield rows(False, [_unique(left, right)])
                        left, right, held = [], [], 0
            else:
                for s in starts.tolist():
                    group = np.unique(ids[s : s + n])
                    blocks = [group[i : i + IDS] for i in range(0, len(group), IDS)]
                    for i, x in enumerate(blocks):
                        yield rows(True, [(x, y) for y in blocks[i:]])
        if left:
            yield rows(False, [_unique(left, right)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cross, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                if cross:
                    a, b = np.repeat(a, len(b)), np.tile(b, len(a))
                    a, b = a[a < b], b[a < b]  # blocks are in order
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    blocks = bands.groupBy("part").applyInArrow(run, "across boolean, xs binary, ys binary")
    return blocks.repartition(F.xxhash64("xs", "ys")).mapInArrow(pairs, "a long, b long").distinct()


def _unique(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different texts, once each."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _exact_candidates(texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``a, b`` with a < b: pairs of different texts that share one of their rarest features and are long enough, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = features(batch.column(1).to_pylist(), shingle)
            parts = [np.unique(h) for h in np.split(hashes.astype(np.int64), np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int64()))], names=["id", "fs"])

    sets = cut(texts.mapInArrow(run, "id long, fs array<long>").dropDuplicates(["id"]))
    flat = sets.select("id", F.size("fs").alias("n"), F.explode("fs").alias("f"))
    rarity = flat.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(rarity, "f").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "f"))).alias("o"))  # features of one text
    first = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    posted = cut(ordered.select("id", "n", F.explode(first).alias("o")).filter("o.df > 1").select("id", "n", F.col("o.f").alias("f")))
    x, y = posted.select(F.col("id").alias("a"), F.col("n").alias("na"), "f"), posted.select(F.col("id").alias("b"), F.col("n").alias("nb"), "f")
    long_enough = (F.col("nb") >= threshold * F.col("na") - 1e-9) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    return x.join(y, "f").filter((F.col("a") < F.col("b")) & long_enough).select("a", "b").distinct()


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """``id, sketch``: the lowest bits of the first coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                hashes, counts = features(piece.column(1).to_pylist(), shingle)
                bits = np.packbits((signatures(hashes, counts, SKETCH) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(np.ascontiguousarray(bits[:, j])) for j in range(SKETCH // 64)]], names=["id", *[f"s{j}" for j in range(SKETCH // 64)]])

    words = ", ".join(f"s{j} long" for j in range(SKETCH // 64))
    return texts.mapInArrow(run, f"id long, {words}")


def _verify(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs ``a, b, text_a, text_b`` that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep, found = [], []
            sets: dict[int, frozenset] = {}
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            texts = [batch.column(2).to_pylist(), batch.column(3).to_pylist()]
            for side in (0, 1):
                for i, t in zip(ids[side], texts[side]):
                    if i not in sets:
                        w = _WORD.findall(t.lower())
                        sets[i] = frozenset(zip(*(w[j:] for j in range(shingle))))
            for i in range(n):
                x, y = sets[ids[0][i]], sets[ids[1][i]]
                both = len(x & y)
                of = len(x) + len(y) - both
                if of and both >= threshold * of - 1e-12:
                    keep.append(i)
                    found.append(both / of)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _sketched(texts: DataFrame, shingle: int, threshold: float, shape: tuple[int, int], parts: int | None) -> DataFrame:
    """``a, b`` of the texts that share a band and whose sketches do not tell them apart."""
    parts = parts or max(4, -(-texts.count() * shape[1] // PART))
    pairs = cut(_candidates(_bands(texts, shingle, *shape, parts)))
    release(texts.sparkSession)
    asked = _ids(pairs)
    sketch = _sketches(likely(texts, F.col("id"), asked), shingle).dropDuplicates(["id"])
    names = [f"s{j}" for j in range(SKETCH // 64)]
    a = sketch.select(F.col("id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in names])
    b = sketch.select(F.col("id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in names])
    differ = sum(F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in names)
    expected = SKETCH * (1 - threshold) / 2
    most = expected + DEVIATIONS * (SKETCH * (1 - threshold) / 2 * (1 + threshold) / 2) ** 0.5
    return cut(pairs.join(a, "a").join(b, "b").filter(differ <= most).select("a", "b"))


def similar_texts(items: DataFrame, shingle: int, threshold: float, shape: tuple[int, int] = LONG, parts: int | None = None, exact: bool = False) -> DataFrame:
    """``a, b, similarity``: different texts, by the hash of each, whose distinct shingles have at least ``threshold`` in common."""
    texts = items.filter("text is not null").select(_key(F.col("text")).alias("id"), "text")
    maybe = cut(_exact_candidates(texts, shingle, threshold)) if exact else _sketched(texts, shingle, threshold, shape, parts)
    release(texts.sparkSession)
    needed = _ids(maybe)
    stored = likely(texts, F.col("id"), needed).join(needed, "id", "left_semi").dropDuplicates(["id"])
    full = maybe.join(stored.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(stored.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return _verify(full, shingle, threshold)


class Classes:
    """Classes of copies and the links between them, of ``key, text``."""

    def __init__(self, items: DataFrame, shingle: int, threshold: float, shape: tuple[int, int] = LONG, exact: bool = False) -> None:
        rows = items.filter("text is not null").select("key", "text").filter(F.col("text").rlike(rf"(?U)\w+(?:\W+\w+){{{shingle - 1}}}"))
        self.keys = rows.select(_key(F.col("text")).alias("id"), "key").distinct()
        self.heads = self.keys.groupBy("id").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n"))
        self.found = cut(similar_texts(rows, shingle, threshold, shape, exact=exact))

    def links(self) -> DataFrame:
        """``class_a, class_b, similarity``: near-duplicate classes, the smaller name first."""
        h = self.heads.select("id", "head")
        d = self.found.join(h.select(F.col("id").alias("a"), F.col("head").alias("x")), "a").join(h.select(F.col("id").alias("b"), F.col("head").alias("y")), "b")
        return d.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")

    def members(self) -> DataFrame:
        """``key, class_id, n_copies, n_links``: every text that has a feature, and how many keys are near-duplicates of it."""
        both = self.found.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("l")).select("l.*")
        sizes = self.heads.select(F.col("id").alias("other"), F.col("n").alias("more"))
        further = both.join(sizes, "other").groupBy("id").agg(F.sum("more").alias("more"))
        d = self.keys.join(self.heads, "id").join(further, "id", "left")
        return d.select("key", F.col("head").alias("class_id"), F.col("n").alias("n_copies"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))

    def pairs(self) -> DataFrame:
        """``key_a, key_b`` with key_a < key_b; large classes through their smallest keys."""
        copies = cut(self.keys.join(self.heads.filter("n > 1"), "id"))  # copies only
        star = copies.filter(F.col("key") != F.col("head")).select(F.col("head").alias("key_a"), F.col("key").alias("key_b"))
        small = copies.filter(F.col("n") <= EXPANDED)
        inner = small.alias("x").join(small.alias("y"), "id").filter(F.col("x.key") < F.col("y.key")).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
        wanted = self.found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        linked = cut(self.keys.join(wanted, "id", "left_semi").join(self.heads, "id"))
        few, large = linked.filter((F.col("n") <= EXPANDED) | (F.col("key") == F.col("head"))), linked.filter(F.col("n") > EXPANDED)
        first = linked.filter(F.col("key") == F.col("head"))

        def across(x: DataFrame, y: DataFrame) -> DataFrame:
            d = self.found.join(x.select(F.col("id").alias("a"), F.col("key").alias("k1")), "a").join(y.select(F.col("id").alias("b"), F.col("key").alias("k2")), "b")
            return d.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))

        every = across(few, few).unionByName(across(large, first)).unionByName(across(first, large))
        return star.unionByName(inner).unionByName(every).distinct()


def near_duplicates(items: DataFrame, shingle: int, threshold: float, shape: tuple[int, int] = LONG, exact: bool = False) -> DataFrame:
    """``key_a, key_b`` with key_a < key_b of the near-duplicates among ``key, text``."""
    return Classes(items, shingle, threshold, shape, exact).pairs()


def _sets(spark, root: str):
    chunks = table(spark, root, "chunks").select(F.col("chunk_id").alias("key"), "text")
    acts = table(spark, root, "acts").select(F.col("doc_id").cast("string").alias("key"), F.col("subject").alias("text"))
    return (("chunk", chunks, 3, 0.5, LONG), ("act", acts, 1, 0.8, SHORT))


def _each(spark, root: str, part) -> DataFrame:
    parts = [part(Classes(items, shingle, threshold, shape)).select(F.lit(kind).alias("item_kind"), "*") for kind, items, shingle, threshold, shape in _sets(spark, root)]
    return parts[0].unionByName(parts[1])


def p2_found(spark, root: str) -> DataFrame:
    return _each(spark, root, Classes.pairs)


def p2_members(spark, root: str) -> DataFrame:
    """Class of copies and number of links of every chunk and act."""
    return _each(spark, root, Classes.members)


def p2_links(spark, root: str) -> DataFrame:
    """Pairs of classes that are near-duplicates, with their similarity."""
    return _each(spark, root, Classes.links)


QUERIES = {"p2_found": p2_found, "p2_members": p2_members, "p2_links": p2_links}
ORACLES: dict[str, str] = {}
