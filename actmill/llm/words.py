"""Counts of distinct words of the whole corpus."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap of ``likely``.
BITMAP = 1 << 24
#: Distinct words a task holds before it hands its partial counts on; only memory depends on it.
HELD = 300_000


def word_counts(df: DataFrame, pattern: str, lower: bool = False, keep: str | None = None, clean: Callable[[str], str] | None = None) -> DataFrame:
    """``word, n`` over every string column of ``df``: the matches of ``pattern`` that also contain ``keep``, in texts after ``clean``.

    Each task counts its own rows first, so that a frequent word crosses the shuffle once a task.
    """
    find = re.compile(pattern).findall
    wanted = re.compile(keep).search if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in held if wanted(w)] if wanted else list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for column in batch.columns:
                for t in column.to_pylist():
                    if t and clean:
                        t = clean(t)
                    if t:
                        held.update(find(t.lower() if lower else t))
            if len(held) >= HELD:
                yield out()
                held.clear()
        yield out()

    return df.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weighted_counts(df: DataFrame, pattern: str, lower: bool = False, keep: str | None = None, clean: Callable[[str], str] | None = None) -> DataFrame:
    """``word, n, n_rows`` over the texts of ``df``, a text and the number of rows that hold it: matches in the texts, and in all their rows."""
    find = re.compile(pattern).findall
    wanted = re.compile(keep).search if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        more: Counter[str] = Counter()  # occurrences in the further rows of texts stored several times

        def out() -> pa.RecordBatch:
            words = [w for w in held if wanted(w)] if wanted else list(held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64()), pa.array([held[w] + more[w] for w in words], pa.int64())], names=["word", "n", "n_rows"])

        for batch in batches:
            for t, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and clean:
                    t = clean(t)
                if not t:
                    continue
                words = find(t.lower() if lower else t)
                held.update(words)
                if rows > 1:
                    for w in words:
                        more[w] += rows - 1
            if len(held) >= HELD:
                yield out()
                held.clear()
                more.clear()
        yield out()

    return df.mapInArrow(run, "word string, n long, n_rows long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def likely(rows: DataFrame, key: Column, needed: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key``, a long, is not among the longs of ``needed``.

    A bitmap of BITMAP bits, of that size whatever the number of rows, is all that is sent; a join with ``needed`` must follow.
    """
    place = F.pmod(F.col(needed.columns[0]), F.lit(BITMAP)) + 1  # positions count from 1
    bits = needed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.pmod(key, F.lit(BITMAP)) + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(at) == F.col("__bucket")).filter(F.getbit(byte, bit % 8) == 1).select(*rows.columns)
