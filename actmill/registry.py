"""The named queries of the core library and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actmill.functions import restoration, text
from actmill.operators import acts, evaluation, obligations, references, retrieval, segments
from actmill.plans import answers, index
from actmill.sources import corpus
from actmill.streaming import limits

MODULES = [text, restoration, references, segments, retrieval, acts, obligations, evaluation, corpus, limits, index, answers]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["search_bm25"](spark, "/root/testdata/sf0.001")
