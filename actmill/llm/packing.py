"""Filling fixed-capacity containers with items (problem 9).

Items of one size are interchangeable, so the plan is made on the histogram of sizes, which has at most as many rows
as the capacity however many items there are, and the items find their container by their rank within their size.

Large items, above a third of the capacity, pair at most twice per container: the largest open one takes the largest
other that still fits, greedily from above.  Smaller items, largest first, go to the tightest gap that holds them and
stay there until it holds no more; a new container is opened only where no gap is left.  An item longer than the
capacity fills whole containers and its rest is packed like any other item, so only such items are split.

Defined results: an item of size 0 or null takes no space and joins the first container of its kind, or container 0
if all are empty.  Repeated ids are separate items.  No rows give no rows; a kind whose capacity is null or below 1 is left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.llm.tokens import encode
from actmill.session import cut, table

#: Parts into which the items of one size are split for ranking, against sizes that hold a large share of all items.
SALTS = 32


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(size, first_rank, last_rank, first_container, per_container)`` and the number of containers."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    groups: list[tuple[dict[int, int], int]] = []  # items by size, number of such containers
    gaps: dict[int, list[int]] = defaultdict(list)  # gap -> groups
    order: list[int] = []  # gaps in use, ascending

    def put(items: dict[int, int], n: int) -> None:
        gap = capacity - sum(s * k for s, k in items.items())
        groups.append((items, n))
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap].append(len(groups) - 1)

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        n = left[s]
        at = bisect_left(large, capacity - s + 1) - 1  # largest partner that fits
        if at < 0:
            put({s: 1}, n)
            large.pop()
            continue
        other = large[at]
        if other == s:
            if n > 1:
                put({s: 2}, n // 2)
            if n % 2:
                left[s] = 1
                if at > 0:
                    other, n = large[at - 1], 1
                else:
                    put({s: 1}, 1)
                    large.pop()
                    continue
            else:
                large.pop()
                continue
        k = min(n, left[other])
        put({s: 1, other: 1}, k)
        left[s] = n - k
        left[other] -= k
        if not left[other]:
            large.remove(other)
        if not left[s]:
            large.remove(s)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                if n >= each:
                    put({s: each}, n // each)
                if n % each:
                    put({s: n % each}, 1)
                break
            gap = order[at]
            items, m = groups[(i := gaps[gap].pop())]
            if not gaps[gap]:
                order.pop(at)
            each = gap // s
            whole = min(m, n // each)
            rest = n - whole * each if whole < m else 0
            groups[i] = ({}, 0)
            if whole:
                put({**items, s: each}, whole)
            if rest:
                put({**items, s: rest}, 1)
            if m - whole - bool(rest):
                put(items, m - whole - bool(rest))
            n -= whole * each + rest

    rows, ranks, containers = [], defaultdict(int), 0
    for items, n in groups:
        for s, k in items.items():
            rows.append((s, ranks[s], ranks[s] + n * k - 1, containers, k))
            ranks[s] += n * k
        containers += n
    return rows, containers


def pack(sizes: DataFrame, kinds: DataFrame, key: str = "doc_id") -> DataFrame:
    """``container_kind, container_no, key, piece_no, n_tokens``: one row per item, or per piece of one longer than the capacity.

    ``sizes`` has ``key`` and ``n_tokens``; ``kinds`` has ``container_kind`` and ``capacity``.  For a capacity c the histogram
    on the driver has at most c rows.  A size adds at most three groups of containers to the plan, and a group holds at most
    sqrt(2c) different sizes, so that the plan has at most 3c * sqrt(2c) rows however many items there are; it is joined by
    size, and sent whole only where Spark finds it small enough.
    """
    spark = sizes.sparkSession
    kinds = kinds.select("container_kind", "capacity").filter("capacity >= 1").distinct()
    cap, n = F.col("capacity"), F.coalesce(F.col("n_tokens"), F.lit(0))
    whole = F.floor(F.greatest(n - 1, F.lit(0)) / cap).cast("int")
    pieces = sizes.select(key, "n_tokens").crossJoin(F.broadcast(kinds)).select(  # a row per kind: their number is fixed
        "container_kind", "capacity", key, n.alias("n"), F.explode(F.sequence(F.lit(0), whole)).alias("piece_no"))
    pieces = pieces.withColumn("size", F.least(cap, F.col("n") - F.col("piece_no") * cap).cast("int")).drop("n")
    counts = pieces.groupBy("container_kind", "capacity", "size").count().collect()
    by_kind: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in counts:
        by_kind[(r.container_kind, r.capacity)][r["size"]] = r["count"]
    rows = []
    for (kind, capacity), histogram in sorted(by_kind.items()):
        rows += [(kind, *row) for row in plan(histogram, capacity)[0]]
    slots = spark.createDataFrame(rows, "k string, s int, lo long, hi long, base long, per int")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(SALTS)))
    part = ["container_kind", "size", "salt"]
    local = salted.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy(key, "piece_no")))
    before = Window.partitionBy("container_kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*part).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = local.join(offsets, part).withColumn("rank", F.col("before") + F.col("r") - 1)
    at = (F.col("container_kind") == F.col("k")) & (F.col("size") == F.col("s")) & F.col("rank").between(F.col("lo"), F.col("hi"))
    placed = ranked.join(slots, at, "left")
    number = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    return placed.select("container_kind", number.cast("long").alias("container_no"), key, "piece_no", F.col("size").alias("n_tokens"))


def _packed(spark, root: str) -> DataFrame:
    sizes = cut(encode(table(spark, root, "documents"), "doc_id", "text", lengths=True))
    return pack(sizes, table(spark, root, "containers"))


def p9_containers(spark, root: str) -> DataFrame:
    """Every document, or piece of one, with its container, for each capacity."""
    return _packed(spark, root)


def p9_fill(spark, root: str) -> DataFrame:
    """Per kind: containers, tokens, share filled, and the least number of containers that the tokens need."""
    used = _packed(spark, root).groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("used"))
    kinds = table(spark, root, "containers").distinct()
    total = used.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    cap = F.col("n_containers") * F.col("capacity")
    return total.join(kinds, "container_kind").select("container_kind", "capacity", "n_containers", "n_tokens", "fullest", (F.col("n_tokens") / cap).alias("filled"), F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least"))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLES: dict[str, str] = {}
