import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from actmill.llm import packing as pk


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), max_size=40))
def test_every_item_once_and_no_container_too_full(h):
    rows, n = pk.plan(h, 100)
    used, seen, large = defaultdict(int), Counter(), Counter()
    for size, lo, hi, base, per in rows:
        seen[size] += hi - lo + 1
        for r in range(lo, hi + 1):
            used[base + (r - lo) // per] += size
            large[base + (r - lo) // per] += 3 * size > 100
    assert seen == Counter(h) and all(u <= 100 for u in used.values()) and len(used) == n and max(large.values(), default=0) <= 2
    assert n <= 2 * sum(s * c for s, c in h.items()) / 100 + 2


def test_tables(spark):
    sizes = spark.createDataFrame([(1, 0), (2, None), (3, 25), (4, 10), (5, 10), (5, 10), (6, 7), (7, 3)], "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("a", 10), ("a", 10), ("b", None), ("c", 0)], "container_kind string, capacity int")
    r = pk.pack(sizes, kinds).collect()
    assert {x.container_kind for x in r} == {"a"} and len(r) == 10
    full = Counter()
    for x in r:
        full[x.container_no] += x.n_tokens
    assert max(full.values()) <= 10 and sum(full.values()) == 65 and len(full) == 7
    assert sorted(x.n_tokens for x in r if x.doc_id == 3) == [5, 10, 10]
    assert pk.pack(sizes.limit(0), kinds).count() == 0


def test_hot_size(spark):
    sizes = spark.range(3000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 40, 20) as int) as n_tokens")
    kinds = spark.createDataFrame([("k", 100)], "container_kind string, capacity int")
    r = pk.pack(sizes, kinds).groupBy("container_no").agg({"n_tokens": "sum"}).collect()
    assert max(x[1] for x in r) <= 100 and len(r) <= 1.02 * 80000 / 100 + 1


def test_the_plan_is_bounded_by_the_capacity():
    rng = random.Random(11)
    for c in (64, 512, 2048):
        for scale in (3, 1000, 10**7):
            rows, _ = pk.plan({s: rng.randrange(1, scale) for s in range(1, c + 1)}, c)
            assert len(rows) <= 3 * c * (2 * c) ** 0.5
