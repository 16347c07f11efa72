import random
import re

import numpy as np
import pytest

from actmill.llm import neardup as nd

W = re.compile(r"\w+")


def sets(t, k):
    w = W.findall(t.lower())
    return set(zip(*(w[j:] for j in range(k))))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"fjala{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(n)]
    texts = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        c = list(b)
        for _ in range(rng.randrange(1, 6)):
            c[rng.randrange(len(c))] = rng.choice(words)
        texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("exact", [False, True])
def test_all_pairs_above_the_threshold(spark, exact):
    texts = corpus(1, 60)
    rows = [(f"k{i:03d}", t, "x") for i, t in enumerate(texts)]
    got = {(r.key_a, r.key_b) for r in nd.near_duplicates(spark.createDataFrame(rows, "key string, text string, id string"), 3, 0.5, exact=exact).collect()}
    s = [sets(t, 3) for t in texts]
    want = {(rows[i][0], rows[j][0]) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) >= 0.5 * len(s[i] | s[j])}
    assert got <= want and len(want - got) <= (0 if exact else 0.03) * len(want) and len(want) > 20


def test_copies_nulls_short_texts_and_repeated_rows(spark):
    t = "një dy tre katër pesë gjashtë shtatë tetë"
    rows = [("a", t), ("b", t), ("b", t), ("c", t + " nëntë"), ("d", None), ("e", ""), ("f", "një"), ("g", "një"), ("h", "!!"), ("i", "!!")]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {(r.key_a, r.key_b) for r in nd.near_duplicates(df, 3, 0.5).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert nd.near_duplicates(df.limit(0), 3, 0.5).count() == 0


def test_large_classes_keep_all_links(spark):
    t = "një dy tre katër pesë gjashtë shtatë tetë"
    n = nd.EXPANDED + 5
    rows = [(f"a{i:02d}", t) for i in range(n)] + [(f"b{i:02d}", t + " nëntë") for i in range(n)] + [("z", t + " dhjetë"), ("q", "krejt tjetër gjë nga këto")]
    c = nd.Classes(spark.createDataFrame(rows, "key string, text string"), 3, 0.5)
    got = {(r.key_a, r.key_b) for r in c.pairs().collect()}
    inside = {(f"{x}00", f"{x}{i:02d}") for x in "ab" for i in range(1, n)}
    across = {("a00", f"b{i:02d}") for i in range(n)} | {(f"a{i:02d}", "b00") for i in range(n)} | {(f"{x}{i:02d}", "z") for x in "ab" for i in range(n)}
    assert got == inside | across
    assert {(r.class_a, r.class_b) for r in c.links().collect()} == {("a00", "b00"), ("a00", "z"), ("b00", "z")}
    members = {r.key: (r.class_id, r.n_copies, r.n_links) for r in c.members().collect()}
    assert members["a07"] == ("a00", n, 2 * n) and members["z"] == ("z", 1, 2 * n) and members["q"] == ("q", 1, 0) and len(members) == len(rows)


def test_bands_of_many_texts_leave_in_blocks(spark):
    """More different texts than GROUP that share all their bands."""
    t = " ".join(f"fjala{i}" for i in range(80))
    rows = [(f"k{i:03d}", f"{t} fund{i}") for i in range(nd.GROUP + 20)]
    got = {(r.key_a, r.key_b) for r in nd.near_duplicates(spark.createDataFrame(rows, "key string, text string"), 3, 0.5).collect()}
    assert len(got) == len(rows) * (len(rows) - 1) // 2


def test_signature_estimates_similarity():
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(30, 130))
    h, n = nd.features([a, b, "", None], 1)
    s = nd.signatures(h, n, 1000)
    assert abs((s[0] == s[1]).mean() - 70 / 130) < 0.06 and n.tolist() == [100, 100, 0, 0] and (s[2] == nd.UNIVERSE).all()


def test_features_stay_inside_their_text():
    h, n = nd.features(["a b c d", "x", "", "a b c"], 3)
    assert n.tolist() == [2, 0, 0, 1] and h[0] == h[2] and len(np.unique(h)) == 2
