import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stammwerk.llm import components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: find(k) for k in parent}


def groups(spark, pairs, small=0):
    """small=0: no graph is finished in one task."""
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, key string")
    return {r.key: r.group for r in components.connected_groups(df, "a", "b", small).collect()}


CASES = {
    "empty": [],
    "odd": [(None, "a"), ("", "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e"), ("e", "ä")],
    "chain": [(f"{i:03}", f"{i + 1:03}") for i in range(200)],
    "star": [("hub", f"s{i}") for i in range(300)] + [("s7", "z")],
    "random": [(f"v{random.Random(i).randint(0, 150)}", f"v{random.Random(-i - 1).randint(0, 150)}") for i in range(110)],
}


@pytest.mark.parametrize("small", [0, 200, 100_000])
@pytest.mark.parametrize("name", CASES)
def test_like_union_find(spark, name, small):
    assert groups(spark, CASES[name], small) == union_find(CASES[name])


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 20)
    pairs = CASES["star"] + CASES["chain"] + CASES["random"]
    assert groups(spark, pairs) == union_find(pairs)


@given(st.lists(st.tuples(st.sampled_from("abcdefghij"), st.sampled_from("abcdefghij")), max_size=8))
@settings(max_examples=5, deadline=None)
def test_small_graphs(spark, pairs):
    assert groups(spark, pairs, 100_000) == union_find(pairs)


def test_one_giant_group(spark):
    """A third of all rows at one hub and a long chain behind it: one group, named by its smallest key."""
    pairs = [("hub", f"s{i:05}") for i in range(30_000)] + [(f"c{i:04}", f"c{i + 1:04}") for i in range(3000)] + [("c3000", "hub")] + [(f"x{i}", f"y{i}") for i in range(30_000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = components.connected_groups(df, "a", "b").groupBy("group").count()
    assert found.filter("count > 2").collect()[0].asDict() == {"group": "c0000", "count": 33_002} and found.count() == 30_001


def test_material_key(spark):
    df = spark.createDataFrame([(" 12 ",), ("000000000000000012",), ("HX-1 ",), ("",), (None,), ("1234567890123456789",), ("12\n",)], "k string")
    assert [r[0] for r in df.select(components.material_key(F.col("k"))).collect()] == ["0" * 16 + "12", "0" * 16 + "12", "HX-1", "", None, "1234567890123456789", "12\n"]
