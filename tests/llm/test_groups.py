import random

import pytest
from pyspark.sql import functions as F

from speciesbridge.llm import groups
from speciesbridge.llm.groups import linked_groups, linking_rows

SCHEMA = "a string, b string, group_name string"


def brute(pairs):
    up = {}

    def find(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for a, b, *_ in pairs:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    groups = {}
    for n in up:
        groups.setdefault(find(n), []).append(n)
    order = lambda n: n.encode()
    return sorted(((min(g, key=order), n) for g in groups.values() for n in g if n != min(g, key=order)), key=repr)


@pytest.mark.parametrize("seed,few", [(0, 3), (1, 10), (2, 10**6)])
def test_groups_by_union_find(spark, rows, monkeypatch, seed, few):
    monkeypatch.setattr(groups, "FEW", few)
    rng = random.Random(seed)
    names = [None, "", "Å", "a", "𝘗", "ﬁ", *[f"n{i:03}" for i in range(150)]]
    pairs = [(rng.choice(names), rng.choice(names), "x") for _ in range(110)]
    assert rows(linked_groups(spark.createDataFrame(pairs, SCHEMA), "a", "b")) == brute(pairs)


def test_long_chain(spark, rows, monkeypatch):
    monkeypatch.setattr(groups, "FEW", 30)
    rng = random.Random(9)
    names = [f"c{i:04}" for i in range(400)]
    rng.shuffle(names)
    pairs = [(a, b, None) for a, b in zip(names, names[1:])]
    assert rows(linked_groups(spark.createDataFrame(pairs, SCHEMA), "a", "b")) == brute(pairs)


def test_hot_hub_is_salted(spark, rows, monkeypatch):
    monkeypatch.setattr("speciesbridge.runtime.HOT_ROWS", 20)
    monkeypatch.setattr(groups, "FEW", 5)
    pairs = [("hub" if i % 2 else f"m{i:04}", f"m{i + 1:04}", None) for i in range(0, 200)] + [("hub", f"z{i}", None) for i in range(60)]
    assert rows(linked_groups(spark.createDataFrame(pairs, SCHEMA), "a", "b")) == brute(pairs)


def test_nothing_to_link(spark, rows):
    assert rows(linked_groups(spark.createDataFrame([], SCHEMA), "a", "b")) == []
    assert rows(linked_groups(spark.createDataFrame([("a", "a", ""), (None, "b", ""), ("c", None, "")], SCHEMA), "a", "b")) == []


def test_names_in_a_row(spark, rows, monkeypatch):
    monkeypatch.setattr(groups, "FEW", 50)
    pairs = [(f"k{i:03}", f"k{i + 1:03}", "") for i in range(300)]
    assert rows(linked_groups(spark.createDataFrame(pairs, SCHEMA), "a", "b")) == brute(pairs)


def test_numbers_that_collide_are_drawn_again(spark, rows, monkeypatch):
    real = groups._number
    monkeypatch.setattr(groups, "_number", lambda name, seed: F.length(name).cast("bigint") if seed < 2 else real(name, seed))
    pairs = [("a", "b", ""), ("c", "d", ""), ("d", "e", "")]
    assert rows(linked_groups(spark.createDataFrame(pairs, SCHEMA), "a", "b")) == brute(pairs)


def test_types_that_link(spark, rows):
    df = spark.createDataFrame([(t,) for t in ["1BL to 1BT", " 1bl  TO\t1bt ", "Many BL to 1BT", "1BL to many BT", "1BL to many BT", "Extinct", None, "", "Many BL to many BT"]], "t string")
    assert len(rows(linking_rows(df, "t"))) == 5
