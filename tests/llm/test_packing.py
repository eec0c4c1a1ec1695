import random

import numpy as np
import pytest

from speciesbridge.llm.packing import fill, first_fit_decreasing, pack


def slow(sizes, capacity):
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, out = [], [0] * len(sizes)
    for i in order:
        at = next((k for k, room in enumerate(bins) if room >= sizes[i]), None)
        if at is None:
            bins.append(capacity)
            at = len(bins) - 1
        bins[at] -= sizes[i]
        out[i] = at
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.choice([1, 2, 3, 64, 257]))]
    assert first_fit_decreasing(np.array(sizes), 50).tolist() == slow(sizes, 50)


def check(rows, sizes, capacity):
    room = {}
    for r in rows:
        assert 0 < r["item_end"] - r["item_start"] <= capacity
        room[r["container"]] = room.get(r["container"], 0) + r["item_end"] - r["item_start"]
    assert max(room.values(), default=0) <= capacity
    pieces = {}
    for r in rows:
        pieces.setdefault(r["k"], []).append((r["item_start"], r["item_end"]))
    for k, n in sizes.items():
        if n and n > 0:
            got = sorted(pieces.pop(k))
            assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:]))
            assert len(got) == 1 or n > capacity
    assert not pieces
    return room


@pytest.mark.parametrize("group", [20_000, 40])
def test_pack(spark, group):
    rng = random.Random(2)
    sizes = {i: rng.choice([None, 0, -3, 100, 101, *range(1, 99), 1000]) for i in range(400)} | {None: 7}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "k bigint, n int, container string")
    room = check(pack(df, "k", "n", 100, group).collect(), sizes, 100)
    total = sum(n for n in sizes.values() if n and n > 0)
    assert len(room) <= total / 100 * 1.1 + 400 / group + 2
    a, b = (sorted(map(tuple, pack(d, "k", "n", 100, group).collect()), key=repr) for d in (df, df.repartition(7)))
    assert a == b


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 60)] * 5 + [(2, 250)] * 2, "k bigint, n int")
    rows = pack(df, "k", "n", 100).collect()
    assert len(rows) == 5 + 6
    room = {}
    for r in rows:
        room[r["container"]] = room.get(r["container"], 0) + r["item_end"] - r["item_start"]
    assert max(room.values()) <= 100
    assert pack(df.limit(0), "k", "n", 100).collect() == []


def test_hot_item_is_dealt_over_groups(spark):
    df = spark.createDataFrame([(7, 30)] * 500 + [(i, 70) for i in range(1000, 1100)], "k bigint, n int")
    got = pack(df, "k", "n", 100, 50)
    rows = got.collect()
    assert sum(r["k"] == 7 for r in rows) == 500 and len(rows) == 600
    assert len({r["container"].split("-")[0] for r in rows if r["k"] == 7}) == 12
    one = fill(got, 100).first()
    assert one["n_used"] == 22_000 and one["n_least"] == 220 <= one["n_containers"] <= 250
    assert tuple(fill(got.limit(0), 100).first()) == (0, 0, 0)
