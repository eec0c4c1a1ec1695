import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from speciesbridge.llm import layout as L

SCHEMA = "map_id bigint, x string, y string, first_id string"


def key(x, y):
    canon = lambda s: "".join(c for c in (s or "").casefold() if unicodedata.category(c)[0] in "LNM")
    return tuple(sorted((canon(x), canon(y))))


def brute(rows):
    groups = {}
    for i, x, y, *_ in rows:
        if i is not None and any(key(x, y)):
            groups.setdefault(key(x, y), []).append(i)
    return sorted(((min(v), i) for v in groups.values() for i in v if i != min(v)), key=repr)


def data(seed, n=300):
    rng = random.Random(seed)
    words = ["Abc", "aBC", "a-b c!", "ábc", "ábc", "", None, "  ", "123", "1 2 3", "Ωμ", "ωΜ", "x" * 3000, "X" * 3000, "_", "ς", "Σ"]
    return [(i, rng.choice(words), rng.choice(words), "clash") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_copies_by_brute_force(spark, rows, seed):
    d = data(seed) + [(None, "Abc", "Abc", "")]
    assert rows(L.layout_copies(spark.createDataFrame(d, SCHEMA), "map_id", ["x", "y"])) == brute(d)


def test_empty_and_single(spark, rows):
    assert rows(L.layout_copies(spark.createDataFrame([], SCHEMA), "map_id", ["x", "y"])) == []
    assert rows(L.layout_copies(spark.createDataFrame([(1, "a", None, ""), (2, None, None, ""), (3, "", " ", "")], SCHEMA), "map_id", ["x", "y"])) == []
    assert rows(L.layout_copies(spark.createDataFrame([(1, "a", None, ""), (2, None, "A.", "")], SCHEMA), "map_id", ["x", "y"])) == [(1, 2)]


def test_colliding_hashes_are_told_apart(spark, rows, monkeypatch):
    """With a hash that is the same for all, the comparison alone has to find the records."""

    def weak(fields, number=0):
        from pyspark.sql import functions as F

        return F.struct(F.array(*[F.lit(0).cast("bigint") for _ in fields]).alias("k"), F.length(F.regexp_replace(F.concat_ws("", *fields), r"[^\p{L}\p{N}\p{M}]", "")).cast("bigint").alias("n"))

    monkeypatch.setattr(L, "_hashed", weak)
    d = [(i, w, None, "") for i, w in enumerate(["one", "ONE", "two", "t-wo", "three", "o.n.e", "two", ""])]
    assert rows(L.layout_copies(spark.createDataFrame(d, SCHEMA), "map_id", ["x", "y"])) == brute(d)


def test_hot_group_is_salted(spark, rows, monkeypatch):
    monkeypatch.setattr("speciesbridge.runtime.HOT_ROWS", 20)
    d = [(i, "Hot name" if i % 3 else "hot_NAME", "b", "") for i in range(200)] + [(1000 + i, f"n{i // 2}", "c", "") for i in range(50)]
    assert rows(L.layout_copies(spark.createDataFrame(d, SCHEMA), "map_id", ["x", "y"])) == brute(d)


def test_records_and_counts(spark, rows):
    d = [(1, "a b", "c", "q"), (2, "C", "A.B", "r"), (3, None, "", "s"), (4, "z", None, "t"), (None, "z", None, "u")]
    got = L.layout_records(spark.createDataFrame(d, SCHEMA), "map_id", ["x", "y"])
    assert rows(got, "map_id", "first_id", "n_copies") == sorted([(1, "q", 2), (3, "s", None), (4, "t", 1), (None, "u", 1)], key=repr)


def test_hash_is_of_what_counts():
    h, n = L.field_hashes(pa.array(["Ab-c", "aB C", "abd", None, ""]))
    assert h[0] == h[1] != h[2] and n.tolist() == [3, 3, 3, 0, 0]
    own, other = L.Folded(pa.array(["A-b", "ab", "", "Ωé𝘗!", None])), L.Folded(pa.array(["ab!!", "abc", "--", "ω é ­𝘗", ""]))
    every = np.arange(5)
    assert L.same_but_layout(own, every, other, every).tolist() == [True, False, True, True, True]
    assert L.same_but_layout(own, np.array([3, 1]), other, np.array([0, 0])).tolist() == [False, True]


@pytest.mark.parametrize("seed", range(2))
def test_bytes_give_the_code_points(seed):
    rng = random.Random(seed)
    values = ["".join(chr(rng.choice([65, 97, 233, 0x3A9, 0x4E2D, 0xFF21, 0x1D4D0, 0x200B, 32])) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    folded, table = L.Folded(pa.array(values)), L.fold_table()
    want = [[int(table[ord(c)]) for c in v if table[ord(c)]] for v in values]
    got = [folded.value[i:j][folded.value[i:j] > 0].tolist() for i, j in zip(folded.at, folded.at[1:])]
    assert got == want and folded.sizes.tolist() == list(map(len, want))
    for number in range(3):
        for f, h in zip(want, folded.hashes(number)):
            out = 0
            for prime, base in zip(L.PRIMES, L.bases(number)):
                value = 0
                for x in f:
                    value = (value * base + x) % prime
                out = out << 31 | value
            assert out == h


def test_equal_hashes_within_a_row(monkeypatch):
    monkeypatch.setattr(L.Folded, "hashes", lambda self, number=0: self.sizes * 0)
    own = [L.Folded(pa.array(["a", "b", "a"])), L.Folded(pa.array(["b", "a", "a"]))]
    other = [L.Folded(pa.array(["B", "b", "a"])), L.Folded(pa.array(["A!", "a", "b"]))]
    assert L.same_records(own, other).tolist() == [True, True, False]


def test_keys_given_twice(spark, rows):
    d = [(1, "alpha", "beta", ""), (1, "gamma", "delta", ""), (2, "ALPHA", "beta", ""), (3, "GAMMA", "delta", ""), (4, "alpha!", "beta", "")]
    run = lambda d: rows(L.layout_copies(spark.createDataFrame(d, SCHEMA), "map_id", ["x", "y"]))
    assert run(d) == [(1, 2), (1, 3), (1, 4)]
    assert run([(1, "a", "b", ""), (1, "a", "b", ""), (1, "B", "a", "")]) == []
