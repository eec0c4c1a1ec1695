import random

from speciesbridge.operators.copies import copy_differences

SCHEMA = "k bigint, a string, b string, left string, note string"
FIELDS = ["a", "b"]


def brute(left, right):
    def held(side):
        out = {}
        for r in side:
            out.setdefault(r[0], set()).add((r[1], r[2]))
        return out

    x, y, out = held(left), held(right), set()
    for k in x.keys() | y.keys():
        if k not in y:
            out.add((k, "only_left"))
        elif k not in x:
            out.add((k, "only_right"))
        else:
            out |= {(k, f) for i, f in enumerate(FIELDS) if {v[i] for v in x[k]} != {v[i] for v in y[k]}}
    return out


def test_differences_by_brute_force(spark, rows):
    rng = random.Random(1)
    value = lambda: rng.choice([None, "", "x", "X", "x ", "é", "é", "y" * 5000])
    left = [(rng.randrange(60), value(), value(), "l", None) for _ in range(80)]
    right = [(r[0], *(v if rng.random() < 0.8 else value() for v in r[1:3]), "r", "other") for r in left if rng.random() < 0.9]
    right += [(rng.randrange(90), value(), value(), "r", None) for _ in range(20)] + right[:10]
    got = copy_differences(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "k", FIELDS)
    assert set(rows(got)) == brute(left, right)


def test_null_keys_delivered_twice_and_other_columns(spark, rows):
    a = spark.createDataFrame([(None, "x", None, "1", "n"), (1, None, "", "1", "n")], SCHEMA)
    b = spark.createDataFrame([(None, "x", None, "2", "m"), (1, None, "", "2", "m"), (1, None, "", "3", "k")], SCHEMA)
    assert rows(copy_differences(a, b, "k", FIELDS)) == []


def test_empty_sides(spark, rows):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "x", "y", "", "")], SCHEMA)
    assert rows(copy_differences(empty, one, "k", FIELDS, "old", "new")) == [(1, "only_new")]
    assert rows(copy_differences(one, empty, "k", FIELDS, "old", "new")) == [(1, "only_old")]
    assert rows(copy_differences(empty, empty, "k", FIELDS)) == []


def test_hot_key(spark, rows):
    """One key holding most rows is no row of the result more than once per field."""
    a = spark.range(5000).selectExpr("7L as k", "cast(id as string) as a", "'b' as b")
    b = spark.range(5000).selectExpr("7L as k", "cast(id + 1 as string) as a", "'b' as b")
    assert rows(copy_differences(a, b, "k", FIELDS)) == [(7, "a")]
