import random

import pytest

from speciesbridge.functions.schema import MAPPING
from speciesbridge.operators import mapping as M
from speciesbridge.operators.crosswalk import crosswalk_overrides, crosswalk_supplement
from speciesbridge.operators.merge import apply_to_data, assemble, merge

NINE = MAPPING.fieldNames()


def row(x, y, kind="exact", resolved=None, in_x=True, in_y=True, note=""):
    return (x, y, resolved, kind, 1.0 if in_x and in_y else None, "s", in_x, in_y, note)


def open_x(x):
    return row(x, None, "unresolved", in_y=False)


def open_y(y):
    return row(None, y, "unresolved", in_x=False)


def sequential(mapping, batch):
    """The corrections one by one on a list, as they are meant."""
    rows = [list(r) for r in mapping]
    for x, y, action, note in batch:
        if x is None:
            continue
        if action != "reject":
            rows = [r for r in rows if r[0] != x]
            rows = [r for r in rows if not (r[1] == y and r[3] == "unresolved" and not r[6])]
            rows.append([x, y, None, "manual", 1.0, "user_override", True, True, note])
        else:
            mine = [r for r in rows if r[0] == x]
            if mine:
                r, old = mine[0], mine[0][1]
                r[1], r[3], r[4], r[5], r[7], r[8] = None, "unresolved", None, None, False, f"Rejected: {note}"
                if old is not None and all(q[1] != old for q in rows):
                    rows.append([None, old, None, "unresolved", None, None, False, True, "Re-added after rejection"])
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(12))
def test_batch_is_the_sequential_fold(spark, rows, seed):
    rng = random.Random(seed)
    xs, ys = list("abcdef"), list("pqrst")
    mapping = [row(rng.choice(xs), rng.choice(ys)) for _ in range(7)] + [open_x(rng.choice(xs)) for _ in range(2)] + [open_y(rng.choice(ys)) for _ in range(3)]
    # rows that are open though they name an x
    mapping = [row(rng.choice(xs), rng.choice(ys), "unresolved", in_x=False) for _ in range(seed % 4)] + mapping
    batch = [(rng.choice([*xs, "new", None]), rng.choice(ys), rng.choice(["accept", "reject", "replace"]), f"n{i}") for i in range(12)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(mapping)], "o int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MAPPING))
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(batch)], "pos int, name_x string, name_y string, action string, note string")
    assert rows(M.override_batch(df, b, "pos", ["o"]).select(*NINE)) == sequential(mapping, batch)


def test_batch_errors_and_defaults(spark, rows):
    m = spark.createDataFrame([row("a", "p"), open_y("q")], MAPPING)
    make = lambda r, s: spark.createDataFrame([r], s)
    with pytest.raises(ValueError):
        M.override_batch(m, make((0, "a", "q", "perhaps"), "pos int, name_x string, name_y string, action string"), "pos")
    with pytest.raises(ValueError):
        M.override_batch(m, make((0, "a"), "pos int, name_x string"), "pos")
    got = M.override_batch(m, make((0, "a", "q"), "pos int, name_x string, name_y string"), "pos")
    assert rows(got, "name_x", "name_y", "match_type") == [("a", "q", "manual")]
    assert rows(M.override_batch(m, make((0, "a", "q"), "pos int, name_x string, name_y string").limit(0), "pos").select(*NINE)) == rows(m)


def test_override_is_logged(spark, rows):
    rec = M.override(M.Reconciliation(spark.createDataFrame([row("a", "p")], MAPPING)), "a", action="reject", note="no")
    assert rows(rec.overrides.drop("timestamp")) == [("a", None, "reject", "no")] and rec.overrides.first()["timestamp"] is not None
    assert rows(rec.mapping, "name_x", "name_y", "match_type") == [("a", None, "unresolved"), (None, "p", "unresolved")]
    assert "coverage 0.0 %" in str(rec)


def test_counts_and_types(spark):
    m = spark.createDataFrame([row("a", "p"), row("b", "q", "flagged"), row("c", "r", None), open_x("d"), open_y("s"), (None,) * 9], MAPPING)
    c = M.counts(m).first()
    assert (c["n_x"], c["n_y"], c["n_exact"], c["n_flagged"], c["n_unresolved_x"], c["n_unresolved_y"], c["n_augmented"]) == (4, 4, 1, 1, 1, 1, 0)
    assert M.coverage(m).first()["coverage"] == 0.25 and M.coverage(m.limit(0)).first()["coverage"] is None
    with pytest.raises(ValueError):
        M.Reconciliation(m.drop("notes"))
    with pytest.raises(TypeError):
        M.Reconciliation(m.withColumn("in_x", m.match_score))


def test_diff(spark, rows):
    a = spark.createDataFrame([row("a", "p"), open_x("b"), row("c", "q"), row("d", "r"), row("e", "s", "flagged"), open_y("t")], MAPPING)
    b = spark.createDataFrame([open_x("a"), row("b", "t", "fuzzy"), row("c", "q", "manual"), row("d", "z"), row("e", "s", "synonym"), row("only", "u")], MAPPING)
    d = M.diff(a, b)
    assert rows(d.gained, "name_x", "name_y_new") == [("b", "t"), ("e", "s")] and rows(d.lost, "name_x") == [("a",)]
    assert rows(d.type_changed, "name_x") == [("c",)] and rows(d.target_changed) == [("d", "r", "z")]
    assert tuple(d.summary.first()) == (2, 1, 1, 1, 5, 0)
    same = M.diff(a, a)
    assert all(not rows(t) for t in (same.gained, same.lost, same.type_changed, same.target_changed, same.unused_overrides_diff))
    back = M.diff(b, a)
    assert rows(back.lost, "name_x") == rows(d.gained, "name_x") and rows(back.gained, "name_x") == rows(d.lost, "name_x")
    u = spark.createDataFrame([("a", None, "r"), ("b", "c", "s")], "name_x string, name_y string, reason string")
    assert rows(M.diff(a, a, unused_a=u, unused_b=u.limit(1)).unused_overrides_diff) == [("b", "c", "s", "x")]


def test_splits_and_lumps(spark, rows):
    syn = lambda x, y, n: row(x, y, "synonym", n)
    m = spark.createDataFrame([syn("a", "p", "N"), syn("a", "q", "N"), syn("b", "r", "O"), syn("c", "r", "O"), syn("d", "s", "P"), syn("e", "t", "P"), syn("f", "u", "Q"), row("g", "v", "exact", "Q"), syn(None, "w", "R"), syn("h", None, None)], MAPPING)
    assert rows(M.splits_lumps(m), "name_resolved", "n_x", "n_y", "type") == [("N", 1, 2, "split"), ("O", 2, 1, "lump"), ("P", 2, 2, "split_lump")]


@pytest.mark.parametrize("how,n", [("inner", 3), ("left", 6), ("full", 8)])
def test_merge_counts(spark, rows, how, n):
    m = spark.createDataFrame([row("a", "p", "synonym", "N"), row("b", "q", "flagged"), row("b", "z"), open_x("c")], MAPPING)
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5), ("nowhere", 6)], "sp string, v int")
    y = spark.createDataFrame([("p", 10), ("q", 20), ("w", 30), (None, 40)], "sp string, v int")
    out = merge(m, x, y, "sp", "sp", how)
    assert out.columns[0] == "species_resolved" and out.columns[1:] == ["sp_x", "v_x", "sp_y", "v_y"] and len(rows(out)) == n
    assert rows(out.where("species_resolved is not null"), "species_resolved", "v_x", "v_y") == [("N", 1, 10), ("N", 2, 10), ("q", 3, 20)]
    assert len(rows(merge(m, x, y, "sp", "sp", how, drop_unresolved=True))) == 3
    assert len(rows(merge(m, x.limit(0), y, "sp", "sp", how))) == (4 if how == "full" else 0)
    with pytest.raises(ValueError):
        merge(m, x, y, "sp", "sp", "right")


def test_apply_and_assemble(spark, rows):
    m = spark.createDataFrame([row("a", "p", "synonym", "N"), row("b", "q"), open_x("c")], MAPPING)
    x = spark.createDataFrame([("a", 1.0), ("c", 2.0), (None, 3.0)], "species string, mass double")
    assert rows(apply_to_data(m, x, "species", True)) == [("a", 1.0)] and len(rows(apply_to_data(m, x, "species"))) == 3
    got = rows(assemble({"one": x, "two": spark.createDataFrame([("a", 4.0, 7.0), ("b", None, 1.0)], "species string, mass double, len double")}, m, ["mass", "len"]))
    assert got == [("N", 2, 2, "one; two", 2.5, 7.0), ("q", 1, 1, "two", None, 1.0)]


def test_crosswalk(spark, rows):
    cw = spark.createDataFrame([("a", "p", "1BL to 1BT", "x"), ("b", "q", "Many BL to 1BT", ""), ("c", "c", "1BL to 1BT", None), (None, "r", None, None), ("", "r", None, None), ("d", "s", None, None), ("e", "p", "1bl TO 1bt", None)], "f string, t string, k string, n string")
    assert rows(crosswalk_overrides(cw, "f", "t", "k", "n")) == [("a", "p", "crosswalk [1BL to 1BT]: x"), ("b", "q", "crosswalk [Many BL to 1BT]"), ("d", "s", "crosswalk [NA]"), ("e", "p", "crosswalk [1bl TO 1bt]")]
    one = crosswalk_overrides(cw, "f", "t", "k", None, True)
    assert rows(one, "name_x") == [("a",), ("e",)] and len(rows(crosswalk_overrides(cw, "f", "t", one_to_one_only=True))) == 4
    m = spark.createDataFrame([open_x("A"), open_x("B"), open_y("Q"), open_y("P"), row("Z", "Y")], MAPPING)
    done, audit = crosswalk_supplement(m, crosswalk_overrides(cw, "f", "t"))
    assert rows(done, "name_x", "name_y", "match_type") == rows(spark.createDataFrame([("A", "P", "manual"), ("B", "Q", "manual"), ("Z", "Y", "exact")], "a string, b string, c string"))
    assert audit.first().asDict() == {"n_crosswalk_rows": 4, "n_unresolved_x": 2, "n_unresolved_y": 2, "n_available": 2, "n_applied": 2, "n_ambiguous": 0}


@pytest.mark.parametrize(("how", "drop", "suffix"), [("inner", False, ("_x", "_y")), ("left", False, ("_x", "_y")), ("full", False, ("_x", "_y")), ("full", True, ("_x", "_y")), ("left", False, (".a", ".b"))])
def test_merge_spreads_what_a_key_gives(spark, rows, monkeypatch, how, drop, suffix):
    m = spark.createDataFrame([row("a", "a"), row("b", "b"), row("c", "c"), row("d", "d"), open_x("u")], MAPPING)
    sx, sy = ["a"] * 40 + ["b"] * 3 + ["c", "u", None, "zz"], ["a"] * 25 + ["b"] * 9 + ["d", "d", None, "yy"]
    x = spark.createDataFrame([(i // 2, s) for i, s in enumerate(sx)], "i int, sp string")
    y = spark.createDataFrame([(i, s) for i, s in enumerate(sy)], "i int, sp string")
    key = lambda s: s if s in set("abcd") else None
    want = [(key(p), i // 2, p, j, q) for i, p in enumerate(sx) for j, q in enumerate(sy) if key(p) and key(p) == key(q)]
    if how != "inner":
        want += [(key(p), i // 2, p, None, None) for i, p in enumerate(sx) if p not in ("a", "b")]
    if how == "full":
        want += [(key(q), None, None, j, q) for j, q in enumerate(sy) if q not in ("a", "b")]
    want = sorted((w for w in want if w[0] or not drop), key=repr)
    monkeypatch.setattr("speciesbridge.operators.merge.SHARE_ROWS", 20)
    out = merge(m, x, y, "sp", "sp", how, suffix, drop)
    assert out.columns == ["species_resolved", *[c + s for s in suffix for c in ("i", "sp")]]
    assert rows(out) == want
    parts = out.where("species_resolved = 'a'").rdd.glom().map(len).collect()
    assert sum(parts) == 1000 and sum(n > 0 for n in parts) > 5


@pytest.mark.parametrize(("how", "drop", "suffix"), [("inner", False, ("_x", "_y")), ("full", False, ("_x", "_y")), ("left", False, ("_x", "_y")), ("full", True, ("_x", "_y")), ("left", False, (".a", ".b"))])
def test_what_a_merge_gives_takes_little_disk(spark, rows, tmp_path, monkeypatch, how, drop, suffix):
    m = spark.createDataFrame([row("a", "a"), row("b", "b"), open_x("u")], MAPPING)
    number = lambda n, other: spark.range(n).selectExpr("id as v", f"if(id % 10 = 9, if(id % 20 = 9, '{other}', null), 'a') as sp")
    x, y = number(800, "b"), number(5000, "yy")
    monkeypatch.setattr("speciesbridge.operators.merge.SHARE_ROWS", 1_000_000)
    out = merge(m, x, y, "sp", "sp", how, suffix, drop)
    out.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    n = 720 * 4500 + (40 if drop else {"inner": 0, "left": 80, "full": 580}[how])
    v, w = (f"`v{s}`" for s in suffix)
    assert back.count() == n and back.where(f"{v} is not null and {w} is not null").select(v, w).distinct().count() == 720 * 4500
    size = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet"))
    assert size < 0.8 * n, size / n
