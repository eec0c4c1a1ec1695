import random

import pytest
from pyspark.sql import functions as F

from speciesbridge.functions.relational import first_rows
from speciesbridge.functions.schema import MAPPING
from speciesbridge.operators import fuzzy
from speciesbridge.operators.cascade import cascade, unused_counts
from speciesbridge.operators.fuzzy import genus_pairs, suggestions
from speciesbridge.operators.greedy import greedy_matching
from speciesbridge.operators.reconcile import reconcile_data, reconcile_multi, reconcile_to_tree_set, reconcile_to_trees, reconcile_tree, reconcile_trees
from speciesbridge.operators.synonyms import resolve_names, synonym_pairs
from speciesbridge.sources.treefiles import tree_from_text


def named(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos bigint")


def kinds(c):
    return {(r["name_x"], r["name_y"]): (r["match_type"], r["match_score"]) for r in c.mapping.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_the_sequential_loop(spark, rows, seed):
    rng = random.Random(seed)
    pairs = [(i, rng.choice([None, *"abcdefg"]), rng.choice([None, *"pqrstu"])) for i in range(40)]
    used_x, used_y, expected = set(), set(), []
    for i, x, y in pairs:
        if x and y and x not in used_x and y not in used_y:
            expected.append((i, x, y))
            used_x.add(x), used_y.add(y)
    assert rows(greedy_matching(spark.createDataFrame(pairs, "i int, x string, y string"))) == sorted(expected, key=repr)


def test_greedy_of_nothing(spark, rows):
    assert rows(greedy_matching(spark.createDataFrame([], "i int, x string, y string"))) == []


def test_stages_in_order(spark):
    x = named(spark, "Parus major", "parus_major", "Corvus corax L.", "Corvvs corone", None, "", "Falco x")
    y = named(spark, "Parus major", "Corvus corax", "Corvus corone", "Aquila one", "")
    c = cascade(x, y, authority=None, fuzzy=True, fuzzy_threshold=0.85)
    got = kinds(c)
    assert got[("Parus major", "Parus major")] == ("exact", 1.0)
    assert got[("", "")] == ("exact", 1.0)
    assert got[("Corvus corax L.", "Corvus corax")] == ("normalized", 1.0)
    assert got[("Corvvs corone", "Corvus corone")] == ("flagged", 0.9)
    assert got[("parus_major", None)][0] == "unresolved" and got[("Falco x", None)][0] == "unresolved" and got[(None, "Aquila one")][0] == "unresolved"
    assert c.mapping.schema.fieldNames() == MAPPING.fieldNames() and len(got) == 7


def test_first_x_wins_unless_multi(spark):
    x, y = named(spark, "A b Linn, 1758", "a_b", "A_b"), named(spark, "A b")
    assert sum(k == ("normalized", 1.0) for k in kinds(cascade(x, y, authority=None)).values()) == 1
    assert sum(k == ("normalized", 1.0) for k in kinds(cascade(x, y, authority=None, multi_x=True)).values()) == 3


def test_overrides_and_reasons(spark, rows):
    o = spark.createDataFrame([(0, "a_b", "C d", "hand"), (1, "A b", "E f", None), (2, "zz", "E f", None), (3, "G h", "yy", None), (4, None, None, None)], "pos int, name_x string, name_y string, user_note string")
    c = cascade(named(spark, "A b", "G h"), named(spark, "C_d", "E f"), overrides=o, authority=None)
    assert kinds(c)[("A b", "C_d")] == ("manual", 1.0)
    assert rows(c.unused_overrides, "reason") == [("already_matched",), ("name_x_not_in_data",), ("name_x_not_in_data",), ("name_y_not_in_target",)]
    assert rows(unused_counts(c.unused_overrides)) == [("already_matched", 1), ("name_x_not_in_data", 2), ("name_y_not_in_target", 1)]


def sequential_synonyms(xs, ys, means):
    out = []
    for x in xs:
        if means.get(x) in ys:
            out.append((1, x, means[x]))
    for y in ys:
        x = means.get(y)
        if x in xs and y not in {o[2] for o in out} and x not in {o[1] for o in out}:
            out.append((2, x, y))
    for x in xs:
        if means.get(x) and x not in {o[1] for o in out}:
            y = next((y for y in ys if means.get(y) == means[x] and y not in {o[2] for o in out}), None)
            if y:
                out.append((3, x, y))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_synonym_strategies_by_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    universe = [f"N{i}" for i in range(25)]
    xs, ys = rng.sample(universe, 12), [f"Y{i}" for i in range(8)] + rng.sample(universe, 4)
    means = {n: rng.choice([*universe, *ys, None]) for n in [*xs, *ys]}
    side = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "norm string, pos int")
    lookup = spark.createDataFrame(list(means.items()), "input string, accepted_name string")
    got = rows(synonym_pairs(side(xs), side(ys), lookup), "strategy", "norm_x", "norm_y")
    assert got == sequential_synonyms(xs, ys, means)


def test_authority_answers(spark, rows):
    taxa = spark.createDataFrame([("A b", "1", None, "accepted", 0), ("A c", "2", "1", "synonym", 1), ("A d", "3", "99", None, 2), ("A c", "4", None, "doubtful", 3)], "scientificName string, taxonID string, acceptedNameUsageID string, taxonomicStatus string, ord int")
    got = rows(resolve_names(spark.createDataFrame([("A b",), ("A c",), ("A d",), ("Z",), (None,), ("Z",)], "name string"), taxa, "col"))
    assert got == [("A b", "A b", "accepted", "1", "col"), ("A c", "A b", "synonym", "1", "col"), ("A d", None, "unknown", "3", "col"), ("Z", None, "not_found", None, "col")]


def test_cascade_synonym_flags_indirect(spark):
    lookup = spark.createDataFrame([("A b", "C d"), ("E f", "G h"), ("I j", "G h")], "input string, accepted_name string")
    c = cascade(named(spark, "A_b", "E f"), named(spark, "C d", "I_j"), lookup=lookup)
    assert kinds(c) == {("A_b", "C d"): ("synonym", 0.95), ("E f", "I_j"): ("flagged", 0.95)}


def test_genus_pairs_by_brute_force(spark, rows):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = _next(row, i, c, b)
        return row[-1]

    def _next(row, i, c, b):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        return new

    df = spark.createDataFrame([(w,) for w in words], "genus string")
    assert rows(genus_pairs(df, df)) == sorted(((a, b) for a in words for b in words if distance(a, b) <= 2), key=repr)


@pytest.mark.parametrize("threshold", [0.84, 0.9, 0.95])
def test_large_genera_lose_no_pair(spark, rows, monkeypatch, threshold):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(40)]

    def edited(w):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", "x", "a"]) + w[i + rng.randint(0, 1) :]
        return w or "a"

    side = lambda: named(spark, *sorted({f"{rng.choice(['Parus', 'Parsus', 'Falco'])} {edited(rng.choice(stems))}" for _ in range(150)}))
    x, y = side(), side()
    plain = rows(fuzzy.similar_names(x, y, threshold, "subspecies"), "name_x", "name_y", "score")
    monkeypatch.setattr(fuzzy, "HOT_GENUS", 0)
    assert plain and rows(fuzzy.similar_names(x, y, threshold, "subspecies"), "name_x", "name_y", "score") == plain


def test_suggestions_are_ordered_and_limited(spark):
    got = suggestions(named(spark, "Parus majro", "Single", None), named(spark, "Parus major", "Parus majros", "Parus x", "Parus majro"), 2, 0.7).collect()
    assert [(r["suggestion"], r["score"]) for r in sorted(got, key=lambda r: -r["score"])] == [("Parus majro", 1.0), ("Parus majros", 0.9333)]


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "name string, pos bigint")
    assert kinds(cascade(named(spark, "A b"), empty, authority=None, fuzzy=True)) == {("A b", None): ("unresolved", None)}
    assert kinds(cascade(empty, empty, authority=None)) == {}


def test_entry_points(spark, rows):
    tree = tree_from_text(spark, "((Parus_major:1,Corvus_corax:1):1,Falco_a:2);", "t1")
    other = tree_from_text(spark, "((Parus_major:1,Aquila_b:1):1,Falco_a:2);", "t2")
    x = spark.createDataFrame([("Parus major", 1), ("Corvus corax", 2), ("Nix nix", 3), (None, 4)], "species string, n int")
    rec = reconcile_tree(x, tree, authority=None)
    c = rec.counts().first()
    assert (c["n_x"], c["n_y"], c["n_normalized"], c["n_unresolved_x"], c["n_unresolved_y"]) == (3, 3, 2, 1, 1)
    assert c["n_normalized"] + c["n_unresolved_x"] == c["n_x"]
    assert reconcile_data(x, x, authority=None).counts().first()["n_exact"] == 3
    assert reconcile_trees(tree, other, authority=None).counts().first()["n_exact"] == 2
    assert set(reconcile_to_trees(x, [tree, other], authority=None)) == {"tree_1", "tree_2"}
    names = x.selectExpr("species as name", "n as pos")
    keyed = reconcile_to_tree_set(names, tree.unionByName(other), fuzzy=True)
    for t, e in (("t1", tree), ("t2", other)):
        single = reconcile_tree(x, e, x_order="n", authority=None, fuzzy=True)
        assert rows(keyed.where(f"tree_id = '{t}'").drop("tree_id")) == rows(single.mapping)
    multi = reconcile_multi({"a": x, "b": x.limit(0).unionByName(spark.createDataFrame([("Parus_major", 9)], "species string, n int"))}, tree, authority=None)
    flags = {r["name_x"]: (r["in_a"], r["in_b"]) for r in multi.mapping.where("in_x").collect()}
    assert flags["Parus major"] == (True, False) and flags["Parus_major"] == (False, True)
    with pytest.raises(ValueError):
        reconcile_data(x.where("false"), x, "species", authority=None)
    with pytest.raises(ValueError):
        reconcile_data(x, x, authority="iucn")


def test_suggestions_need_no_row_for_each_pair(spark, rows, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abné") for _ in range(n))
    name = lambda: f"{rng.choice(['Aus', 'Auas', 'Bus', 'Corvus', 'Korvus', 'Xylophagus'])} {word(rng.choice([1, 2, 3, 3, 4, 4, 17, 34, 70]))}{rng.choice(['', '', ' ott12'])}"
    table = lambda k: spark.createDataFrame([(n, i) for i, n in enumerate(sorted({name() for _ in range(k)}, key=lambda s: s[::-1]))] + [("Aus", 900), (" ", 901)], "name string, pos int")
    x, y = table(60), table(120)
    order = [F.desc("score"), "genus_y", "pos_y", "name_y"]
    wanted = {n: rows(first_rows(fuzzy.similar_names(x, y, t, "species"), ["name_x"], order, n).select("name_x", "name_y", F.round("score", 4))) for n, t in ((1, 0.9), (3, 0.7), (200, 0.0))}
    monkeypatch.setattr(fuzzy, "similar_names", None)
    for asking, asked in ((4_000, 32_768), (5, 7)):
        monkeypatch.setattr(fuzzy, "MOST_ASKING", asking)
        monkeypatch.setattr(fuzzy, "MOST_ASKED", asked)
        for n, t in ((1, 0.9), (3, 0.7), (200, 0.0)):
            assert rows(fuzzy.suggestions(x, y, n, t)) == wanted[n] and wanted[n]
    assert rows(fuzzy.suggestions(x, y.limit(0), 3)) == []
    others = [word(n) for n in (0, 1, 5, 16, 17, 32, 64)]
    for some in (others[:4], others[:6], others, [*others, word(65), word(90)]):
        words = sorted([*some, word(3), word(66)])
        plain = spark.createDataFrame([(a, b) for a in words for b in some], "a string, b string").select(F.levenshtein("a", "b")).collect()
        assert [int(d) for ds in fuzzy.edit_distances(words, some) for d in ds] == [r[0] for r in plain]
