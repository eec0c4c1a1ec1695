import itertools
import math
import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
from speciesbridge.functions.schema import MAPPING, TREE
from speciesbridge.operators import retrieval as R
from speciesbridge.operators import trees as T
from speciesbridge.sources import treefiles as N

SMALL = Path("/root/testdata/sf0.001")


class Model:
    """A tree as plain dictionaries, to check against."""

    def __init__(self, edges):
        self.up = {c: (p, n) for _, p, c, n, _, _ in edges}
        self.label = {c: lab for _, _, c, _, lab, tip in edges if tip}

    def path(self, node):
        out, d = [(node, 0.0)], 0.0
        while node in self.up:
            node, n = self.up[node][0], self.up[node][1]
            d += n
            out.append((node, d))
        return out

    def depth(self, node):
        return self.path(node)[-1][1]

    def distance(self, a, b):
        up = dict(self.path(a))
        return next(d + up[n] for n, d in self.path(b) if n in up)

    def clades(self, keep=None):
        out = {}
        for c, lab in self.label.items():
            if keep is None or lab in keep:
                for n, _ in self.path(c):
                    out.setdefault(n, set()).add(lab)
        return out


def random_tree(rng, tree_id, n, labels=None):
    labels = labels or [f"G{i % 5}_s{i}" for i in range(n)]
    live, edges, nxt = list(range(1, n + 1)), [], n + 1
    while len(live) > 1:
        k = min(len(live), rng.choice([2, 2, 2, 3]))
        kids = rng.sample(live, k)
        for c in kids:
            live.remove(c)
            edges.append((tree_id, nxt, c, round(rng.uniform(0.1, 3), 3), labels[c - 1] if c <= n else None, c <= n))
        live.append(nxt)
        nxt += 1
    return edges


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(7)
    lists = [random_tree(rng, f"t{i}", n, lab) for i, (n, lab) in enumerate([(9, None), (12, None), (7, [f"H_s{i}" for i in range(7)]), (2, None)])]
    return lists, spark.createDataFrame([e for t in lists for e in t], TREE)


def test_closure_and_depths(forest, rows):
    lists, df = forest
    expected = {(t[0][0], n, a, h) for t in lists for m in [Model(t)] for n in {*m.up, *(p for p, _ in m.up.values())} for h, (a, _) in enumerate(m.path(n))}
    got = T.closure(df).collect()
    assert {(r["tree_id"], r["node"], r["ancestor"], r["hops"]) for r in got} == expected and len(got) == len(expected)
    models = {t[0][0]: Model(t) for t in lists}
    assert all(math.isclose(r["depth"], models[r["tree_id"]].depth(r["node"])) for r in T.tip_depths(df).collect())


def test_ladder_is_deep(spark):
    n = 300
    edges = [("l", 2 * i, 2 * i + 2, 1.0, None, False) for i in range(n)] + [("l", 2 * i, 2 * i + 1, 1.0, f"a{i}", True) for i in range(n + 1)]
    df = spark.createDataFrame(edges, TREE)
    assert T.tip_depths(df).agg({"depth": "max"}).first()[0] == n + 1


def test_prune_keeps_distances(forest, spark):
    lists, df = forest
    keep = {"t0": {"G0_s0", "G1_s1", "G3_s3", "G0_s5"}, "t1": {"G2_s2", "G4_s9", "G1_s11"}, "t2": {"H_s4"}}
    out = T.prune(df, spark.createDataFrame([(t, lab) for t, ls in keep.items() for lab in [*ls, "unknown"]], "tree_id string, label string")).collect()
    for t, labels in keep.items():
        edges = [tuple(r[c] for c in TREE.fieldNames()) for r in out if r["tree_id"] == t]
        full, small = Model(next(x for x in lists if x[0][0] == t)), Model(edges)
        assert set(small.label.values()) == labels
        where = {lab: c for c, lab in full.label.items()}
        for a, b in itertools.combinations(small.label, 2):
            assert math.isclose(small.distance(a, b), full.distance(where[small.label[a]], where[small.label[b]]))
        if len(labels) == 1:
            assert len(edges) == 1 and math.isclose(edges[0][3], full.depth(where["H_s4"]))
    assert not [r for r in out if r["tree_id"] == "t3"]


def test_comparison_by_brute_force(forest, spark):
    lists, df = forest
    pairs = spark.createDataFrame([("t0", "t1"), ("t0", "t2"), ("t1", "t1")], "tree_a string, tree_b string")
    models = {t[0][0]: Model(t) for t in lists}
    rf = {(r["tree_a"], r["tree_b"]): r["rf"] for r in T.robinson_foulds(df, pairs).collect()}
    cor = {(r["tree_a"], r["tree_b"]): r["branch_cor"] for r in T.branch_correlation(df, pairs).collect()}
    jac = {(r["tree_a"], r["tree_b"]): r["jaccard"] for r in T.compare_tips(df, pairs).collect()}
    for a, b in rf:
        x, y = set(models[a].label.values()), set(models[b].label.values())
        common = x & y
        assert math.isclose(jac[a, b], len(common) / len(x | y))
        if len(common) < 4:
            assert rf[a, b] is None and cor[a, b] is None
            continue
        ref = min(common)
        splits = [{frozenset(s if ref not in s else common - s) for s in models[t].clades(common).values()} for t in (a, b)]
        splits = [{s for s in ss if 2 <= len(s) <= len(common) - 2} for ss in splits]
        assert rf[a, b] == len(splits[0] ^ splits[1])
    assert math.isclose(cor["t1", "t1"], 1.0) and rf["t1", "t1"] == 0


def test_grafen_units_and_polytomies(forest):
    lists, df = forest
    models = {t[0][0]: Model(t) for t in lists}
    for r in T.grafen(df).collect():
        n = {k: len(v) for k, v in models[r["tree_id"]].clades().items()}
        big = max(n.values())
        assert math.isclose(r["edge_length"], (n[r["parent"]] - n[r["child"]]) / (big - 1), abs_tol=1e-12)
    assert {r["is_ultrametric"] for r in T.ultrametric(T.grafen(df)).collect()} == {True}
    assert {r["is_ultrametric"] for r in T.ultrametric(df).where("tree_id <> 't3'").collect()} == {False}
    assert {r["edge_length"] for r in T.unit_lengths(df).collect()} == {1.0}
    binary = [tuple(r) for r in T.resolve_polytomies(df).select(*TREE.fieldNames()).collect()]
    for t in models:
        mine = [e for e in binary if e[0] == t]
        kids = [p for _, p, *_ in mine]
        assert {kids.count(p) for p in kids} == {2} and len({e[2] for e in mine}) == len(mine)
        small, where = Model(mine), {lab: c for c, lab in models[t].label.items()}
        for a, b in itertools.combinations(small.label, 2):
            assert math.isclose(small.distance(a, b), models[t].distance(where[small.label[a]], where[small.label[b]]))


def test_covariance(spark, rows):
    df = N.tree_from_text(spark, "((a:1,b:2):3,c:4);", "t")
    assert rows(T.phylo_covariance(df), "tip_i", "tip_j", "value") == [("a", "a", 4.0), ("a", "b", 3.0), ("a", "c", 0.0), ("b", "b", 5.0), ("b", "c", 0.0), ("c", "c", 4.0)]
    cor = {(r["tip_i"], r["tip_j"]): r["value"] for r in T.phylo_covariance(df, True).collect()}
    assert cor["a", "a"] == 1.0 and math.isclose(cor["a", "b"], 3 / math.sqrt(20))
    assert rows(T.phylo_covariance(N.tree_from_text(spark, "((a,b),c);"))) == []


def test_missing_and_zero_lengths(spark):
    assert T.ultrametric(N.tree_from_text(spark, "((a,b),c);")).first()["is_ultrametric"] is None
    assert T.ultrametric(N.tree_from_text(spark, "((a:0,b:0):0,c:0);")).first()["is_ultrametric"] is False
    assert T.ultrametric(N.tree_from_text(spark, "((a:1,b:1):1,c:2);")).first()["is_ultrametric"] is True


def test_align(spark, rows):
    df = N.tree_from_text(spark, "((Parus_major:1,Corvus_corax:1):1,(Falco_a:1,Old_one:1):1);", "t")
    m = spark.createDataFrame([("parus M", "Parus_major", None, "exact", 1.0, "", True, True, ""), ("first", "Corvus corax", None, "exact", 1.0, "", True, True, ""), ("last", "Corvus_corax", None, "exact", 1.0, "", True, True, ""), (None, "Old_one", None, "unresolved", None, None, False, True, "")], MAPPING)
    assert rows(T.tips(T.align(df, m, ["name_x"])), "label") == [("Falco_a",), ("Old_one",), ("last",), ("parus M",)]
    assert rows(T.tips(T.align(df, m, ["name_x"], drop_unresolved=True)), "label") == [("Falco_a",), ("last",), ("parus M",)]


def test_validation(spark):
    twice = spark.createDataFrame([("t", 3, 1, 1.0, "a", True), ("t", 3, 2, 1.0, "a", True)], TREE)
    with pytest.raises(ValueError, match="a in t"):
        T.validate(twice)
    with pytest.raises(ValueError, match="without tips"):
        T.validate(spark.createDataFrame([("t", 3, 1, 1.0, None, False)], TREE))


@pytest.mark.parametrize("where", ["genus", "near"])
@pytest.mark.parametrize("how", ["congener_median", "half_terminal", "zero"])
def test_graft_keeps_level_and_distances(spark, where, how):
    df = N.tree_from_text(spark, "((Aus_one:6,Aus_two:6):4,((Bus_one:3,Bus_two:3):4,Cus_one:7):3);", "t")
    new = spark.createDataFrame([("t", n, i) for i, n in enumerate(["Aus three", "Bus_three", "Bus four", "Cus two", "Cus three", "Dus one", None, " "])], "tree_id string, name string, pos int")
    tree, added, skipped = T.graft(df, new, how, where)
    edges = [tuple(r) for r in tree.select(*TREE.fieldNames()).collect()]
    m = Model(edges)
    assert sorted(m.label.values()) == sorted(["Aus_one", "Aus_two", "Bus_one", "Bus_two", "Cus_one", "Aus_three", "Bus_three", "Bus_four", "Cus_two", "Cus_three"])
    assert len({e[2] for e in edges}) == len(edges)
    old = Model([tuple(r) for r in df.collect()])
    where_ = {lab: c for c, lab in m.label.items()}
    for a, b in itertools.combinations(old.label, 2):
        assert math.isclose(m.distance(where_[old.label[a]], where_[old.label[b]]), old.distance(a, b))
    if how != "zero":
        assert all(math.isclose(m.depth(c), 10) for c in m.label)
    assert {(r["species"], r["n_congeners"]) for r in added.collect()} == {("Aus three", 2), ("Bus_three", 2), ("Bus four", 3), ("Cus two", 1), ("Cus three", 2)}
    assert {(r["species"], r["reason"]) for r in skipped.collect()} == {("Dus one", "No congener in tree"), (None, "Could not extract genus from name"), (" ", "Could not extract genus from name")}


def test_newick_and_nexus(spark, rows, tmp_path):
    text = "((a_b:1,'it''s, b':2.5)x:0.5,[note]c);"
    edges, rest = N.parse_newick(text)
    assert rest == "" and N.newick_text([e[:4] for e in edges]) == "(c,(a_b:1.0,'it''s, b':2.5)x:0.5);"
    nexus = "#NEXUS\nBEGIN TREES;\nTRANSLATE 1 Parus_major, 2 'Corvus corax';\nTREE one = [&R] (1:1,2:2);\nTREE two = (1,2);\nEND;"
    assert [(n, [e[3] for e in t]) for n, t in N.parse_nexus(nexus)] == [("one", ["Parus_major", "Corvus corax"]), ("two", ["Parus_major", "Corvus corax"])]
    assert len(N.parse_trees("(a,b);(c,d);")) == 2 and N.parse_trees(nexus)[1][0] == "two"
    for bad in ("", "(a,b)", "a,b;", "(a,b));", "((a,b);", "(a:x,b);"):
        with pytest.raises(N.TreeSyntaxError):
            N.parse_newick(bad)
    (tmp_path / "x.nwk").write_text("(a:1,b:2);\n(c:1,d:2);"), (tmp_path / "y.nex").write_text(nexus)
    got = N.read_trees(spark, str(tmp_path))
    assert rows(T.tips(got), "tree_id", "label") == [("x.nwk", "a"), ("x.nwk", "b"), ("y.nex", "Corvus corax"), ("y.nex", "Parus_major")]
    assert got.select("tree_id").distinct().count() == 2 and N.read_trees(spark, str(tmp_path), False).select("tree_id").distinct().count() == 4
    N.write_trees(got, str(tmp_path / "out"), "nexus")
    again = N.parse_nexus("\n".join(p.read_text() for p in (tmp_path / "out").glob("part*") if "x.nwk" in p.read_text()).split("END;")[0] + "END;")
    assert again
    assert rows(N.to_newick(got.where("tree_id = 'x.nwk'"))) == [("x.nwk", "(a:1.0,b:2.0);")]


def test_retrieval(spark, rows):
    tree = N.tree_from_text(spark, "((Parus_major**,Corvus_corax):1,Falco_new*);", "t")
    names = spark.createDataFrame([("Parus major",), ("corvus_corax",), ("Old name",), ("nix nix",), (None,), ("nix nix",)], "name string")
    service = spark.createDataFrame([("old name", "Falco new (species in x)", 2, True, False, "f"), ("nix nix", "", 1, False, False, None)], "search_string string, unique_name string, number_matches int, is_synonym boolean, approximate_match boolean, flags string")
    got = R.get_tree(names, R.TableProvider("table", tree, "cited {1}"), replacements=service)
    assert rows(got.mapping, "input_name", "tree_name", "match_type", "placement_status") == [
        ("Old name", "Falco_new*", "tnrs", None), ("Parus major", "Parus_major**", "exact", None), ("corvus_corax", "Corvus_corax", "normalized", None), ("nix nix", None, "unmatched", None)]
    assert len(rows(got.matched)) + len(rows(got.unmatched)) == got.meta["n_queried"] == 4
    assert "cited" in R.cite(got) and "\\{1\\}" in R.cite(got, "bibtex") and R.cite(got, "markdown").startswith("**")

    class Broken:
        name, citation, calibration = "broken", "", ""

        def fetch(self, query, n_tree):
            raise OSError("no network")

    auto = R.get_tree_auto(names, [Broken(), R.TableProvider("small", T.prune(tree, T.tips(tree).limit(1))), R.TableProvider("table", tree)], 0.5)
    assert auto.source == "table" and auto.meta["auto_attempts"]["broken"]["success"] is False
    said = spark.createDataFrame([("Parus major", "Parus_major**", "family_added"), ("nix nix", "Nix_nix*", "genus_added")], "input_name string, tree_name string, placement_status string")
    assert rows(R.tree_mapping(R.resolve_query(names), tree, placement=said).where("placement_status is not null"), "input_name", "tree_name", "placement_status") == rows(said)
    graf = R.get_tree(names, R.TableProvider("table", tree), branch_lengths="grafen", binary=True)
    assert T.ultrametric(graf.edges).first()["is_ultrametric"] is True
    with pytest.raises(ValueError):
        R.get_tree(names, R.TableProvider("table", tree), n_tree=0)


def test_comparison_without_pairs_is_of_all(forest, spark):
    lists, df = forest
    pairs = set(itertools.combinations(["t0", "t1", "t2", "t3"], 2))
    given = spark.createDataFrame(sorted(pairs), "tree_a string, tree_b string")
    for compare in (T.compare_tips, T.robinson_foulds, T.branch_correlation):
        every = {(r["tree_a"], r["tree_b"]): tuple(r) for r in compare(df).collect()}
        assert set(every) == pairs
        assert every == {(r["tree_a"], r["tree_b"]): tuple(r) for r in compare(df, given).collect()}
    jac = {(r["tree_a"], r["tree_b"]): (r["n_shared"], r["n_only_a"], r["n_only_b"]) for r in T.compare_tips(df).collect()}
    assert jac["t0", "t2"] == (0, 9, 7) and jac["t1", "t3"] == (2, 10, 0)


def test_every_tree_gets_what_it_lacks(spark, rows):
    texts = {"t": "((Aus_one:6,Aus_two:6):4,Cus_one:10);", "u": "((Bus_one:3,Aus_two:3):4,Cus_one:7);"}
    first, second = (N.tree_from_text(spark, text, i) for i, text in texts.items())
    df = first.unionByName(second)
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(["Aus one", "Aus two", "Bus one", "Bus two", "Dus one", " "])], "name string, pos int")
    species, skipped = T.wanted_by_all(df, wanted)
    assert rows(species, "tree_id", "name") == [("u", "Aus one"), ("u", "Bus two")]
    none, no_genus = "No congener in tree", "Could not extract genus from name"
    assert rows(skipped) == [("t", " ", None, no_genus), ("t", "Bus one", "Bus", none), ("t", "Bus two", "Bus", none), ("t", "Dus one", "Dus", none), ("u", " ", None, no_genus), ("u", "Dus one", "Dus", none)]
    tree, added, _ = T.graft(df, species)
    assert rows(added, "tree_id", "species") == [("u", "Aus one"), ("u", "Bus two")]
    assert rows(tree.where("is_tip").groupBy("tree_id").count()) == [("t", 3), ("u", 5)]


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_grafting_covers_the_forest(spark):
    trees = entry.queries()["tips"](spark, str(SMALL)).select("tree_id").distinct().count()
    assert trees > 1
    for name in ("graft_genus", "graft_report", "graft_skipped_all"):
        assert entry.queries()[name](spark, str(SMALL)).select("tree_id").distinct().count() == trees


def test_provider_stops_at_many_trees_too(spark):
    edges = spark.range(100_001).selectExpr("cast(id as string) as tree_id", "2L as parent", "1L as child", "1.0D as edge_length", "'a' as label", "true as is_tip")
    assert R.TableProvider("table", edges).fetch(None, 100_000).count() == 100_000


def test_retrieval_options(spark, rows, tmp_path):
    trees = N.tree_from_text(spark, "((Parus_major:1,Corvus_corax:1):1,Falco_new:3);", "t").unionByName(N.tree_from_text(spark, "((Parus_major:1,Corvus_corax:1):1,Zus_us:2);", "u"))
    from speciesbridge.functions.schema import MAPPING
    from speciesbridge.operators.mapping import Reconciliation
    from speciesbridge.sources.cache import TreeCache

    class Counting(R.TableProvider):
        calls = 0

        def fetch(self, query, n_tree):
            Counting.calls += 1
            return super().fetch(query, n_tree)

    cache, provider = TreeCache(spark, str(tmp_path / "cache")), Counting("counting", trees)
    named = spark.createDataFrame([("Parus major", 1), ("Corvus corax", 2), ("Zus us", 3)], "species string, n int")
    with pytest.warns(UserWarning, match="1 of 2"):
        one = R.get_tree(named, provider, n_tree=2, cache=cache)
    again = R.get_tree(named, provider, n_tree=2, cache=cache, check_ultrametric=False)
    assert Counting.calls == 1 and again.meta["cached"] and not one.meta["cached"] and rows(again.mapping) == rows(one.mapping)
    assert one.meta["n_returned"] == 2 and one.meta["tip_set_consistent"] is False and rows(one.dropped) == [("t", "Zus_us"), ("u", "Falco_new")]
    rec = Reconciliation(spark.createDataFrame([("a", "Parus_major", None, "exact", 1.0, "", True, True, ""), ("b", None, None, "unresolved", None, None, True, False, "")], MAPPING))
    assert R.get_tree(rec, provider, check_ultrametric=False).meta["n_queried"] == 1
    with pytest.raises(ValueError):
        R.get_tree(named.limit(0), provider, species_col="species")
    with pytest.raises(ValueError):
        R.get_tree(named, provider, tnrs="always")
    with pytest.raises(ValueError):
        R.backend("unknown", trees)
    assert R.provider_status([R.backend("rotl", trees)])[0]["needs_network"] is True


def test_medians_are_of_lengths_before_levelling(spark, rows):
    tree = N.tree_from_text(spark, "((Aus_one:6,Bus_one:6):4,Cus_one:10);", "t")
    wanted = spark.createDataFrame([("t", "Aus a", 1), ("t", "Aus b", 2)], "tree_id string, name string, pos int")
    grown, added, _ = T.graft(tree, wanted)
    assert rows(added, "species", "branch_length") == [("Aus a", 6.0), ("Aus b", 4.5)]
    assert T.ultrametric(grown).first()["is_ultrametric"] is True


def test_augmenting_a_reconciliation(spark, rows):
    from speciesbridge.functions.schema import MAPPING
    from speciesbridge.operators.mapping import Reconciliation
    from speciesbridge.operators.reconcile import reconcile_augment

    tree = N.tree_from_text(spark, "((Aus_one:6,Bus_one:6):4,Cus_one:10);", "t")
    open_ = lambda x: (x, None, None, "unresolved", None, None, True, False, "")
    rec = Reconciliation(spark.createDataFrame([("Aus one", "Aus_one", None, "normalized", 1.0, "", True, True, ""), open_("Aus a"), open_("Zus z"), open_(None), (None, "Cus_one", None, "unresolved", None, None, False, True, "")], MAPPING))
    got = reconcile_augment(rec, tree)
    assert rows(got.augmented, "species", "placed_near") == [("Aus a", "Aus one")] and rows(got.skipped, "species") == [("Zus z",)]
    assert got.meta == {"n_augmented": 1, "n_skipped": 1, "where": "genus", "branch_length_method": "congener_median", "source": "internal", "original_n_tips": 3, "augmented_n_tips": 4}
    none = reconcile_augment(Reconciliation(rec.mapping.where("match_type = 'normalized'")), tree)
    assert rows(T.tips(none.tree), "label") == rows(T.tips(tree), "label") and none.meta["n_augmented"] == 0


@pytest.mark.parametrize("how", ["congener_median", "half_terminal", "zero"])
@pytest.mark.parametrize("lengths", ["whole", "gaps", "none"])
def test_genera_at_once_are_as_name_by_name(spark, rows, how, lengths):
    rng, edges = random.Random(how + lengths), []
    for tree in ("t1", "t2", "t3"):
        for i in range(14):
            size = {"whole": rng.choice([0.0, 0.25, 1.0, 3.0]), "gaps": rng.choice([None, 0.5, 2.0]), "none": None}[lengths]
            level = 1.0 if tree == "t3" and lengths == "whole" else size
            edges.append((tree, 1, 2 + i, level, f"{rng.choice(['Ab', 'Cd', 'ef'])}_s{i}", True))
    df = spark.createDataFrame(edges, T.TREE)
    new = [(f"{rng.choice(['Ab', 'Cd', 'Ef', 'Gh'])} n{i}", 2 * i) for i in range(60)] + [(f"Ab s{i}", 2 * i + 1) for i in range(14)]
    species = spark.createDataFrame(new, "name string, pos bigint")
    one, said, _ = T.graft(df, T.wanted_by_all(df, species)[0], how)
    all_, said_all, _ = T.graft_all(df, species, how)
    assert rows(all_, *T.EDGE) == rows(one, *T.EDGE)
    assert rows(said_all, *said.columns) == rows(said, *said.columns)
    assert T._hung(1.0, [1.0, 1.0, 4.0], True, 1200, how)[1] == 1074


def test_what_trees_lack_is_counted_without_a_row_for_each(spark, monkeypatch):
    from speciesbridge.operators import reconcile as C
    from speciesbridge.operators.mapping import Reconciliation

    edges = [(t, 1, 2 + i, 1.0, label, True) for t, labels in {"t1": ["Ab_a", "Ab_b", "cd_x", None], "t2": ["Cd_x", "Ab_a"], "t3": ["Ef_e"]}.items() for i, label in enumerate(labels)]
    df = spark.createDataFrame(edges, T.TREE)
    names = ["Ab a", "Ab c", "Cd x", "Cd y", "Gh g", "  ", "ef e"]
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos bigint")
    assert T.count_lacking(df, wanted) == tuple(t.count() for t in T.wanted_by_all(df, wanted)) and T.count_lacking(df, wanted.limit(0)) == (0, 0)
    monkeypatch.setattr(T, "graft", None)  # nothing goes name by name
    mapping = spark.createDataFrame([(n, None, None, "unresolved", None, None, True, False, "") for n in names], MAPPING)
    meta = C.reconcile_augment(Reconciliation(mapping), df).meta
    assert (meta["n_augmented"], meta["n_skipped"]) == T.count_lacking(df, wanted)


def test_what_is_grafted_is_said_without_making_trees(spark, rows, monkeypatch):
    edges = [(t, 1, 2 + i, [0.5, None, 2.0, 4.0][i % 4], label, True) for t, labels in {"t1": ["Ab_n1", "Ab_n7", "cd_x", None], "t2": ["Cd_n3", "Ab_a", "Ab_b"], "t3": ["Ef_e"], "t4": [f"Ab_n{i}" for i in range(13)]}.items() for i, label in enumerate(labels)]
    df = spark.createDataFrame(edges, T.TREE)
    species = spark.createDataFrame([(f"{g} n{i}", 20 - i) for g in ("Ab",) for i in range(13)] + [(f"Cd n{i}", 30 + i) for i in range(4)] + [(None, 50), ("  ", 51)], "name string, pos int")
    said = rows(T.graft(df, T.wanted_by_all(df, species)[0])[1], "tree_id", "species", "genus", "placed_near", "branch_length", "n_congeners")
    monkeypatch.setattr(T, "closure", None)
    for together in (1, 4, 2_000):
        monkeypatch.setattr(T, "TOGETHER", together)
        assert rows(T.grafted_all(df, species).drop("method")) == said and len(said) == 11 + 13 + 3
    if SMALL.exists():
        assert entry.queries()["graft_report"](spark, str(SMALL)).count() > 0


@pytest.mark.parametrize("together", [5, 30_000])
def test_trees_meet_names_some_at_a_time(spark, rows, monkeypatch, together):
    rng, edges = random.Random(together), []
    for tree, sizes in {"whole": [0.0, 0.25, 1.0], "gaps": [None, 0.5], "none": [None], "level": [1.0]}.items():
        edges += [(tree, 1, 2 + i, rng.choice(sizes), f"{rng.choice(['Ab', 'Cd', 'ef'])}_s{i}", True) for i in range(9)]
    df = spark.createDataFrame(edges, T.TREE)
    new = [(f"{rng.choice(['Ab', 'Cd', 'Ef', 'Gh', 'ef'])} n{i}", 2 * i) for i in range(40)] + [(f"Ab s{i}", 8 * i + 1) for i in range(9)] + [("", 81), ("  ", 83)]
    species = spark.createDataFrame(new, "name string, pos bigint")
    want = rows(T.graft(df, T.wanted_by_all(df, species)[0])[0], *T.EDGE)
    for name, n in (("NAMES_TOGETHER", together), ("PLACES_TOGETHER", 3 * together)):
        monkeypatch.setattr(T, name, n)
    assert rows(T.graft_all(df, species)[0], *T.EDGE) == want
    assert rows(T.graft_all(df, species.where("name like 'Gh%'"))[0], *T.EDGE) == rows(df, *T.EDGE)
    assert rows(T.graft_all(df, species.limit(0))[0], *T.EDGE) == rows(df, *T.EDGE)
