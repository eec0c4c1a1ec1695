import pandas as pd
import pytest

from speciesbridge.operators import providers as P
from speciesbridge.operators.trees import tips
from speciesbridge.sources.sinks import plot_svg
from speciesbridge.sources.treefiles import tree_from_text


def test_parser(spark, rows):
    def parser(names):
        known = {"Parus major L. 1758": ("Parus major", None, None), "x y z": (None, "Aus bus cus", None), "w": (None, None, None)}
        return pd.DataFrame([known.get(n, (None, None, None)) for n in names], columns=["simple", "full", "stem"], dtype=object)

    df = spark.createDataFrame([(1, "Parus major L. 1758"), (2, "x y z"), (3, "w"), (4, None)], "i int, n string")
    assert rows(P.normalise_with(df, "n", parser), "i", "normalised") == [(1, "Parus major"), (2, "Aus bus"), (3, "W"), (4, None)]


def test_verifier(spark, rows):
    def verifier(names):
        if "boom" in set(names):
            raise OSError("service is down")
        rows = {"A b": ("A b", "A b L.", "A b", "Exact", "1"), "A c": ("A b", None, "A c", "Exact", "2"), "A d": (None, None, "A d", "Fuzzy", None)}
        return pd.DataFrame([rows.get(n, (None,) * 5) for n in names], columns=["current_simple", "current_full", "matched", "match_type", "taxon_id"], dtype=object)

    ask = lambda *n: rows(P.verify_names(spark.createDataFrame([(x,) for x in n], "name string").coalesce(1), verifier), "input", "accepted_name", "status")
    assert ask("A b", "A c", "A d", "zz", None, "zz") == [("A b", "A b", "accepted"), ("A c", "A b", "synonym"), ("A d", "A d", "synonym"), ("zz", None, "not_found")]
    assert ask("boom") == [("boom", None, "not_found")]


def test_grafting_and_dating_services(spark, rows):
    tree = tree_from_text(spark, "(A_a:1,B_b:2);", "t")
    grown = tree_from_text(spark, "((A_a:1,A_c*:1):1,(B_b:2,Z_z**:1):1);", "t")
    wanted = spark.createDataFrame([("A a",), ("A c",), ("Z z",), ("Q q",), (None,)], "name string")
    out, account = P.augment_with(wanted, tree, lambda s, e: grown)
    assert rows(account) == [("A a", "exact"), ("A c", "genus_added"), ("Q q", "skipped"), ("Z z", "family_added")]
    assert rows(tips(out), "label") == [("A_a",), ("A_c",), ("B_b",), ("Z_z",)]
    two = tree_from_text(spark, "(A_a:1,C_c:1);", "d1").unionByName(tree_from_text(spark, "(A_a:1,B_b:1);", "d2"))
    dated, counts = P.date_tree(tree, lambda e, n: two, 1)
    assert {r["tree_id"] for r in dated.collect()} == {"d1"} and counts.first().asDict() == {"n_tips_in": 2, "n_tips_out": 2, "n_tips_lost": 1, "n_trees": 1}
    with pytest.raises(ValueError):
        P.date_tree(tree, lambda e, n: two, 0)


def test_plots(spark):
    from speciesbridge.functions.schema import MAPPING

    m = spark.createDataFrame([("a", "b", None, "exact", 1.0, "", True, True, "")], MAPPING)
    two = m.unionByName(m.withColumn("match_type", m.name_x).replace("a", "fuzzy", ["match_type"]))
    assert "<circle" in plot_svg(m, "pie") and plot_svg(two, "pie").count("<path") == 2 and plot_svg(two).count("<rect") == 2
    with pytest.raises(ValueError):
        plot_svg(m, "line")
