"""Operators on trees held as edges (tree_id, parent, child, edge_length, label, is_tip).

The root is the only parent that is no child. Labels of tips are unique in a tree; lengths may be NULL. Any number of
trees is processed at once; no operator walks a tree node by node except grafting, which goes genus by genus.
"""

from __future__ import annotations

import statistics
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import genus, normalise
from ..functions.relational import first_rows
from ..functions.schema import TREE
from ..runtime import cut, discard, ship

EDGE = TREE.fieldNames()
#: The depths of an ultrametric tree's tips may differ by so much of the greatest.
ULTRAMETRIC_TOLERANCE = 1e-6
#: The names of a genus are spread over so many tasks where they meet all trees with that genus.
SPREAD = 16


def tips(edges: DataFrame) -> DataFrame:
    """(tree_id, label, child) of all tips; unlabelled ones too."""
    return edges.where("is_tip").select("tree_id", "label", "child")


def duplicate_tips(edges: DataFrame) -> DataFrame:
    """(tree_id, label, n) of tip labels that a tree has more than once."""
    return tips(edges).where("label is not null").groupBy("tree_id", "label").agg(F.count("*").alias("n")).where("n > 1")


def validate(edges: DataFrame) -> DataFrame:
    """edges, if every tree has a tip and no tip label twice, else an error that names up to five."""
    bad = duplicate_tips(edges).orderBy("tree_id", "label").limit(5).collect()
    if bad:
        raise ValueError("duplicate tip labels: " + ", ".join(f"{r['label']} in {r['tree_id']}" for r in bad))
    bare = edges.groupBy("tree_id").agg(F.bool_or("is_tip").alias("t")).where("not t").limit(5).collect()
    if bare:
        raise ValueError("trees without tips: " + ", ".join(str(r["tree_id"]) for r in bare))
    return edges


def roots(edges: DataFrame) -> DataFrame:
    """(tree_id, root)."""
    parents = edges.select("tree_id", F.col("parent").alias("root")).distinct()
    return parents.join(edges.select("tree_id", F.col("child").alias("root")), ["tree_id", "root"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """(tree_id, node, ancestor, hops, dist): every child and root with itself and all nodes above it.

    By pointer doubling: after k rounds paths of less than 2^k edges are known, so that even a ladder of a million tips
    takes 20 rounds. dist is NULL where a length on the path is.
    """
    jump = edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("to"), F.col("edge_length").alias("by"))
    nodes = edges.select("tree_id", F.col("child").alias("node")).unionByName(roots(edges).withColumnRenamed("root", "node"))
    known = nodes.select("tree_id", "node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("hops"), F.lit(0.0).alias("dist"))
    hops = 1
    jump = cut(jump)
    while not jump.isEmpty():
        further = jump.join(known.withColumnRenamed("node", "to"), ["tree_id", "to"]).select(
            "tree_id", "node", "ancestor", (F.col("hops") + hops).alias("hops"), (F.col("by") + F.col("dist")).alias("dist")
        )
        known = cut(known.unionByName(further))
        on = jump.select("tree_id", F.col("node").alias("to"), F.col("to").alias("far"), F.col("by").alias("more"))
        jump = cut(jump.join(on, ["tree_id", "to"]).select("tree_id", "node", F.col("far").alias("to"), (F.col("by") + F.col("more")).alias("by")))
        hops *= 2
    return known


def tip_ancestors(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, label, node, ancestor, hops, dist) of tips only."""
    paths = closure(edges) if paths is None else paths
    return paths.join(tips(edges).withColumnRenamed("child", "node"), ["tree_id", "node"])


def descendant_counts(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, n_tips): tips at or below each node."""
    return tip_ancestors(edges, paths).groupBy("tree_id", F.col("ancestor").alias("node")).agg(F.count("*").alias("n_tips"))


def clades(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, tips): the sorted labels below each inner node, which are the feature, as long as the clade."""
    below = tip_ancestors(edges, paths).where("hops > 0 and label is not null")
    return below.groupBy("tree_id", F.col("ancestor").alias("node")).agg(F.array_sort(F.collect_set("label")).alias("tips"))


def prune(edges: DataFrame, keep: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The trees with only the tips of keep (tree_id, label); nodes left with one child go, lengths add up.

    Trees without a kept tip vanish; of a tree with a single one remains the edge from the root. New parents are the
    nearest surviving nodes above, found without iteration. Labels that a tree lacks mean nothing.
    """
    paths = cut(closure(edges)) if paths is None else paths
    kept = tips(edges).join(keep.select("tree_id", "label").distinct(), ["tree_id", "label"], "left_semi").select("tree_id", F.col("child").alias("node"))
    alive = cut(paths.join(kept, ["tree_id", "node"], "left_semi").select("tree_id", F.col("ancestor").alias("node")).distinct())
    inner = edges.join(alive.withColumnRenamed("node", "child"), ["tree_id", "child"], "left_semi").groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    forks = inner.where("n > 1").select("tree_id", "node")
    lone = kept.groupBy("tree_id").agg(F.count("*").alias("n")).where("n = 1").select("tree_id")
    surviving = cut(forks.unionByName(kept).unionByName(roots(edges).withColumnRenamed("root", "node").join(lone, "tree_id", "left_semi")))
    up = paths.where("hops > 0").join(surviving, ["tree_id", "node"], "left_semi").join(surviving.withColumnRenamed("node", "ancestor"), ["tree_id", "ancestor"], "left_semi")
    nearest = first_rows(up, ["tree_id", "node"], ["hops"])
    named = edges.select("tree_id", F.col("child").alias("node"), "label", "is_tip")
    return nearest.join(named, ["tree_id", "node"]).select("tree_id", F.col("ancestor").alias("parent"), F.col("node").alias("child"), F.col("dist").alias("edge_length"), "label", "is_tip")


def drop_tips(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The trees without the tips of gone (tree_id, label)."""
    return prune(edges, tips(edges).join(gone.select("tree_id", "label"), ["tree_id", "label"], "left_anti"))


def align(edges: DataFrame, mapping: DataFrame, order: list[str], rank: str = "species", drop_unresolved: bool = False) -> DataFrame:
    """Tips renamed to name_x where they are name_y, as written or in normal form; on request without unresolved tips.

    Every matched row names the first tip, by node, of each tree that is its name_y; of several rows that name one
    tip the last by `order` counts. Rows with a NULL name do nothing. Unresolved tips are those whose label then is the
    name_y of a y-only unresolved row.
    """
    t = tips(edges).where("label is not null").withColumn("norm", normalise(F.col("label"), rank))
    rows = mapping.where("in_x and in_y and name_x is not null and name_y is not null").select("name_x", "name_y", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = rows.withColumn("norm", normalise(F.col("name_y"), rank))
    by = [f"_o{i}" for i in range(len(order))]
    literal = t.drop("norm").join(rows.drop("norm").withColumn("label", F.col("name_y")), "label")
    normal = t.join(rows.where("norm <> ''"), "norm").drop("norm")
    hits = literal.select("tree_id", "child", "name_x", "name_y", *by).unionByName(normal.select("tree_id", "child", "name_x", "name_y", *by)).distinct()
    firsts = first_rows(hits, ["tree_id", "name_x", "name_y", *by], ["child"])
    new = first_rows(firsts, ["tree_id", "child"], [F.desc(c) for c in by] + [F.desc("name_x")]).select("tree_id", "child", F.col("name_x").alias("_new"))
    out = edges.join(new, ["tree_id", "child"], "left").withColumn("label", F.coalesce("_new", "label")).select(*EDGE)
    if not drop_unresolved:
        return out
    open_y = mapping.where("match_type = 'unresolved' and not in_x and in_y and name_y is not null").select(F.col("name_y").alias("label")).distinct()
    out = cut(out)
    return drop_tips(out, tips(out).join(open_y, "label", "left_semi"))


def tip_depths(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, label, node, depth): distance of each tip from the root, NULL without lengths."""
    above = tip_ancestors(edges, paths)
    top = roots(edges).withColumnRenamed("root", "ancestor")
    return above.join(top, ["tree_id", "ancestor"], "left_semi").select("tree_id", "label", "node", F.col("dist").alias("depth"))


def ultrametric(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, min_depth, max_depth, is_ultrametric); NULL where a length is missing, false where all depths are 0."""
    d = tip_depths(edges, paths).groupBy("tree_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.count_if(F.col("depth").isNull()).alias("n"))
    crit = (F.col("hi") - F.col("lo")) / F.nullif("hi", F.lit(0.0))
    good = F.coalesce(crit <= ULTRAMETRIC_TOLERANCE, F.lit(False))
    return d.select("tree_id", F.when(F.col("n") == 0, F.col("lo")).alias("min_depth"), F.when(F.col("n") == 0, F.col("hi")).alias("max_depth"), F.when(F.col("n") == 0, good).alias("is_ultrametric"))


def grafen(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The trees with lengths by tips below: height (n - 1) / (N - 1), an edge being the difference; a tree of one tip has 0."""
    n = descendant_counts(edges, paths)
    total = tips(edges).groupBy("tree_id").agg(F.count("*").alias("N"))
    height = n.join(total, "tree_id").select("tree_id", "node", F.coalesce(F.try_divide(F.col("n_tips") - 1, F.col("N") - 1), F.lit(0.0)).alias("h"))
    up = height.select("tree_id", F.col("node").alias("parent"), F.col("h").alias("hp"))
    down = height.select("tree_id", F.col("node").alias("child"), F.col("h").alias("hc"))
    return edges.join(up, ["tree_id", "parent"]).join(down, ["tree_id", "child"]).withColumn("edge_length", F.col("hp") - F.col("hc")).select(*EDGE)


def unit_lengths(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_length", F.lit(1.0)).select(*EDGE)


def resolve_polytomies(edges: DataFrame) -> DataFrame:
    """Binary trees: the children of a wider node, in order, hang on a ladder of new nodes joined by edges of length 0.

    The ladder is fixed, not drawn at random. A new node's id is the tree's greatest id plus the id of the child that it
    holds, which keeps ids apart without numbering them across tasks. Trees without lengths keep none.
    """
    top = edges.groupBy("tree_id").agg((F.max(F.greatest("parent", "child")) + 1).alias("_max"), F.count_if(F.col("edge_length").isNotNull()).alias("_len"))
    wide = edges.groupBy("tree_id", "parent").agg(F.count("*").alias("_k")).where("_k > 2")
    e = edges.join(wide, ["tree_id", "parent"], "left").join(top, "tree_id")
    w = Window.partitionBy("tree_id", "parent").orderBy("child")
    ladder = e.where("_k > 2").withColumn("_r", F.row_number().over(w)).withColumn("_prev", F.lag("child").over(w))
    own = lambda c: F.col("_max") + F.col(c)
    holder = F.when(F.col("_r") == 1, F.col("parent")).when(F.col("_r") < F.col("_k"), own("child")).otherwise(own("_prev"))
    hung = ladder.select("tree_id", holder.alias("parent"), "child", "edge_length", "label", "is_tip")
    zero = F.when(F.col("_len") > 0, F.lit(0.0))
    new = ladder.where("_r > 1 and _r < _k").select(
        "tree_id", F.when(F.col("_r") == 2, F.col("parent")).otherwise(own("_prev")).alias("parent"), own("child").alias("child"),
        zero.alias("edge_length"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_tip"),
    )
    return e.where("_k is null").select(*EDGE).unionByName(hung).unionByName(new)


def phylo_covariance(edges: DataFrame, correlation: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """(tree_id, tip_i, tip_j, value) for tip_i <= tip_j: length of the path that two tips share from the root.

    correlation divides by the roots of the tips' depths; NULL where one is 0. Trees with a missing length give
    nothing. The result has a row per pair of tips of a tree, being its matrix.
    """
    whole = edges.groupBy("tree_id").agg(F.count_if(F.col("edge_length").isNull()).alias("n")).where("n = 0").select("tree_id")
    e = edges.join(whole, "tree_id", "left_semi")
    above = tip_ancestors(e, paths).select("tree_id", "label", F.col("ancestor").alias("child"))
    a = above.select("tree_id", F.col("label").alias("tip_i"), "child")
    b = above.select("tree_id", F.col("label").alias("tip_j"), "child")
    lengths = e.select("tree_id", "child", "edge_length")
    shared = a.join(lengths, ["tree_id", "child"]).join(b, ["tree_id", "child"]).where("tip_i <= tip_j").groupBy("tree_id", "tip_i", "tip_j").agg(F.sum("edge_length").alias("value"))
    depth = above.join(lengths, ["tree_id", "child"]).groupBy("tree_id", "label").agg(F.sum("edge_length").alias("d"))
    # pairs that share no edge meet in the root only
    at_root = roots(e).withColumnRenamed("root", "child")
    pairs = a.join(at_root, ["tree_id", "child"], "left_semi").join(b.join(at_root, ["tree_id", "child"], "left_semi"), ["tree_id"]).where("tip_i <= tip_j").select("tree_id", "tip_i", "tip_j")
    out = pairs.join(shared, ["tree_id", "tip_i", "tip_j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if not correlation:
        return out
    di = depth.select("tree_id", F.col("label").alias("tip_i"), F.col("d").alias("di"))
    dj = depth.select("tree_id", F.col("label").alias("tip_j"), F.col("d").alias("dj"))
    scaled = F.try_divide(F.col("value"), F.sqrt(F.col("di") * F.col("dj")))
    return out.join(di, ["tree_id", "tip_i"]).join(dj, ["tree_id", "tip_j"]).select("tree_id", "tip_i", "tip_j", scaled.alias("value"))


def _set_key(label: Column) -> list[Column]:
    """A set of labels as count and two 64-bit exclusive-or sums of hashes: 128 bits, whatever the size of the set."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), label)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), label)).alias("h2")]


def consecutive_pairs(edges: DataFrame) -> DataFrame:
    """(tree_a, tree_b): each tree with the next by id."""
    ids = edges.select(F.col("tree_id").alias("tree_a")).distinct()
    # ids of trees, one small row each; the window has to see all of them in order
    return ids.select("tree_a", F.lead("tree_a").over(Window.orderBy("tree_a")).alias("tree_b")).where("tree_b is not null")


def all_pairs(edges: DataFrame) -> DataFrame:
    """(tree_a, tree_b): every tree with every other, once, the smaller id first."""
    ids = edges.select(F.col("tree_id").alias("tree_a")).distinct()
    # a product, as large as the result is meant to be; one side is spread, for the ids of all trees are few bytes
    spread = ids.repartition(edges.sparkSession.sparkContext.defaultParallelism, "tree_a")
    return spread.join(ids.withColumnRenamed("tree_a", "tree_b"), F.col("tree_a") < F.col("tree_b"))


def _common_tips(edges: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(tree_a, tree_b, label) of labels that both trees of a pair have.

    Over all pairs trees meet by label, so that pairs without a common tip cost nothing; given pairs look up their labels.
    """
    t = tips(edges).where("label is not null").select("tree_id", "label").distinct()
    a, b = t.withColumnRenamed("tree_id", "tree_a"), t.withColumnRenamed("tree_id", "tree_b")
    if pairs is None:
        return a.join(b, "label").where("tree_a < tree_b").select("tree_a", "tree_b", "label")
    return pairs.join(a, "tree_a").join(b, ["tree_b", "label"]).select("tree_a", "tree_b", "label")


def compare_tips(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(tree_a, tree_b, n_shared, n_only_a, n_only_b, jaccard) of pairs of trees (tree_a, tree_b); without pairs, of all."""
    n = tips(edges).where("label is not null").groupBy("tree_id").agg(F.count_distinct("label").alias("n"))
    shared = _common_tips(edges, pairs).groupBy("tree_a", "tree_b").agg(F.count("*").alias("n_shared"))
    out = (all_pairs(edges) if pairs is None else pairs).join(shared, ["tree_a", "tree_b"], "left")
    for s in "ab":
        out = out.join(n.select(F.col("tree_id").alias(f"tree_{s}"), F.col("n").alias(f"n_{s}")), f"tree_{s}", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("tree_a", "tree_b", count("n_shared").alias("n_shared"), (count("n_a") - count("n_shared")).alias("n_only_a"), (count("n_b") - count("n_shared")).alias("n_only_b"))
    return out.withColumn("jaccard", F.col("n_shared") / F.greatest(F.lit(1), F.col("n_shared") + F.col("n_only_a") + F.col("n_only_b")))


def _shared_edges(edges: DataFrame, pairs: DataFrame | None, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(common tips of each pair; edges of each side of a pair, above the common tips, with the set below)."""
    common = _common_tips(edges, pairs)
    sets = common.groupBy("tree_a", "tree_b").agg(*_set_key(F.col("label")), F.min("label").alias("ref")).where("n >= 4")
    sets = sets.select("tree_a", "tree_b", F.col("n").alias("all_n"), F.col("h1").alias("all_1"), F.col("h2").alias("all_2"), "ref")
    common = cut(common.join(sets, ["tree_a", "tree_b"]))
    above = tip_ancestors(edges, paths).where("label is not null").select(F.col("tree_id"), "label", F.col("ancestor").alias("child"))
    sides = []
    for s in "ab":
        mine = common.withColumn("tree_id", F.col(f"tree_{s}")).join(above, ["tree_id", "label"])
        has_ref = F.bool_or(F.col("label") == F.col("ref")).alias("has_ref")
        sides.append(mine.groupBy("tree_a", "tree_b", "all_n", "all_1", "all_2", "tree_id", "child").agg(*_set_key(F.col("label")), has_ref).withColumn("side", F.lit(s)))
    return sets, cut(sides[0].unionByName(sides[1]))


def robinson_foulds(edges: DataFrame, pairs: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(tree_a, tree_b, rf): unrooted symmetric difference on the subtrees of common tips, NULL below four of them.

    A split is the side without a reference tip, as a 128-bit key; splits that set off less than two tips don't count.
    Without pairs, of all pairs of trees.
    """
    paths = closure(edges) if paths is None else paths
    _, below = _shared_edges(edges, pairs, paths)
    flip = lambda own, all_: F.when(F.col("has_ref"), F.col(own).bitwiseXOR(F.col(all_))).otherwise(F.col(own))
    splits = below.select(
        "tree_a", "tree_b", "side", F.when(F.col("has_ref"), F.col("all_n") - F.col("n")).otherwise(F.col("n")).alias("n"), "all_n", flip("h1", "all_1").alias("h1"), flip("h2", "all_2").alias("h2")
    ).where("n >= 2 and n <= all_n - 2").drop("all_n").distinct()
    single = splits.groupBy("tree_a", "tree_b", "n", "h1", "h2").agg(F.count("*").alias("k"))
    found = single.groupBy("tree_a", "tree_b").agg(F.count_if(F.col("k") == 1).alias("d"))
    enough = below.select("tree_a", "tree_b").distinct()
    rf = enough.join(found, ["tree_a", "tree_b"], "left").select("tree_a", "tree_b", F.coalesce("d", F.lit(0)).cast("double").alias("rf"))
    return (all_pairs(edges) if pairs is None else pairs).join(rf, ["tree_a", "tree_b"], "left")


def branch_correlation(edges: DataFrame, pairs: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(tree_a, tree_b, n_edges, branch_cor): Pearson correlation of the lengths of edges over the same common tips.

    Both trees are first taken down to their common tips: of nodes over the same tips the edges add up. NULL below four
    common tips, below two shared edges, where a length is missing or where lengths don't vary. Without pairs, of all
    pairs of trees.
    """
    paths = cut(closure(edges)) if paths is None else paths
    sets, below = _shared_edges(edges, pairs, paths)
    key = ["tree_a", "tree_b", "n", "h1", "h2"]
    lengths = edges.select("tree_id", "child", "edge_length")
    summed = below.where("n < all_n").join(lengths, ["tree_id", "child"], "left").groupBy(*key, "side").agg(
        F.when(F.count_if(F.col("edge_length").isNull()) == 0, F.sum("edge_length")).alias("bl")
    )
    at = lambda s: F.max(F.when(F.col("side") == s, F.col("bl")))
    both = summed.groupBy(*key).agg(F.count("*").alias("k"), at("a").alias("a"), at("b").alias("b")).where("k = 2")
    cor = both.groupBy("tree_a", "tree_b").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("gaps"), F.corr("a", "b").alias("r"),
        F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"),
    )
    good = (F.col("n_edges") >= 2) & (F.col("gaps") == 0) & (F.col("sa") > 0) & (F.col("sb") > 0)
    return (all_pairs(edges) if pairs is None else pairs).join(cor.select("tree_a", "tree_b", "n_edges", F.when(good, F.col("r")).alias("branch_cor")), ["tree_a", "tree_b"], "left")


def unique_tips(edges: DataFrame) -> DataFrame:
    """(tree_id, label) of labels that no other tree has."""
    t = tips(edges).where("label is not null").select("tree_id", "label").distinct()
    return t.groupBy("label").agg(F.count("*").alias("n"), F.min("tree_id").alias("tree_id")).where("n = 1").select("tree_id", "label")


def shared_tips(edges: DataFrame) -> DataFrame:
    """(label) of labels that all trees have."""
    t = tips(edges).where("label is not null").select("tree_id", "label").distinct()
    n = edges.select("tree_id").distinct().count()
    return t.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") == n).select("label")


def tip_set_gaps(edges: DataFrame) -> DataFrame:
    """(tree_id, n_tips, n_missing): tips of a tree, and labels of the whole sample that it lacks."""
    t = tips(edges).where("label is not null").select("tree_id", "label").distinct()
    total = t.select("label").distinct().count()
    return t.groupBy("tree_id").agg(F.count("*").alias("n_tips")).withColumn("n_missing", F.lit(total) - F.col("n_tips"))


def wanted_by_all(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names (name, pos) that each tree lacks: (tree_id, name, pos) for graft, and (tree_id, species, genus, reason) it would skip.

    Names meet trees by genus and never as a product that is shuffled; trees that have a name, in normal form, travel
    with the name.
    """
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    labels = tips(edges).where("label is not null")
    owners = labels.groupBy(normalise(F.col("label")).alias("name")).agg(F.collect_set("tree_id").alias("owners"))
    # no genus is empty: an empty one stands for none
    lists = wanted.join(owners, "name", "left").withColumn("g", F.coalesce(genus(spaced(F.col("name"))), F.lit("")))
    possible = labels.select("tree_id", genus(spaced(F.col("label"))).alias("g")).where("g is not null").distinct()
    absent = edges.select("tree_id").distinct().join(lists.select("g").distinct()).join(possible, ["tree_id", "g"], "left_anti")
    n = 8 * edges.sparkSession.sparkContext.defaultParallelism
    spread = lists.withColumn("s", F.pmod(F.xxhash64("name"), F.lit(SPREAD))).repartition(n, "g", "s")

    def lacking(trees: DataFrame) -> DataFrame:
        salted = trees.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
        return spread.join(salted, ["g", "s"]).where("owners is null or not array_contains(owners, tree_id)")

    skipped = lacking(absent).select(
        "tree_id", F.col("name").alias("species"), F.nullif("g", F.lit("")).alias("genus"), F.when(F.col("g") == "", "Could not extract genus from name").otherwise("No congener in tree").alias("reason")
    )
    return lacking(possible).select("tree_id", "name", "pos"), skipped


def count_lacking(edges: DataFrame, wanted: DataFrame) -> tuple[int, int]:
    """How many rows each table of wanted_by_all has, from counts by genus; names of wanted are distinct."""
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    labels = edges.where("is_tip and label is not null")
    possible = labels.select("tree_id", genus(spaced(F.col("label"))).alias("g")).where("g is not null").distinct()
    names = wanted.select("name", genus(spaced(F.col("name"))).alias("g"))
    owned = labels.select("tree_id", normalise(F.col("label")).alias("name")).distinct().join(names, "name")
    by_genus = names.groupBy("g").agg(F.count("*").alias("n")).join(possible.groupBy("g").agg(F.count("*").alias("k")), "g")
    met = (by_genus.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0) - owned.join(possible, ["tree_id", "g"], "left_semi").count()
    return met, edges.select("tree_id").distinct().count() * names.count() - owned.count() - met


GRAFTED = "tree_id string, parent bigint, child bigint, edge_length double, label string, is_tip boolean, species string, genus string, placed_near string, branch_length double, n_congeners bigint, kind string"


def graft(
    edges: DataFrame, species: DataFrame, branch_length: str = "congener_median", where: str = "genus", keep_ultrametric: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees with the species grafted, what was grafted, what was skipped and why).

    species: (tree_id, name, pos), grafted in the order of pos (unique in a tree) beside a tip of the same genus, those
    grafted before among them. where genus: in the middle of the terminal edge of the first congener by node; near: at
    the last common ancestor of all congeners (with one of them as genus). branch_length: congener_median,
    half_terminal (half the first congener's edge) or zero. If a tree was ultrametric and lengths aren't zero, grafted
    tips are set level with the others. On an edge of length 0 a tip hangs on the node above. Trees without lengths get
    none. NULL or blank names have no genus.

    Genera don't meet, so each genus of a tree is one group, sequential inside; a group has that genus's tips and
    names only. New ids follow the tree's greatest one by the species' rank.
    """
    if branch_length not in ("congener_median", "half_terminal", "zero") or where not in ("genus", "near"):
        raise ValueError("unknown branch_length or where")
    ship(edges.sparkSession)
    paths = cut(closure(edges))
    flat = ultrametric(edges, paths).select("tree_id", F.coalesce("is_ultrametric", F.lit(False)).alias("level"), F.col("max_depth").alias("target"))
    top = edges.groupBy("tree_id").agg(F.max(F.greatest("parent", "child")).alias("top"), F.count_if(F.col("edge_length").isNotNull()).alias("lengths"))
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    have = edges.where("is_tip").withColumn("genus", genus(spaced(F.col("label")))).join(
        tip_depths(edges, paths).select("tree_id", F.col("node").alias("child"), "depth"), ["tree_id", "child"], "left"
    )
    ranked = species.select("tree_id", F.col("name").alias("species"), "pos", genus(spaced(F.col("name"))).alias("genus"), F.row_number().over(Window.partitionBy("tree_id").orderBy("pos")).alias("rank"))
    possible = have.select("tree_id", "genus").where("genus is not null").distinct()
    skipped = ranked.join(possible, ["tree_id", "genus"], "left_anti").select(
        "tree_id", "species", "genus", F.when(F.col("genus").isNull(), "Could not extract genus from name").otherwise("No congener in tree").alias("reason")
    )
    wanted = ranked.where("genus is not null").join(possible, ["tree_id", "genus"], "left_semi")
    used = wanted.select("tree_id", "genus").distinct()
    mine = have.join(used, ["tree_id", "genus"], "left_semi")
    over = paths.join(mine.select("tree_id", "genus", F.col("child").alias("node")), ["tree_id", "node"]).groupBy("tree_id", "genus", "ancestor").agg(F.count("*").alias("n"), F.min("hops").alias("hops"))
    sizes = mine.groupBy("tree_id", "genus").agg(F.count("*").alias("n"))
    mrca = first_rows(over.join(sizes, ["tree_id", "genus", "n"]), ["tree_id", "genus"], ["hops", "ancestor"]).select("tree_id", "genus", F.col("ancestor").alias("mrca"))
    mrca = mrca.join(paths.join(roots(edges).withColumnRenamed("root", "ancestor"), ["tree_id", "ancestor"], "left_semi").select("tree_id", F.col("node").alias("mrca"), F.col("dist").alias("mrca_depth")), ["tree_id", "mrca"], "left")
    null = lambda t: F.lit(None).cast(t)
    rows = mine.select("tree_id", "genus", F.lit(0).alias("new"), F.col("child").alias("ord"), "label", "parent", "child", "edge_length", "depth").unionByName(
        wanted.select("tree_id", "genus", F.lit(1).alias("new"), F.col("rank").cast("bigint").alias("ord"), F.col("species").alias("label"), null("bigint").alias("parent"), null("bigint").alias("child"), null("double").alias("edge_length"), null("double").alias("depth"))
    )
    rows = rows.join(mrca, ["tree_id", "genus"], "left").join(flat, "tree_id", "left").join(top, "tree_id")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        value = lambda v: None if pd.isna(v) else v
        pdf = pdf.sort_values(["new", "ord"])
        lengths, level = int(pdf["lengths"].iloc[0]) > 0, bool(pdf["level"].iloc[0]) and keep_ultrametric and branch_length != "zero"
        target, base = value(pdf["target"].iloc[0]), int(pdf["top"].iloc[0])
        tips_ = [{"label": r.label, "parent": r.parent, "child": r.child, "len": value(r.edge_length), "depth": value(r.depth), "old": True} for r in pdf[pdf["new"] == 0].itertuples()]
        anc, anc_depth = value(pdf["mrca"].iloc[0]), value(pdf["mrca_depth"].iloc[0])
        inner, log = [], []
        known = sorted(t["len"] for t in tips_ if t["len"] is not None)  # kept sorted: a graft changes one length and adds one
        for r in pdf[pdf["new"] == 1].itertuples():
            first, n = tips_[0], len(tips_)
            bl = 0.0 if branch_length == "zero" else statistics.median(known) if branch_length == "congener_median" and known else (first["len"] or 0.0) / 2 if branch_length == "half_terminal" else 0.0
            tip_id, node_id = base + 2 * int(r.ord) - 1, base + 2 * int(r.ord)
            if where == "near" and n > 1 and anc is not None:
                parent, at, near = anc, anc_depth, "MRCA of " + ", ".join(t["label"].replace("_", " ") for t in tips_[:3])
            else:
                near = first["label"].replace("_", " ")
                half = (first["len"] if first["len"] is not None else 1.0) / 2
                if half > 0:
                    at = None if first["depth"] is None else first["depth"] - half
                    inner.append((node_id, first["parent"], half if lengths else None))
                    if first["len"] is not None:
                        del known[bisect_left(known, first["len"])]
                    first["parent"], first["len"], parent = node_id, half if lengths else None, node_id
                    if lengths:
                        insort(known, half)
                else:
                    parent, at = first["parent"], first["depth"]
                if n == 1:
                    anc, anc_depth = parent, at
            length = target - at if level and at is not None and target is not None else bl
            if lengths:
                insort(known, bl)  # levelling comes after all grafting and doesn't count in medians
            tips_.append({"label": r.label.replace(" ", "_"), "parent": parent, "child": tip_id, "len": length if lengths else None, "bl": bl, "depth": None if at is None else at + length, "old": False, "n": n, "near": near, "species": r.label})
        tree, g = pdf["tree_id"].iloc[0], pdf["genus"].iloc[0]
        for t in tips_:
            extra = (None, g, None, None, None, "tip") if t["old"] else (t["species"], g, t["near"], t["bl"], t["n"], "grafted")
            log.append((tree, t["parent"], t["child"], t["len"], t["label"], True, *extra))
        log += [(tree, p, i, n, None, False, None, g, None, None, None, "inner") for i, p, n in inner]
        out = pd.DataFrame(log, columns=[c.split()[0] for c in GRAFTED.split(", ")])
        return out.astype({"parent": "int64", "child": "int64", "n_congeners": "Int64"})

    placed = cut(rows.groupBy("tree_id", "genus").applyInPandas(place, GRAFTED))
    rest = edges.join(placed.where("kind = 'tip'").select("tree_id", "child"), ["tree_id", "child"], "left_anti").select(*EDGE)
    augmented = placed.where("kind = 'grafted'").select("tree_id", "species", "genus", "placed_near", "branch_length", F.lit(f"{where}/{branch_length}").alias("method"), "n_congeners")
    return rest.unionByName(placed.select(*EDGE)), augmented, skipped



def _hung(first: float | None, known: list[float], lengths: bool, names: int, branch_length: str) -> tuple[np.ndarray, int, np.ndarray]:
    """(the half that each graft takes, how many of them split the first tip's edge, branch lengths), as graft() has them.

    The first tip's edge is halved each time. Once what is left of it is less than the median, it no longer moves it, and
    neither does a median added to its own list: all further ones are the same.
    """
    start = 1.0 if first is None else first
    if not lengths:
        return np.full(names, 0.5), names, np.zeros(names)
    halves = np.multiply.accumulate(np.append(start, np.full(names, 0.5)))[1:] if start > 0 else np.full(names, start / 2)
    splits = int(np.count_nonzero(halves > 0))
    bl = np.zeros(names)
    if branch_length == "half_terminal":
        bl = halves.copy()
        bl[:1] = (first or 0.0) / 2
    if branch_length == "congener_median":
        known = sorted(known)
        for k in range(names):
            bl[k] = statistics.median(known) if known else 0.0
            if known and (k >= splits or (first is not None and first < bl[k])):
                bl[k:] = bl[k]
                break
            if k < splits:
                if first is not None:
                    del known[bisect_left(known, first)]
                first = float(halves[k])
                insort(known, first)
            insort(known, float(bl[k]))
    return halves, splits, bl


#: Names that meet trees in one task: so many different labels that Parquet still writes each of them once.
NAMES_TOGETHER = 30_000
#: Names whose places are found in one task, and trees that meet them in one.
PLACES_TOGETHER = 500_000
TREES_TOGETHER = 2_000


def _numbered(names: DataFrame, n: int) -> DataFrame:
    """names with `at`, their place by pos (and name) from 0, found in tasks of some PLACES_TOGETHER of the n names."""
    k = -(-n // PLACES_TOGETHER)
    cuts = names.approxQuantile("pos", [i / k for i in range(1, k)], 0.01 / k) if k > 1 else []
    part = reduce(lambda p, c: p + (F.col("pos") > c).cast("int"), cuts, F.lit(0))
    names = names.withColumn("part", part)
    before = F.lit(0).cast("bigint")
    if cuts:
        sizes = {r["part"]: r["count"] for r in names.groupBy("part").count().collect()}
        for p in sizes:
            before = F.when(F.col("part") == p, F.lit(sum(k for q, k in sizes.items() if q < p))).otherwise(before)
    return names.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("pos", "name")) - 1 + before).drop("part")


def graft_all(edges: DataFrame, wanted: DataFrame, branch_length: str = "congener_median", where: str = "genus", keep_ultrametric: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graft() of the names (name, pos) onto every tree, each with those that it lacks; where near goes through graft()."""
    lacking, skipped = wanted_by_all(edges, wanted)
    if where != "genus":
        return *graft(edges, lacking, branch_length, where, keep_ultrametric)[:2], skipped
    return grafted_trees(edges, wanted, branch_length, keep_ultrametric), grafted_all(edges, wanted, branch_length), skipped


def grafted_trees(edges: DataFrame, wanted: DataFrame, branch_length: str = "congener_median", keep_ultrametric: bool = True) -> DataFrame:
    """The trees of graft_all (where genus).

    They have a row or two per tree and name, which are first made where they are written and never shuffled. What
    names in the places before do to a tree is computed first, from the genera of all names in their order, as numbers;
    then trees meet the names themselves, NAMES_TOGETHER at a time.
    """
    if branch_length not in ("congener_median", "half_terminal", "zero"):
        raise ValueError("unknown branch_length or where")
    spark = edges.sparkSession
    ship(spark)
    paths = cut(closure(edges))
    flat = ultrametric(edges, paths).select("tree_id", F.coalesce("is_ultrametric", F.lit(False)).alias("level"), F.col("max_depth").alias("target"))
    top = edges.groupBy("tree_id").agg(F.max(F.greatest("parent", "child")).alias("top"), (F.count("edge_length") > 0).alias("lengths"))
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    labels = edges.where("is_tip and label is not null").select(*EDGE, genus(spaced(F.col("label"))).alias("genus"), normalise(F.col("label")).alias("name"))
    names = wanted.groupBy("name").agg(F.min("pos").alias("pos")).withColumn("genus", genus(spaced(F.col("name")))).where("genus is not null")
    found = cut(names.join(labels.select("genus").distinct(), "genus", "left_semi"))
    genera = cut(found.select("genus").distinct().withColumn("code", F.row_number().over(Window.orderBy("genus")) - 1))
    n, kinds = found.count(), genera.count()
    names = cut(_numbered(found.join(genera, "genus"), n).select("name", "code", "at"))
    discard(found)
    chunks, tasks = max(1, -(-n // NAMES_TOGETHER)), 2 * spark.sparkContext.defaultParallelism
    owned = labels.join(names, "name").groupBy("tree_id").agg(F.collect_set("at").alias("owned"))
    tips_ = labels.join(genera, "genus").join(tip_depths(edges, paths).select("tree_id", F.col("node").alias("child"), "depth"), ["tree_id", "child"], "left")
    tips_ = tips_.groupBy("tree_id").agg(F.collect_list(F.struct("code", "child", "parent", "edge_length", "depth", "label")).alias("tips"))
    trees = cut(tips_.join(flat, "tree_id", "left").join(top, "tree_id").join(owned, "tree_id", "left"))
    discard(paths)
    blocks = max(-(-3 * tasks // chunks), -(-trees.count() // TREES_TOGETHER))
    narrow = "array<tinyint>" if kinds < 2**7 else "array<smallint>" if kinds < 2**15 else "array<int>"
    chunked = names.groupBy(F.expr(f"at div {NAMES_TOGETHER}").alias("chunk"))
    by_place = lambda *cols: chunked.agg(F.sort_array(F.collect_list(F.struct("at", *cols))).alias("some")).select("chunk", *[F.col(f"some.{c}").cast(narrow if c == "code" else "array<string>").alias(f"{c}s") for c in cols])
    order = by_place("code").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = trees.withColumn("task", F.pmod(F.xxhash64("tree_id"), F.lit(tasks)).cast("int")).unionByName(order, allowMissingColumns=True)
    dealt = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions(F.col("chunk").asc_nulls_last())
    size = NAMES_TOGETHER

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each tree is where each chunk of the names begins."""
        parts, code = [], None
        for batch in batches:
            for i, some in enumerate(batch["codes"]):
                if some.is_valid:
                    parts.append(np.asarray(some.values).astype(np.int32))
                    continue
                r = {c: batch[c][i].as_py() for c in batch.schema.names if c != "codes"}
                if code is None:
                    code = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                    by_code = np.argsort(code, kind="stable").astype(np.int32)
                    most = int(code.max(initial=-1)) + 1
                if len(code):
                    yield from _begun(r, code, by_code, most, size, branch_length)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first tips as they then are, grafted tips and their nodes."""
        code = None
        for batch in batches:
            for i, chunk in enumerate(batch["names"]):
                if chunk.is_valid:
                    text = pc.replace_substring(pa.array(chunk.values, pa.string()), " ", "_")
                    code = np.asarray(batch["codes"][i].values).astype(np.int64)
                    by_code = np.argsort(code, kind="stable")
                else:
                    yield from _placed({c: batch[c][i].as_py() if c in ("tree_id", "first_label") else batch[c][i] for c in BEGUN.names}, code, by_code, text, keep_ultrametric and branch_length != "zero")

    at_start = dealt.select("tree_id", "tips", "level", "target", "top", "lengths", "owned", "codes").mapInArrow(begun, _ddl(BEGUN))
    place = lambda block: (F.col("chunk") * blocks + block).cast("int")
    texts = by_place("name", "code").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("task", place(F.col("block"))).drop("block")
    meet = at_start.withColumn("task", place(F.pmod(F.xxhash64("tree_id"), F.lit(blocks)))).unionByName(texts, allowMissingColumns=True)
    meet = meet.repartitionById(chunks * blocks, F.col("task")).sortWithinPartitions(F.col("tree_id").asc_nulls_first()).drop("task")
    firsts = labels.join(genera, "genus", "left_semi").groupBy("tree_id", "genus").agg(F.min("child").alias("child")).select("tree_id", "child")
    return edges.join(firsts, ["tree_id", "child"], "left_anti").select(*EDGE).unionByName(meet.mapInArrow(placed, _ddl(PLACED)))


def _begun(r: dict, code: np.ndarray, by_code: np.ndarray, most: int, size: int, branch_length: str) -> Iterator[pa.RecordBatch]:
    """Rows of BEGUN of one tree: code has the genus of each name, by_code their places by genus."""
    has, base, chunks = bool(r["lengths"]), r["top"], -(-len(code) // size)
    groups: dict[int, list[dict]] = {}
    for t in sorted(r["tips"], key=lambda t: t["child"]):
        groups.setdefault(t["code"], []).append(t)
    own = np.array(sorted(groups), np.int64)
    slot = np.full(most, -1, np.int32)
    slot[own] = np.arange(len(own))
    mask = (slot >= 0)[code]
    out = np.array(sorted(r["owned"] or []), np.int64)
    mask[out] = False
    rank = np.cumsum(mask, dtype=np.int64)
    o = by_code[mask[by_code]]
    per = np.bincount(slot[code[o]].astype(np.int64) * chunks + o // size, minlength=len(own) * chunks).reshape(len(own), chunks)
    names = per.sum(axis=1)
    starts = np.cumsum(names) - names
    done = np.cumsum(per, axis=1) - per
    bls, splits, left = [], np.zeros(len(own), np.int64), []
    for i, g in enumerate(own):
        first, k = groups[g][0]["edge_length"], int(names[i])
        few = min(k, MOST_HALVINGS)
        halves, s, bl = _hung(first, [t["edge_length"] for t in groups[g] if t["edge_length"] is not None], has, few, branch_length)
        splits[i] = s if has else k
        bls.append(bl[: np.max(np.flatnonzero(bl[1:] != bl[:-1]), initial=-1) + 2] if k else np.zeros(1))
        left.append(None if splits[i] and not has else float(halves[s - 1]) if splits[i] else first)
    parent = np.array([groups[g][0]["parent"] for g in own], np.int64)
    node = np.append(base + 2 * rank[o], 0)

    def above(k: np.ndarray) -> np.ndarray:
        """What the next tip hangs on after k names of each genus."""
        q = np.minimum(k, splits)
        return np.where(q > 0, node[np.where(q > 0, starts + q - 1, -1)], parent)

    value = lambda k, none=np.nan: [none if (v := groups[g][0][k]) is None else v for g in own]
    fixed = {
        "tree_id": r["tree_id"], "base": base, "lengths": has, "target": r["target"] if r["level"] else None, "code": own, "splits": splits, "start": value("edge_length", 1.0), "depth": value("depth"),
        "bl": np.concatenate(bls), "bls": [len(b) for b in bls],
    }
    rows = []
    for c in range(chunks):
        if c and not per[:, c].any():
            continue
        lo = c * size
        here = out[(out >= lo) & (out < lo + size)] - lo
        firsts = {"first_parent": above(names), "first_child": value("child"), "first_left": left, "first_label": value("label")} if c == 0 else {}
        rows.append(fixed | firsts | {"chunk": c, "rank": int(rank[lo - 1]) if lo else 0, "done": done[:, c], "above": above(done[:, c]), "owned": here})
    yield pa.RecordBatch.from_pylist([{f.name: x.get(f.name) for f in BEGUN} for x in rows], BEGUN)


def _placed(r: dict, code: np.ndarray, by_code: np.ndarray, text: pa.Array, may_level: bool) -> Iterator[pa.RecordBatch]:
    """Rows of PLACED that the names of one chunk make in one tree."""
    array = lambda c: np.asarray(r[c].values)
    tree, base, has, target = r["tree_id"], r["base"].as_py(), r["lengths"].as_py(), r["target"].as_py()
    own, splits, lengths_of, bls = array("code"), array("splits"), array("bl"), array("bls")
    if r["first_child"].is_valid:
        yield from _batches([tree, array("first_parent"), array("first_child"), r["first_left"].values, pa.array(r["first_label"], pa.string()), True], PLACED, len(own))
    slot = np.full(max(int(code.max(initial=0)), int(own.max(initial=0))) + 1, -1, np.int64)
    slot[own] = np.arange(len(own))
    mask = (slot >= 0)[code]
    mask[array("owned")] = False
    node_of = base + 2 * (r["rank"].as_py() + np.cumsum(mask))
    o = by_code[mask[by_code]]
    if not len(o):
        return
    g, node = slot[code[o]], node_of[o]
    per = np.bincount(g, minlength=len(own))
    begin = np.cumsum(per) - per
    nth = np.arange(len(o)) - begin[g]
    j = array("done")[g] + nth
    split = j < splits[g]
    before = np.where(nth > 0, np.append(node[:1], node[:-1]), array("above")[g])
    halves = np.ldexp(array("start")[g], -(np.minimum(j, MOST_HALVINGS) + 1)) if has else np.full(len(o), 0.5)
    ends = np.cumsum(bls)
    bl = lengths_of[(ends - bls)[g] + np.minimum(j, bls[g] - 1)]
    # past the last split all hang on its node, which may be of a chunk before
    last = np.clip(splits - array("done"), 0, per)
    hung = np.where(last > 0, node[np.minimum(begin + np.maximum(last, 1) - 1, len(node) - 1)], array("above"))
    at = array("depth")[g]
    at = np.where(split, at - halves, at)
    tip_length = np.where(np.isnan(at), bl, target - at) if may_level and target is not None else bl
    none = lambda n: pa.nulls(n, pa.float64())
    yield from _batches([tree, np.where(split, node, hung[g]), node - 1, tip_length if has else none(len(o)), text.take(pa.array(o)), True], PLACED, len(o))
    k = int(split.sum())
    yield from _batches([tree, before[split], node[split], halves[split] if has else none(k), None, False], PLACED, k)


BEGUN = pa.schema([
    ("tree_id", pa.string()), ("chunk", pa.int64()), ("rank", pa.int64()), ("base", pa.int64()), ("lengths", pa.bool_()), ("target", pa.float64()), ("code", pa.list_(pa.int64())), ("done", pa.list_(pa.int64())), ("above", pa.list_(pa.int64())),
    ("splits", pa.list_(pa.int64())), ("start", pa.list_(pa.float64())), ("depth", pa.list_(pa.float64())), ("bl", pa.list_(pa.float64())), ("bls", pa.list_(pa.int64())), ("owned", pa.list_(pa.int64())),
    ("first_parent", pa.list_(pa.int64())), ("first_child", pa.list_(pa.int64())), ("first_left", pa.list_(pa.float64())), ("first_label", pa.list_(pa.string())),
])


#: Names of a genus that are written out together where they meet the trees with that genus.
TOGETHER = 2_000
#: No length can be halved so often before it is 0.
MOST_HALVINGS = 2_200


def grafted_all(edges: DataFrame, wanted: DataFrame, branch_length: str = "congener_median") -> DataFrame:
    """What graft_all says of the names that it grafts (where genus), without making the trees.

    All that differs between the names of a genus of a tree are their places and the first few branch lengths, so a row
    per tree and genus is computed, and rows per name are written out where it meets the names, in runs of TOGETHER.
    """
    if branch_length not in ("congener_median", "half_terminal", "zero"):
        raise ValueError("unknown branch_length")
    ship(edges.sparkSession)
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    named = wanted.groupBy("name").agg(F.min("pos").alias("pos")).withColumn("genus", genus(spaced(F.col("name")))).where("genus is not null")
    named = cut(named.select("name", "genus", (F.row_number().over(Window.partitionBy("genus").orderBy("pos", "name")) - 1).alias("at")))
    labels = edges.where("is_tip and label is not null")
    firsts = labels.withColumn("genus", genus(spaced(F.col("label")))).where("genus is not null").groupBy("tree_id", "genus").agg(
        F.min(F.struct("child", "label", "edge_length")).alias("tip"), F.sort_array(F.collect_list("edge_length")).alias("known"), F.count("*").alias("n")
    )
    owned = labels.select("tree_id", normalise(F.col("label")).alias("name")).distinct().join(named, "name").groupBy("tree_id", "genus").agg(F.collect_list("at").alias("owned"))
    lengths = edges.groupBy("tree_id").agg((F.count("edge_length") > 0).alias("lengths"))

    @F.pandas_udf("array<double>")
    def hung(first: pd.Series, known: pd.Series, lengths: pd.Series, names: pd.Series) -> pd.Series:
        """Branch lengths as far as they differ; all further ones are like the last."""
        out = []
        for f, k, has, n in zip(first, known, lengths, names):
            bl = _hung(None if pd.isna(f) else f, list(k), bool(has), min(int(n), MOST_HALVINGS), branch_length)[2]
            out.append(bl[: np.max(np.flatnonzero(bl[1:] != bl[:-1]), initial=-1) + 2])
        return pd.Series(out)

    none = F.array().cast("array<int>")
    per = firsts.join(named.groupBy("genus").agg(F.count("*").alias("names")), "genus").join(owned, ["tree_id", "genus"], "left").join(lengths, "tree_id")
    per = per.withColumn("owned", F.coalesce("owned", none)).where("names > size(owned)")
    # a table, so that lengths are computed once and before rows are repeated
    per = cut(per.select("tree_id", "genus", F.regexp_replace("tip.label", "_", " ").alias("placed_near"), hung("tip.edge_length", "known", "lengths", F.expr("names - size(owned)")).alias("bl"), "n", "names", "owned"))
    runs = named.groupBy("genus", F.expr(f"at div {TOGETHER}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("some")).select("genus", "run", F.col("some.name").alias("some"))
    meet = per.withColumn("run", F.explode(F.expr(f"sequence(0, (names - 1) div {TOGETHER})"))).withColumns({
        "before": F.expr(f"run * {TOGETHER} - size(filter(owned, i -> i < run * {TOGETHER}))"), "owned": F.expr(f"filter(owned, i -> i div {TOGETHER} = run)")
    }).drop("names")
    n = 8 * edges.sparkSession.sparkContext.defaultParallelism
    # sorted by genus, so that equal names are written one after the other
    met = meet.repartition(n, "genus", "run").hint("merge").join(runs.repartition(n, "genus", "run"), ["genus", "run"])
    lacked = F.when(F.size("owned") == 0, F.col("some")).otherwise(F.array_except("some", F.expr(f"transform(owned, i -> some[int(i - run * {TOGETHER})])")))
    rows = met.select("tree_id", "genus", "placed_near", "bl", "n", "before", F.posexplode(lacked).alias("i", "species"))
    at = F.col("before") + F.col("i")
    return rows.select(
        "tree_id", "species", "genus", "placed_near", F.expr("bl[int(least(before + i, size(bl) - 1))]").alias("branch_length"), F.lit(f"genus/{branch_length}").alias("method"), (F.col("n") + at).alias("n_congeners")
    )


PLACED = pa.schema([("tree_id", pa.string()), ("parent", pa.int64()), ("child", pa.int64()), ("edge_length", pa.float64()), ("label", pa.string()), ("is_tip", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}
    kinds |= {pa.list_(k): f"array<{v}>" for k, v in kinds.items()}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batches(columns: list, schema: pa.Schema, n: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of columns, of which those that are no arrays hold for all n rows."""
    if not n:
        return
    whole = [c if isinstance(c, pa.Array) else pa.array(c, f.type) if isinstance(c, np.ndarray) else pa.repeat(pa.scalar(c, f.type), n) for c, f in zip(columns, schema)]
    out = pa.RecordBatch.from_arrays(whole, schema=schema)
    yield from (out.slice(i, most) for i in range(0, n, most))
