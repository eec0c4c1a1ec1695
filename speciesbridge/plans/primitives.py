"""Queries on entry points and on the relational primitives below the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relational import first_rows, names, occurring_once, without
from ..operators.reconcile import reconcile_data, reconcile_tree, reconcile_trees
from ..operators.trees import tips
from ..runtime import table
from ..sources.treefiles import first_tree
from . import sqlparts as S
from .registry import Registry

REGISTRY = Registry()
FIRST = "(SELECT min(tree_id) FROM tree_edges)"
SECOND = f"(SELECT min(tree_id) FROM tree_edges WHERE tree_id > {FIRST})"


def _tree(which: str) -> tuple[str, str, str]:
    return (f"(SELECT label, child FROM tree_edges WHERE is_tip AND tree_id = {which})", "label", "child")


@REGISTRY.add("reconcile_data", S.cascade(("trait_records", "species", "rec_id"), ("crosswalk", "from_name", "xw_id")) + f"SELECT {S.COLS} FROM result")
def data(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile_data(table(spark, folder, "trait_records"), table(spark, folder, "crosswalk"), None, "from_name", "rec_id", "xw_id", authority=None).mapping


@REGISTRY.add("reconcile_tree", S.cascade(("trait_records", "species", "rec_id"), _tree(FIRST), rank="subspecies") + f"SELECT {S.COLS} FROM result")
def tree(spark: SparkSession, folder: str) -> DataFrame:
    first = first_tree(table(spark, folder, "tree_edges"))
    return reconcile_tree(table(spark, folder, "trait_records"), first, "species", "rec_id", authority=None, rank="subspecies").mapping


@REGISTRY.add("reconcile_trees", S.cascade(_tree(FIRST), _tree(SECOND), fuzzy=True) + f"SELECT {S.COLS} FROM result")
def trees(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "tree_edges")
    first = first_tree(edges)
    second = first_tree(without(edges, first.select("tree_id").distinct(), "tree_id"))
    return reconcile_trees(first, second, authority=None, fuzzy=True).mapping


@REGISTRY.add("distinct_names", "SELECT name_x AS name, min(map_id) AS pos FROM mapping WHERE name_x IS NOT NULL GROUP BY name_x")
def distinct_names(spark: SparkSession, folder: str) -> DataFrame:
    return names(table(spark, folder, "mapping"), "name_x", "map_id")


@REGISTRY.add("species_list", "SELECT DISTINCT name_y AS name FROM mapping WHERE name_y IS NOT NULL")
def species_list(spark: SparkSession, folder: str) -> DataFrame:
    return names(table(spark, folder, "mapping"), "name_y", "map_id").select("name")


@REGISTRY.add("names_only_in_x", "SELECT DISTINCT species AS name FROM trait_records WHERE species IS NOT NULL AND species NOT IN (SELECT name_x FROM mapping WHERE name_x IS NOT NULL)")
def only_in_x(spark: SparkSession, folder: str) -> DataFrame:
    return without(names(table(spark, folder, "trait_records"), "species", "rec_id"), table(spark, folder, "mapping"), "name", "name_x").select("name")


@REGISTRY.add("names_in_both", "SELECT DISTINCT species AS name FROM trait_records WHERE species IN (SELECT name_x FROM mapping)")
def in_both(spark: SparkSession, folder: str) -> DataFrame:
    x, y = names(table(spark, folder, "trait_records"), "species", "rec_id"), names(table(spark, folder, "mapping"), "name_x", "map_id")
    return x.select("name").join(y.select("name"), "name")


@REGISTRY.add("names_in_any", "SELECT species AS name FROM trait_records WHERE species IS NOT NULL UNION SELECT name_x FROM mapping WHERE name_x IS NOT NULL UNION SELECT label FROM tree_edges WHERE is_tip AND label IS NOT NULL")
def in_any(spark: SparkSession, folder: str) -> DataFrame:
    parts = names(table(spark, folder, "trait_records"), "species", "rec_id").unionByName(names(table(spark, folder, "mapping"), "name_x", "map_id"))
    labels = tips(table(spark, folder, "tree_edges")).where("label is not null").select(F.col("label").alias("name"))
    return parts.select("name").unionByName(labels).distinct()


@REGISTRY.add("first_per_name", "SELECT map_id, name_x, name_y FROM " + S.first("mapping", "name_x", "map_id", "name_x IS NOT NULL"))
def first_per_name(spark: SparkSession, folder: str) -> DataFrame:
    return first_rows(table(spark, folder, "mapping").where("name_x is not null"), ["name_x"], ["map_id"]).select("map_id", "name_x", "name_y")


@REGISTRY.add("names_once", """WITH b AS (SELECT *, count(*) OVER (PARTITION BY from_name) AS cx, count(*) OVER (PARTITION BY to_name) AS cy FROM crosswalk WHERE from_name IS NOT NULL AND to_name IS NOT NULL)
SELECT xw_id, from_name, to_name FROM b WHERE cx = 1 AND cy = 1""")
def once(spark: SparkSession, folder: str) -> DataFrame:
    return occurring_once(table(spark, folder, "crosswalk").where("from_name is not null and to_name is not null"), ["from_name", "to_name"]).select("xw_id", "from_name", "to_name")
