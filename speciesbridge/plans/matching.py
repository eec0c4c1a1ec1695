"""Queries on names and on the matching cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import genus, normalise, word
from ..functions.relational import names
from ..functions.schema import MAPPING
from ..operators.cascade import Cascade, cascade, unused_counts
from ..operators.fuzzy import suggestions
from ..operators.reconcile import reconcile_multi, reconcile_to_tree_set, tip_names
from ..operators.synonyms import resolve_names
from ..runtime import table
from ..sources.ingest import binomial_shares
from . import sqlparts as S
from .registry import Registry

REGISTRY = Registry()

SPECIES, TARGETS = ("trait_records", "species", "rec_id"), ("mapping", "name_y", "map_id")
CLEAN_X, CLEAN_Y = ("crosswalk", "from_name", "xw_id"), ("tree_edges", "label", "child")


def _names(spark: SparkSession, folder: str, side: tuple[str, str, str]) -> DataFrame:
    return names(table(spark, folder, side[0]), side[1], side[2])


def _taxa(spark: SparkSession, folder: str) -> DataFrame:
    """The crosswalk read as an authority: its to-names are accepted, its from-names synonyms of them."""
    cw = table(spark, folder, "crosswalk").where("to_name is not null")
    first = cw.groupBy("to_name").agg(F.min("xw_id").alias("a"))
    none = F.lit(None).cast("string")
    accepted = first.select(F.col("to_name").alias("scientificName"), F.concat(F.lit("A"), "a").alias("taxonID"), none.alias("acceptedNameUsageID"), F.lit("accepted").alias("taxonomicStatus"), (2 * F.col("a") + 1).alias("ord"))
    synonyms = cw.where("from_name is not null").join(first, "to_name").select(F.col("from_name").alias("scientificName"), F.concat(F.lit("S"), "xw_id").alias("taxonID"), F.concat(F.lit("A"), "a").alias("acceptedNameUsageID"), F.lit("synonym").alias("taxonomicStatus"), (2 * F.col("xw_id")).alias("ord"))
    return accepted.unionByName(synonyms)


def _lookup(spark: SparkSession, folder: str, *sides: tuple[str, str, str]) -> DataFrame:
    asked = [_names(spark, folder, s).select(normalise(F.col("name")).alias("name")) for s in sides]
    both = asked[0]
    for a in asked[1:]:
        both = both.unionByName(a)
    return resolve_names(both.where("name <> ''"), _taxa(spark, folder), "col")


def _overrides(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "override_batch").select("name_x", "name_y", F.col("note").alias("user_note"), F.col("override_id").alias("pos"))


def _cascade(spark: SparkSession, folder: str, x, y, with_overrides: bool = False, with_lookup: bool = False, **options) -> Cascade:
    return cascade(
        _names(spark, folder, x), _names(spark, folder, y), overrides=_overrides(spark, folder) if with_overrides else None,
        lookup=_lookup(spark, folder, x, y) if with_lookup else None, **options,
    )


for _rank in ("species", "subspecies"):

    @REGISTRY.add(f"norm_{_rank}", f"SELECT map_id, name_x AS raw, {S.NORM('name_x', _rank)} AS normalised, name_x <> {S.NORM('name_x', _rank)} AS changed FROM mapping")
    def norm(spark: SparkSession, folder: str, rank: str = _rank) -> DataFrame:
        n = normalise(F.col("name_x"), rank)
        return table(spark, folder, "mapping").select("map_id", F.col("name_x").alias("raw"), n.alias("normalised"), (F.col("name_x") != n).alias("changed"))


@REGISTRY.add("name_words", f"""SELECT map_id, nullif(split_part(n, ' ', 1), '') AS genus, CASE WHEN contains(n, ' ') THEN split_part(n, ' ', 2) END AS epithet
FROM (SELECT map_id, {S.NORM('name_y')} AS n FROM mapping)""")
def name_words(spark: SparkSession, folder: str) -> DataFrame:
    n = normalise(F.col("name_y"))
    return table(spark, folder, "mapping").select("map_id", n.alias("n")).select("map_id", genus(F.col("n")).alias("genus"), word(F.col("n"), 1).alias("epithet"))


@REGISTRY.add("detect_species_column", "SELECT column_name, n_values, n_binomial FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (length({c}) > 0) AS n_values, count(*) FILTER (regexp_matches({c}, '^[A-Z][a-z]+ [a-z]+')) AS n_binomial FROM trait_records" for c in ("dataset_x", "species", "sex")) + ")")
def detect_species_column(spark: SparkSession, folder: str) -> DataFrame:
    return binomial_shares(table(spark, folder, "trait_records"))


def _add(name: str, x, y, sql_options: dict, **options) -> None:
    @REGISTRY.add(name, S.cascade(x, y, **sql_options) + f"SELECT {S.COLS} FROM result")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _cascade(spark, folder, x, y, **options).mapping


_add("cascade_normalised", SPECIES, TARGETS, {}, authority=None)
_add("cascade_normalised_subspecies", SPECIES, TARGETS, {"rank": "subspecies"}, authority=None, rank="subspecies")
_add("cascade_multi_x", SPECIES, TARGETS, {"multi_x": True}, authority=None, multi_x=True)
_add("cascade_synonym", SPECIES, CLEAN_Y, {"authority": True}, with_lookup=True)
_add("cascade_synonym_first", SPECIES, CLEAN_Y, {"authority": True, "resolve": "first"}, with_lookup=True, resolve="first")
_add("cascade_fuzzy_flag", CLEAN_X, CLEAN_Y, {"fuzzy": True}, authority=None, fuzzy=True)
_add("cascade_fuzzy_first", CLEAN_X, CLEAN_Y, {"fuzzy": True, "resolve": "first", "threshold": 0.85}, authority=None, fuzzy=True, resolve="first", fuzzy_threshold=0.85)
_add("cascade_overrides", SPECIES, TARGETS, {"overrides": True}, authority=None, with_overrides=True)
_add("cascade_full", CLEAN_X, CLEAN_Y, {"overrides": True, "authority": True, "fuzzy": True, "flag": 0.93}, with_overrides=True, with_lookup=True, fuzzy=True, flag_threshold=0.93)


@REGISTRY.add("unused_overrides", S.cascade(SPECIES, TARGETS, overrides=True) + "SELECT name_x, name_y, reason FROM unused")
def unused_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return _cascade(spark, folder, SPECIES, TARGETS, with_overrides=True, authority=None).unused_overrides


@REGISTRY.add("unused_override_counts", S.cascade(SPECIES, TARGETS, overrides=True) + "SELECT reason, count(*) AS n FROM unused GROUP BY reason")
def unused_override_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unused_counts(_cascade(spark, folder, SPECIES, TARGETS, with_overrides=True, authority=None).unused_overrides)


@REGISTRY.add("authority_lookup", "WITH " + S.side("xs", *SPECIES) + ", " + S.lookup("SELECT norm FROM xs WHERE norm <> ''") + " SELECT input, accepted_name, status, taxon_id, 'col' AS authority FROM lookup")
def authority_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _lookup(spark, folder, SPECIES)


SUGGEST = "WITH " + S.side("xs", *CLEAN_X) + ", " + S.side("ys", *CLEAN_Y) + f""", alike AS {S.alike("(SELECT * FROM xs WHERE norm NOT IN (SELECT norm FROM ys))", "ys", 0.7)}
SELECT name_x AS unresolved, name_y AS suggestion, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name_x ORDER BY score DESC, genus_y, pos_y, name_y) AS rn FROM alike) WHERE rn <= 3"""


@REGISTRY.add("suggest_topn", SUGGEST)
def suggest_topn(spark: SparkSession, folder: str) -> DataFrame:
    norm = lambda side: _names(spark, folder, side).withColumn("norm", normalise(F.col("name")))
    y = norm(CLEAN_Y)
    open_x = norm(CLEAN_X).join(y.select("norm"), "norm", "left_anti")
    return suggestions(open_x.select("name", "pos", "norm"), y, 3, 0.7)


def _tree_set_sql() -> str:
    left = lambda s, *stages: f"(SELECT * FROM {s} WHERE " + " AND ".join(["true"] + [f"NOT EXISTS (SELECT 1 FROM {t} WHERE {t}.tree_id = {s}.tree_id AND {t}.name_{s[0]} = {s}.name)" for t in stages]) + ")"
    return f"""WITH {S.side('nx', *SPECIES)},
ys AS MATERIALIZED (SELECT tree_id, label AS name, min(child) AS pos, {S.NORM('label')} AS norm FROM tree_edges WHERE is_tip AND label IS NOT NULL GROUP BY 1, 2),
xs AS MATERIALIZED (SELECT t.tree_id, nx.* FROM nx, (SELECT DISTINCT tree_id FROM ys) t),
e AS MATERIALIZED (SELECT tree_id, name AS name_x, name AS name_y FROM xs JOIN ys USING (tree_id, name)),
n AS MATERIALIZED (SELECT tree_id, name_x, name_y, norm FROM {S.first("(SELECT a.tree_id, a.name AS name_x, a.pos, a.norm, b.name AS name_y FROM " + left('xs', 'e') + " a JOIN " + S.first(left('ys', 'e'), 'tree_id, norm', 'pos, name', "norm <> ''") + " b ON a.tree_id = b.tree_id AND a.norm = b.norm)", 'tree_id, name_y', 'pos, name_x')})
SELECT tree_id, name_x, name_y, NULL AS name_resolved, 'exact' AS match_type, 1.0::DOUBLE AS match_score, 'exact_string' AS match_source, true AS in_x, true AS in_y, '' AS notes FROM e
UNION ALL SELECT tree_id, name_x, name_y, NULL, 'normalized', 1.0, 'normalisation', true, true, '''' || name_x || ''' normalised to ''' || norm || '''' FROM n
UNION ALL SELECT tree_id, name, NULL, NULL, 'unresolved', NULL, NULL, true, false, 'No match found in source y' FROM {left('xs', 'e', 'n')}
UNION ALL SELECT tree_id, NULL, name, NULL, 'unresolved', NULL, NULL, false, true, 'No match found in source x' FROM {left('ys', 'e', 'n')}"""


@REGISTRY.add("to_trees", _tree_set_sql())
def to_trees(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile_to_tree_set(_names(spark, folder, SPECIES), table(spark, folder, "tree_edges"))


MULTI_SIDE = ("(SELECT species, 0 AS d, rec_id AS pos FROM trait_records UNION ALL SELECT name_x, 1, override_id FROM override_batch)", "species", "d * 1000000000 + pos")
MULTI = S.cascade(MULTI_SIDE, ("tree_edges", "label", "child"), multi_x=True) + f"""SELECT {S.COLS}, coalesce(name_x IN (SELECT species FROM trait_records WHERE species IS NOT NULL), false) AS in_traits,
  coalesce(name_x IN (SELECT name_x FROM override_batch WHERE name_x IS NOT NULL), false) AS in_batch FROM result"""


@REGISTRY.add("multi_flags", MULTI)
def multi_flags(spark: SparkSession, folder: str) -> DataFrame:
    sets = {"traits": table(spark, folder, "trait_records").withColumnRenamed("rec_id", "_o"), "batch": table(spark, folder, "override_batch").select(F.col("name_x").alias("species"), F.col("override_id").alias("_o"))}
    rec = reconcile_multi(sets, table(spark, folder, "tree_edges"), "species", "_o", authority=None)
    return rec.mapping.select(*MAPPING.fieldNames(), "in_traits", "in_batch")


@REGISTRY.add("tip_name_list", "SELECT label AS name, min(child) AS pos FROM tree_edges WHERE is_tip AND label IS NOT NULL GROUP BY 1")
def tip_name_list(spark: SparkSession, folder: str) -> DataFrame:
    return tip_names(table(spark, folder, "tree_edges"))
