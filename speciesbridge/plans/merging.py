"""Queries that join and assemble trait tables through a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..functions.relational import first_rows
from ..operators import merge as J
from ..runtime import table
from ..streaming.names import frozen_lookup, resolve_stream
from .registry import Registry
from .sqlparts import NORM, first

REGISTRY = Registry()

KEYS = f"""WITH m AS (SELECT *, coalesce(name_resolved, name_y) AS k FROM mapping WHERE in_x AND in_y),
kx AS {first('m', 'name_x', 'map_id', 'name_x IS NOT NULL')}, ky AS {first('m', 'name_y', 'map_id', 'name_y IS NOT NULL')},
x AS (SELECT t.*, kx.k FROM trait_records t LEFT JOIN kx ON t.species = kx.name_x),
y AS (SELECT c.*, ky.k FROM crosswalk c LEFT JOIN ky ON c.from_name = ky.name_y)
"""
PICK = "rec_id, species, sex, x.trait, mass, xw_id, from_name, to_name, x.loaded_at AS {a}, y.loaded_at AS {b}"


def _merge(spark: SparkSession, folder: str, how: str, suffix: tuple[str, str] = ("_x", "_y"), drop: bool = False) -> DataFrame:
    data_x = table(spark, folder, "trait_records").select("rec_id", "species", "sex", "trait", "mass", "loaded_at")
    data_y = table(spark, folder, "crosswalk").select("xw_id", "from_name", "to_name", "loaded_at")
    return J.merge(table(spark, folder, "mapping"), data_x, data_y, "species", "from_name", how, suffix, drop, ["map_id"])


def _add(name: str, how: str, join: str, where: str = "true", suffix: tuple[str, str] = ("_x", "_y"), drop: bool = False) -> None:
    cols = PICK.format(a=f'"loaded_at{suffix[0]}"', b=f'"loaded_at{suffix[1]}"')
    right = "y" if how == "full" else "(SELECT * FROM y WHERE k IS NOT NULL)"

    @REGISTRY.add(name, KEYS + f"SELECT coalesce(x.k, y.k) AS species_resolved, {cols} FROM x {join} {right} y ON x.k = y.k WHERE {where}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _merge(spark, folder, how, suffix, drop)


_add("merge_inner", "inner", "JOIN")
_add("merge_left", "left", "LEFT JOIN")
_add("merge_full", "full", "FULL JOIN")
_add("merge_drop", "full", "FULL JOIN", "coalesce(x.k, y.k) IS NOT NULL", drop=True)
_add("merge_suffix", "left", "LEFT JOIN", suffix=(".traits", ".crosswalk"))


@REGISTRY.add("apply_data", "SELECT rec_id, species FROM trait_records t WHERE EXISTS (SELECT 1 FROM mapping m WHERE m.in_x AND m.in_y AND m.name_x = t.species)")
def apply_data(spark: SparkSession, folder: str) -> DataFrame:
    return J.apply_to_data(table(spark, folder, "mapping"), table(spark, folder, "trait_records"), "species", True).select("rec_id", "species")


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = table(spark, folder, "trait_records").withColumn("mass", J.clean_measure(F.col("mass"))).withColumn("trait", J.clean_measure(F.col("trait")))
    atlas = F.coalesce(F.col("dataset_x") == "atlas_main", F.lit(False))
    return {"atlas": t.where(atlas), "surveys": t.where(~atlas)}


CLEAN = "CASE WHEN {c} = -999 OR {c} <= 0 OR isnan({c}) THEN NULL ELSE {c} END"
TRAITS = f"t AS (SELECT CASE WHEN dataset_x = 'atlas_main' THEN 'atlas' ELSE 'surveys' END AS source, species, {CLEAN.format(c='trait')} AS trait, {CLEAN.format(c='mass')} AS mass FROM trait_records)"


@REGISTRY.add("assemble_species", f"""WITH m AS (SELECT *, coalesce(name_resolved, name_y) AS k FROM mapping WHERE in_x AND in_y), kx AS {first('m', 'name_x', 'map_id', 'name_x IS NOT NULL')}, {TRAITS}
SELECT k AS species_resolved, count(*) AS n_records, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source)), '; ') AS sources, median(trait) AS trait, median(mass) AS mass
FROM t JOIN kx ON t.species = kx.name_x WHERE k IS NOT NULL GROUP BY k""")
def assemble_species(spark: SparkSession, folder: str) -> DataFrame:
    return J.assemble(_sources(spark, folder), table(spark, folder, "mapping"), ["trait", "mass"], ["map_id"])


@REGISTRY.add("source_coverage", f"WITH {TRAITS} SELECT source, count(*) AS n_records, count(DISTINCT species) AS n_species FROM t GROUP BY source")
def source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return J.source_coverage(_sources(spark, folder))


@REGISTRY.add("species_means", "SELECT species, count(*) AS n_records, round(avg(trait), 9) AS trait, round(avg(mass), 9) AS mass FROM trait_records WHERE species IS NOT NULL GROUP BY species")
def species_means(spark: SparkSession, folder: str) -> DataFrame:
    m = J.species_means(table(spark, folder, "trait_records"), "species", ["trait", "mass"])
    return m.select("species", "n_records", F.round("trait", 9).alias("trait"), F.round("mass", 9).alias("mass"))


@REGISTRY.add("frozen_lookup", f"""WITH m AS (SELECT name_x, coalesce(name_resolved, name_y) AS r, {NORM('name_x')} AS norm FROM mapping WHERE in_x AND in_y AND name_x IS NOT NULL),
l AS {first('m', 'norm', 'name_x, r NULLS FIRST', "norm <> ''")} SELECT rec_id, species, {NORM('species')} AS normalised, r AS species_resolved FROM trait_records t LEFT JOIN l ON {NORM('t.species')} = l.norm""")
def frozen_lookup_query(spark: SparkSession, folder: str) -> DataFrame:
    lookup = frozen_lookup(table(spark, folder, "mapping"))
    return resolve_stream(table(spark, folder, "trait_records").select("rec_id", "species"), lookup, "species").select("rec_id", "species", "normalised", "species_resolved")


@REGISTRY.add("resolved_mass", f"""WITH m AS (SELECT *, coalesce(name_resolved, name_y) AS k FROM mapping WHERE in_x AND in_y), kx AS {first('m', 'name_x', 'map_id', 'name_x IS NOT NULL')}
SELECT {NORM('k')} AS species_resolved, count(*) AS n, round(sum(CASE WHEN mass > 0 THEN mass END), 4) AS mass FROM trait_records t JOIN kx ON t.species = kx.name_x WHERE k IS NOT NULL GROUP BY 1""")
def resolved_mass(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: traits led through the mapping, by normal form of the resolved name."""
    data = table(spark, folder, "trait_records").select("species", "mass")
    m = table(spark, folder, "mapping")
    keys = first_rows(m.where("in_x and in_y and name_x is not null"), ["name_x"], ["map_id"]).select(F.col("name_x").alias("species"), F.coalesce("name_resolved", "name_y").alias("k"))
    known = data.join(keys, "species").where("k is not null")
    return known.groupBy(normalise(F.col("k")).alias("species_resolved")).agg(F.count("*").alias("n"), F.round(F.sum(J.clean_measure(F.col("mass"), ())), 4).alias("mass"))
