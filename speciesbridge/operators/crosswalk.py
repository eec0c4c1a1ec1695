"""Published crosswalks as overrides and as a supplement to a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ONE_TO_ONE, crosswalk_kind, normalise
from ..functions.relational import first_rows, occurring_once, one_row
from ..functions.schema import require
from ..runtime import cut
from ..sources.ingest import read_crosswalk
from .mapping import accept_pairs


def crosswalk_overrides(
    crosswalk: DataFrame | str, from_col: str, to_col: str, type_col: str | None = None, notes_col: str | None = None, one_to_one_only: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(name_x, name_y, user_note, *keep): the rows of a crosswalk that say something, as overrides.

    Rows with a NULL or empty name and rows of identical names go; with one_to_one_only, if there is a type column,
    also rows whose type isn't one to one, NULL among them. Repeated rows stay. keep: further columns, such as an order.
    crosswalk: a table, or a csv, tsv or txt file.
    """
    if isinstance(crosswalk, str):
        crosswalk = read_crosswalk(SparkSession.active(), crosswalk)
    require(crosswalk, [from_col, to_col, *keep], "the crosswalk")
    typed = type_col is not None and type_col in crosswalk.columns
    note = F.concat(F.lit("crosswalk ["), F.coalesce(F.col(f"`{type_col}`").cast("string"), F.lit("NA")), F.lit("]")) if typed else F.lit("crosswalk")
    if notes_col is not None and notes_col in crosswalk.columns:
        extra = F.col(f"`{notes_col}`").cast("string")
        note = F.when(F.length(extra) > 0, F.concat(note, F.lit(": "), extra)).otherwise(note)
    rows = crosswalk
    if one_to_one_only and typed:
        rows = rows.where(F.col(f"`{type_col}`").rlike(ONE_TO_ONE))
    named = rows.select(F.col(f"`{from_col}`").cast("string").alias("name_x"), F.col(f"`{to_col}`").cast("string").alias("name_y"), note.alias("user_note"), *keep)
    return named.where("name_x <> '' and name_y <> '' and name_x <> name_y")


def crosswalk_kinds(crosswalk: DataFrame, type_col: str) -> DataFrame:
    """(kind, n): rows by kind of their type, which tells how many splits and lumps need review."""
    return crosswalk.groupBy(crosswalk_kind(F.col(f"`{type_col}`")).alias("kind")).agg(F.count("*").alias("n"))


def supplement_candidates(mapping: DataFrame, overrides: DataFrame, rank: str = "species", order: str = "name") -> DataFrame:
    """(name_x, name_y, note): overrides whose two ends are, in normal form, still unresolved names of their side.

    Of several unresolved names of one normal form the first by `order`, a column of the mapping, counts, then the smallest; overrides that then share a name with another
    are ambiguous and are all left out, repeated ones too.
    """
    def lookup(side: str) -> DataFrame:
        open_ = mapping.where((F.col("match_type") == "unresolved") & F.col(f"in_{side}") & F.col(f"name_{side}").isNotNull())
        place = F.col(f"name_{side}" if order == "name" else order)
        named = open_.groupBy(F.col(f"name_{side}").alias("name")).agg(F.min(place).alias("place")).withColumn("norm", normalise(F.col("name"), rank)).where("norm <> ''")
        return first_rows(named, ["norm"], ["place", "name"]).select(F.col("norm").alias(f"n{side}"), F.col("name").alias(f"_{side}"))

    ends = overrides.withColumn("nx", normalise(F.col("name_x"), rank)).withColumn("ny", normalise(F.col("name_y"), rank))
    found = ends.join(lookup("x"), "nx").join(lookup("y"), "ny")
    return found.select(F.col("_x").alias("name_x"), F.col("_y").alias("name_y"), F.col("user_note").alias("note"))


def crosswalk_supplement(mapping: DataFrame, overrides: DataFrame, rank: str = "species", order: str = "name") -> tuple[DataFrame, DataFrame]:
    """(mapping after the unambiguous candidates are accepted, one row of counts of the audit)."""
    candidates = cut(supplement_candidates(mapping, overrides, rank, order))
    single = cut(occurring_once(candidates, ["name_x", "name_y"]))
    open_ = lambda s: F.count_if(F.coalesce((F.col("match_type") == "unresolved") & F.col(f"in_{s}") & F.col(f"name_{s}").isNotNull(), F.lit(False)))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    left = mapping.agg(open_("x").alias("n_unresolved_x"), open_("y").alias("n_unresolved_y"))
    audit = one_row(one(overrides, "n_crosswalk_rows"), left, one(candidates, "n_available"), one(single, "n_applied"))
    return accept_pairs(mapping, single), audit.withColumn("n_ambiguous", F.col("n_available") - F.col("n_applied"))
