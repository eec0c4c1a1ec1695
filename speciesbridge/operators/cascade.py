"""The matching cascade: overrides, exact, normalised, synonym, fuzzy; each stage sees what the ones before left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..functions.relational import first_rows, without
from ..functions.schema import MAPPING, UNUSED, check_authority, mapping_rows
from ..runtime import cut
from .fuzzy import best_matches
from .greedy import greedy_matching
from .synonyms import registered, resolve_names, synonym_pairs


@dataclass
class Cascade:
    mapping: DataFrame
    unused_overrides: DataFrame


# The reasons and notes of mapping rows.
NOT_IN_X, NOT_IN_Y, TAKEN = "name_x_not_in_data", "name_y_not_in_target", "already_matched"
NO_X, NO_Y = "No match found in source x", "No match found in source y"


def _empty(df: DataFrame, schema) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def apply_overrides(xs: DataFrame, ys: DataFrame, overrides: DataFrame, rank: str) -> tuple[DataFrame, DataFrame]:
    """(manual mapping rows, unused overrides). overrides: name_x, name_y, user_note and a unique order column pos.

    An override finds the first name of either side with its normal form and is accepted if neither is taken yet. The
    reasons why one is not used: name_x_not_in_data, then name_y_not_in_target, then already_matched. Empty normal
    forms, as of NULL or blank names, are in no data. A NULL note stays NULL; without the column it is 'Manual override'.
    """
    first = lambda s, new: first_rows(s.where("norm <> ''"), ["norm"], ["pos", "name"]).select(F.col("norm").alias(f"n{new}"), F.col("name").alias(new))
    note = F.col("user_note") if "user_note" in overrides.columns else F.lit("Manual override")
    wanted = overrides.select(
        F.col("pos").alias("i"), F.col("name_x").alias("ox"), F.col("name_y").alias("oy"), note.alias("note"),
        normalise(F.col("name_x"), rank).alias("nx"), normalise(F.col("name_y"), rank).alias("ny"),
    )
    located = cut(wanted.join(first(xs, "x"), "nx", "left").join(first(ys, "y"), "ny", "left"))
    taken = greedy_matching(located)
    used = located.join(taken.select("i"), "i", "left_semi").select(F.col("x").alias("name_x"), F.col("y").alias("name_y"), "note")
    manual = mapping_rows(used, "manual", 1.0, "user_override", True, True, F.col("note"))
    reason = F.when(F.col("x").isNull(), NOT_IN_X).when(F.col("y").isNull(), NOT_IN_Y).otherwise(TAKEN)
    unused = located.join(taken.select("i"), "i", "left_anti").select(F.col("ox").alias("name_x"), F.col("oy").alias("name_y"), reason.alias("reason"))
    return manual, unused


def cascade(
    x: DataFrame,
    y: DataFrame,
    *,
    rank: str = "species",
    overrides: DataFrame | None = None,
    lookup: DataFrame | None = None,
    authority: str | None = "col",
    resolve: str = "flag",
    fuzzy: bool = False,
    fuzzy_threshold: float = 0.9,
    flag_threshold: float = 0.95,
    multi_x: bool = False,
) -> Cascade:
    """Match two tables of distinct names (name, pos) one to one, pos giving the order in which ties are decided.

    authority: whose synonyms are followed, None for none. lookup: its answers (input, accepted_name) for normal forms;
    without it they come from the table registered for the authority, and it is an error if there is none. NULL names are left out; names whose normal form is empty match exactly or not at all. With
    multi_x several x may share a y in the normalised stage. Empty sides give only unresolved rows. Stages are cut
    where later ones read them twice; leftovers only ever shrink.
    """
    if resolve not in ("flag", "first"):
        raise ValueError("resolve must be flag or first")
    authority = check_authority(authority)
    taxa = registered(x.sparkSession, authority) if authority is not None and lookup is None else None
    side = lambda df: cut(df.where("name is not null").select("name", "pos", normalise(F.col("name"), rank).alias("norm")))
    xs, ys = side(x), side(y)
    unused = _empty(x, UNUSED)
    stages = []

    def take(rows: DataFrame) -> None:
        nonlocal left_x, left_y
        stages.append(rows)
        left_x, left_y = without(left_x, rows, "name", "name_x"), without(left_y, rows, "name", "name_y")

    left_x, left_y = xs, ys
    if overrides is not None:
        manual, unused = apply_overrides(xs, ys, overrides, rank)
        take(cut(manual))
    same = left_x.join(left_y.select("name"), "name").select(F.col("name").alias("name_x"), F.col("name").alias("name_y"))
    take(cut(mapping_rows(same, "exact", 1.0, "exact_string", True, True, "")))
    targets = first_rows((ys if multi_x else left_y).where("norm <> ''"), ["norm"], ["pos", "name"])
    normal = left_x.join(targets.select("norm", F.col("name").alias("name_y")), "norm").withColumnRenamed("name", "name_x")
    if not multi_x:
        normal = first_rows(normal, ["name_y"], ["pos", "name_x"])
    take(cut(mapping_rows(normal, "normalized", 1.0, "normalisation", True, True, F.format_string("'%s' normalised to '%s'", "name_x", "norm"))))
    if authority is not None:
        first = lambda df: first_rows(df.where("norm <> ''"), ["norm"], ["pos", "name"])
        fx, fy = cut(first(left_x)), cut(first(left_y))
        if lookup is None:
            asked = fx.select(F.col("norm").alias("name")).unionByName(fy.select(F.col("norm").alias("name")))
            lookup = cut(resolve_names(asked, taxa, authority))
        pairs = synonym_pairs(fx.select("norm", "pos"), fy.select("norm", "pos"), lookup)
        # of all pairs only those of the first strategy can share a name, a y, and there the earliest x wins
        pairs = first_rows(pairs, ["norm_y"], ["strategy", "pos_x", "norm_x"])
        named = pairs.join(fx.select(F.col("norm").alias("norm_x"), F.col("name").alias("name_x")), "norm_x").join(
            fy.select(F.col("norm").alias("norm_y"), F.col("name").alias("name_y")), "norm_y"
        )
        code = authority.upper()
        direct = lambda name: F.format_string(f"Synonym per {code}: '%s' -> accepted '%s'", name, "accepted")
        notes = (
            F.when(F.col("strategy") == 1, direct("norm_x")).when(F.col("strategy") == 2, direct("norm_y"))
            .otherwise(F.format_string(f"Both synonyms per {code}: '%s' and '%s' -> accepted '%s'", "norm_x", "norm_y", "accepted"))
        )
        kind = F.when((F.col("strategy") == 3) & F.lit(resolve == "flag"), "flagged").otherwise("synonym")
        take(cut(mapping_rows(named, kind, 0.95, f"{authority}_synonym", True, True, notes, F.col("accepted"))))
    if fuzzy:
        found = first_rows(best_matches(left_x, left_y, fuzzy_threshold, rank), ["name_y"], ["pos_x", "name_x"])
        weak = F.when((F.col("score") < flag_threshold) & F.lit(resolve == "flag"), "flagged").otherwise("fuzzy")
        take(cut(mapping_rows(found, weak, F.col("score"), "fuzzy_match", True, True, F.col("notes"))))
    stages.append(mapping_rows(left_x.select(F.col("name").alias("name_x")), "unresolved", None, None, True, False, NO_Y))
    stages.append(mapping_rows(left_y.select(F.col("name").alias("name_y")), "unresolved", None, None, False, True, NO_X))
    mapping = stages[0]
    for s in stages[1:]:
        mapping = mapping.unionByName(s)
    assert mapping.columns == MAPPING.fieldNames()
    return Cascade(mapping, unused)


def unused_counts(unused: DataFrame) -> DataFrame:
    """(reason, n): how many overrides were not used, by reason."""
    return unused.groupBy("reason").agg(F.count("*").alias("n"))
