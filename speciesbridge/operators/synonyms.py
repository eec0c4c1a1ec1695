"""Synonyms by a taxonomic authority given as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.relational import first_rows, without
from ..functions.schema import check_authority, require
from ..runtime import cut


_registered: dict[tuple[str, str], DataFrame] = {}


def register_authority(code: str, taxa: DataFrame) -> None:
    """Make a table of taxa (Darwin Core columns, see resolve_names) what an authority's code stands for in its session."""
    code = check_authority(code)
    require(taxa, ["scientificName", "taxonID", "acceptedNameUsageID", "taxonomicStatus", "ord"], f"the table of {code}")
    _registered[taxa.sparkSession.sparkContext.applicationId, code] = taxa


def registered(spark: SparkSession, code: str) -> DataFrame:
    """The table of an authority, an error if none was registered: a synonym stage is never left out unsaid."""
    taxa = _registered.get((spark.sparkContext.applicationId, code))
    if taxa is None:
        raise ValueError(f"no table is registered for the authority {code!r}: register_authority(), give a lookup, or set authority=None")
    return taxa


def resolve_names(inputs: DataFrame, taxa: DataFrame, authority: str) -> DataFrame:
    """(input, accepted_name, status, taxon_id, authority) of each input name.

    inputs: name. taxa: Darwin Core columns scientificName, taxonID, acceptedNameUsageID, taxonomicStatus and an order
    column ord; optionally input. The first accepted hit wins, else the first hit, whose acceptedNameUsageID is looked
    up; a name without hit is not_found. Names given twice are answered once, NULL not at all.
    """
    wanted = inputs.select(F.col("name").alias("input")).where("input is not null").distinct()
    t = taxa.select("scientificName", "taxonID", "acceptedNameUsageID", "taxonomicStatus", "ord")
    hits = t.withColumn("input", F.col("scientificName"))
    if "input" in taxa.columns:
        hits = hits.unionByName(taxa.select("scientificName", "taxonID", "acceptedNameUsageID", "taxonomicStatus", "ord", "input").where("input is not null"))
    best = first_rows(
        hits.join(wanted, "input", "left_semi").withColumn("_acc", F.coalesce(F.col("taxonomicStatus") == "accepted", F.lit(False))),
        ["input"], [F.desc("_acc"), "ord"],
    )
    by_id = first_rows(t.where("taxonID is not null"), ["taxonID"], ["ord"]).select(F.col("taxonID").alias("_id"), F.col("scientificName").alias("_accepted"))
    found = best.join(by_id, (F.col("acceptedNameUsageID") == F.col("_id")) & ~F.col("_acc") & (F.col("acceptedNameUsageID") != ""), "left")
    answered = found.select(
        "input",
        F.when(F.col("_acc"), F.col("scientificName")).otherwise(F.col("_accepted")).alias("accepted_name"),
        F.when(F.col("_acc"), F.lit("accepted")).otherwise(F.coalesce("taxonomicStatus", F.when(F.col("_accepted").isNotNull(), F.lit("synonym")).otherwise(F.lit("unknown")))).alias("status"),
        F.when(F.col("_acc") | F.col("_accepted").isNull(), F.col("taxonID")).otherwise(F.col("acceptedNameUsageID")).alias("taxon_id"),
    )
    return wanted.join(answered, "input", "left").select(
        "input", "accepted_name", F.coalesce("status", F.lit("not_found")).alias("status"), "taxon_id", F.lit(authority).alias("authority")
    )


def synonym_pairs(x: DataFrame, y: DataFrame, lookup: DataFrame) -> DataFrame:
    """(strategy, pos_x, pos_y, norm_x, norm_y, accepted): pairs of normal forms that an authority holds for one taxon.

    x, y: distinct (norm, pos) of what is left. lookup: input, accepted_name. In this order: 1, what x means is a y;
    2, what y means is an x, neither of them in a pair so far and each x with its first y; 3, both mean the same name,
    the n-th x left of a name going with its n-th y left.
    """
    means = lookup.where("accepted_name is not null").select(F.col("input").alias("norm"), F.col("accepted_name").alias("accepted"))
    x, y = cut(x), cut(y)
    mx, my = cut(x.join(means, "norm")), cut(y.join(means, "norm"))
    one = mx.join(y.select(F.col("norm").alias("accepted"), F.col("pos").alias("pos_y")), "accepted").select(
        F.lit(1).alias("strategy"), F.col("pos").alias("pos_x"), "pos_y", F.col("norm").alias("norm_x"), F.col("accepted").alias("norm_y"), "accepted"
    )
    one = cut(one)
    left_y = without(my, one, "norm", "norm_y")
    left_x = without(x, one, "norm", "norm_x")
    two = first_rows(
        left_y.join(left_x.select(F.col("norm").alias("accepted"), F.col("pos").alias("pos_x")), "accepted"), ["accepted"], ["pos", "norm"]
    ).select(F.lit(2).alias("strategy"), "pos_x", F.col("pos").alias("pos_y"), F.col("accepted").alias("norm_x"), F.col("norm").alias("norm_y"), "accepted")
    two = cut(two)
    far_x = without(without(mx, one, "norm", "norm_x"), two, "norm", "norm_x")
    far_y = without(left_y, two, "norm", "norm_y")
    w = Window.partitionBy("accepted").orderBy("pos", "norm")
    # accepted names with candidates on both sides only: the ranking sorts what can still pair
    both = far_x.select("accepted").distinct().join(far_y.select("accepted").distinct(), "accepted")
    nx = far_x.join(both, "accepted", "left_semi").select("accepted", F.col("norm").alias("norm_x"), F.col("pos").alias("pos_x"), F.row_number().over(w).alias("n"))
    ny = far_y.join(both, "accepted", "left_semi").select("accepted", F.col("norm").alias("norm_y"), F.col("pos").alias("pos_y"), F.row_number().over(w).alias("n"))
    three = nx.join(ny, ["accepted", "n"]).select(F.lit(3).alias("strategy"), "pos_x", "pos_y", "norm_x", "norm_y", "accepted")
    return one.unionByName(two).unionByName(three)
