"""Names in a stream led through a frozen mapping.

Normalisation and a lookup in a fixed mapping keep no state, so a stream of names can be reconciled as it arrives;
first-come matching can't, and stays with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..functions.relational import first_rows


def frozen_lookup(mapping: DataFrame, rank: str = "species") -> DataFrame:
    """(norm, species_resolved): one answer per normal form of the matched names of x, the first by name."""
    rows = mapping.where("in_x and in_y and name_x is not null").select("name_x", F.coalesce("name_resolved", "name_y").alias("species_resolved"), normalise(F.col("name_x"), rank).alias("norm"))
    return first_rows(rows.where("norm <> ''"), ["norm"], ["name_x", "species_resolved"]).select("norm", "species_resolved")


def resolve_stream(stream: DataFrame, lookup: DataFrame, species: str, rank: str = "species") -> DataFrame:
    """The stream with `normalised` and `species_resolved`, NULL where the mapping has no answer. Works on batches too."""
    named = stream.withColumn("normalised", normalise(F.col(f"`{species}`"), rank))
    return named.join(lookup.withColumnRenamed("norm", "normalised"), "normalised", "left")


def windowed_counts(stream: DataFrame, time: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, species_resolved, n) of a resolved stream; rows later than `late` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "species_resolved").agg(F.count("*").alias("n"))
