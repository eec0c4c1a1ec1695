"""Relational primitives that the operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names(df: DataFrame, column: str, order: str) -> DataFrame:
    """(name, pos): the distinct names, NULL left out, each with its first place by the order column."""
    return (
        df.select(F.col(f"`{column}`").cast("string").alias("name"), F.col(f"`{order}`").alias("pos"))
        .where("name is not null")
        .groupBy("name")
        .agg(F.min("pos").alias("pos"))
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark limits within partitions before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def without(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """The rows of df whose key isn't in other."""
    return df.join(other.select(F.col(f"`{other_key or key}`").alias(key)), key, "left_anti")


def occurring_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose values of each of the keys occur in no other row of df. Counts are folded map-side."""
    out = df
    for k in keys:
        out = out.join(df.groupBy(k).agg(F.count("*").alias("_n")).where("_n = 1").select(k), k, "left_semi")
    return out


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each side by side, without a product: a union whose columns are then maxima."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
