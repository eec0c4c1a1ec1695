"""Differences between two copies of one dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = -1


def copy_differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[str],
    left_name: str = "left",
    right_name: str = "right",
) -> DataFrame:
    """(key, finding): `only_<left_name>`, `only_<right_name>` or the name of a field whose values differ.

    Both sides become key-field-value cells with a signed count, +1 left and -1 right, and one cell per row that
    stands for the row itself; what doesn't cancel is a difference. Cells are counted once per side, so a row that was
    delivered twice is one row; if a side holds several contents under one key, a field agrees when both sides hold
    the same set of values. NULL agrees with NULL only and '' is not NULL; a NULL key is a key like any other. Other
    columns, also such that both sides name alike, are not read. Fields of different types are compared as strings.
    An empty side makes every row of the other an `only_` finding.

    Two shuffles: cells by (key, field, value) with map-side sums, which no hot key can crowd as one key's values
    differ, and then the few cells left over by key, whose groups fold to flags before they are shuffled.
    """
    if key in fields:
        raise ValueError("the key is no field")

    def cells(df: DataFrame, sign: int) -> DataFrame:
        values = [F.struct(F.lit(ROW).alias("f"), F.lit(None).cast("string").alias("v"))]
        values += [F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(fields)]
        return df.select(F.col(f"`{key}`").alias("k"), F.inline(F.array(*values)), F.lit(sign).alias("s"))

    left_over = (
        cells(left, 1)
        .unionAll(cells(right, -1))
        .groupBy("k", "f", "v")
        .agg((F.max("s") + F.min("s")).alias("s"))
        .where("s <> 0")
    )
    flags = [F.bool_or((F.col("f") == i) & F.lit(True)).alias(f"d{i}") for i in range(len(fields))]
    findings = F.array_compact(
        F.when(F.col("row") > 0, F.array(F.lit(f"only_{left_name}")))
        .when(F.col("row") < 0, F.array(F.lit(f"only_{right_name}")))
        .otherwise(F.array(*[F.when(F.col(f"d{i}"), F.lit(c)) for i, c in enumerate(fields)]))
    )
    return (
        left_over.groupBy("k")
        .agg(F.sum(F.when(F.col("f") == ROW, F.col("s")).otherwise(0)).alias("row"), *flags)
        .select(F.col("k").alias(key), F.explode(findings).alias("finding"))
    )
