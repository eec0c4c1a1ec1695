"""Ordered greedy one-to-one matching, in rounds instead of one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def greedy_matching(pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The rows (i, x, y) that a loop in the order of i accepts, if it takes each pair whose x and y are both unused.

    i must be unique; rows with a NULL in x or y are never accepted; an empty table gives none. Each round accepts
    every pair that is the first of its x and the first of its y, then drops all pairs that touch an accepted name.
    Minima are folded map-side, so a hot name is no hot task. Rounds are as many as the longest chain of pairs of
    which each blocks the next; beyond max_rounds it raises.
    """
    live = cut(pairs.select("i", "x", "y").where("x is not null and y is not null"))
    accepted = live.where("false")
    for _ in range(max_rounds):
        if live.isEmpty():
            return accepted
        best_x = live.groupBy("x").agg(F.min("i").alias("i"))
        best_y = live.groupBy("y").agg(F.min("i").alias("i"))
        taken = cut(live.join(best_x, ["x", "i"], "left_semi").join(best_y, ["y", "i"], "left_semi").select("i", "x", "y"))
        accepted = accepted.unionByName(taken)
        live = cut(live.join(taken.select("x"), "x", "left_anti").join(taken.select("y"), "y", "left_anti"))
    raise RuntimeError(f"pairs are left after {max_rounds} rounds")
