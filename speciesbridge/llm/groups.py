"""Pairwise links consolidated into groups: hash-to-min on rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, salted_join, ship


#: So many links and fewer are few enough for one task (some 5 MB): there the rounds go on over arrays, as a round of
#: jobs takes about a second whatever it has to do.
FEW = 50_000


def _number(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name) if seed else F.xxhash64(name)


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links as pairs of numbers v, u; names with their numbers). A number is a hash that was checked to be of one name.

    Of a billion names two share a hash once in some 40 runs; then all are numbered with another seed. The order of
    numbers is that of no names, so names in a row, each linked with the next, don't make many rounds.
    """
    for seed in count():
        names = cut(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().select(_number(F.col("name"), seed).alias("id"), "name"))
        if names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return pairs.select(_number(F.col("a"), seed).alias("v"), _number(F.col("b"), seed).alias("u")), names
        discard(names)


def _least(links: DataFrame) -> DataFrame:
    """(v, m, n): the least member m of each vertex's cluster, which is v and what it is linked with; n links."""
    ends = links.select(F.inline(F.array(F.struct(F.col("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))))
    return ends.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("m"), "n")


def _sent(links: DataFrame, least: DataFrame) -> DataFrame:
    """The links among what is left after each vertex sent its cluster to the least member and that one to all others.

    A member that two vertices have in common was told both their least members, and so links them: of the link v, u
    remains that of v's least with u's. Where they are one, nothing remains.
    """
    told = salted_join(links, least, ["v"], "n", F.col("u")).select(F.col("m").alias("w"), "u")
    both = salted_join(told.withColumnRenamed("u", "v"), least, ["v"], "n", F.col("w")).where("w <> m")
    return both.select(F.greatest("w", "m").alias("v"), F.least("w", "m").alias("u")).distinct()


def _rounds(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rounds over arrays, to the end: (vertex, least of its group)."""
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = np.split(at, 2)
    group = np.arange(len(ids))
    while len(a):
        least = np.arange(len(ids))
        np.minimum.at(least, a, b)
        np.minimum.at(least, b, a)
        group = least[group]
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[group]


def _finished(links: DataFrame) -> DataFrame:
    """(v, m) of few links: each vertex with the least of its group."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            ids, group = _rounds(np.asarray(t["v"]), np.asarray(t["u"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(group)], ["v", "m"])

    return links.select("v", "u").repartition(1).mapInArrow(finish, "v bigint, m bigint")


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(group_name, member_name): for each group of two or more names its smallest name with each of its others.

    Names are linked by the rows of links, in either direction; order is that of bytes, which for UTF-8 is that of
    code points. Rows with a NULL name or a name linked to itself link nothing; repeated and reversed rows count once;
    '' is a name; other columns are not read; no links give no groups.

    Rounds of hash-to-min go on until no links are left. A vertex that is not the least of its cluster has handed the
    cluster over and knows only its least member; it is set aside with that, so a round is about what is not settled,
    which shrinks by a constant share. The last rounds, of FEW links, are those of one task. At the end the least members are handed down to those set aside, last round
    first. A cluster is rows, never an array; minima are folded map-side and hot vertices salted. Each round is a table
    in the shared folder, and the one before it is deleted.
    """
    ship(links.sparkSession)
    pairs = links.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).where("a is not null and b is not null and a <> b")
    numbers, names = _numbered(pairs)
    live = cut(numbers.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
    aside: list[DataFrame] = []
    while live.count() > FEW:
        aside.append(cut(_least(live)))
        after = cut(_sent(live, aside[-1]))
        discard(live)
        live = after
    groups = _finished(live)
    for least in reversed(aside):
        # a least member that is in no later round is the least of its group
        sizes = least.groupBy("m").agg(F.count("*").alias("n"))
        final = sizes.join(groups.select(F.col("v").alias("m"), F.col("m").alias("g")), "m", "left").select("m", F.coalesce("g", "m").alias("g"), "n")
        after = cut(salted_join(least.select("v", "m"), final, ["m"], "n", F.col("v")).select("v", F.col("g").alias("m")))
        discard(groups), discard(least)
        groups = after
    named = groups.join(names.withColumnRenamed("id", "v"), "v")
    firsts = named.groupBy("m").agg(F.min("name").alias("group_name"), F.count("*").alias("n"))
    return salted_join(named, firsts, ["m"], "n", F.col("v")).where("name <> group_name").select("group_name", F.col("name").alias("member_name"))


#: The crosswalk types that link two names, in lower case without white space.
LINKING = ("1blto1bt", "manyblto1bt", "1bltomanybt")


def linking_rows(crosswalk: DataFrame, type_column: str) -> DataFrame:
    """The rows whose type links, disregarding case and white space; a NULL type links nothing."""
    return crosswalk.where(F.lower(F.regexp_replace(F.col(f"`{type_column}`"), r"[\s\p{Z}]+", "")).isin(*LINKING))
