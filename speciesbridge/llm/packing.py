"""Items of varying length packed into containers of fixed capacity: first-fit decreasing in randomised groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .tokens import TOKENIZERS, token_counts

#: Items of a group, on average. A group wastes about half a container more than packing everything at once would.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, by a tournament tree whose nodes hold the most room left below them."""
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = np.zeros(n, np.int64)
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[item] = at - leaves
        room[at] -= size
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            most = left if left > right else right
            if room[at] == most:
                break
            room[at] = most
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, key, piece, item_start, item_end): where each item, or piece of an item beyond capacity, goes.

    Items up to the capacity stay whole; longer ones are cut into full containers and a rest that is packed like an
    item. Items of size NULL, 0 or less are in no container; a NULL key is packed like any other; repeated rows are
    items of their own; an empty table has no containers; other columns are not read. Ties in size go by the order of
    keys, so the result doesn't depend on partitions.

    Items are dealt to groups by a hash of their key, which keeps every group near group_items, and each group is
    packed on its own; containers are named group-number. Repeated rows of one key and size are counted first, and
    their number is dealt in equal shares over as many groups as there are, or as there are rows.
    """
    ship(items.sparkSession)
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{size}`").cast("bigint").alias("n")).where("n > 0")
    groups = max(1, math.ceil(items.count() / group_items))
    shares = F.least("times", F.lit(groups).cast("bigint"))
    share = F.expr("times div shares") + (F.col("share") < F.col("times") % F.col("shares")).cast("bigint")
    counted = rows.groupBy("k", "n").agg(F.count("*").alias("times")).withColumn("shares", shares)
    dealt = counted.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))).select(
        F.pmod(F.pmod(F.xxhash64("k", "n", F.lit(17)), F.lit(groups)) + F.col("share"), F.lit(groups)).alias("g"), "k", "n", share.alias("times")
    )
    kind = items.schema[key].dataType.simpleString()

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), np.asarray(table["times"]))))
        table = table.sort_by([("n", "descending"), ("k", "ascending")])
        n = np.asarray(table["n"]).astype(np.int64)
        whole, rest = n // capacity, n % capacity
        small = np.flatnonzero(rest)
        bins = first_fit_decreasing(rest[small], capacity)
        used = int(bins.max(initial=-1)) + 1
        item = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)
        container = np.concatenate([np.arange(len(item)) + used, bins])
        item, piece = np.concatenate([item, small]), np.concatenate([piece, whole[small]])
        end = np.minimum((piece + 1) * capacity, n[item])
        g = table["g"][0].as_py()
        names = pa.array([f"{g}-{c}" for c in container.tolist()])
        return pa.table(
            {"container": names, key: table["k"].take(pa.array(item)), "piece": pa.array(piece), "item_start": pa.array(piece * capacity), "item_end": pa.array(end)}
        )

    return dealt.groupBy("g").applyInArrow(
        fit, f"container string, `{key}` {kind}, piece bigint, item_start bigint, item_end bigint"
    )


def pack_documents(df: DataFrame, key: str, text: str, capacity: int = 1024, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Texts packed by their tokens; edge cases as in pack, NULL and '' being of size 0."""
    ship(df.sparkSession)
    sized = df.select(F.col(f"`{key}`"), token_counts(F.col(f"`{text}`"), name, folder).alias("_tokens"))
    return pack(sized, key, "_tokens", capacity)


def fill(containers: DataFrame, capacity: int) -> DataFrame:
    """One row (n_containers, n_used, n_least): containers, what they hold, and the fewest that could hold it."""
    held = F.coalesce(F.sum(F.col("item_end") - F.col("item_start")), F.lit(0))
    least = F.ceil(held / F.lit(capacity)).cast("bigint")
    return containers.agg(F.count_distinct("container").alias("n_containers"), held.alias("n_used"), least.alias("n_least"))
