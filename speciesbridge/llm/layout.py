"""Records that are the same but for layout, collapsed by rolling hashes of what counts in them."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from itertools import count, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, salted_join, ship
from . import codepoints as C

#: Two prime moduli below 2^31: a product of two residues fits 64 bits. Together a hash has 62 bits.
PRIMES = (2147483647, 2147483629)
#: The bases of the first hash; those of further ones, for rows that collide, are made from them.
BASES = (1103515245, 1566083941)


@cache
def fold_table() -> np.ndarray:
    """For each code point 0 if it is skipped, else the folded code point plus one.

    Letters, digits and combining marks count (an accent makes another record); letters are case-folded where the
    fold is one code point.
    """
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0xE01F0 <= cp:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LNM":
            fold = ch.casefold()
            out[cp] = 1 + (ord(fold) if len(fold) == 1 else ord(ch.lower()) if len(ch.lower()) == 1 else cp)
    return out


@cache
def _powers(prime: int, base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out


def bases(number: int) -> tuple[int, ...]:
    """The bases of the hash of that number."""
    return tuple(pow(b, 2 * number + 1, p) for b, p in zip(BASES, PRIMES))


class Folded:
    """The bytes of a batch of values, each with what it counts as: 0 if it is skipped, else a letter's number.

    A byte of ASCII counts as the table has it. The first byte of a longer sequence counts as its code point, which is put
    together from the bytes behind it, and those are skipped.
    """

    def __init__(self, values: pa.Array) -> None:
        raw, self.at = C.utf8(values)
        self.value = fold_table()[:256][raw]
        self.value[raw >= 0x80] = 0
        lead = np.flatnonzero(raw >= 0xC2)
        if len(lead):
            more = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
            b, c1, c2, c3 = raw[lead].astype(np.uint32), more[lead + 1], more[lead + 2], more[lead + 3]
            two, three = (b & 0x1F) << 6 | c1, (b & 0x0F) << 12 | c1 << 6 | c2
            cp = np.where(b < 0xE0, two, np.where(b < 0xF0, three, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
            self.value[lead] = fold_table()[np.minimum(cp, 0x10FFFF)]
        self.places = np.flatnonzero(self.value)
        self.counted = np.concatenate([[0], np.cumsum(self.value > 0)])  # what counts before each byte
        self.sizes = self.counted[self.at[1:]] - self.counted[self.at[:-1]]

    def hashes(self, number: int = 0) -> np.ndarray:
        """A 62-bit polynomial of what counts in each value, skipped bytes adding nothing."""
        lengths = self.at[1:] - self.at[:-1]
        # how many letters of the value come behind; of no meaning, and times 0, where a byte is skipped
        power = np.maximum(np.repeat(self.counted[self.at[1:]], lengths) - 1 - self.counted[:-1], 0)
        size = 1 << max(6, int(power.max(initial=0)).bit_length())
        out = np.zeros(len(lengths), np.uint64)
        value = self.value.astype(np.uint64)
        for prime, base in zip(PRIMES, bases(number)):
            terms = value * _powers(prime, base, size)[power] % np.uint64(prime)  # below 2^31: 2^33 of them fit a sum
            out = out << np.uint64(31) | C.per_row(terms, self.at) % np.uint64(prime)
        return out.astype(np.int64)


def field_hashes(values: pa.Array, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(62-bit rolling hash of what counts in each value, how many letters count)."""
    folded = Folded(values)
    return folded.hashes(number), folded.sizes


def same_but_layout(own: Folded, i: np.ndarray, other: Folded, j: np.ndarray) -> np.ndarray:
    """Whether values i of own are values j of other but for layout.

    Two pointers go over each pair of values at once, from one byte that counts to the next, for all pairs together.
    """
    good = own.sizes[i] == other.sizes[j]
    pairs = np.flatnonzero(good & (own.sizes[i] > 0))
    n = own.sizes[i[pairs]]
    p = own.places[C.spread(own.counted[own.at[i[pairs]]], n)]
    q = other.places[C.spread(other.counted[other.at[j[pairs]]], n)]
    wrong = C.per_row((own.value[p] != other.value[q]).astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
    good[pairs[wrong > 0]] = False
    return good


def same_records(own: list[Folded], other: list[Folded]) -> np.ndarray:
    """Row by row, whether the fields of own are those of other in some order.

    Fields are compared in the order of their hashes. Only where hashes of different fields of a row are equal, which is
    a collision or two equal fields, are all orders tried.
    """
    a, b = (np.stack([f.hashes() for f in side], axis=1) for side in (own, other))
    by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")

    def compared(rows: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
        good = np.ones(len(rows), bool)
        for place in range(len(own)):
            for f in range(len(own)):
                for g in range(len(other)):
                    k = np.flatnonzero(good & (of_a[:, place] == f) & (of_b[:, place] == g))
                    good[k] = same_but_layout(own[f], rows[k], other[g], rows[k])
        return good

    every = np.arange(len(a))
    good = compared(every, by_a, by_b)
    alike = np.sort(a, axis=1)
    tied = np.flatnonzero(~good & (alike[:, 1:] == alike[:, :-1]).any(axis=1))
    for order in permutations(range(len(other))) if len(tied) else ():
        left = tied[~good[tied]]
        good[left] = compared(left, np.tile(np.arange(len(own)), (len(left), 1)), np.tile(order, (len(left), 1)))
    return good


def _hashed(fields: list[Column], number: int = 0) -> Column:
    """struct(k: hashes of the fields in ascending order, n: letters that count in all of them)."""

    @F.arrow_udf("struct<k: array<bigint>, n: bigint>")
    def hashed(*columns: pa.Array) -> pa.Array:
        both = [field_hashes(C.flat(c), number) for c in columns]
        keys = np.sort(np.stack([h for h, _ in both], axis=1), axis=1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), len(columns)).cast(pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([lists, pa.array(sum(n for _, n in both))], ["k", "n"])

    # else filters on the hash would be pushed below it and the hash made twice
    return hashed.asNondeterministic()(*fields)


def _verified(pairs: list[Column]) -> Column:
    """Whether the first half of the columns is the same record as the second half, in any order of fields."""

    @F.arrow_udf("boolean")
    def verified(*columns: pa.Array) -> pa.Array:
        sides = [Folded(C.flat(c)) for c in columns]
        half = len(sides) // 2
        return pa.array(same_records(sides[:half], sides[half:]))

    return verified.asNondeterministic()(*pairs)


def layout_copies(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(first_id, copy_id): of each record held by two or more rows its smallest key with each of its other keys.

    Rows are one record if their fields agree in any order when only letters, digits and accents count and letter case
    doesn't. NULL counts like ''; rows whose fields all hold nothing that counts are no record and give nothing. Rows
    with a NULL key are left out. A key may be given several times, for one record or several; each of its rows is a row
    of its own, but no copy of itself. Other columns are not read; an empty df gives an empty result.

    Rows are hashed in Arrow batches and grouped by their hashes with map-side minima; only rows whose hash occurs
    twice go on, beside the first row of their hash, to the comparison that settles it. Rows that merely collide with
    that one can only be equal among themselves, and are grouped once more by hashes with other bases, until none
    collide. No group is ever gathered; hot ones are salted.
    """
    ship(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in fields]
    names, ids, heads_ = ([f"{x}{i}" for i in range(len(fields))] for x in "fkg")
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("id"), *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cols, names)], _hashed(cols).alias("h")
    )
    rows = rows.where("h.n > 0").select("id", *names, *[F.col("h.k")[i].alias(k) for i, k in enumerate(ids)])
    out = None
    for number in count(1):
        firsts = rows.groupBy(*ids).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
        members = cut(salted_join(rows, firsts, ids, "n", F.col("id")))  # read twice below
        heads = members.where("id = first_id").groupBy(*ids).agg(F.min(F.struct(*names)).alias("head"), F.first("n").alias("n"))
        heads = heads.select(*ids, *[F.col("head")[n].alias(g) for n, g in zip(names, heads_)], "n")
        beside = salted_join(members.drop("n"), heads, ids, "n", F.col("id"))
        itself = (F.col("id") == F.col("first_id")) & reduce(Column.__and__, [F.col(n) == F.col(g) for n, g in zip(names, heads_)])
        same = _verified([F.col(c) for c in (*names, *heads_)])
        judged = beside.where(~itself).withColumn("same", same)
        settled = cut(judged.select("first_id", "id", "same", *[F.when(~F.col("same"), F.col(n)).alias(n) for n in names]))
        copies = settled.where("same and id <> first_id").select("first_id", F.col("id").alias("copy_id"))
        out = copies if out is None else out.unionByName(copies)
        collided = settled.where("not same")
        if collided.isEmpty():
            return out
        again = collided.select("id", *names, _hashed([F.col(n) for n in names], number).alias("h"))
        rows = again.select("id", *names, *[F.col("h.k")[i].alias(k) for i, k in enumerate(ids)])


def layout_records(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with one row per record and `n_copies`; rows with nothing that counts stay as they are with NULL copies.

    The row kept of a record is the one with its smallest key. Edge cases as in layout_copies; rows with a NULL key stay.
    """
    copies = layout_copies(df, key, fields).select(F.col("first_id").alias("_first"), F.col("copy_id").alias("_copy"))
    counts = copies.groupBy("_first").agg((F.count("*") + 1).alias("n_copies"))
    kept = df.join(copies.select("_copy"), df[f"`{key}`"] == F.col("_copy"), "left_anti")
    counts_something = F.coalesce(*[F.when(F.col(f"`{c}`").rlike(r"[\p{L}\p{N}\p{M}]"), F.lit(1)) for c in fields])
    return kept.join(counts, kept[f"`{key}`"] == F.col("_first"), "left").drop("_first").withColumn(
        "n_copies", F.when(counts_something.isNotNull(), F.coalesce("n_copies", F.lit(1).cast("bigint")))
    )
