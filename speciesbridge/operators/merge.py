"""Trait tables joined, filtered and assembled through a mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import first_rows, one_row
from ..functions.schema import MAPPING, check_mapping, require
from ..runtime import cut
from ..sources.ingest import species_column

#: A key that gives more rows than this is joined in shares of about so many, each in its own place. Rows of y are dealt
#: in pieces of PIECE_ROWS: written one after the other for each row of x they repeat within what Parquet compresses
#: together, where a whole key's would not. Rows of x go to every piece of their key, in at most MOST_SHARES shares.
#: Pieces are numbered in tasks of PIECE_TASK rows. The lists of hot keys and of pieces are small: of the first there are
#: at most as many as both tables have rows by twice SHARE_ROWS' root, of the second y's rows by PIECE_ROWS and one a task.
SHARE_ROWS = 2_000_000
PIECE_ROWS = 512
PIECE_TASK = 65_536
MOST_SHARES = 4096


def _keyed(mapping: DataFrame, data_x: DataFrame, data_y: DataFrame, species: tuple[str | None, str | None], suffix: tuple[str, str], order: list[str] | None) -> list[DataFrame]:
    """Both tables with `_key`, the resolved name of their species, columns of both with their suffixes."""
    check_mapping(mapping)
    rows = mapping.where("in_x and in_y").withColumn("_key", F.coalesce("name_resolved", "name_y"))
    by = [F.col(c) for c in order or MAPPING.fieldNames()]
    common = set(data_x.columns) & set(data_y.columns)
    out = []
    for df, column, name, s, what in ((data_x, species[0], "name_x", suffix[0], "data_x"), (data_y, species[1], "name_y", suffix[1], "data_y")):
        column = column or species_column(df)
        require(df, [column], what)
        keys = first_rows(rows.where(F.col(name).isNotNull()), [name], by).select(F.col(name).alias("_species"), "_key")
        named = df.select(F.col(f"`{column}`").cast("string").alias("_species"), *[F.col(f"`{c}`").alias(c + s if c in common else c) for c in df.columns])
        out.append(named.join(keys, "_species", "left").drop("_species"))
    return out


def _joined(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
    """x and y joined on _key; what keys that give many rows give is spread over tasks.

    Both sides have such keys, so theirs is an inner join, whatever how is: shares of x by the hash of all columns meet
    pieces of y, so that rows are repeated by the root of what they give. Rows without a key are not moved.
    """
    x, y = cut(x), cut(y)
    named = "_key is not null"
    count = lambda df, n: df.where(named).groupBy("_key").agg(F.count("*").alias(n))
    given = F.col("_nx") * F.col("_ny")
    hot = cut(count(x, "_nx").join(count(y, "_ny"), "_key").where(given > SHARE_ROWS))
    keyless = {"inner": [], "left": [x], "full": [x, y]}[how]
    rest = lambda df: df.where(named)
    add = lambda out: reduce(lambda o, df: o.unionByName(df.where("_key is null"), allowMissingColumns=True), keyless, out)
    if hot.isEmpty():
        return add(rest(x).join(rest(y), "_key", how))
    few = F.broadcast(hot.select("_key"))
    cold = rest(x).join(few, "_key", "left_anti").join(rest(y).join(few, "_key", "left_anti"), "_key", how)
    n = 16 * x.sparkSession.sparkContext.defaultParallelism
    hashed = lambda df: F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    pieces = y.join(F.broadcast(hot.select("_key", F.ceil(F.col("_ny") / PIECE_TASK).alias("_tasks"))), "_key").withColumn("_hash", hashed(y))
    pieces = pieces.withColumn("_task", F.pmod("_hash", "_tasks"))
    at = F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_hash")) - 1
    # a table, so that rows are in the same piece whenever it is read
    pieces = cut(pieces.withColumn("_piece", F.struct("_task", F.floor(at / PIECE_ROWS).alias("piece"))).drop("_hash", "_task", "_tasks"))
    shares = F.ceil(F.col("_nx") * F.least("_ny", F.lit(PIECE_ROWS)) / SHARE_ROWS)
    met = hot.select("_key", F.least(shares, F.lit(MOST_SHARES)).cast("int").alias("_shares"))
    dealt = x.join(F.broadcast(met), "_key").withColumn("_share", F.pmod(hashed(x), F.col("_shares")).cast("int")).drop("_shares")
    dealt = dealt.join(F.broadcast(pieces.select("_key", "_piece").distinct()), "_key")
    every = pieces.join(F.broadcast(met), "_key").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    # a number of partitions of its own, for adaptive execution would put small inputs together again, large as their result is
    spread = lambda df: df.repartition(n, "_key", "_share", "_piece")
    # a merge join, which writes a piece out for each row of x
    warm = spread(dealt).hint("merge").join(spread(every), ["_key", "_share", "_piece"]).drop("_share", "_piece")
    return add(cold.union(warm))


def merge(
    mapping: DataFrame, data_x: DataFrame, data_y: DataFrame, species_x: str | None = None, species_y: str | None = None,
    how: str = "inner", suffix: tuple[str, str] = ("_x", "_y"), drop_unresolved: bool = False, order: list[str] | None = None,
) -> DataFrame:
    """data_x and data_y joined on the resolved name of their species; species_resolved is the first column.

    Matched rows of the mapping, flagged ones among them, give name_x and name_y the key name_resolved, else name_y;
    of several rows of a name the first by `order` counts (default: all columns). Species columns are found if not named.
    how: inner, left or full. Rows without a key meet nothing and stay, with NULL, on the sides that how keeps, unless
    drop_unresolved. Columns that both tables have get the suffixes on both sides. Species that occur repeatedly multiply,
    as in any join, which merge_duplicates counts beforehand; those that give more than SHARE_ROWS rows are split on both
    sides, for they may be small before. Empty tables are as in SQL.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError("how must be inner, left or full")
    x, y = _keyed(mapping, data_x, data_y, (species_x, species_y), suffix, order)
    if how != "full":
        y = y.where("_key is not null")
    out = _joined(x, y, how)
    if drop_unresolved:
        out = out.where("_key is not null")
    return out.select(F.col("_key").alias("species_resolved"), *[F.col(f"`{c}`") for c in out.columns if c != "_key"])


def merge_duplicates(mapping: DataFrame, data_x: DataFrame, data_y: DataFrame, species_x: str | None = None, species_y: str | None = None, order: list[str] | None = None) -> DataFrame:
    """One row (n_dup_x, n_dup_y): rows of each table beyond the first of their resolved name, which a merge multiplies."""
    x, y = _keyed(mapping, data_x, data_y, (species_x, species_y), ("_x", "_y"), order)
    beyond = lambda df, name: df.where("_key is not null").groupBy("_key").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    return one_row(beyond(x, "n_dup_x"), beyond(y, "n_dup_y"))


def apply_to_data(mapping: DataFrame, data: DataFrame, species: str, drop_unresolved: bool = False) -> DataFrame:
    """The data, with drop_unresolved only the rows whose species is, letter by letter, a matched name_x."""
    require(data, [species], "the data")
    if not drop_unresolved:
        return data
    matched = mapping.where("in_x and in_y and name_x is not null").select(F.col("name_x").alias("_x")).distinct()
    return data.join(matched, F.col(f"`{species}`").cast("string") == F.col("_x"), "left_semi")


def clean_measure(col: Column, sentinels: tuple[float, ...] = (-999.0,), positive: bool = True) -> Column:
    """A measure with sentinels, and with positive also values of 0 and less, made NULL; text is read as numbers."""
    value = col.try_cast("double")
    bad = value.isin(*sentinels) | F.isnan(value)
    return F.when(~(bad | (value <= 0) if positive else bad), value)


def assemble(sources: dict[str, DataFrame], mapping: DataFrame, measures: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per resolved species from several sources (species and measures): how many records and sources it
    has, the sources in order, joined by '; ', and the median of each measure.

    Species that are NULL or that the mapping doesn't match are left out; matching is by name_x, its first row
    counting. A measure that a source lacks is NULL there. Medians are exact, which needs the values of one species in
    one task; they are folded to counted distinct values before that.
    """
    parts = []
    for name, df in sources.items():
        require(df, ["species"], f"source {name}")
        parts.append(df.select(F.lit(name).alias("source"), F.col("species").cast("string").alias("species"), *[(F.col(m).cast("double") if m in df.columns else F.lit(None).cast("double")).alias(m) for m in measures]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    by = [F.col(c) for c in order or MAPPING.fieldNames()]
    keys = first_rows(mapping.where("in_x and in_y and name_x is not null"), ["name_x"], by).select(
        F.col("name_x").alias("species"), F.coalesce("name_resolved", "name_y").alias("species_resolved")
    )
    known = rows.join(keys, "species").where("species_resolved is not null")
    return known.groupBy("species_resolved").agg(
        F.count("*").alias("n_records"),
        F.countDistinct("source").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"),
        *[F.median(m).alias(m) for m in measures],
    )


def source_coverage(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, n_records, n_species) of each source, NULL species not counting as one."""
    parts = [df.select(F.lit(n).alias("source"), F.col("species").cast("string").alias("species")) for n, df in sources.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("source").agg(F.count("*").alias("n_records"), F.countDistinct("species").alias("n_species"))


def species_means(df: DataFrame, species: str, measures: list[str]) -> DataFrame:
    """One row per species with the means of its measures, for tables that must have one row per species."""
    return df.where(F.col(species).isNotNull()).groupBy(species).agg(F.count("*").alias("n_records"), *[F.avg(m).alias(m) for m in measures])
