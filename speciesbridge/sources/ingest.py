"""Tables in: species columns, ordered inputs, overrides and crosswalks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.relational import names
from ..functions.schema import require
from ..runtime import cut

# Names of species columns, the most telling first; case doesn't count.
SPECIES_COLUMNS = (
    "species", "species_name", "binomial", "taxon", "scientificName", "Scientific_name", "canonical_name", "tip.label", "PhyloName",
    "Binomial", "latin_name", "sci_name", "sciName", "phylo_name", "tip_label", "Species", "Species_name", "SPECIES",
)
BINOMIAL = r"^[A-Z][a-z]+ [a-z]+"
#: How CSV files are written and read, so that values with blanks, quotes and line ends come back as they were, and ''
#: apart from NULL, which is written NA.
CSV = {"header": True, "escape": '"', "nullValue": "NA", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def binomial_shares(df: DataFrame) -> DataFrame:
    """(column_name, n_values, n_binomial) of each string column: values that aren't empty, and those that look like
    binomials. One aggregation over all columns; a table without string columns gives no rows."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column_name string, n_values bigint, n_binomial bigint")
    cells = []
    for i, c in enumerate(texts):
        v = F.col(f"`{c}`")
        cells += [F.count_if(F.length(v) > 0).alias(f"n{i}"), F.count_if(v.rlike(BINOMIAL)).alias(f"b{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values"), F.col(f"b{i}").alias("n_binomial")) for i, c in enumerate(texts)])
    return df.agg(*cells).select(F.inline(rows))


def species_column(df: DataFrame) -> str:
    """The column that holds species: by its name, if exactly one column has one of the known ones, else the only string
    column of which, of three values or more, over half look like binomials. None or several are an error."""
    for known in SPECIES_COLUMNS:
        hits = [c for c in df.columns if c.lower() == known.lower()]
        if len(hits) == 1:
            return hits[0]
    found = [r["column_name"] for r in binomial_shares(df).where("n_values >= 3 and n_binomial > 0.5 * n_values").collect()]
    if len(found) == 1:
        return found[0]
    raise ValueError(f"several columns look like species names: {sorted(found)}" if found else f"no column looks like species names among {df.columns}")


def with_pos(df: DataFrame, name: str = "pos") -> DataFrame:
    """df with a unique column in the order in which the source is read; written out, so that it stays fixed."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def species_names(df: DataFrame, species: str | None = None, order: str | None = None) -> DataFrame:
    """(name, pos): distinct species, NULL left out, in the order of `order` or else of the names themselves."""
    species = species or species_column(df)
    require(df, [species], "the table")
    if order is None:
        df, order = df.select(F.col(f"`{species}`").alias(species), F.col(f"`{species}`").cast("string").alias("_pos")), "_pos"
    return names(df, species, order)


def check_not_empty(found: DataFrame, what: str) -> DataFrame:
    if found.isEmpty():
        raise ValueError(f"{what} has no species names")
    return found


def read_overrides(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """(name_x, name_y, user_note, pos) from a CSV file or a table; the note defaults to 'Pre-built override'."""
    df = spark.read.csv(source, multiLine=True, **CSV) if isinstance(source, str) else source
    require(df, ["name_x", "name_y"], "the overrides")
    if "user_note" not in df.columns:
        df = df.withColumn("user_note", F.lit("Pre-built override"))
    return df if "pos" in df.columns else with_pos(df)


def read_crosswalk(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A crosswalk from a table or a file: csv by commas, tsv and txt by tabs."""
    if not isinstance(source, str):
        return source
    kind = os.path.splitext(source)[1].lower()
    if kind not in (".csv", ".tsv", ".txt"):
        raise ValueError("a crosswalk file must be csv, tsv or txt")
    return spark.read.csv(source, sep="," if kind == ".csv" else "\t", multiLine=True, **CSV)
