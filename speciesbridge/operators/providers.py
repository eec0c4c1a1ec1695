"""External services as protocols, and the bookkeeping around them.

Nothing here opens a connection: a parser, a verifier, a grafting or a dating service is passed in as an object, and a
test or a cluster without network passes one over tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import INFRASPECIFIC, placement_marker, standard_case, trim_blanks
from ..functions.relational import one_row
from .trees import tips, validate

#: A parser takes a batch of names and gives columns simple, full and stem, NULL where it can't say.
Parser = Callable[[pd.Series], pd.DataFrame]
#: A verifier takes a batch of names and gives current_simple, current_full, matched, match_type and taxon_id.
Verifier = Callable[[pd.Series], pd.DataFrame]


def normalise_with(df: DataFrame, name: str, parser: Parser, rank: str = "species") -> DataFrame:
    """df with `normalised` by an external parser: its simple form, else full, else stem, else the name as it is.

    Names go to the parser in Arrow batches. NULL stays NULL. Infraspecific parts and case are treated as everywhere.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _canonical string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = parser(pdf[name])
            form = said["simple"].fillna(said["full"]).fillna(said["stem"]).fillna(pdf[name])
            yield pdf.assign(_canonical=form.where(pdf[name].notna(), None))

    col = F.col("_canonical")
    if rank == "species":
        for pattern, by in INFRASPECIFIC:
            col = F.regexp_replace(col, pattern, by)
    return df.mapInPandas(parse, schema).withColumn("normalised", trim_blanks(standard_case(trim_blanks(col)))).drop("_canonical")


def verify_names(names: DataFrame, verifier: Verifier, authority: str = "gnverifier") -> DataFrame:
    """(input, accepted_name, status, taxon_id, authority) of distinct names by an external verifier.

    The accepted name is the current simple form, else the full one, else what was matched; it is accepted if the match
    is exact and current, a synonym otherwise. A batch on which the verifier fails is not_found, as is a name without match.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = verifier(pdf["name"])
                accepted = said["current_simple"].fillna(said["current_full"]).fillna(said["matched"])
                exact = (said["match_type"] == "Exact") & (accepted == said["matched"])
                status = exact.map({True: "accepted", False: "synonym"}).where(accepted.notna(), "not_found")
                yield pd.DataFrame({"input": pdf["name"], "accepted_name": accepted, "status": status, "taxon_id": said["taxon_id"]})
            except Exception:  # noqa: BLE001 - a service that fails finds nothing
                yield pd.DataFrame({"input": pdf["name"], "accepted_name": None, "status": "not_found", "taxon_id": None})

    asked = names.select("name").where("name is not null").distinct()
    return asked.mapInPandas(ask, "input string, accepted_name string, status string, taxon_id string").withColumn("authority", F.lit(authority))


def placement_account(species: DataFrame, augmented: DataFrame, original: DataFrame) -> DataFrame:
    """(species, placement): how a grafting service placed each wanted species (name) in its tree.

    exact if the original tree had the tip, else by the asterisks of its label: genus_added or family_added; skipped if
    it isn't there.
    """
    clean, placed = placement_marker(F.col("label"))
    as_tip = lambda c: F.regexp_replace(c, " ", "_")
    found = tips(augmented).where("label is not null").select(as_tip(clean).alias("tip"), placed.alias("placed")).groupBy("tip").agg(F.max("placed").alias("placed"))
    had = tips(original).where("label is not null").select(as_tip(F.col("label")).alias("tip"), F.lit(True).alias("had")).distinct()
    wanted = species.where("name is not null").select(F.col("name").alias("species"), as_tip(F.col("name")).alias("tip")).distinct()
    kind = F.when(F.col("had"), "exact").when(F.col("placed").isNull(), "skipped").when(F.col("placed") == "exact", "genus_added").otherwise(F.col("placed"))
    return wanted.join(found, "tip", "left").join(had, "tip", "left").select("species", kind.alias("placement"))


def augment_with(species: DataFrame, edges: DataFrame, graft: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a service's tree with its markers taken off, the account of it)."""
    tree = validate(graft(species, edges))
    clean, _ = placement_marker(F.col("label"))
    return tree.withColumn("label", clean), placement_account(species, tree, edges)


def date_tree(edges: DataFrame, dater: Callable[[DataFrame, int], DataFrame], n_dated: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the first n_dated dated trees of a service, one row with n_tips_in, n_tips_out, n_tips_lost and n_trees)."""
    if n_dated < 1:
        raise ValueError("n_dated must be at least 1")
    dated = dater(edges, n_dated)
    ids = dated.select("tree_id").distinct().orderBy("tree_id").limit(n_dated)
    dated = dated.join(ids, "tree_id", "left_semi")
    before = tips(edges).where("label is not null").select("label").distinct()
    after = tips(dated).where("label is not null").select("label").distinct()
    account = one_row(
        before.agg(F.count("*").alias("n_tips_in")), after.agg(F.count("*").alias("n_tips_out")),
        before.join(after, "label", "left_anti").agg(F.count("*").alias("n_tips_lost")), ids.agg(F.count("*").alias("n_trees")),
    )
    return dated, account

