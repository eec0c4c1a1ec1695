"""Entry points: what is reconciled with what."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise
from ..functions.relational import first_rows
from ..functions.schema import MAPPING, check_authority, mapping_rows
from ..runtime import cut
from ..sources.ingest import check_not_empty, read_overrides, species_column, species_names
from .cascade import cascade
from .fuzzy import similar_names
from .mapping import Reconciliation
from .trees import count_lacking, graft_all, tips, validate


def tip_names(edges: DataFrame) -> DataFrame:
    """(name, pos) of the tips of a tree, or of all trees of a sample together, by node."""
    return tips(edges).where("label is not null").groupBy(F.col("label").alias("name")).agg(F.min("child").alias("pos"))


def _run(kind: str, x: DataFrame, y: DataFrame, overrides, labels: tuple[str, str], **options) -> Reconciliation:
    check_authority(options.get("authority", "col"))
    if overrides is not None:
        overrides = read_overrides(x.sparkSession, overrides)
    done = cascade(x, y, overrides=overrides, **options)
    meta = {"type": kind, "x": labels[0], "y": labels[1], "rank": options.get("rank", "species"), "timestamp": datetime.now(timezone.utc).isoformat()}
    plain = {k: v for k, v in options.items() if not isinstance(v, DataFrame)}
    return Reconciliation(done.mapping, meta | plain, unused_overrides=done.unused_overrides)


def reconcile_data(x: DataFrame, y: DataFrame, x_species: str | None = None, y_species: str | None = None, x_order: str | None = None, y_order: str | None = None, overrides=None, labels: tuple[str, str] = ("x", "y"), **options) -> Reconciliation:
    """Table against table. Species columns are found if not named; order columns say which name is first."""
    nx = check_not_empty(species_names(x, x_species, x_order), "x")
    ny = check_not_empty(species_names(y, y_species, y_order), "y")
    return _run("data_data", nx, ny, overrides, labels, **options)


def reconcile_tree(x: DataFrame, edges: DataFrame, x_species: str | None = None, x_order: str | None = None, overrides=None, labels: tuple[str, str] = ("x", "tree"), **options) -> Reconciliation:
    """Table against the tips of one tree."""
    nx = check_not_empty(species_names(x, x_species, x_order), "x")
    return _run("data_tree", nx, tip_names(validate(edges)), overrides, labels, **options)


def reconcile_trees(a: DataFrame, b: DataFrame, overrides=None, labels: tuple[str, str] = ("tree1", "tree2"), **options) -> Reconciliation:
    """Tips against tips."""
    return _run("tree_tree", tip_names(validate(a)), tip_names(validate(b)), overrides, labels, **options)


def reconcile_to_trees(x: DataFrame, trees: dict[str, DataFrame] | list[DataFrame], x_species: str | None = None, x_order: str | None = None, **options) -> dict[str, Reconciliation]:
    """One table against each of some trees, by name (tree_1, ... without names)."""
    named = trees if isinstance(trees, dict) else {f"tree_{i}": t for i, t in enumerate(trees, 1)}
    species = x_species or species_column(x)
    return {k: reconcile_tree(x, t, species, x_order, labels=("x", k), **options) for k, t in named.items()}


def reconcile_to_tree_set(x: DataFrame, edges: DataFrame, rank: str = "species", fuzzy: bool = False, fuzzy_threshold: float = 0.9, flag_threshold: float = 0.95, resolve: str = "flag") -> DataFrame:
    """(tree_id, mapping columns): names (name, pos) against every tree of a set at once, in one run keyed by tree.

    The stages are those of the cascade without overrides and synonyms. Each tree has its own leftovers; unresolved
    names of x appear once per tree, as they do when trees are taken one by one.
    """
    nx = x.where("name is not null").select("name", "pos", normalise(F.col("name"), rank).alias("norm"))
    ny = cut(tips(edges).where("label is not null").groupBy("tree_id", F.col("label").alias("name")).agg(F.min("child").alias("pos")).withColumn("norm", normalise(F.col("name"), rank)))
    ids = ny.select("tree_id").distinct()
    # each name is a question to each tree, which the result answers row by row; ids of trees are few beside their tips
    listed = F.broadcast(ids.agg(F.collect_list("tree_id").alias("_trees")).withColumn("_one", F.lit(1)))
    lx = cut(nx.withColumn("_one", F.lit(1)).join(listed, "_one").withColumn("tree_id", F.explode("_trees")).drop("_one", "_trees"))
    ly, stages = ny, []
    key = ["tree_id", "name"]

    def take(rows: DataFrame, **columns) -> None:
        nonlocal lx, ly
        rows = cut(_keyed(rows, **columns))
        stages.append(rows)
        lx = lx.join(rows.select("tree_id", F.col("name_x").alias("name")), key, "left_anti")
        ly = ly.join(rows.select("tree_id", F.col("name_y").alias("name")), key, "left_anti")

    take(lx.join(ly.select(*key), key).select("tree_id", F.col("name").alias("name_x"), F.col("name").alias("name_y")), match_type="exact", score=1.0, source="exact_string", notes="")
    targets = first_rows(ly.where("norm <> ''"), ["tree_id", "norm"], ["pos", "name"]).select("tree_id", "norm", F.col("name").alias("name_y"))
    normal = first_rows(lx.join(targets, ["tree_id", "norm"]), ["tree_id", "name_y"], ["pos", "name"]).withColumnRenamed("name", "name_x")
    take(normal, match_type="normalized", score=1.0, source="normalisation", notes=F.format_string("'%s' normalised to '%s'", "name_x", "norm"))
    if fuzzy:
        # distinct names are compared once, whatever the number of trees that they are in
        once = lambda df: df.groupBy("name", "norm").agg(F.min("pos").alias("pos"))
        alike = similar_names(once(lx), once(ly), fuzzy_threshold, rank).drop("pos_x", "pos_y")
        pairs = lx.select("tree_id", F.col("name").alias("name_x"), F.col("pos").alias("pos_x")).join(alike, "name_x").join(ly.select("tree_id", F.col("name").alias("name_y"), F.col("pos").alias("pos_y")), ["tree_id", "name_y"])
        best = first_rows(pairs, ["tree_id", "name_x"], [F.desc("score"), "genus_y", "pos_y", "name_y"])
        best = first_rows(best, ["tree_id", "name_y"], ["pos_x", "name_x"]).withColumn("rounded", F.round("score", 4))
        kind = F.when((F.col("rounded") < flag_threshold) & F.lit(resolve == "flag"), "flagged").otherwise("fuzzy")
        notes = F.concat(F.lit("Fuzzy match (score "), F.format_string("%.3f", "score"), F.lit("): '"), "norm_x", F.lit("' ~ '"), "norm_y", F.lit("'"))
        take(best, match_type=kind, score=F.col("rounded"), source="fuzzy_match", notes=notes)
    stages.append(_keyed(lx.select("tree_id", F.col("name").alias("name_x")), match_type="unresolved", score=None, source=None, notes="No match found in source y", in_y=False))
    stages.append(_keyed(ly.select("tree_id", F.col("name").alias("name_y")), match_type="unresolved", score=None, source=None, notes="No match found in source x", in_x=False))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def _keyed(df: DataFrame, match_type, score, source, notes, in_x: bool = True, in_y: bool = True) -> DataFrame:
    return mapping_rows(df, match_type, score, source, in_x, in_y, notes, keep=("tree_id",))


def reconcile_multi(datasets: dict[str, DataFrame], edges: DataFrame, species: str | dict[str, str] | None = None, order: str | None = None, overrides=None, **options) -> Reconciliation:
    """Several tables together against one tree; the mapping has a column in_<dataset> for each, saying whether it has
    the name. Several spellings may share a tip."""
    col = lambda k: species.get(k) if isinstance(species, dict) else species
    parts = [species_names(df, col(k), order).withColumn("_d", F.lit(k)).withColumn("_i", F.lit(i)) for i, (k, df) in enumerate(datasets.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    flags = cut(rows.groupBy("name").agg(F.min(F.struct("_i", "pos")).alias("pos"), *[F.bool_or(F.col("_d") == k).alias(f"in_{k}") for k in datasets]))
    rec = _run("multi", check_not_empty(flags.select("name", "pos"), "the datasets"), tip_names(validate(edges)), overrides, ("+".join(datasets), "tree"), multi_x=True, **options)
    marks = flags.drop("pos").withColumnRenamed("name", "name_x")
    wide = rec.mapping.join(marks, "name_x", "left").fillna(False, [f"in_{k}" for k in datasets])
    rec.mapping = wide.select(*MAPPING.fieldNames(), *[f"in_{k}" for k in datasets])
    return rec


@dataclass
class Augmented:
    tree: DataFrame
    original: DataFrame
    augmented: DataFrame
    skipped: DataFrame
    meta: dict


def reconcile_augment(rec: Reconciliation, edges: DataFrame, where: str = "genus", branch_length: str = "congener_median", order: str | None = None) -> Augmented:
    """The trees with the names of x that the reconciliation left unresolved grafted beside their congeners.

    order: a column of the mapping that says which name comes first (default: the names themselves). Without unresolved
    names the trees stay as they are. A name that occurs in several rows is grafted once on each tree that lacks it.
    """
    validate(edges)
    open_x = rec.mapping.where("match_type = 'unresolved' and in_x and not in_y and name_x is not null")
    named = open_x.groupBy(F.col("name_x").alias("name")).agg(F.min(F.col(order) if order else F.col("name_x")).alias("pos"))
    named = cut(named)
    tree, augmented, skipped = graft_all(edges, named, branch_length, where)
    # each name that a tree lacks is grafted as one more tip or skipped: counting needs no grafting
    n_augmented, n_skipped = count_lacking(edges, named)
    meta = {"n_augmented": n_augmented, "n_skipped": n_skipped, "where": where, "branch_length_method": branch_length, "source": "internal"}
    n = tips(edges).count()
    meta |= {"original_n_tips": n, "augmented_n_tips": n + n_augmented}
    return Augmented(tree, edges, augmented, skipped, meta)
