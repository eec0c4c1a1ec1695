"""Trees asked from providers, with an account of what was found.

There is no network here: a provider is anything with the protocol below, such as TableProvider over tables at hand.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise, placement_marker
from ..functions.relational import first_rows
from ..functions.schema import require
from ..runtime import cut
from ..sources.cache import TreeCache
from ..sources.ingest import check_not_empty, species_column
from ..sources.treefiles import first_tree
from .mapping import Reconciliation
from .trees import grafen, resolve_polytomies, tip_set_gaps, tips, ultrametric, unit_lengths


# The tree services in the order in which they are tried, whether they need a network, where they are had,
# and what is cited for them.
BACKENDS = {
    "rotl": (True, "CRAN", "Hinchliff et al. (2015) Synthesis of phylogeny and taxonomy into a comprehensive tree of life. PNAS 112:12764-12769. doi:10.1073/pnas.1423041112"),
    "rtrees": (False, "CRAN", "Li, D. (2023). rtrees: an R package to assemble phylogenetic trees from megatrees. Ecography, 2023, e06643. doi:10.1111/ecog.06643"),
    "clootl": (False, "CRAN", "Miller, E. T. (2023). clootl: Clements taxonomy phylogenies."),
    "fishtree": (True, "CRAN", "Rabosky et al. (2018). An inverse latitudinal gradient in speciation rate for marine fishes. Nature, 559(7714), 392-395. doi:10.1038/s41586-018-0273-1"),
    "datelife": (False, "github", "Sanchez Reyes, L. L., McTavish, E. J., & O'Meara, B. (2024). DateLife. Systematic Biology, 73(2), 470-485. doi:10.1093/sysbio/syae015"),
}


class TreeProvider(Protocol):
    name: str
    citation: str
    calibration: str

    def fetch(self, query: DataFrame, n_tree: int) -> DataFrame:
        """Edges for the names of query (query_name)."""


@dataclass
class TableProvider:
    """Trees from a table of edges, all of it or the first n_tree by id."""

    name: str
    edges: DataFrame
    citation: str = "(no citation available)"
    calibration: str = "none"

    def fetch(self, query: DataFrame, n_tree: int) -> DataFrame:
        ids = self.edges.select("tree_id").distinct().orderBy("tree_id").limit(n_tree)
        return self.edges.join(F.broadcast(ids) if n_tree < 100_000 else ids, "tree_id", "left_semi")


@dataclass
class TreeResult:
    edges: DataFrame
    mapping: DataFrame
    source: str
    meta: dict = field(default_factory=dict)

    @property
    def matched(self) -> DataFrame:
        return self.mapping.where("in_tree").select("input_name")

    @property
    def dropped(self) -> DataFrame:
        """(tree_id, label): tips of the sample that a tree lacks, none where all trees have the same."""
        t = tips(self.edges).where("label is not null").select("tree_id", "label").distinct()
        n = t.select("tree_id").distinct().agg(F.count("*").alias("trees"))
        held = t.groupBy("label").agg(F.count("*").alias("n"))
        some = held.join(n, held["n"] < n["trees"]).select("label")
        return t.select("tree_id").distinct().join(some).join(t, ["tree_id", "label"], "left_anti")

    @property
    def unmatched(self) -> DataFrame:
        return self.mapping.where("not in_tree").select("input_name")


def resolve_query(species: DataFrame, replacements: DataFrame | None = None, rank: str = "species") -> DataFrame:
    """(input_name, normalized_name, query_name, tnrs_*): each distinct name as asked for.

    species: name. replacements: answers of a name service (search_string in lower case, unique_name, number_matches,
    is_synonym, approximate_match, flags); an answer replaces the normal form it was asked for unless it is empty. Of
    several answers the first by unique_name counts.
    """
    asked = species.where("name is not null").select(F.col("name").alias("input_name")).distinct().withColumn("normalized_name", normalise(F.col("input_name"), rank))
    none = lambda t: F.lit(None).cast(t)
    if replacements is None:
        return asked.select("*", F.col("normalized_name").alias("query_name"), none("int").alias("tnrs_number_matches"), none("boolean").alias("tnrs_is_synonym"), none("boolean").alias("tnrs_approximate_match"), none("string").alias("tnrs_flags"))
    answers = first_rows(replacements.where("search_string is not null"), ["search_string"], ["unique_name"])
    found = asked.withColumn("search_string", F.lower("normalized_name")).join(answers, "search_string", "left")
    better = normalise(F.col("unique_name"), rank)
    return found.select(
        "input_name", "normalized_name", F.when(better != "", better).otherwise(F.col("normalized_name")).alias("query_name"),
        F.col("number_matches").cast("int").alias("tnrs_number_matches"), F.col("is_synonym").alias("tnrs_is_synonym"),
        F.col("approximate_match").alias("tnrs_approximate_match"), F.col("flags").alias("tnrs_flags"),
    )


def tree_mapping(query: DataFrame, edges: DataFrame, rank: str = "species", placement: DataFrame | None = None) -> DataFrame:
    """The mapping of asked names to the tips of the first tree, by normal form, with match type and placement.

    Asterisks that mark grafted tips don't count in names. Of several tips of one normal form the first by node counts.
    placement: what a grafting service says of the names (input_name, and tree_name, placement_status or both); it comes
    before what was found, the first of several by tree_name; without it placement_status is NULL.
    """
    t = tips(first_tree(edges)).where("label is not null")
    clean, _ = placement_marker(F.col("label"))
    named = t.select(F.col("label").alias("tree_name"), normalise(clean, rank).alias("_norm"), "child").where("_norm <> ''")
    by_norm = first_rows(named, ["_norm"], ["child"]).drop("child")
    found = query.withColumn("_norm", normalise(F.col("query_name"), rank)).join(by_norm, "_norm", "left")
    found = found.withColumn("placement_status", F.lit(None).cast("string"))
    if placement is not None:
        said = [c for c in ("tree_name", "placement_status") if c in placement.columns]
        first = first_rows(placement.where("input_name is not null"), ["input_name"], said).select("input_name", *[F.col(c).alias(f"_{c}") for c in said], F.lit(True).alias("_said"))
        found = found.join(first, "input_name", "left")
        for c in said:
            found = found.withColumn(c, F.when(F.col("_said"), F.col(f"_{c}")).otherwise(F.col(c)))
    kind = (
        F.when(F.col("tree_name").isNull(), "unmatched").when(F.col("query_name") != F.col("normalized_name"), "tnrs")
        .when(F.col("normalized_name") != F.col("input_name"), "normalized").otherwise("exact")
    )
    return found.select(
        "input_name", "normalized_name", "query_name", "tree_name", F.col("tree_name").isNotNull().alias("in_tree"), kind.alias("match_type"),
        "placement_status",
        "tnrs_number_matches", "tnrs_is_synonym", "tnrs_approximate_match", "tnrs_flags",
    )


def provenance(edges: DataFrame, citation: str, calibration: str) -> DataFrame:
    """(tree_id, citation, calibration_method, n_tips) of each tree."""
    return tips(edges).groupBy("tree_id").agg(F.count("*").alias("n_tips")).select("tree_id", F.lit(citation).alias("citation"), F.lit(calibration).alias("calibration_method"), "n_tips")


def asked_species(x: DataFrame | Reconciliation, species_col: str | None = None) -> DataFrame:
    """(name) asked for: the names of y of a reconciliation, or the species of a table; NULL and repeated ones once less."""
    if isinstance(x, Reconciliation):
        names = x.mapping.select(F.col("name_y").alias("name"))
    else:
        column = species_col or ("name" if "name" in x.columns else species_column(x))
        require(x, [column], "the table of species")
        names = x.select(F.col(f"`{column}`").cast("string").alias("name"))
    return names.where("name is not null").distinct()


def get_tree(
    x: DataFrame | Reconciliation, provider: TreeProvider, n_tree: int = 1, replacements: DataFrame | None = None, binary: bool = False,
    branch_lengths: str | None = None, species_col: str | None = None, tnrs: str = "auto", cache: TreeCache | None = None,
    check_ultrametric: bool = True, placement: DataFrame | None = None,
) -> TreeResult:
    """A provider's trees for some species, with the account of what they hold.

    x: a table with a species column (name, or species_col, or found) or a reconciliation, whose names of y are asked.
    tnrs: whether a name service's answers (replacements) are used: auto if they are given, always (an error without
    them) or never. cache: where fetched trees are kept by what was asked for. Trees that aren't ultrametric are warned
    of. meta has the counts, whether all trees have the same tips, and the citation; `dropped` the tips that trees lack.
    No names at all are an error; so is an account that doesn't add up.
    """
    if n_tree < 1:
        raise ValueError("n_tree must be at least 1")
    if branch_lengths not in (None, "grafen", "compute.brlen", "unit"):
        raise ValueError("branch_lengths must be grafen, compute.brlen, unit or None")
    if tnrs not in ("auto", "always", "never"):
        raise ValueError("tnrs must be auto, always or never")
    if tnrs == "always" and replacements is None:
        raise ValueError("tnrs='always' needs the answers of a name service")
    species = check_not_empty(asked_species(x, species_col), "the query")
    query = cut(resolve_query(species, None if tnrs == "never" else replacements))
    key = None if cache is None else cache.key(query.select(F.concat_ws("\x00", "input_name", "query_name")), provider.name, n_tree=n_tree, tnrs=tnrs)
    edges = None if cache is None else cache.get(provider.name, key)
    cached = edges is not None
    if not cached:
        edges = provider.fetch(query.select("query_name"), n_tree)
        if cache is not None:
            cache.put(provider.name, key, edges)
            edges = cache.get(provider.name, key)
    if binary:
        edges = resolve_polytomies(edges)
    if branch_lengths:
        edges = unit_lengths(edges) if branch_lengths == "unit" else grafen(edges)
    mapping = tree_mapping(query, edges, placement=placement)
    n = mapping.agg(F.count("*").alias("n"), F.count_distinct("input_name").alias("names"), F.count_if("in_tree").alias("m"), F.count_if(F.col("in_tree") != F.col("tree_name").isNotNull()).alias("odd")).first()
    if n["n"] != n["names"] or n["n"] != query.count() or n["m"] > n["n"] or n["odd"] and placement is None:
        raise RuntimeError(f"the account of {provider.name} doesn't add up: {n.asDict()}")
    gaps = tip_set_gaps(edges).agg(F.count("*").alias("trees"), F.coalesce(F.max("n_missing"), F.lit(0)).alias("missing")).first()
    if check_ultrametric:
        uneven = ultrametric(edges).where("not is_ultrametric").count()
        if uneven:
            warnings.warn(f"{uneven} of {gaps['trees']} trees from {provider.name} are not ultrametric", stacklevel=2)
    meta = {
        "n_queried": n["n"], "n_matched": n["m"], "n_requested": n_tree, "n_returned": gaps["trees"], "tip_set_consistent": gaps["missing"] == 0,
        "cached": cached, "citation": provider.citation, "calibration": provider.calibration,
    }
    return TreeResult(edges, mapping, provider.name, meta)


def get_tree_auto(species: DataFrame, providers: list[TreeProvider], min_match: float = 0.8, **asked) -> TreeResult:
    """The first provider that has min_match of the names, else the best one; what was tried is in meta."""
    if not providers:
        raise ValueError("no providers")
    best, attempts = None, {}
    for p in providers:
        try:
            got = get_tree(species, p, **asked)
        except Exception as e:  # noqa: BLE001 - a provider that fails is passed over
            attempts[p.name] = {"success": False, "n_matched": 0, "error": str(e)[:200]}
            continue
        n = got.meta["n_matched"]
        attempts[p.name] = {"success": True, "n_matched": n}
        if best is None or n > best.meta["n_matched"]:
            best = got
        if n >= min_match * got.meta["n_queried"]:
            best = got
            break
    if best is None:
        raise RuntimeError("no provider gave a tree")
    best.meta |= {"auto_attempts": attempts, "auto_chose": best.source}
    return best


def provider_status(providers: list[TreeProvider]) -> list[dict]:
    """Per provider: source, installed, version, needs_network, reachable, install_hint, source_repo and citation.

    A provider says itself, by attributes of these names, what differs from a table at hand; reachable is None where no
    network is needed or nothing was asked.
    """
    said = {"installed": True, "version": None, "needs_network": False, "reachable": None, "install_hint": None, "source_repo": None}
    return [{"source": p.name} | {k: getattr(p, k, v) for k, v in said.items()} | {"citation": p.citation} for p in providers]


def backend(name: str, edges: DataFrame) -> TableProvider:
    """One of the known tree services as a provider over a table of its trees, with what is to be cited for it."""
    if name not in BACKENDS:
        raise ValueError(f"the services are {tuple(BACKENDS)}, not {name!r}")
    network, repo, citation = BACKENDS[name]
    out = TableProvider(name, edges, citation)
    out.needs_network, out.source_repo = network, repo
    return out


def cite(result: TreeResult, form: str = "text") -> str:
    """The citation of a result's trees as text, markdown or bibtex; trees are listed if there are several."""
    trees = [r.asDict() for r in provenance(result.edges, result.meta["citation"], result.meta["calibration"]).orderBy("tree_id").toLocalIterator()]
    name, cited = result.source, result.meta["citation"]
    if form == "text":
        lines = [f"Trees from {name}: {cited}"] + ([f"  [{i}] {t['citation']} (calibration: {t['calibration_method']})" for i, t in enumerate(trees, 1)] if len(trees) > 1 else [])
    elif form == "markdown":
        lines = [f"**Trees from {name}**", "", f"- {cited}"] + ([f"- [{i}] {t['citation']} _(calibration: {t['calibration_method']})_" for i, t in enumerate(trees, 1)] if len(trees) > 1 else [])
    elif form == "bibtex":
        esc = lambda s: s.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}")
        lines = [f"@misc{{{name},\n  note = {{{esc(cited)}}}\n}}"] + ([f"@misc{{{name}_tree{i},\n  note = {{{esc(t['citation'])}}}\n}}" for i, t in enumerate(trees, 1)] if len(trees) > 1 else [])
    else:
        raise ValueError("form must be text, markdown or bibtex")
    return "\n".join(lines)
