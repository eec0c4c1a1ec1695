"""Queries that go through files and through services given as tables: sources, sinks, providers, retrieval, review."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relational import names
from ..functions.schema import MAPPING
from ..operators import mapping as M
from ..operators import providers as P
from ..operators import retrieval as R
from ..operators import trees as T
from ..operators.cascade import cascade
from ..operators.crosswalk import crosswalk_overrides
from ..operators.merge import merge_duplicates
from ..operators.reconcile import reconcile_augment
from ..operators.synonyms import register_authority
from ..runtime import scratch, table
from ..sources import sinks
from ..sources.cache import TreeCache
from ..sources.ingest import CSV, read_overrides
from ..sources.treefiles import read_trees, write_trees
from . import sqlparts as S
from .forests import QUERY, _edges, _query
from .mappings import COUNTS, CROSSWALK, _batch, _mapping
from .matching import CLEAN_Y, SPECIES, _names, _taxa
from .registry import Registry

REGISTRY = Registry()
NINE = MAPPING.fieldNames()


def _add(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    REGISTRY.add(name, sql)(lambda spark, folder: run(spark, folder))


# files out and in


def _overrides_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    table(spark, folder, "override_batch").select("name_x", "name_y", F.col("note").alias("user_note")).write.csv(path, **CSV)
    return read_overrides(spark, path).drop("pos")


def _crosswalk_from_tsv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark) + ".tsv"
    table(spark, folder, "crosswalk").select("from_name", "to_name", "link_type", "notes").write.csv(path, sep="\t", **CSV)
    return crosswalk_overrides(path, "from_name", "to_name", "link_type", "notes")


def _through_file(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Of each tree, written and read again, what doesn't depend on the numbers of nodes."""
    path = scratch(spark)
    write_trees(_edges(spark, folder), path, kind)
    read = read_trees(spark, f"{path}/part-*", first_only=False)
    label = F.col("label")
    return read.groupBy("tree_id").agg(
        F.count_if("is_tip").alias("n_tips"), F.count("*").alias("n_edges"), F.round(F.sum("edge_length"), 6).alias("length"), F.min(label).alias("first"), F.max(label).alias("last"), F.sum(F.length(label)).alias("letters")
    ).drop("tree_id")


SHAPES = "SELECT count(*) FILTER (is_tip) AS n_tips, count(*) AS n_edges, round(sum(edge_length), 6) AS length, min(label) AS first, max(label) AS last, sum(length(label)) AS letters FROM tree_edges GROUP BY tree_id"


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    paths = sinks.export(M.Reconciliation(_mapping(spark, folder).select(*NINE)), scratch(spark))
    return spark.read.schema(MAPPING).csv(paths["mapping"], multiLine=True, **CSV)


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    cache, e = TreeCache(spark, scratch(spark)), _edges(spark, folder)
    key = cache.key(T.tips(e).select("label"), "table", n_tree=1)
    if cache.get("table", key) is not None:
        raise RuntimeError("a new cache has an entry")
    cache.put("table", key, e)
    return cache.get("table", key)


_add("overrides_from_csv", "SELECT name_x, name_y, note AS user_note FROM override_batch", _overrides_from_csv)
_add("crosswalk_from_tsv", CROSSWALK, _crosswalk_from_tsv)
_add("trees_through_newick", SHAPES, lambda s, f: _through_file(s, f, "newick"))
_add("trees_through_nexus", SHAPES, lambda s, f: _through_file(s, f, "nexus"))
_add("mapping_through_csv", f"SELECT {S.COLS} FROM mapping", _exported)
_add("trees_through_cache", "SELECT tree_id, parent, child, edge_length, label, is_tip FROM tree_edges", _cached)
SHOWN = ("unresolved", "flagged", "fuzzy", "synonym", "manual", "normalized")
_add("report_rows", f"""SELECT match_type, rank, name_x, name_y FROM (SELECT match_type, name_x, name_y, row_number() OVER (PARTITION BY match_type ORDER BY name_x NULLS FIRST, name_y NULLS FIRST) AS rank
FROM mapping WHERE match_type IN {SHOWN}) WHERE rank <= 20""", lambda s, f: sinks.report_rows(_mapping(s, f), list(SHOWN), 20))  # fmt: skip
_add("summary_text", f"""SELECT 'Reconciliation (unknown): ' || n_x || ' x, ' || n_y || ' y, coverage ' || printf('%.1f', 100 * (n_exact + n_normalized + n_synonym + n_fuzzy + n_manual)::DOUBLE / n_x) || ' %; exact ' || n_exact || ', normalized ' || n_normalized
|| ', synonym ' || n_synonym || ', fuzzy ' || n_fuzzy || ', manual ' || n_manual || ', flagged ' || n_flagged || '; unresolved ' || n_unresolved_x || ' x, ' || n_unresolved_y || ' y' AS text FROM ({COUNTS})""",
     lambda s, f: s.createDataFrame([(sinks.summary_text(M.Reconciliation(_mapping(s, f)), "brief"),)], "text string"))
_add("html_report", f"SELECT n_x, n_y, n_flagged FROM ({COUNTS})", lambda s, f: _report_counts(s, f))


def _report_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts as the page shows them."""
    import re

    page = sinks.html_report(M.Reconciliation(_mapping(spark, folder)))
    shown = dict(re.findall(r"<tr><th>(n_\w+)</th><td>(\d+)</td></tr>", page))
    return spark.createDataFrame([tuple(int(shown[c]) for c in ("n_x", "n_y", "n_flagged"))], "n_x bigint, n_y bigint, n_flagged bigint")


# review and log

for _kind, _sql in (
    ("flagged", "match_type = 'flagged'"), ("fuzzy", "match_type IN ('fuzzy', 'flagged')"), ("all_unresolved", "match_type IN ('unresolved', 'flagged') AND in_x"),
):
    _add(f"review_{_kind}", f"SELECT map_id, {S.COLS} FROM mapping WHERE {_sql}", lambda s, f, k=_kind: M.review_candidates(_mapping(s, f), k))

_add("override_log", """SELECT name_x, name_y, coalesce(lower(trim(action)), 'accept') AS action, coalesce(note, '') AS user_note FROM override_batch
WHERE coalesce(lower(trim(action)), 'accept') = 'reject' OR name_y IS NOT NULL""", lambda s, f: M.apply_batch(M.Reconciliation(_mapping(s, f)), _batch(s, f), "override_id", ["map_id"]).overrides.drop("timestamp"))  # fmt: skip


# authority by name


def _by_name(spark: SparkSession, folder: str) -> DataFrame:
    register_authority("col", _taxa(spark, folder))
    return cascade(_names(spark, folder, SPECIES), _names(spark, folder, CLEAN_Y), authority="COL").mapping


_add("cascade_registered_authority", S.cascade(SPECIES, CLEAN_Y, authority=True) + f"SELECT {S.COLS} FROM result", _by_name)


# services given as functions and tables


def _plain_parser(values: pd.Series) -> pd.DataFrame:
    """A parser that only knows names with underscores."""
    known = values.where(values.str.contains("_", na=False))
    return pd.DataFrame({"simple": known.str.replace("_", " "), "full": None, "stem": None})


def _plain_verifier(values: pd.Series) -> pd.DataFrame:
    """A verifier that takes names of an even number of letters for current, and the others for synonyms of what is before
    their last letter; names that begin with T it doesn't know."""
    even = values.str.len() % 2 == 0
    current = values.where(even, values.str[:-1])
    unknown = values.str.startswith("T")
    out = pd.DataFrame({"current_simple": current, "current_full": None, "matched": values, "match_type": "Exact", "taxon_id": "n" + values.str.len().astype(str)})
    out.loc[unknown, ["current_simple", "matched", "taxon_id"]] = None
    return out


_add("parsed_names", "SELECT map_id, name_x, trim(list_transform([trim(replace(name_x, '_', ' '), ' ' || chr(9) || chr(10) || chr(13))], lambda n: upper(left(n, 1)) || lower(substring(n, 2)))[1], ' ' || chr(9) || chr(10) || chr(13)) AS normalised FROM mapping",
     lambda s, f: P.normalise_with(_mapping(s, f).select("map_id", "name_x"), "name_x", _plain_parser, "subspecies"))
_add("verified_names", """SELECT name AS input, CASE WHEN name LIKE 'T%' THEN NULL WHEN length(name) % 2 = 0 THEN name ELSE substring(name, 1, length(name) - 1) END AS accepted_name,
CASE WHEN name LIKE 'T%' THEN 'not_found' WHEN length(name) % 2 = 0 THEN 'accepted' ELSE 'synonym' END AS status, CASE WHEN name NOT LIKE 'T%' THEN 'n' || length(name) END AS taxon_id, 'gnverifier' AS authority
FROM (SELECT DISTINCT to_name AS name FROM crosswalk WHERE to_name IS NOT NULL)""", lambda s, f: P.verify_names(table(s, f, "crosswalk").select(F.col("to_name").alias("name")), _plain_verifier))  # fmt: skip


def _marked(species: DataFrame, edges: DataFrame) -> DataFrame:
    """A grafting service: what a tree lacks hangs on its root, with one or two asterisks by the length of its name."""
    tip = species.where("name is not null").select(F.regexp_replace("name", " ", "_").alias("tip")).distinct()
    new = tip.join(T.tips(edges).select(F.regexp_replace("label", " ", "_").alias("tip")).distinct(), "tip", "left_anti").where("length(tip) % 3 > 0")
    hung = new.join(F.broadcast(T.roots(edges))).select("tree_id", F.col("root").alias("parent"), F.abs(F.xxhash64("tip")).alias("child"), F.lit(1.0).alias("edge_length"), F.concat("tip", F.repeat(F.lit("*"), F.expr("int(length(tip) % 3)"))).alias("label"), F.lit(True).alias("is_tip"))
    return edges.unionByName(hung)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    wanted = names(table(spark, folder, "crosswalk"), "to_name", "xw_id").select("name")
    return P.augment_with(wanted, R.first_tree(_edges(spark, folder)), _marked)[1]


_add("graft_service_account", """WITH l AS (SELECT DISTINCT replace(label, ' ', '_') AS tip FROM tree_edges WHERE is_tip AND label IS NOT NULL AND tree_id = (SELECT min(tree_id) FROM tree_edges))
SELECT DISTINCT to_name AS species, CASE WHEN replace(to_name, ' ', '_') IN (SELECT tip FROM l) THEN 'exact' WHEN length(to_name) % 3 = 0 THEN 'skipped' WHEN length(to_name) % 3 = 1 THEN 'genus_added' ELSE 'family_added' END AS placement
FROM crosswalk WHERE to_name IS NOT NULL""", _placed)  # fmt: skip
_add("date_service_account", f"""WITH l AS (SELECT DISTINCT label, tree_id FROM tree_edges WHERE is_tip AND label IS NOT NULL), two AS (SELECT DISTINCT tree_id FROM tree_edges ORDER BY 1 LIMIT 2),
o AS (SELECT DISTINCT label FROM l WHERE tree_id IN (SELECT tree_id FROM two))
SELECT (SELECT count(DISTINCT label) FROM l) AS n_tips_in, (SELECT count(*) FROM o) AS n_tips_out, (SELECT count(DISTINCT label) FROM l WHERE label NOT IN (SELECT label FROM o)) AS n_tips_lost, (SELECT count(*) FROM two) AS n_trees""",
     lambda s, f: P.date_tree(_edges(s, f), lambda e, n: T.grafen(e), 2)[1])


# retrieval


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mapping").select(F.col("name_y").alias("name"))


def _quiet(x, provider: R.TableProvider, **asked) -> R.TreeResult:
    return R.get_tree(x, provider, check_ultrametric=False, **asked)


def _provider(spark: SparkSession, folder: str, name: str = "table") -> R.TableProvider:
    return R.TableProvider(name, _edges(spark, folder), "test trees")


def _account(spark: SparkSession, folder: str) -> DataFrame:
    got = _quiet(_asked(spark, folder), _provider(spark, folder), n_tree=3, cache=TreeCache(spark, scratch(spark)))
    m = got.meta
    return spark.createDataFrame([(m["n_queried"], m["n_matched"], m["n_returned"], m["tip_set_consistent"], got.dropped.count())], "n_queried bigint, n_matched bigint, n_returned bigint, tip_set_consistent boolean, n_dropped bigint")


PLAIN = f"""q AS (SELECT DISTINCT name_y AS input_name FROM mapping WHERE name_y IS NOT NULL), o AS (SELECT input_name, {S.NORM('input_name')} AS norm FROM q), n AS (SELECT input_name, {S.NORM('norm')} AS norm FROM o),
three AS (SELECT DISTINCT tree_id FROM tree_edges ORDER BY 1 LIMIT 3), l AS (SELECT DISTINCT tree_id, label FROM tree_edges WHERE is_tip AND label IS NOT NULL AND tree_id IN (SELECT tree_id FROM three)),
f AS (SELECT DISTINCT {S.NORM('label')} AS norm FROM l WHERE tree_id = (SELECT min(tree_id) FROM three)),
m AS (SELECT input_name, norm <> '' AND norm IN (SELECT norm FROM f) AS hit FROM n)"""
GAPS = "(SELECT count(DISTINCT label) FROM l) * (SELECT count(*) FROM three) - (SELECT count(*) FROM l)"
_add("get_tree_account", f"WITH {PLAIN} SELECT count(*) AS n_queried, count(*) FILTER (hit) AS n_matched, (SELECT count(*) FROM three) AS n_returned, {GAPS} = 0 AS tip_set_consistent, {GAPS} AS n_dropped FROM m", _account)


def _auto(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    small = R.TableProvider("small", T.prune(R.first_tree(e), T.tips(e).where("label < 'C'")), "few tips")
    got = R.get_tree_auto(_asked(spark, folder), [small, _provider(spark, folder)], 1.0, check_ultrametric=False)
    tried = [(k, v["success"], v["n_matched"], k == got.source) for k, v in got.meta["auto_attempts"].items()]
    return spark.createDataFrame(tried, "source string, success boolean, n_matched bigint, chosen boolean")


_add("get_tree_auto", f"""WITH {PLAIN}, s AS (SELECT DISTINCT {S.NORM('label')} AS norm FROM l WHERE tree_id = (SELECT min(tree_id) FROM three) AND label < 'C'),
c AS (SELECT count(*) FILTER (norm <> '' AND norm IN (SELECT norm FROM s)) AS a, count(*) FILTER (norm <> '' AND norm IN (SELECT norm FROM f)) AS b FROM n)
SELECT 'small' AS source, true AS success, a AS n_matched, a >= b AS chosen FROM c UNION ALL SELECT 'table', true, b, b > a FROM c""", _auto)  # fmt: skip
_add("provider_status", "SELECT * FROM (VALUES ('rotl', true, true, 'CRAN'), ('rtrees', true, false, 'CRAN'), ('clootl', true, false, 'CRAN'), ('fishtree', true, true, 'CRAN'), ('datelife', true, false, 'github')) AS t(source, installed, needs_network, source_repo)",
     lambda s, f: s.createDataFrame([(p["source"], p["installed"], p["needs_network"], p["source_repo"]) for p in R.provider_status([R.backend(b, _edges(s, f)) for b in R.BACKENDS])], "source string, installed boolean, needs_network boolean, source_repo string"))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    text = R.cite(_quiet(_asked(spark, folder), _provider(spark, folder), n_tree=3))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line bigint, text string")


_add("citation_lines", """SELECT 0::BIGINT AS line, 'Trees from table: test trees' AS text
UNION ALL SELECT i, '  [' || i || '] test trees (calibration: none)' FROM (SELECT least(3, count(DISTINCT tree_id)) AS n FROM tree_edges), unnest(range(1, n + 1)) AS u(i) WHERE n > 1""", _cited)  # fmt: skip
_add("graft_unresolved", f"""WITH w AS (SELECT name_x AS name, nullif(regexp_extract(replace(name_x, '_', ' '), '[^\\t\\n\\x0B\\f\\r ]+'), '') AS genus FROM mapping WHERE match_type = 'unresolved' AND in_x AND NOT in_y AND name_x IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT tree_id, {S.NORM('label')} AS name, string_split(trim(replace(label, '_', ' ')), ' ')[1] AS genus FROM tree_edges WHERE is_tip AND label IS NOT NULL)
SELECT t.tree_id, w.name AS species, w.genus FROM w JOIN (SELECT DISTINCT tree_id, genus FROM l) t ON w.genus = t.genus WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree_id = t.tree_id AND l.name = w.name)""",
     lambda s, f: reconcile_augment(M.Reconciliation(_mapping(s, f)), _edges(s, f), order="map_id").augmented.select("tree_id", "species", "genus"))
_add("tnrs_replacements", QUERY + "SELECT input_name, normalized_name, query_name FROM r WHERE query_name <> normalized_name", lambda s, f: _query(s, f).where("query_name <> normalized_name").select("input_name", "normalized_name", "query_name"))
DUPLICATES = f"""WITH x AS {S.first('mapping', 'name_x', 'map_id', 'in_x AND in_y AND name_x IS NOT NULL')}, y AS {S.first('mapping', 'name_y', 'map_id', 'in_x AND in_y AND name_y IS NOT NULL')}
SELECT (SELECT count(*) - count(DISTINCT coalesce(x.name_resolved, x.name_y)) FROM trait_records t JOIN x ON t.species = x.name_x WHERE coalesce(x.name_resolved, x.name_y) IS NOT NULL) AS n_dup_x,
(SELECT count(*) - count(DISTINCT coalesce(y.name_resolved, y.name_y)) FROM mapping m JOIN y ON m.name_y = y.name_y) AS n_dup_y"""
_add("merge_duplicates", DUPLICATES, lambda s, f: merge_duplicates(_mapping(s, f), table(s, f, "trait_records"), _mapping(s, f), None, "name_y", ["map_id"]))
