"""Queries on mapping tables: counts, corrections, crosswalks, differences, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import escape_bibtex, escape_html
from ..functions.schema import MAPPING
from ..operators import mapping as M
from ..operators.crosswalk import crosswalk_kinds, crosswalk_overrides, crosswalk_supplement
from ..runtime import table
from .registry import Registry
from .sqlparts import COLS, NORM, first

REGISTRY = Registry()
NINE = MAPPING.fieldNames()
ORDER = ["map_id"]


def _mapping(spark: SparkSession, folder: str, name: str = "mapping") -> DataFrame:
    df = table(spark, folder, name).select("map_id", *NINE)
    return df.distinct() if name == "mapping_copy" else df


KINDS = ("exact", "normalized", "synonym", "fuzzy", "manual", "flagged", "augmented")
COUNTS = "SELECT count(*) FILTER (in_x) AS n_x, count(*) FILTER (in_y) AS n_y, " + ", ".join(f"count(*) FILTER (match_type = '{k}') AS n_{k}" for k in KINDS) + (
    ", count(*) FILTER (match_type = 'unresolved' AND in_x) AS n_unresolved_x, count(*) FILTER (match_type = 'unresolved' AND in_y) AS n_unresolved_y FROM mapping"
)


@REGISTRY.add("mapping_counts", COUNTS)
def mapping_counts(spark: SparkSession, folder: str) -> DataFrame:
    return M.counts(_mapping(spark, folder))


@REGISTRY.add("coverage", f"SELECT n_exact + n_normalized + n_synonym + n_fuzzy + n_manual AS n_matched, n_x, (n_exact + n_normalized + n_synonym + n_fuzzy + n_manual)::DOUBLE / n_x AS coverage FROM ({COUNTS})")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return M.coverage(_mapping(spark, folder))


@REGISTRY.add("mapping_by_type", "SELECT match_type, count(*) AS n FROM mapping GROUP BY match_type")
def mapping_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_type(_mapping(spark, folder))


@REGISTRY.add("mapping_composition", f"SELECT match_type, count(*) AS n FROM mapping WHERE match_type IN {KINDS + ('unresolved',)} GROUP BY match_type")
def mapping_composition(spark: SparkSession, folder: str) -> DataFrame:
    return M.composition(_mapping(spark, folder))


@REGISTRY.add("mapping_with_unused", f"""SELECT {COLS} FROM mapping UNION ALL SELECT name_x, name_y, NULL, 'override_unused', NULL, 'user_override', false, false, 'name_x_not_in_data'
FROM override_batch o WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.name_x = o.name_x)""")
def mapping_with_unused(spark: SparkSession, folder: str) -> DataFrame:
    m = _mapping(spark, folder)
    unused = table(spark, folder, "override_batch").select("name_x", "name_y").join(m.select("name_x"), "name_x", "left_anti")
    return M.with_unused_overrides(m, unused.withColumn("reason", F.lit("name_x_not_in_data")))


PICK = "(SELECT min(name_x) FROM mapping WHERE match_type = 'fuzzy')", "(SELECT max(name_y) FROM mapping WHERE match_type = 'unresolved' AND NOT in_x AND name_x IS NULL)"


def _picked(spark: SparkSession, folder: str) -> tuple[str, str]:
    m = _mapping(spark, folder)
    x = m.where("match_type = 'fuzzy'").agg(F.min("name_x")).first()[0]
    return x, m.where("match_type = 'unresolved' and not in_x and name_x is null").agg(F.max("name_y")).first()[0]


@REGISTRY.add("override_accept", f"""SELECT {COLS} FROM mapping WHERE name_x IS DISTINCT FROM {PICK[0]} AND NOT coalesce(name_y = {PICK[1]} AND match_type = 'unresolved' AND NOT in_x, false)
UNION ALL SELECT {PICK[0]}, {PICK[1]}, NULL, 'manual', 1.0, 'user_override', true, true, 'reviewed'""")
def override_accept(spark: SparkSession, folder: str) -> DataFrame:
    x, y = _picked(spark, folder)
    return M.override(M.Reconciliation(_mapping(spark, folder)), x, y, "accept", "reviewed").mapping.select(*NINE)


@REGISTRY.add("override_reject", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY name_x ORDER BY map_id) AS rn FROM mapping),
h AS (SELECT * FROM t WHERE name_x = {PICK[0]} AND rn = 1)
SELECT {COLS} FROM t WHERE NOT coalesce(name_x = {PICK[0]} AND rn = 1, false)
UNION ALL SELECT name_x, NULL, name_resolved, 'unresolved', NULL, NULL, in_x, false, 'Rejected: wrong' FROM h
UNION ALL SELECT NULL, name_y, NULL, 'unresolved', NULL, NULL, false, true, 'Re-added after rejection' FROM h WHERE name_y IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.name_y = h.name_y AND t.map_id <> h.map_id)""")
def override_reject(spark: SparkSession, folder: str) -> DataFrame:
    x, _ = _picked(spark, folder)
    one = spark.createDataFrame([(0, x, None, "reject", "wrong")], "pos int, name_x string, name_y string, action string, note string")
    return M.override_batch(_mapping(spark, folder), one, "pos", ORDER)


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    """The batch with its actions in one spelling, without accepts that lack a name_y."""
    b = table(spark, folder, "override_batch").withColumn("action", F.coalesce(F.lower(F.trim("action")), F.lit("accept")))
    return b.where("action = 'reject' or name_y is not null").withColumn("note", F.coalesce("note", F.lit("")))


# episodes of a name_x: number 0 is before its first accept, each accept begins another; rows leave at the first accept of
# their name_x or, if open, of their name_y; what a reject sets free is counted as it stood then
BATCH = f"""WITH b AS (SELECT override_id AS pos, name_x AS x, name_y AS y, coalesce(lower(trim(action)), 'accept') = 'reject' AS rej, coalesce(note, '') AS note FROM override_batch WHERE name_x IS NOT NULL),
n AS (SELECT *, count(*) FILTER (NOT rej) OVER (PARTITION BY x ORDER BY pos) AS g FROM b WHERE rej OR y IS NOT NULL),
e AS (SELECT x, g, min(pos) FILTER (NOT rej) AS b, max(y) FILTER (NOT rej) AS y, max(note) FILTER (NOT rej) AS note, min(pos) FILTER (rej) AS r, arg_max(note, pos) FILTER (rej) AS why FROM n GROUP BY 1, 2),
ep AS MATERIALIZED (SELECT *, lead(b) OVER (PARTITION BY x ORDER BY g) AS nx FROM e),
m AS MATERIALIZED (SELECT m.*, (SELECT min(b) FROM ep WHERE ep.x = m.name_x AND g = 1) AS gone, (SELECT r FROM ep WHERE ep.x = m.name_x AND g = 0) AS r0, (SELECT why FROM ep WHERE ep.x = m.name_x AND g = 0) AS why,
  CASE WHEN match_type = 'unresolved' AND NOT in_x THEN (SELECT min(b) FROM ep WHERE ep.y = m.name_y AND g > 0) END AS taken FROM mapping m),
f AS MATERIALIZED (SELECT name_x, min(map_id) AS map_id FROM m WHERE r0 IS NOT NULL AND (taken IS NULL OR taken > r0) GROUP BY 1),
h AS MATERIALIZED (SELECT m.*, f.map_id IS NOT NULL AS first, CASE WHEN f.map_id IS NOT NULL THEN r0 ELSE least(gone, taken) END AS leaves FROM m LEFT JOIN f ON m.map_id = f.map_id),
free AS (SELECT name_y AS y, r0 AS t FROM h WHERE first AND name_y IS NOT NULL UNION ALL SELECT y, r FROM ep WHERE g > 0 AND r IS NOT NULL),
left_over AS (SELECT y, t, (SELECT count(*) FROM h WHERE h.name_y = free.y AND (leaves IS NULL OR leaves > t)) + (SELECT count(*) FROM ep WHERE ep.y = free.y AND g > 0 AND b <= t AND (coalesce(r, nx) IS NULL OR coalesce(r, nx) > t)) AS k FROM free)
SELECT {COLS} FROM h WHERE NOT first AND gone IS NULL AND taken IS NULL
UNION ALL SELECT name_x, NULL, name_resolved, 'unresolved', NULL, NULL, in_x, false, 'Rejected: ' || why FROM h WHERE first AND gone IS NULL
UNION ALL SELECT x, y, NULL, 'manual', 1.0, 'user_override', true, true, note FROM ep WHERE g > 0 AND nx IS NULL AND r IS NULL
UNION ALL SELECT x, NULL, NULL, 'unresolved', NULL, NULL, true, false, 'Rejected: ' || why FROM ep WHERE g > 0 AND nx IS NULL AND r IS NOT NULL
UNION ALL SELECT DISTINCT NULL, y, NULL, 'unresolved', NULL::DOUBLE, NULL, false, true, 'Re-added after rejection' FROM left_over WHERE k = 0 AND t > coalesce((SELECT max(b) FROM ep WHERE ep.y = left_over.y AND g > 0), -1)"""


@REGISTRY.add("override_batch", BATCH)
def override_batch(spark: SparkSession, folder: str) -> DataFrame:
    return M.override_batch(_mapping(spark, folder), _batch(spark, folder), "override_id", ORDER)


SINGLE = """b AS (SELECT *, count(*) OVER (PARTITION BY name_x) AS cx, count(*) OVER (PARTITION BY name_y) AS cy FROM override_batch WHERE name_x IS NOT NULL AND name_y IS NOT NULL),
p AS (SELECT name_x, name_y, note FROM b WHERE cx = 1 AND cy = 1)"""


@REGISTRY.add("accept_pairs", f"""WITH {SINGLE} SELECT {COLS} FROM mapping m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.name_x = m.name_x)
AND NOT (coalesce(match_type = 'unresolved' AND NOT in_x, false) AND EXISTS (SELECT 1 FROM p WHERE p.name_y = m.name_y))
UNION ALL SELECT name_x, name_y, NULL, 'manual', 1.0, 'user_override', true, true, note FROM p""")
def accept_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.relational import occurring_once

    pairs = occurring_once(table(spark, folder, "override_batch").where("name_x is not null and name_y is not null"), ["name_x", "name_y"])
    return M.accept_pairs(_mapping(spark, folder), pairs.select("name_x", "name_y", "note"))


CROSSWALK = """SELECT from_name AS name_x, to_name AS name_y, 'crosswalk [' || coalesce(link_type, 'NA') || ']' || CASE WHEN length(notes) > 0 THEN ': ' || notes ELSE '' END AS user_note
FROM crosswalk WHERE from_name <> '' AND to_name <> '' AND from_name <> to_name"""
ONE = "regexp_matches(link_type, '^1.*to.*1', 'i')"


@REGISTRY.add("crosswalk_all", CROSSWALK)
def crosswalk_all(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk_overrides(table(spark, folder, "crosswalk"), "from_name", "to_name", "link_type", "notes")


@REGISTRY.add("crosswalk_one_to_one", f"{CROSSWALK} AND {ONE}")
def crosswalk_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk_overrides(table(spark, folder, "crosswalk"), "from_name", "to_name", "link_type", "notes", True)


@REGISTRY.add("crosswalk_kinds", f"""SELECT CASE WHEN {ONE} THEN 'one_to_one' WHEN regexp_matches(link_type, 'many.*to.*1', 'i') THEN 'many_to_one'
WHEN regexp_matches(link_type, '1.*to.*many', 'i') THEN 'one_to_many' ELSE 'other' END AS kind, count(*) AS n FROM crosswalk GROUP BY 1""")
def crosswalk_kinds_query(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk_kinds(table(spark, folder, "crosswalk"), "link_type")


def _open(s: str) -> str:
    names = f"(SELECT name, pos, {NORM('name')} AS norm FROM (SELECT name_{s} AS name, min(map_id) AS pos FROM mapping WHERE match_type = 'unresolved' AND in_{s} AND name_{s} IS NOT NULL GROUP BY 1))"
    return first(names, "norm", "pos, name", "norm <> ''")


SUPPLEMENT = f"""WITH o AS ({CROSSWALK} AND {ONE}),
c AS MATERIALIZED (SELECT x.name AS name_x, y.name AS name_y, user_note AS note FROM o JOIN {_open('x')} x ON {NORM('o.name_x')} = x.norm JOIN {_open('y')} y ON {NORM('o.name_y')} = y.norm),
p AS MATERIALIZED (SELECT name_x, name_y, note FROM (SELECT *, count(*) OVER (PARTITION BY name_x) AS cx, count(*) OVER (PARTITION BY name_y) AS cy FROM c) WHERE cx = 1 AND cy = 1)
"""


def _supplement(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return crosswalk_supplement(_mapping(spark, folder), crosswalk_one_to_one(spark, folder), order="map_id")


@REGISTRY.add("crosswalk_supplement", SUPPLEMENT + f"""SELECT {COLS} FROM mapping m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.name_x = m.name_x)
AND NOT (coalesce(match_type = 'unresolved' AND NOT in_x, false) AND EXISTS (SELECT 1 FROM p WHERE p.name_y = m.name_y))
UNION ALL SELECT name_x, name_y, NULL, 'manual', 1.0, 'user_override', true, true, note FROM p""")
def crosswalk_supplement_query(spark: SparkSession, folder: str) -> DataFrame:
    return _supplement(spark, folder)[0]


@REGISTRY.add("crosswalk_audit", SUPPLEMENT + """SELECT (SELECT count(*) FROM o) AS n_crosswalk_rows, (SELECT count(*) FROM mapping WHERE match_type = 'unresolved' AND in_x AND name_x IS NOT NULL) AS n_unresolved_x,
(SELECT count(*) FROM mapping WHERE match_type = 'unresolved' AND in_y AND name_y IS NOT NULL) AS n_unresolved_y, (SELECT count(*) FROM c) AS n_available, (SELECT count(*) FROM p) AS n_applied,
(SELECT count(*) FROM c) - (SELECT count(*) FROM p) AS n_ambiguous""")
def crosswalk_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _supplement(spark, folder)[1]


@REGISTRY.add("splits_lumps", """WITH g AS (SELECT name_resolved, list_sort(list(DISTINCT name_x) FILTER (name_x IS NOT NULL)) AS xs, list_sort(list(DISTINCT name_y) FILTER (name_y IS NOT NULL)) AS ys
FROM mapping WHERE match_type = 'synonym' AND name_resolved IS NOT NULL GROUP BY name_resolved)
SELECT name_resolved, coalesce(array_to_string(xs, '; '), '') AS names_x, coalesce(array_to_string(ys, '; '), '') AS names_y, coalesce(len(xs), 0) AS n_x, coalesce(len(ys), 0) AS n_y,
CASE WHEN len(ys) > 1 AND len(xs) = 1 THEN 'split' WHEN len(xs) > 1 AND len(ys) = 1 THEN 'lump' ELSE 'split_lump' END AS type FROM g WHERE len(xs) > 1 OR len(ys) > 1""")
def splits_lumps(spark: SparkSession, folder: str) -> DataFrame:
    s = M.splits_lumps(_mapping(spark, folder))
    return s.withColumn("names_x", F.array_join("names_x", "; ")).withColumn("names_y", F.array_join("names_y", "; "))


RESOLVED = "coalesce(match_type IN ('exact', 'normalized', 'synonym', 'fuzzy', 'manual', 'augmented'), false)"
DIFF = f"""WITH a AS (SELECT *, {RESOLVED} AS r FROM {first('mapping', 'name_x', 'map_id', 'in_x AND name_x IS NOT NULL')}),
b AS (SELECT *, {RESOLVED} AS r FROM {first(f'(SELECT DISTINCT map_id, {COLS} FROM mapping_copy)', 'name_x', 'map_id', 'in_x AND name_x IS NOT NULL')}),
j AS (SELECT a.name_x, a.name_y AS ya, b.name_y AS yb, a.match_type AS ta, b.match_type AS tb, b.match_score AS sb, a.r AS ra, b.r AS rb FROM a JOIN b ON a.name_x = b.name_x)
"""


def _diff(spark: SparkSession, folder: str) -> M.Diff:
    return M.diff(_mapping(spark, folder), _mapping(spark, folder, "mapping_copy"), ORDER, ORDER)


@REGISTRY.add("diff_gained", DIFF + "SELECT name_x, yb AS name_y_new, ta AS match_type_old, tb AS match_type_new, sb AS match_score FROM j WHERE NOT ra AND rb")
def diff_gained(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).gained


@REGISTRY.add("diff_lost", DIFF + "SELECT name_x, ya AS name_y_old, ta AS match_type_old, tb AS match_type_new FROM j WHERE ra AND NOT rb")
def diff_lost(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).lost


@REGISTRY.add("diff_type", DIFF + "SELECT name_x, ta AS match_type_old, tb AS match_type_new, yb AS name_y FROM j WHERE ra AND rb AND ta <> tb")
def diff_type(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).type_changed


@REGISTRY.add("diff_target", DIFF + "SELECT name_x, ya AS name_y_old, yb AS name_y_new FROM j WHERE ra AND rb AND coalesce(ya, '') <> coalesce(yb, '')")
def diff_target(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).target_changed


@REGISTRY.add("diff_summary", DIFF + """SELECT count(*) FILTER (NOT ra AND rb) AS n_gained, count(*) FILTER (ra AND NOT rb) AS n_lost, count(*) FILTER (ra AND rb AND ta <> tb) AS n_type_changed,
count(*) FILTER (ra AND rb AND coalesce(ya, '') <> coalesce(yb, '')) AS n_target_changed, count(*) AS n_shared, 0::BIGINT AS n_unused_override_diff FROM j""")
def diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder).summary


@REGISTRY.add("diff_unused", """SELECT name_x, name_y, note AS reason, 'x' AS side FROM override_batch o WHERE NOT EXISTS (SELECT 1 FROM crosswalk c WHERE c.from_name IS NOT DISTINCT FROM o.name_x AND c.to_name IS NOT DISTINCT FROM o.name_y AND c.notes IS NOT DISTINCT FROM o.note)
UNION ALL SELECT from_name, to_name, notes, 'y' FROM crosswalk c WHERE NOT EXISTS (SELECT 1 FROM override_batch o WHERE c.from_name IS NOT DISTINCT FROM o.name_x AND c.to_name IS NOT DISTINCT FROM o.name_y AND c.notes IS NOT DISTINCT FROM o.note)""")
def diff_unused(spark: SparkSession, folder: str) -> DataFrame:
    m = _mapping(spark, folder)
    a = table(spark, folder, "override_batch").select("name_x", "name_y", F.col("note").alias("reason"))
    b = table(spark, folder, "crosswalk").select(F.col("from_name").alias("name_x"), F.col("to_name").alias("name_y"), F.col("notes").alias("reason"))
    return M.diff(m, m, ORDER, ORDER, a, b).unused_overrides_diff


@REGISTRY.add("unresolved_lists", """SELECT 'x' AS side, name_x AS name FROM mapping WHERE in_x AND match_type = 'unresolved' AND name_x IS NOT NULL GROUP BY name_x
UNION ALL SELECT 'y', name_y FROM mapping WHERE in_y AND match_type = 'unresolved' AND name_y IS NOT NULL GROUP BY name_y""")
def unresolved_lists(spark: SparkSession, folder: str) -> DataFrame:
    m = _mapping(spark, folder)
    return M.unresolved_names(m, "x").select(F.lit("x").alias("side"), "name").unionByName(M.unresolved_names(m, "y").select(F.lit("y").alias("side"), "name"))


@REGISTRY.add("escapes", """SELECT map_id, replace(replace(replace(replace(name_x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
replace(replace(replace(name_x, '\\', '\\\\'), '{', '\\{'), '}', '\\}') AS bibtex FROM mapping""")
def escapes(spark: SparkSession, folder: str) -> DataFrame:
    return _mapping(spark, folder).select("map_id", escape_html(F.col("name_x")).alias("html"), escape_bibtex(F.col("name_x")).alias("bibtex"))
