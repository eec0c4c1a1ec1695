"""Queries on trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalise, placement_marker
from ..functions.relational import names
from ..operators import retrieval as R
from ..operators import trees as T
from ..runtime import table
from ..sources.treefiles import first_tree, to_newick
from .registry import Registry
from .sqlparts import CLOSURE, NORM, first

REGISTRY = Registry()
W = "WITH RECURSIVE " + CLOSURE


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tree_edges").select(*T.EDGE)


def _add(name: str, sql: str | None, run) -> None:
    REGISTRY.add(name, sql)(lambda spark, folder: run(spark, folder))


_add("tips", "SELECT tree_id, label, child FROM tree_edges WHERE is_tip", lambda s, f: T.tips(_edges(s, f)))
_add("validate_dups", "SELECT label, count(*) AS n, count(DISTINCT tree_id) AS trees FROM tree_edges WHERE is_tip AND label IS NOT NULL GROUP BY label HAVING count(*) > 1",
     lambda s, f: T.duplicate_tips(_edges(s, f).withColumn("t", F.col("tree_id")).withColumn("tree_id", F.lit("all"))).select("label", "n", F.col("n").alias("trees")))
_add("roots", W + " SELECT tree_id, root FROM rt", lambda s, f: T.roots(_edges(s, f)))
_add("closure", W + " SELECT tree_id, node, ancestor, hops, round(dist, 6) AS dist FROM up", lambda s, f: T.closure(_edges(s, f)).withColumn("dist", F.round("dist", 6)))
_add("descendant_counts", W + " SELECT tree_id, ancestor AS node, count(*) AS n_tips FROM ta GROUP BY 1, 2", lambda s, f: T.descendant_counts(_edges(s, f)))
_add("descendants", W + " SELECT tree_id, ancestor AS node, string_agg(DISTINCT label, '; ' ORDER BY label) AS tips FROM ta WHERE hops > 0 GROUP BY 1, 2",
     lambda s, f: T.clades(_edges(s, f)).withColumn("tips", F.array_join("tips", "; ")))

KEEP = "keep AS (SELECT DISTINCT tree_id, label FROM tip WHERE label < 'N')"
PRUNE = W + f""", {KEEP},
kn AS MATERIALIZED (SELECT tip.tree_id, tip.child AS node FROM tip JOIN keep USING (tree_id, label)),
alive AS MATERIALIZED (SELECT DISTINCT up.tree_id, up.ancestor AS node FROM up JOIN kn USING (tree_id, node)),
forks AS (SELECT e.tree_id, e.parent AS node FROM tree_edges e JOIN alive a ON e.tree_id = a.tree_id AND e.child = a.node GROUP BY 1, 2 HAVING count(*) > 1),
lone AS (SELECT tree_id FROM kn GROUP BY 1 HAVING count(*) = 1),
s AS MATERIALIZED (SELECT * FROM forks UNION SELECT * FROM kn UNION SELECT rt.tree_id, root FROM rt JOIN lone USING (tree_id)),
near AS (SELECT up.*, row_number() OVER (PARTITION BY up.tree_id, up.node ORDER BY hops) AS rn FROM up JOIN s a ON up.tree_id = a.tree_id AND up.node = a.node
  JOIN s b ON up.tree_id = b.tree_id AND up.ancestor = b.node WHERE hops > 0)
SELECT n.tree_id, n.ancestor AS parent, n.node AS child, round(n.dist, 6) AS edge_length, e.label, e.is_tip FROM near n JOIN tree_edges e ON n.tree_id = e.tree_id AND n.node = e.child WHERE rn = 1"""


def prune(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return T.prune(e, T.tips(e).where("label < 'N'")).withColumn("edge_length", F.round("edge_length", 6))


_add("prune", PRUNE, prune)

ALIGN = f"""WITH t AS MATERIALIZED (SELECT tree_id, child, label, {NORM('label')} AS norm FROM tree_edges WHERE is_tip AND label IS NOT NULL),
m AS MATERIALIZED (SELECT map_id, name_x, name_y, {NORM('name_y')} AS norm FROM mapping WHERE in_x AND in_y AND name_x IS NOT NULL AND name_y IS NOT NULL),
h AS (SELECT t.tree_id, t.child, m.map_id, m.name_x FROM t JOIN m ON t.label = m.name_y UNION SELECT t.tree_id, t.child, m.map_id, m.name_x FROM t JOIN m ON t.norm = m.norm AND m.norm <> ''),
f AS (SELECT tree_id, map_id, name_x, min(child) AS child FROM h GROUP BY 1, 2, 3),
l AS (SELECT tree_id, child, arg_max(name_x, map_id) AS new FROM f GROUP BY 1, 2)
SELECT e.tree_id, e.parent, e.child, e.edge_length, coalesce(l.new, e.label) AS label, e.is_tip FROM tree_edges e LEFT JOIN l ON e.tree_id = l.tree_id AND e.child = l.child"""
_add("align_labels", ALIGN, lambda s, f: T.align(_edges(s, f), table(s, f, "mapping"), ["map_id"]))
_add("tip_depths", W + " SELECT ta.tree_id, label, node, round(dist, 6) AS depth FROM ta JOIN rt ON ta.tree_id = rt.tree_id AND ancestor = root",
     lambda s, f: T.tip_depths(_edges(s, f)).withColumn("depth", F.round("depth", 6)))
_add("ultrametric", W + """, d AS (SELECT ta.tree_id, min(dist) AS lo, max(dist) AS hi, count(*) FILTER (dist IS NULL) AS n FROM ta JOIN rt ON ta.tree_id = rt.tree_id AND ancestor = root GROUP BY 1)
SELECT tree_id, CASE WHEN n = 0 THEN round(lo, 6) END AS min_depth, CASE WHEN n = 0 THEN round(hi, 6) END AS max_depth, CASE WHEN n = 0 THEN coalesce((hi - lo) / nullif(hi, 0) <= 1e-6, false) END AS is_ultrametric FROM d""",
     lambda s, f: T.ultrametric(_edges(s, f)).withColumn("min_depth", F.round("min_depth", 6)).withColumn("max_depth", F.round("max_depth", 6)))
GRAFEN = W + """, n AS (SELECT tree_id, ancestor AS node, count(*) AS k FROM ta GROUP BY 1, 2), h AS (SELECT tree_id, node, coalesce((k - 1)::DOUBLE / nullif(max(k) OVER (PARTITION BY tree_id) - 1, 0), 0) AS h FROM n)
SELECT e.tree_id, e.parent, e.child, round(a.h - b.h, 6) AS edge_length, e.label, e.is_tip FROM tree_edges e JOIN h a ON e.tree_id = a.tree_id AND e.parent = a.node JOIN h b ON e.tree_id = b.tree_id AND e.child = b.node"""
_add("grafen", GRAFEN, lambda s, f: T.grafen(_edges(s, f)).withColumn("edge_length", F.round("edge_length", 6)))
_add("unit_lengths", "SELECT tree_id, parent, child, 1.0::DOUBLE AS edge_length, label, is_tip FROM tree_edges", lambda s, f: T.unit_lengths(_edges(s, f)))
POLY = """WITH top AS (SELECT tree_id, max(greatest(parent, child)) + 1 AS mx, count(edge_length) AS len FROM tree_edges GROUP BY 1),
e AS (SELECT t.*, mx, len, count(*) OVER w AS k, row_number() OVER (w ORDER BY child) AS r, lag(child) OVER (w ORDER BY child) AS prev FROM tree_edges t JOIN top USING (tree_id) WINDOW w AS (PARTITION BY t.tree_id, t.parent))
SELECT tree_id, CASE WHEN k <= 2 OR r = 1 THEN parent WHEN r < k THEN mx + child ELSE mx + prev END AS parent, child, edge_length, label, is_tip FROM e
UNION ALL SELECT tree_id, CASE WHEN r = 2 THEN parent ELSE mx + prev END, mx + child, CASE WHEN len > 0 THEN 0.0 END, NULL, false FROM e WHERE k > 2 AND r > 1 AND r < k"""
POLY = POLY.replace("count(*) OVER w AS k, row_number() OVER (w ORDER BY child) AS r, lag(child) OVER (w ORDER BY child) AS prev", "count(*) OVER (PARTITION BY t.tree_id, t.parent) AS k, row_number() OVER (PARTITION BY t.tree_id, t.parent ORDER BY child) AS r, lag(child) OVER (PARTITION BY t.tree_id, t.parent ORDER BY child) AS prev").replace(" WINDOW w AS (PARTITION BY t.tree_id, t.parent)", "")
_add("resolve_polytomies", POLY, lambda s, f: T.resolve_polytomies(_edges(s, f)))

COV = W + """, whole AS (SELECT tree_id FROM tree_edges GROUP BY 1 HAVING count(*) = count(edge_length)),
p AS MATERIALIZED (SELECT ta.tree_id, ta.label, ancestor, edge_length FROM ta JOIN whole USING (tree_id) JOIN tree_edges e ON ta.tree_id = e.tree_id AND ta.ancestor = e.child),
t AS (SELECT tip.tree_id, label FROM tip JOIN whole USING (tree_id)),
s AS MATERIALIZED (SELECT a.tree_id, a.label AS i, b.label AS j, sum(a.edge_length) AS v FROM p a JOIN p b ON a.tree_id = b.tree_id AND a.ancestor = b.ancestor AND a.label <= b.label GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT a.tree_id, a.label AS tip_i, b.label AS tip_j, coalesce(v, 0) AS value FROM t a JOIN t b ON a.tree_id = b.tree_id AND a.label <= b.label LEFT JOIN s ON s.tree_id = a.tree_id AND i = a.label AND j = b.label)
"""
_add("phylo_cov", COV + "SELECT tree_id, tip_i, tip_j, round(value, 6) AS value FROM c", lambda s, f: T.phylo_covariance(_edges(s, f)).withColumn("value", F.round("value", 6)))
_add("phylo_cor", COV + """, d AS MATERIALIZED (SELECT tree_id, tip_i AS tip, value AS d FROM c WHERE tip_i = tip_j)
SELECT c.tree_id, tip_i, tip_j, round(value / nullif(sqrt(a.d * b.d), 0), 6) AS value FROM c JOIN d a ON a.tree_id = c.tree_id AND a.tip = tip_i JOIN d b ON b.tree_id = c.tree_id AND b.tip = tip_j""",
     lambda s, f: T.phylo_covariance(_edges(s, f), True).withColumn("value", F.round("value", 6)))

PAIRS = "pairs AS (SELECT a AS tree_a, b AS tree_b FROM (SELECT tree_id AS a, lead(tree_id) OVER (ORDER BY tree_id) AS b FROM (SELECT DISTINCT tree_id FROM tree_edges)) WHERE b IS NOT NULL)"
LABELS = "lab AS (SELECT DISTINCT tree_id, label FROM tree_edges WHERE is_tip AND label IS NOT NULL)"
_add("tree_jaccard", f"""WITH {PAIRS}, {LABELS}, n AS (SELECT tree_a, tree_b, (SELECT count(*) FROM lab x JOIN lab y ON x.label = y.label WHERE x.tree_id = tree_a AND y.tree_id = tree_b) AS n_shared,
(SELECT count(*) FROM lab WHERE tree_id = tree_a) AS na, (SELECT count(*) FROM lab WHERE tree_id = tree_b) AS nb FROM pairs)
SELECT tree_a, tree_b, n_shared, na - n_shared AS n_only_a, nb - n_shared AS n_only_b, n_shared::DOUBLE / greatest(1, na + nb - n_shared) AS jaccard FROM n""",
     lambda s, f: T.compare_tips(_edges(s, f), T.consecutive_pairs(_edges(s, f))))
BELOW = W + f""", {PAIRS}, {LABELS},
com AS MATERIALIZED (SELECT tree_a, tree_b, x.label FROM pairs JOIN lab x ON x.tree_id = tree_a JOIN lab y ON y.tree_id = tree_b AND x.label = y.label),
big AS (SELECT tree_a, tree_b, count(*) AS n, min(label) AS ref, list_sort(list(label)) AS everything FROM com GROUP BY 1, 2 HAVING count(*) >= 4),
below AS MATERIALIZED (SELECT com.tree_a, com.tree_b, ta.tree_id, ta.ancestor AS child, list_sort(list(ta.label)) AS own FROM com JOIN ta ON ta.label = com.label AND ta.tree_id IN (com.tree_a, com.tree_b) GROUP BY 1, 2, 3, 4)
"""
_add("tree_rf", BELOW + """, sp AS (SELECT DISTINCT b.tree_a, b.tree_b, tree_id, CASE WHEN list_contains(own, ref) THEN list_filter(everything, lambda x: NOT list_contains(own, x)) ELSE own END AS side, n FROM below b JOIN big USING (tree_a, tree_b)),
c AS (SELECT tree_a, tree_b, side FROM sp WHERE len(side) BETWEEN 2 AND n - 2 GROUP BY 1, 2, 3 HAVING count(*) = 1), d AS (SELECT tree_a, tree_b, count(*) AS k FROM c GROUP BY 1, 2)
SELECT p.tree_a, p.tree_b, CASE WHEN n IS NOT NULL THEN coalesce(k, 0)::DOUBLE END AS rf FROM pairs p LEFT JOIN big ON big.tree_a = p.tree_a AND big.tree_b = p.tree_b LEFT JOIN d ON d.tree_a = p.tree_a AND d.tree_b = p.tree_b""",
     lambda s, f: T.robinson_foulds(_edges(s, f), T.consecutive_pairs(_edges(s, f))))
_add("tree_branch_cor", BELOW + """, u AS (SELECT b.tree_a, b.tree_b, own, b.tree_id, CASE WHEN count(*) = count(e.edge_length) THEN sum(e.edge_length) END AS bl FROM below b JOIN big USING (tree_a, tree_b)
  LEFT JOIN tree_edges e ON e.tree_id = b.tree_id AND e.child = b.child WHERE len(own) < n GROUP BY 1, 2, 3, 4),
v AS (SELECT tree_a, tree_b, own, max(bl) FILTER (tree_id = tree_a) AS a, max(bl) FILTER (tree_id = tree_b) AS b FROM u GROUP BY 1, 2, 3 HAVING count(*) = 2),
r AS (SELECT tree_a, tree_b, count(*) AS n_edges, CASE WHEN count(*) >= 2 AND count(a) = count(*) AND count(b) = count(*) AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS branch_cor FROM v GROUP BY 1, 2)
SELECT p.tree_a, p.tree_b, n_edges, round(branch_cor, 6) AS branch_cor FROM pairs p LEFT JOIN r ON r.tree_a = p.tree_a AND r.tree_b = p.tree_b""",
     lambda s, f: T.branch_correlation(_edges(s, f), T.consecutive_pairs(_edges(s, f))).withColumn("branch_cor", F.round("branch_cor", 6)))
# every tree against every other, as in the reference's matrices; the SQL is that of the consecutive pairs over other pairs
EVERY = "pairs AS (SELECT a.tree_id AS tree_a, b.tree_id AS tree_b FROM (SELECT DISTINCT tree_id FROM tree_edges) a JOIN (SELECT DISTINCT tree_id FROM tree_edges) b ON a.tree_id < b.tree_id)"
for _name, _run in (
    ("tree_jaccard", lambda s, f: T.compare_tips(_edges(s, f))), ("tree_rf", lambda s, f: T.robinson_foulds(_edges(s, f))),
    ("tree_branch_cor", lambda s, f: T.branch_correlation(_edges(s, f)).withColumn("branch_cor", F.round("branch_cor", 6))),
):
    _add(f"{_name}_all", REGISTRY.sql[_name].replace(PAIRS, EVERY), _run)
_add("tree_unique_tips", f"WITH {LABELS} SELECT min(tree_id) AS tree_id, label FROM lab GROUP BY label HAVING count(*) = 1", lambda s, f: T.unique_tips(_edges(s, f)))
_add("tree_shared_tips", f"WITH {LABELS} SELECT label FROM lab GROUP BY label HAVING count(*) = (SELECT count(DISTINCT tree_id) FROM tree_edges)", lambda s, f: T.shared_tips(_edges(s, f)))
_add("tip_consistency", f"WITH {LABELS} SELECT tree_id, count(*) AS n_tips, (SELECT count(DISTINCT label) FROM lab) - count(*) AS n_missing FROM lab GROUP BY 1", lambda s, f: T.tip_set_gaps(_edges(s, f)))

GENUS = "string_split(trim(replace({c}, '_', ' ')), ' ')[1]"


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """All crosswalk targets, in the order of the crosswalk."""
    return names(table(spark, folder, "crosswalk"), "to_name", "xw_id")


def _first_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """What grafting skips on the first tree."""
    return T.wanted_by_all(first_tree(_edges(spark, folder)), _wanted(spark, folder))[1]


# the names of a genus go one after the other to the middle of the edge of its first tip; lengths before levelling are kept
# in a list, for the median
FIRST_WORD = "nullif(regexp_extract(replace({c}, '_', ' '), '[^\\t\\n\\x0B\\f\\r ]+'), '')"
GRAFT = W + f""", lab AS MATERIALIZED (SELECT t.*, {NORM('label')} AS norm, {FIRST_WORD.format(c='label')} AS genus FROM tree_edges t WHERE is_tip AND label IS NOT NULL),
w AS (SELECT to_name AS name, min(xw_id) AS pos, {FIRST_WORD.format(c='to_name')} AS genus FROM crosswalk WHERE to_name IS NOT NULL GROUP BY 1),
wanted AS (SELECT tree_id, name, g.genus, row_number() OVER (PARTITION BY tree_id ORDER BY pos) AS rank FROM w JOIN (SELECT DISTINCT tree_id, genus FROM lab WHERE genus IS NOT NULL) g ON w.genus = g.genus
  WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.tree_id = g.tree_id AND lab.norm = w.name)),
q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree_id, genus ORDER BY rank) AS k FROM wanted),
dep AS (SELECT ta.tree_id, ta.node, ta.dist FROM ta JOIN rt ON ta.tree_id = rt.tree_id AND ta.ancestor = rt.root),
lev AS (SELECT tree_id, max(dist) AS target, count(*) = count(dist) AND coalesce((max(dist) - min(dist)) / nullif(max(dist), 0) <= 1e-6, false) AS level FROM dep GROUP BY 1),
tree AS (SELECT t.tree_id, max(greatest(parent, child)) AS top, count(edge_length) > 0 AS lengths, any_value(target) AS target, any_value(level) AS level FROM tree_edges t JOIN lev USING (tree_id) GROUP BY 1),
g1 AS (SELECT tree_id, genus, arg_min(label, child) AS label, arg_min(parent, child) AS parent, min(child) AS child, arg_min(edge_length, child) AS len, count(*) AS n, coalesce(list(edge_length) FILTER (edge_length IS NOT NULL), []) AS known
  FROM lab GROUP BY 1, 2),
run AS (SELECT g.tree_id, g.genus, 0::BIGINT AS k, label, parent, child, len, n, known, dist AS depth, 0.0::DOUBLE AS bl, 0.0::DOUBLE AS mid, NULL::BIGINT AS rank, NULL::VARCHAR AS name, NULL::BIGINT AS hung, NULL::BIGINT AS above, false AS split
  FROM g1 g JOIN dep ON dep.tree_id = g.tree_id AND dep.node = g.child
  UNION ALL SELECT tree_id, genus, k, label, CASE WHEN half > 0 THEN top + 2 * rank ELSE parent END, child, CASE WHEN half > 0 AND lengths THEN half ELSE len END, n + 1,
    CASE WHEN NOT lengths THEN known ELSE list_append(CASE WHEN half > 0 THEN list_append(list_concat(known[:list_position(known, len) - 1], known[list_position(known, len) + 1:]), half) ELSE known END, bl) END,
    depth, bl, depth - half, rank, name, CASE WHEN half > 0 THEN top + 2 * rank ELSE parent END, parent, half > 0
  FROM (SELECT r.tree_id, r.genus, q.k, label, parent, child, len, n, known, depth, q.rank, q.name, t.top, t.lengths, coalesce(len, 1.0) / 2 AS half, CASE WHEN len(known) > 0 THEN list_median(known) ELSE 0.0 END AS bl
    FROM run r JOIN q ON q.tree_id = r.tree_id AND q.genus = r.genus AND q.k = r.k + 1 JOIN tree t ON t.tree_id = r.tree_id))
"""
# lengths are halved again and again, so many end in a 5: a little more takes them off the edge of rounding
OFF = 3.3141e-8
_add("graft_report", GRAFT + "SELECT tree_id, name AS species, genus, replace(label, '_', ' ') AS placed_near, round(bl + 3.3141e-8, 6) AS branch_length, 'genus/congener_median' AS method, n - 1 AS n_congeners FROM run WHERE k > 0",
     lambda s, f: T.grafted_all(_edges(s, f), _wanted(s, f)).withColumn("branch_length", F.round(F.col("branch_length") + OFF, 6)))
_add("graft_genus", GRAFT + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, genus ORDER BY k DESC) AS rn FROM run) WHERE rn = 1)
SELECT e.tree_id, coalesce(l.parent, e.parent) AS parent, e.child, round(CASE WHEN l.child IS NOT NULL THEN l.len ELSE e.edge_length END + 3.3141e-8, 6) AS edge_length, e.label, e.is_tip FROM tree_edges e LEFT JOIN last l ON l.tree_id = e.tree_id AND l.child = e.child
UNION ALL SELECT r.tree_id, hung, top + 2 * rank - 1, round(CASE WHEN lengths THEN CASE WHEN level THEN target - mid ELSE bl END END + 3.3141e-8, 6), replace(name, ' ', '_'), true FROM run r JOIN tree t ON t.tree_id = r.tree_id WHERE k > 0
UNION ALL SELECT r.tree_id, above, top + 2 * rank, round(CASE WHEN lengths THEN depth - mid END + 3.3141e-8, 6), NULL, false FROM run r JOIN tree t ON t.tree_id = r.tree_id WHERE k > 0 AND split""",
     lambda s, f: T.grafted_trees(_edges(s, f), _wanted(s, f)).withColumn("edge_length", F.round(F.col("edge_length") + OFF, 6)))
_add("graft_skipped_all", f"""WITH l AS (SELECT DISTINCT tree_id, {NORM('label')} AS name, {GENUS.format(c='label')} AS genus FROM tree_edges WHERE is_tip AND label IS NOT NULL),
w AS (SELECT name, nullif({GENUS.format(c='name')}, '') AS genus FROM (SELECT DISTINCT to_name AS name FROM crosswalk WHERE to_name IS NOT NULL))
SELECT t.tree_id, w.name AS species, w.genus, CASE WHEN w.genus IS NULL THEN 'Could not extract genus from name' ELSE 'No congener in tree' END AS reason
FROM (SELECT DISTINCT tree_id FROM tree_edges) t CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.tree_id = t.tree_id AND l.name = w.name)
AND NOT EXISTS (SELECT 1 FROM l WHERE l.tree_id = t.tree_id AND l.genus = w.genus)""", lambda s, f: T.wanted_by_all(_edges(s, f), _wanted(s, f))[1])
_add("graft_skipped", f"""WITH e AS (SELECT * FROM tree_edges WHERE tree_id = (SELECT min(tree_id) FROM tree_edges)),
w AS (SELECT DISTINCT to_name AS name FROM crosswalk WHERE to_name IS NOT NULL AND to_name NOT IN (SELECT {NORM('label')} FROM e WHERE is_tip AND label IS NOT NULL)),
g AS (SELECT name, nullif({GENUS.format(c='name')}, '') AS genus FROM w)
SELECT (SELECT min(tree_id) FROM tree_edges) AS tree_id, name AS species, genus, CASE WHEN genus IS NULL THEN 'Could not extract genus from name' ELSE 'No congener in tree' END AS reason
FROM g WHERE genus IS NULL OR genus NOT IN (SELECT {GENUS.format(c='label')} FROM e WHERE is_tip AND label IS NOT NULL)""", _first_skipped)
_add("placement_markers", "SELECT tree_id, child, label || m AS label, label AS clean, CASE m WHEN '' THEN 'exact' WHEN '*' THEN 'genus_added' ELSE 'family_added' END AS placement FROM (SELECT *, repeat('*', (child % 3)::INT) AS m FROM tree_edges WHERE is_tip)",
     lambda s, f: _markers(_edges(s, f)))


def _markers(edges: DataFrame) -> DataFrame:
    t = edges.where("is_tip").select("tree_id", "child", F.concat("label", F.repeat(F.lit("*"), (F.col("child") % 3).cast("int"))).alias("label"))
    clean, placed = placement_marker(F.col("label"))
    return t.select("tree_id", "child", "label", clean.alias("clean"), placed.alias("placement"))


def _query(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the mapping asked for, with the crosswalk as the name service."""
    asked = table(spark, folder, "mapping").select(F.col("name_y").alias("name"))
    cw = table(spark, folder, "crosswalk").where("from_name is not null and to_name is not null")
    answers = cw.groupBy(F.lower("from_name").alias("search_string")).agg(
        F.min("to_name").alias("unique_name"), F.count("*").cast("int").alias("number_matches"), F.min(F.col("link_type") == "1BL to 1BT").alias("is_synonym"),
        F.lit(False).alias("approximate_match"), F.lit(None).cast("string").alias("flags"),
    )
    return R.resolve_query(asked, answers)


QUERY = f"""WITH q AS (SELECT DISTINCT name_y AS input_name FROM mapping WHERE name_y IS NOT NULL), n AS (SELECT *, {NORM('input_name')} AS normalized_name FROM q),
a AS (SELECT lower(from_name) AS s, min(to_name) AS u, count(*)::INT AS k, bool_and(link_type = '1BL to 1BT') AS syn FROM crosswalk WHERE from_name IS NOT NULL AND to_name IS NOT NULL GROUP BY 1),
r AS (SELECT input_name, normalized_name, CASE WHEN {NORM('u')} <> '' THEN {NORM('u')} ELSE normalized_name END AS query_name, k AS tnrs_number_matches, syn AS tnrs_is_synonym,
  CASE WHEN s IS NOT NULL THEN false END AS tnrs_approximate_match, NULL::VARCHAR AS tnrs_flags FROM n LEFT JOIN a ON lower(normalized_name) = s)
"""
_add("tnrs_audit", QUERY + "SELECT * FROM r", _query)
_add("tree_mapping", QUERY + f""", t AS (SELECT label, child, {NORM('label')} AS norm FROM tree_edges WHERE is_tip AND label IS NOT NULL AND tree_id = (SELECT min(tree_id) FROM tree_edges)),
f AS {first('t', 'norm', 'child', "norm <> ''")}
SELECT input_name, normalized_name, query_name, f.label AS tree_name, f.label IS NOT NULL AS in_tree, CASE WHEN f.label IS NULL THEN 'unmatched' WHEN query_name <> normalized_name THEN 'tnrs' WHEN normalized_name <> input_name THEN 'normalized' ELSE 'exact' END AS match_type,
NULL::VARCHAR AS placement_status, tnrs_number_matches, tnrs_is_synonym, tnrs_approximate_match, tnrs_flags FROM r LEFT JOIN f ON {NORM('query_name')} = f.norm""",
     lambda s, f: R.tree_mapping(_query(s, f), _edges(s, f)))
_add("tree_provenance", "SELECT tree_id, 'test trees' AS citation, 'none' AS calibration_method, count(*) AS n_tips FROM tree_edges WHERE is_tip GROUP BY 1", lambda s, f: R.provenance(_edges(s, f), "test trees", "none"))
# each node's bracket, label and length in the order of the paths of child ids that lead to them
LABEL = (
    r"CASE WHEN label IS NULL THEN '' WHEN regexp_full_match(label, '[^\s(),:;\[\]'']+') THEN label "
    "ELSE chr(39) || replace(label, chr(39), chr(39) || chr(39)) || chr(39) END || CASE WHEN edge_length IS NULL THEN '' ELSE ':' || edge_length END"
)
_add("newick_text", W + f""", e AS (SELECT *, child <> min(child) OVER (PARTITION BY tree_id, parent) AS later, {LABEL} AS tail FROM tree_edges),
way(tree_id, node, path) AS (SELECT tree_id, root, [0::BIGINT] FROM rt UNION ALL SELECT w.tree_id, e.child, list_append(w.path, e.child) FROM way w JOIN tree_edges e ON e.tree_id = w.tree_id AND e.parent = w.node),
k AS (SELECT w.*, coalesce(later, false) AS later, coalesce(tail, '') AS tail, EXISTS (SELECT 1 FROM tree_edges c WHERE c.tree_id = w.tree_id AND c.parent = w.node) AS inner_ FROM way w LEFT JOIN e ON e.tree_id = w.tree_id AND e.child = w.node),
t AS (SELECT tree_id, path, CASE WHEN later THEN ',' ELSE '' END || CASE WHEN inner_ THEN '(' ELSE tail END AS word FROM k UNION ALL SELECT tree_id, list_append(path, 9000000000000000000), ')' || tail FROM k WHERE inner_)
SELECT tree_id, string_agg(word, '' ORDER BY path) || ';' AS newick FROM t GROUP BY tree_id""", lambda s, f: to_newick(_edges(s, f)))
