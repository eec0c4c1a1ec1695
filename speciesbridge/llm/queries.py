"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import Registry
from ..runtime import table
from .canon import canonical_entries, canonical_matches
from .consistent import irregular_values
from .groups import linked_groups, linking_rows
from .layout import layout_copies, layout_records
from .packing import fill, pack_documents
from .spans import shared_share, shared_spans
from .tokens import encode_corpus

REGISTRY = Registry()

LAYOUT = """
WITH t AS (SELECT map_id, name_x, name_y, coalesce(regexp_replace(lower(name_x), '[^\\p{L}\\p{N}\\p{M}]', '', 'g'), '') AS a,
  coalesce(regexp_replace(lower(name_y), '[^\\p{L}\\p{N}\\p{M}]', '', 'g'), '') AS b FROM mapping),
g AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM t),
w AS (SELECT *, min(map_id) OVER (PARTITION BY lo, hi) AS first_id, count(*) OVER (PARTITION BY lo, hi) AS n FROM g)
"""
P2 = LAYOUT + "SELECT first_id, map_id AS copy_id FROM w WHERE hi <> '' AND map_id <> first_id"
P2_RECORDS = LAYOUT + """
SELECT map_id, name_x, name_y, CASE WHEN hi <> '' THEN n END AS n_copies FROM w WHERE hi = '' OR map_id = first_id"""

P5 = """
WITH RECURSIVE e AS (SELECT from_name AS a, to_name AS b FROM crosswalk
  WHERE lower(regexp_replace(link_type, '[\\s\\p{Z}]+', '', 'g')) IN ('1blto1bt', 'manyblto1bt', '1bltomanybt')
  AND from_name IS NOT NULL AND to_name IS NOT NULL AND from_name <> to_name),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS member, b AS seen FROM s UNION SELECT r.member, s.b FROM r JOIN s ON r.seen = s.a),
g AS (SELECT member, least(member, min(seen)) AS group_name FROM r GROUP BY member)
SELECT group_name, member AS member_name FROM g WHERE member <> group_name
"""

P8_RUNS = """
WITH w AS (SELECT doc_id, i, substring(text, i + 1, 200) AS s FROM documents, unnest(range(0, length(text) - 199)) AS u(i)
  WHERE length(text) >= 200),
h AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
p AS (SELECT w.doc_id, w.i FROM w SEMI JOIN h ON w.s = h.s),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM p),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
runs AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM k GROUP BY doc_id, run)
"""
P8 = P8_RUNS + "SELECT doc_id, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end FROM runs"
P8_SHARE = P8_RUNS + """
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS n_shared,
  CAST(count(span_start) AS BIGINT) AS n_runs FROM documents d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id, d.text
"""


@REGISTRY.add("p2_found", P2)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies(table(spark, folder, "mapping"), "map_id", ["name_x", "name_y"])


@REGISTRY.add("p2_records", P2_RECORDS)
def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return layout_records(table(spark, folder, "mapping").select("map_id", "name_x", "name_y"), "map_id", ["name_x", "name_y"])


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"name_x": "species", "name_y": "species", "match_type": "match_type"}
    return canonical_matches(table(spark, folder, "mapping"), "map_id", fields, table(spark, folder, "canon_names"))


@REGISTRY.add("p3_entries")
def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"name_x": "species", "name_y": "species", "match_type": "match_type"}
    return canonical_entries(table(spark, folder, "mapping"), "map_id", fields, table(spark, folder, "canon_names"))


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return irregular_values(table(spark, folder, "mapping"), "map_id", ["name_x", "name_y"]).select("map_id", "field_name")


@REGISTRY.add("p4_forms")
def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    return irregular_values(table(spark, folder, "mapping"), "map_id", ["name_x", "name_y"])


@REGISTRY.add("p5_found", P5)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(linking_rows(table(spark, folder, "crosswalk"), "link_type"), "from_name", "to_name")


@REGISTRY.add("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


@REGISTRY.add("p7_containers")
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), "doc_id", "text", 1024)


@REGISTRY.add("p7_fill")
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(pack_documents(table(spark, folder, "documents"), "doc_id", "text", 1024), 1024)


@REGISTRY.add("p8_found", P8)
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"), "doc_id", "text", 200)


@REGISTRY.add("p8_share", P8_SHARE)
def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(table(spark, folder, "documents"), "doc_id", "text", 200)
