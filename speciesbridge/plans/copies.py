"""The query on two copies of the mapping table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.copies import copy_differences
from ..runtime import table
from .registry import Registry

REGISTRY = Registry()

P1 = """
WITH a AS (SELECT DISTINCT map_id, name_x, match_type, name_y FROM mapping),
b AS (SELECT DISTINCT map_id, name_x, match_type, name_y FROM mapping_copy),
j AS (SELECT a.map_id AS ka, b.map_id AS kb, coalesce(a.map_id, b.map_id) AS map_id,
  a.name_x IS DISTINCT FROM b.name_x AS dx, a.match_type IS DISTINCT FROM b.match_type AS dt,
  a.name_y IS DISTINCT FROM b.name_y AS dy FROM a FULL JOIN b ON a.map_id = b.map_id)
SELECT map_id, 'only_mapping' AS finding FROM j WHERE kb IS NULL
UNION ALL SELECT map_id, 'only_copy' FROM j WHERE ka IS NULL
UNION ALL SELECT map_id, 'name_x' FROM j WHERE ka = kb AND dx
UNION ALL SELECT map_id, 'match_type' FROM j WHERE ka = kb AND dt
UNION ALL SELECT map_id, 'name_y' FROM j WHERE ka = kb AND dy
"""


@REGISTRY.add("p1_found", P1)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copy_differences(
        table(spark, folder, "mapping"), table(spark, folder, "mapping_copy"), "map_id", ["name_x", "match_type", "name_y"], "mapping", "copy"
    )
