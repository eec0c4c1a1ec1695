"""Fixed schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "bigint": T.LongType()}


def _schema(text: str) -> T.StructType:
    """A schema from its DDL, without a session, so that workers can import this module."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


MAPPING = _schema(
    "name_x string, name_y string, name_resolved string, match_type string, match_score double, match_source string, "
    "in_x boolean, in_y boolean, notes string"
)
UNUSED = _schema("name_x string, name_y string, reason string")
OVERRIDES = _schema("name_x string, name_y string, action string, user_note string, timestamp timestamp")
TREE = _schema("tree_id string, parent bigint, child bigint, edge_length double, label string, is_tip boolean")

# The vocabularies.
MATCH_TYPES = ("exact", "normalized", "synonym", "fuzzy", "manual", "unresolved", "flagged", "augmented", "override_unused")
RESOLVED_TYPES = ("exact", "normalized", "synonym", "fuzzy", "manual", "augmented")
COVERED_TYPES = ("exact", "normalized", "synonym", "fuzzy", "manual")
AUTHORITIES = ("col", "itis", "gbif", "ncbi", "ott", "itis_test", "gnverifier")
REMOVED_AUTHORITIES = ("iucn", "tpl", "fb", "slb", "wd")
ACTIONS = ("accept", "reject", "replace")


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")


def check_mapping(df: DataFrame) -> DataFrame:
    """df if it has the nine columns of a mapping in their types, else an error. Further columns may follow."""
    require(df, MAPPING.fieldNames(), "the mapping")
    for f in MAPPING:
        if df.schema[f.name].dataType != f.dataType:
            raise TypeError(f"mapping column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return df


def check_authority(code: str | None) -> str | None:
    """The authority's code in lower case; None (no synonym stage) is allowed."""
    if code is None:
        return None
    code = code.lower()
    if code in REMOVED_AUTHORITIES:
        raise ValueError(f"authority {code!r} is no longer offered")
    if code not in AUTHORITIES:
        raise ValueError(f"authority must be one of {AUTHORITIES}, not {code!r}")
    return code


def mapping_rows(df: DataFrame, match_type, score, source, in_x: bool, in_y: bool, notes, resolved=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the mapping's schema, after the columns to keep, from df's name_x and name_y (where it has them)."""
    lit = lambda v, t: v.cast(t) if not isinstance(v, (str, float, type(None))) else F.lit(v).cast(t)
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.select(
        *keep,
        has("name_x").alias("name_x"),
        has("name_y").alias("name_y"),
        lit(resolved, "string").alias("name_resolved"),
        lit(match_type, "string").alias("match_type"),
        lit(score, "double").alias("match_score"),
        lit(source, "string").alias("match_source"),
        F.lit(in_x).alias("in_x"),
        F.lit(in_y).alias("in_y"),
        lit(notes, "string").alias("notes"),
    )
