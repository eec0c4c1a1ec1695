"""Scalar functions on scientific names, as Column expressions that stay inside codegen.

Every function takes NULL to NULL and keeps '' apart from NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalisation strips or rewrites, in order. The results must be the same everywhere.
EDGE_BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"
CLEANING = [
    (r"_", " "),
    (r"\s+", " "),
    (r"\s+ott\d+$", ""),
    (r"\s*\(\p{Lu}[\p{L}.&\s]*,?\s*\d{4}\)\s*$", ""),
    (r"^(\S+\s+\S+(?:\s+\S+)?)\s+\p{Lu}[\p{L}.]*(?:\s*(?:&|and)\s*\p{Lu}[\p{L}.]*)*(?:\s*,\s*|\s+)\d{4}\s*$", r"$1"),
    (r"^(\S+\s+\S+)\s+\p{Lu}[\p{L}.]+\.?\s*$", r"$1"),
    (r"\s*\([^()]*\)\s*$", ""),
    (r"\s*×\s*", " x "),
    (r"\bssp\.?\s+", "subsp. "),
    (r"\b(subsp|var|f)\.?\s+", "$1. "),
]
INFRASPECIFIC = [
    (r"^(\S+\s+\S+)\s+(?:subsp|ssp|var|f)\.?\s+.*$", r"$1"),
    (r"^(\S+\s+[a-z]\S*)\s+[a-z]\S*$", r"$1"),
]
RANKS = ("species", "subspecies")
#: Weights of first and second word in the similarity of two names, and the edits allowed between first words.
WORD_WEIGHTS, GENUS_EDITS = (0.6, 0.4), 2


def patterns(rank: str) -> list[tuple[str, str]]:
    if rank not in RANKS:
        raise ValueError(f"rank must be one of {RANKS}")
    return CLEANING + (INFRASPECIFIC if rank == "species" else [])


def trim_blanks(col: Column) -> Column:
    """Blanks, tabs and line ends off both ends; other white space stays."""
    return F.regexp_replace(col, EDGE_BLANKS, "")


def standard_case(col: Column) -> Column:
    """First letter capital, everything else in lower case; after a leading blank there is no capital."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def normalise(col: Column, rank: str = "species") -> Column:
    """The name without author, identifier and, for rank species, infraspecific parts, in standard case."""
    col = trim_blanks(col)
    for pattern, by in patterns(rank):
        col = F.translate(col, "_", " ") if pattern == "_" else F.regexp_replace(col, pattern, by)
    return trim_blanks(standard_case(col))


def word(col: Column, n: int) -> Column:
    """The n-th word (from 0), NULL where there is none. A leading blank makes the first word ''."""
    return F.get(F.split(col, r"\s+"), F.lit(n))


def genus(col: Column) -> Column:
    """The first word that isn't empty, as written; NULL where there is none."""
    return F.get(F.filter(F.split(col, r"\s+"), lambda w: w != ""), F.lit(0))


def part_similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the greater length; two empty words are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def name_similarity(genus_a: Column, epithet_a: Column, genus_b: Column, epithet_b: Column) -> Column:
    """Weighted similarity of first and second words; further words don't count."""
    return WORD_WEIGHTS[0] * part_similarity(genus_a, genus_b) + WORD_WEIGHTS[1] * part_similarity(epithet_a, epithet_b)


def placement_marker(label: Column) -> tuple[Column, Column]:
    """(label without trailing asterisks, placement): two or more family_added, one genus_added, none exact."""
    placed = F.when(label.rlike(r"\*\*+$"), "family_added").when(label.rlike(r"\*+$"), "genus_added").otherwise("exact")
    return F.regexp_replace(label, r"\*+$", ""), F.when(label.isNotNull(), placed)


# How crosswalk types are read, regardless of case.
ONE_TO_ONE, MANY_TO_ONE, ONE_TO_MANY = r"(?i)^1.*to.*1", r"(?i)many.*to.*1", r"(?i)1.*to.*many"


def crosswalk_kind(col: Column) -> Column:
    """one_to_one, many_to_one, one_to_many or other, in this order of precedence; NULL is other."""
    kind = F.when(col.rlike(ONE_TO_ONE), "one_to_one").when(col.rlike(MANY_TO_ONE), "many_to_one")
    return kind.when(col.rlike(ONE_TO_MANY), "one_to_many").otherwise("other")


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def escape_bibtex(col: Column) -> Column:
    for a in ("\\", "{", "}"):
        col = F.replace(col, F.lit(a), F.lit("\\" + a if a != "\\" else "\\\\"))
    return col
