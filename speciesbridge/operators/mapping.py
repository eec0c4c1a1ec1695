"""Operators on the mapping table: counts, corrections, differences, splits and lumps."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relational import first_rows, one_row
from ..functions.schema import ACTIONS, COVERED_TYPES, MAPPING, MATCH_TYPES, OVERRIDES, RESOLVED_TYPES, UNUSED, check_mapping, mapping_rows, require
from ..runtime import cut

# The notes of rows that a reject leaves.
REJECTED, READDED = "Rejected: ", "Re-added after rejection"


@dataclass
class Reconciliation:
    """A mapping with what is known about it."""

    mapping: DataFrame
    meta: dict = field(default_factory=dict)
    overrides: DataFrame | None = None
    unused_overrides: DataFrame | None = None

    def __post_init__(self) -> None:
        check_mapping(self.mapping)
        spark = self.mapping.sparkSession
        if self.overrides is None:
            self.overrides = spark.createDataFrame([], OVERRIDES)
        if self.unused_overrides is None:
            self.unused_overrides = spark.createDataFrame([], UNUSED)

    def table(self, with_unused: bool = False) -> DataFrame:
        return with_unused_overrides(self.mapping, self.unused_overrides) if with_unused else self.mapping

    def counts(self) -> DataFrame:
        return counts(self.mapping)

    def __str__(self) -> str:
        c = self.counts().first().asDict()
        n = sum(c[f"n_{t}"] for t in COVERED_TYPES)
        share = f"{100 * n / c['n_x']:.1f} %" if c["n_x"] else "n/a"
        kinds = ", ".join(f"{t} {c[f'n_{t}']}" for t in (*COVERED_TYPES, "flagged"))
        return f"Reconciliation ({self.meta.get('type', 'unknown')}): {c['n_x']} x, {c['n_y']} y, coverage {share}; {kinds}; unresolved {c['n_unresolved_x']} x, {c['n_unresolved_y']} y"


def _of(kind: str) -> Column:
    return F.count_if(F.coalesce(F.col("match_type") == kind, F.lit(False)))


def counts(mapping: DataFrame) -> DataFrame:
    """One row of 11 counters, in one aggregation with map-side sums; NULLs count nowhere, an empty mapping gives zeros."""
    side = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    open_ = lambda c: F.count_if(F.coalesce((F.col("match_type") == "unresolved") & F.col(c), F.lit(False)))
    return mapping.agg(
        side("in_x").alias("n_x"), side("in_y").alias("n_y"),
        *[_of(t).alias(f"n_{t}") for t in ("exact", "normalized", "synonym", "fuzzy", "manual", "flagged", "augmented")],
        open_("in_x").alias("n_unresolved_x"), open_("in_y").alias("n_unresolved_y"),
    )


def coverage(mapping: DataFrame) -> DataFrame:
    """(n_matched, n_x, coverage): matched names over names of x, flagged ones not among them; NULL without x."""
    c = counts(mapping)
    matched = sum((F.col(f"n_{t}") for t in COVERED_TYPES[1:]), F.col(f"n_{COVERED_TYPES[0]}"))
    return c.select(matched.alias("n_matched"), "n_x", (matched / F.nullif("n_x", F.lit(0))).alias("coverage"))


def by_type(mapping: DataFrame) -> DataFrame:
    """(match_type, n): rows of each type that occurs, NULL being a type."""
    return mapping.groupBy("match_type").agg(F.count("*").alias("n"))


def composition(mapping: DataFrame) -> DataFrame:
    """(match_type, n) of the types of the vocabulary that occur, for plots; zero classes are dropped."""
    return by_type(mapping).where(F.col("match_type").isin(*MATCH_TYPES) & (F.col("match_type") != "override_unused"))


def with_unused_overrides(mapping: DataFrame, unused: DataFrame) -> DataFrame:
    rows = mapping_rows(unused.select("name_x", "name_y", "reason"), "override_unused", None, "user_override", False, False, F.col("reason"))
    return mapping.select(*MAPPING.fieldNames()).unionByName(rows)


def _order(mapping: DataFrame, order: list[str] | None) -> list[str]:
    return order or MAPPING.fieldNames()


def accept_pairs(mapping: DataFrame, pairs: DataFrame) -> DataFrame:
    """The mapping with these pairs (name_x, name_y, note) set by hand, each name occurring in one pair only.

    All rows of the pairs' name_x and the y-only unresolved rows of their name_y go. Set-based, for pairs of any
    number; where names repeat, override_batch keeps the order.
    """
    cols = MAPPING.fieldNames()
    gone = pairs.select(F.col("name_y").alias("_y"), F.lit(True).alias("_gone"))
    kept = mapping.select(*cols).join(pairs.select("name_x"), "name_x", "left_anti")
    kept = kept.join(gone, F.col("name_y") == F.col("_y"), "left")
    only_y = F.coalesce(F.col("_gone") & (F.col("match_type") == "unresolved") & ~F.col("in_x"), F.lit(False))
    return kept.where(~only_y).select(*cols).unionByName(mapping_rows(pairs, "manual", 1.0, "user_override", True, True, F.col("note")))


def clean_actions(batch: DataFrame) -> DataFrame:
    """A batch with its optional columns filled in: action accept, note '', name_y NULL."""
    require(batch, ["name_x"], "the batch of overrides")
    for name, value in (("name_y", None), ("action", "accept"), ("note", "")):
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(value).cast("string"))
    return batch


def override_batch(mapping: DataFrame, batch: DataFrame, pos: str, order: list[str] | None = None) -> DataFrame:
    """The mapping after the batch's corrections (name_x, name_y, action, note), one after the other by pos (unique).

    accept and replace drop all rows of name_x and the unresolved rows of name_y that are not in x, and append the pair as
    manual; reject makes the first row of name_x unresolved and, if its former name_y is nowhere else, appends that as a
    y-only row. Rows with a NULL name_x do nothing; an accept without name_y or another action is an error. order: columns
    that say which row of a name is first (default: all, ascending). An empty batch changes nothing.

    No row is visited one by one. When a row leaves the mapping is known beforehand: at the first accept of its name_x or,
    if it is open, of its name_y. What a name_x is goes by its own corrections only: each accept begins an episode that
    ends with the next reject or accept. So the rows that hold a name_y at the time of a reject are a running sum over what
    comes and goes, and it is added again if that sum is 0 and no accept takes it later. The batch may have any size;
    corrections of one name, and what comes and goes of one rejected name_y, are sorted in one task, which spills.
    """
    cols = MAPPING.fieldNames()
    ops = clean_actions(batch).where("name_x is not null")
    ops = cut(ops.select(F.col(pos).alias("pos"), F.col("name_x").alias("x"), F.col("name_y").alias("y"), "action", "note"))
    bad = ops.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).select("action").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"actions must be among {ACTIONS}, not {sorted(str(r['action']) for r in bad)}")
    if not ops.where("action <> 'reject' and y is null").isEmpty():
        raise ValueError("accept and replace need a name_y")
    # episodes of a name: number 0 is before its first accept, each accept begins another
    rejects, by_x = F.col("action") == "reject", Window.partitionBy("x")
    numbered = ops.withColumn("g", F.count_if(~rejects).over(by_x.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda c, is_reject: F.when(rejects if is_reject else ~rejects, F.col(c))
    episodes = numbered.groupBy("x", "g").agg(
        F.min(at("pos", False)).alias("begin"), F.max(at("y", False)).alias("y"), F.max(at("note", False)).alias("note"),
        F.min(at("pos", True)).alias("rejected"), F.max_by("note", at("pos", True)).alias("why"),
    )
    episodes = cut(episodes.withColumn("next", F.lead("begin").over(by_x.orderBy("g"))))
    accepted = episodes.where("g > 0")
    of_x = episodes.groupBy(F.col("x").alias("_x")).agg(
        F.min("begin").alias("_gone"), F.max(F.when(F.col("g") == 0, F.col("rejected"))).alias("_rejected"), F.max(F.when(F.col("g") == 0, F.col("why"))).alias("_why")
    )
    of_y = accepted.groupBy(F.col("y").alias("_y")).agg(F.min("begin").alias("_taken"), F.max("begin").alias("_last"))
    open_y = F.coalesce((F.col("match_type") == "unresolved") & ~F.col("in_x"), F.lit(False))
    by = _order(mapping, order)
    rows = mapping.select(*cols, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)])
    rows = rows.join(of_x, F.col("name_x") == F.col("_x"), "left").join(of_y.select("_y", "_taken"), (F.col("name_y") == F.col("_y")) & open_y, "left")
    nothing_happens = F.coalesce("_gone", "_rejected", "_taken").isNull()
    still = F.col("_taken").isNull() | (F.col("_taken") > F.col("_rejected"))
    first = F.row_number().over(Window.partitionBy("name_x", F.col("_rejected").isNull()).orderBy(F.desc(F.coalesce(still, F.lit(True))), *[f"_o{i}" for i in range(len(by))]))
    touched = rows.where(~nothing_happens)
    rejected = touched.where("_rejected is not null").withColumn("_first", (first == 1) & F.coalesce(still, F.lit(False)))
    touched = cut(touched.where("_rejected is null").withColumn("_first", F.lit(False)).unionByName(rejected))
    none = F.lit(None).cast("string")
    notes = lambda c: F.concat(F.lit(REJECTED), F.coalesce(c, F.lit("NA")))
    turned = touched.where("_first and _gone is null").select(
        "name_x", none.alias("name_y"), "name_resolved", F.lit("unresolved").alias("match_type"), F.lit(None).cast("double").alias("match_score"),
        none.alias("match_source"), "in_x", F.lit(False).alias("in_y"), notes("_why").alias("notes"),
    )
    ended = accepted.where("next is null").select(F.col("x").alias("name_x"), F.col("y").alias("name_y"), "note", "rejected", "why")
    manual = mapping_rows(ended.where("rejected is null"), "manual", 1.0, "user_override", True, True, F.col("note"))
    undone = mapping_rows(ended.where("rejected is not null").drop("name_y"), "unresolved", None, None, True, False, notes("why"))
    # what comes and goes of each name_y that a reject sets free
    event = lambda df, y, pos_, n, free=False: df.select(F.col(y).alias("y"), F.col(pos_).alias("pos"), F.lit(n).alias("n"), F.lit(free).alias("free")).where("y is not null and pos is not null")
    free = cut(event(touched.where("_first"), "name_y", "_rejected", 0, True).unionByName(event(accepted, "y", "rejected", 0, True)))
    leaves = touched.withColumn("_at", F.when(F.col("_first"), F.col("_rejected")).otherwise(F.least("_gone", "_taken")))
    over = accepted.withColumn("end", F.coalesce("rejected", "next"))
    events = free.unionByName(event(leaves, "name_y", "_at", -1)).unionByName(event(accepted, "y", "begin", 1)).unionByName(event(over, "y", "end", -1))
    freed = free.select("y").distinct()
    sums = events.groupBy("y", "pos").agg(F.sum("n").alias("n"), F.bool_or("free").alias("free")).join(freed, "y", "left_semi")
    held = mapping.select(F.col("name_y").alias("y")).join(freed, "y", "left_semi").groupBy("y").agg(F.count("*").alias("held"))
    running = sums.withColumn("n", F.sum("n").over(Window.partitionBy("y").orderBy("pos"))).join(held, "y", "left")
    running = running.join(of_y.select(F.col("_y").alias("y"), "_last"), "y", "left")
    again = running.where(F.col("free") & (F.coalesce("held", F.lit(0)) + F.col("n") <= 0) & (F.col("_last").isNull() | (F.col("pos") > F.col("_last"))))
    added = mapping_rows(again.select(F.col("y").alias("name_y")).distinct(), "unresolved", None, None, False, True, READDED)
    kept = touched.where("not _first and _gone is null and _taken is null").select(*cols)
    out = rows.where(nothing_happens).select(*cols)
    for part in (kept, turned, manual, undone, added):
        out = out.unionByName(part.select(*cols))
    return out


def override(rec: Reconciliation, name_x: str, name_y: str | None = None, action: str = "accept", note: str = "") -> Reconciliation:
    """One correction; it is logged whether or not it changes anything."""
    one = rec.mapping.sparkSession.createDataFrame([(0, name_x, name_y, action, note)], "pos int, name_x string, name_y string, action string, note string")
    return apply_batch(rec, one, "pos")


def apply_batch(rec: Reconciliation, batch: DataFrame, pos: str, order: list[str] | None = None) -> Reconciliation:
    """A reconciliation after a batch of corrections, or of the decisions of a review (rows skipped are no rows)."""
    now = datetime.now(timezone.utc)
    log = clean_actions(batch).select("name_x", "name_y", "action", F.col("note").alias("user_note"), F.lit(now).cast("timestamp").alias("timestamp"))
    meta = rec.meta | {"overridden_at": now.isoformat()}
    return Reconciliation(override_batch(rec.mapping, batch, pos, order), meta, rec.overrides.unionByName(log), rec.unused_overrides)


@dataclass
class Diff:
    gained: DataFrame
    lost: DataFrame
    type_changed: DataFrame
    target_changed: DataFrame
    unused_overrides_diff: DataFrame
    summary: DataFrame


def diff(a: DataFrame, b: DataFrame, order_a: list[str] | None = None, order_b: list[str] | None = None, unused_a: DataFrame | None = None, unused_b: DataFrame | None = None) -> Diff:
    """What changed from mapping a to mapping b, on names of x that both have, by the first row of each.

    Rows without in_x or name_x don't count; flagged and unresolved rows are not resolved, nor are types outside the
    vocabulary or NULL. Only shared names are compared, after first rows were picked with a limit before the shuffle.
    """
    spark = a.sparkSession

    def side(m: DataFrame, order: list[str] | None, s: str) -> DataFrame:
        rows = first_rows(m.where("in_x and name_x is not null"), ["name_x"], [F.col(c) for c in _order(m, order)])
        resolved = F.coalesce(F.col("match_type").isin(*RESOLVED_TYPES), F.lit(False))
        return rows.select("name_x", F.col("name_y").alias(f"y{s}"), F.col("match_type").alias(f"t{s}"), F.col("match_score").alias(f"s{s}"), resolved.alias(f"r{s}"))

    j = side(a, order_a, "a").join(side(b, order_b, "b"), "name_x")
    unused_a = unused_a if unused_a is not None else spark.createDataFrame([], UNUSED)
    unused_b = unused_b if unused_b is not None else spark.createDataFrame([], UNUSED)

    def only(p: DataFrame, q: DataFrame, s: str) -> DataFrame:
        same = [p[c].eqNullSafe(q[c]) for c in UNUSED.fieldNames()]
        return p.join(q, same[0] & same[1] & same[2], "left_anti").withColumn("side", F.lit(s))

    types = [F.col("ta").alias("match_type_old"), F.col("tb").alias("match_type_new")]
    unused = only(unused_a, unused_b, "x").unionByName(only(unused_b, unused_a, "y"))
    kinds = {
        "n_gained": ~F.col("ra") & F.col("rb"), "n_lost": F.col("ra") & ~F.col("rb"), "n_type_changed": F.col("ra") & F.col("rb") & (F.col("ta") != F.col("tb")),
        "n_target_changed": F.col("ra") & F.col("rb") & (F.coalesce("ya", F.lit("")) != F.coalesce("yb", F.lit(""))),
    }
    counted = j.agg(*[F.count_if(c).alias(n) for n, c in kinds.items()], F.count("*").alias("n_shared"))
    summary = one_row(counted, unused.agg(F.count("*").alias("n_unused_override_diff")))
    return Diff(
        j.where(kinds["n_gained"]).select("name_x", F.col("yb").alias("name_y_new"), *types, F.col("sb").alias("match_score")),
        j.where(kinds["n_lost"]).select("name_x", F.col("ya").alias("name_y_old"), *types),
        j.where(kinds["n_type_changed"]).select("name_x", *types, F.col("yb").alias("name_y")),
        j.where(kinds["n_target_changed"]).select("name_x", F.col("ya").alias("name_y_old"), F.col("yb").alias("name_y_new")),
        unused, summary,
    )


def splits_lumps(mapping: DataFrame) -> DataFrame:
    """(name_resolved, names_x, names_y, n_x, n_y, type) of synonym groups with several names on a side.

    split: one x and several y; lump: several x and one y; else split_lump (which is among both splits and lumps).
    NULL names don't count. Names are first made distinct by a shuffle on (name_resolved, name) that no hot group can
    crowd, and counted from there; the arrays are the feature, as long as the group.
    """
    rows = mapping.where("match_type = 'synonym' and name_resolved is not null")
    side = lambda c, k: rows.select("name_resolved", F.lit(k).alias("k"), F.col(c).alias("n")).where("n is not null")
    cells = side("name_x", 0).unionByName(side("name_y", 1)).distinct()
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("n"))))
    groups = cells.groupBy("name_resolved").agg(pick(0).alias("names_x"), pick(1).alias("names_y"))
    sized = groups.withColumn("n_x", F.size("names_x").cast("bigint")).withColumn("n_y", F.size("names_y").cast("bigint")).where("n_x > 1 or n_y > 1")
    kind = F.when((F.col("n_y") > 1) & (F.col("n_x") == 1), "split").when((F.col("n_x") > 1) & (F.col("n_y") == 1), "lump").otherwise("split_lump")
    return sized.withColumn("type", kind)


def unresolved_names(mapping: DataFrame, side: str) -> DataFrame:
    """(name): the distinct unresolved names of side x or y."""
    rows = mapping.where(F.col(f"in_{side}") & (F.col("match_type") == "unresolved") & F.col(f"name_{side}").isNotNull())
    return rows.select(F.col(f"name_{side}").alias("name")).distinct()


def review_candidates(mapping: DataFrame, kind: str = "flagged") -> DataFrame:
    """The rows that a review of that kind is about: flagged ones; fuzzy and flagged ones; or all_unresolved, which are the
    unresolved and flagged rows of names of x. Decisions on them go to apply_batch; suggestions() has near misses."""
    kinds = {"flagged": ("flagged",), "fuzzy": ("fuzzy", "flagged"), "all_unresolved": ("unresolved", "flagged")}
    if kind not in kinds:
        raise ValueError(f"kind must be one of {tuple(kinds)}")
    rows = mapping.where(F.col("match_type").isin(*kinds[kind]))
    return rows.where("in_x") if kind == "all_unresolved" else rows
