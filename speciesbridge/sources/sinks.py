"""Results out: CSV tables and reports."""

from __future__ import annotations

import html
import math
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.mapping import Reconciliation, composition
from ..operators.merge import apply_to_data
from ..operators.trees import align
from .ingest import CSV
from .treefiles import write_trees

# Rows that reports show at most, and the colours of match types.
REPORT_ROWS, REPORT_LIST, SUMMARY_ROWS = 50, 100, 20
COLOURS = {"exact": "#2166ac", "normalized": "#67a9cf", "synonym": "#5ab4ac", "fuzzy": "#d8b365", "manual": "#762a83", "flagged": "#f1a340", "unresolved": "#b2182b"}


def export(rec: Reconciliation, folder: str, prefix: str = "reconciled", data: DataFrame | None = None, species: str | None = None, tree: DataFrame | None = None, tree_kind: str = "nexus", drop_unresolved: bool = False, order: list[str] | None = None) -> dict[str, str]:
    """Write the mapping, the aligned data and tree if given, and unused overrides if there are any; returns the paths."""
    out = {"mapping": os.path.join(folder, f"{prefix}_mapping")}
    rec.mapping.write.mode("overwrite").csv(out["mapping"], **CSV)
    if data is not None:
        out["data"] = os.path.join(folder, f"{prefix}_data")
        apply_to_data(rec.mapping, data, species or "species", drop_unresolved).write.mode("overwrite").csv(out["data"], **CSV)
    if tree is not None:
        out["tree"] = os.path.join(folder, f"{prefix}_tree")
        write_trees(align(tree, rec.mapping, order or ["name_x", "name_y"], drop_unresolved=drop_unresolved), out["tree"], tree_kind)
    if not rec.unused_overrides.isEmpty():
        out["unused"] = os.path.join(folder, f"{prefix}_unused_overrides")
        rec.unused_overrides.write.mode("overwrite").csv(out["unused"], **CSV)
    return out


def report_rows(mapping: DataFrame, kinds: list[str], n: int) -> DataFrame:
    """(match_type, rank, name_x, name_y): the first n rows of each match type by name, which is all that a report shows."""
    w = Window.partitionBy("match_type").orderBy("name_x", "name_y")
    rows = mapping.where(F.col("match_type").isin(*kinds)).select("match_type", "name_x", "name_y")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("match_type", "rank", "name_x", "name_y")


def summary_text(rec: Reconciliation, detail: str = "full") -> str:
    """A summary to read; detail: full, brief or mismatches_only. Lists are cut after SUMMARY_ROWS names, as that is
    their purpose; the counts are of all rows."""
    if detail not in ("full", "brief", "mismatches_only"):
        raise ValueError("detail must be full, brief or mismatches_only")
    lines = [str(rec)]
    if detail == "brief":
        return lines[0]
    sections = [("unresolved", "Unresolved"), ("flagged", "Flagged for review"), ("fuzzy", "Fuzzy")]
    if detail == "full":
        sections += [("synonym", "Synonyms"), ("manual", "Manual"), ("normalized", "Normalised")]
    listed = report_rows(rec.mapping, [k for k, _ in sections], SUMMARY_ROWS + 1).orderBy("rank").collect()
    for kind, title in sections:
        rows = [r for r in listed if r["match_type"] == kind]
        if rows:
            lines.append(f"\n{title}:")
            lines += [f"  {r['name_x'] or '-'} -> {r['name_y'] or '-'}" for r in rows[:SUMMARY_ROWS]]
            if len(rows) > SUMMARY_ROWS:
                lines.append("  ...")
    return "\n".join(lines)


def html_report(rec: Reconciliation, title: str = "Reconciliation report") -> str:
    """A self-contained page; every value is escaped. Tables are cut after REPORT_ROWS rows."""
    counts = rec.counts().first().asDict()
    esc = lambda v: "" if v is None else html.escape(str(v), quote=True)
    cells = "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in counts.items())
    parts = [f"<h1>{esc(title)}</h1><table>{cells}</table>{plot_svg(rec.mapping)}"]
    cols = ["name_x", "name_y", "match_type", "match_score", "notes"]
    for kind in ("flagged", "fuzzy", "synonym", "manual", "unresolved"):
        rows = rec.mapping.where(F.col("match_type") == kind).select(*cols).orderBy("name_x", "name_y").limit(REPORT_LIST if kind == "unresolved" else REPORT_ROWS).collect()
        if rows:
            body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
            parts.append(f"<h2>{esc(kind)}</h2><table><tr>{''.join(f'<th>{c}</th>' for c in cols)}</tr>{body}</table>")
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>{style}</style></head><body>{''.join(parts)}</body></html>"


def plot_svg(mapping: DataFrame, kind: str = "bar") -> str:
    """The composition of the mapping as a bar or a pie; classes that don't occur have no part in it."""
    if kind not in ("bar", "pie"):
        raise ValueError("kind must be bar or pie")
    counts = {r["match_type"]: r["n"] for r in composition(mapping).collect()}
    total, at, parts = sum(counts.values()) or 1, 0.0, []
    for name, colour in COLOURS.items():
        share = counts.get(name, 0) / total
        if not share:
            continue
        title = f"<title>{name}: {counts[name]}</title>"
        if kind == "bar":
            parts.append(f"<rect x='{600 * at:.2f}' y='0' width='{600 * share:.2f}' height='40' fill='{colour}'>{title}</rect>")
        elif share == 1:
            parts.append(f"<circle cx='100' cy='100' r='100' fill='{colour}'>{title}</circle>")
        else:
            (x0, y0), (x1, y1) = ((100 + 100 * math.sin(2 * math.pi * f), 100 - 100 * math.cos(2 * math.pi * f)) for f in (at, at + share))
            parts.append(f"<path d='M100,100 L{x0:.2f},{y0:.2f} A100,100 0 {int(share > 0.5)} 1 {x1:.2f},{y1:.2f} Z' fill='{colour}'>{title}</path>")
        at += share
    size = "width='600' height='40'" if kind == "bar" else "width='200' height='200'"
    return f"<svg xmlns='http://www.w3.org/2000/svg' {size}>{''.join(parts)}</svg>"
