"""Newick and Nexus, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import TREE
from ..runtime import ship

TOKEN = re.compile(r"\s*(?:\[[^\]]*\]\s*)*('(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+)")


class TreeSyntaxError(ValueError):
    pass


def parse_newick(text: str) -> tuple[list[tuple], str]:
    """([(parent, child, edge_length, label, is_tip)], what follows the tree). Tips are 1..n in the order of the text,
    inner nodes follow, the root first. Blanks in unquoted labels end them; underscores stay."""
    tokens, at, end = [], 0, 0
    for m in iter(lambda: TOKEN.match(text, at), None):
        tokens.append(m.group(1))
        at = end = m.end()
        if m.group(1) == ";":
            break
    if not tokens or tokens[-1] != ";":
        raise TreeSyntaxError("a tree must end with a semicolon")
    parent: list[int | None] = [None]
    label: list[str | None] = [None]
    length: list[float | None] = [None]
    kids: list[int] = [0]
    node, fresh, i = 0, True, 0
    while i < len(tokens):
        t = tokens[i]
        if t == "(" or t == ",":
            if t == "(" and not fresh:
                raise TreeSyntaxError("a bracket opens after a label")
            up = node if t == "(" else parent[node]
            if up is None:
                raise TreeSyntaxError("a comma outside of brackets")
            parent.append(up), label.append(None), length.append(None), kids.append(0)
            kids[up] += 1
            node, fresh = len(parent) - 1, True
        elif t == ")":
            if parent[node] is None:
                raise TreeSyntaxError("a bracket closes that was never opened")
            node, fresh = parent[node], False
        elif t == ":":
            i += 1
            try:
                length[node] = float(tokens[i])
            except (ValueError, IndexError):
                raise TreeSyntaxError("a length is no number") from None
            fresh = False
        elif t == ";":
            if parent[node] is not None:
                raise TreeSyntaxError("a bracket is left open")
            break
        else:
            label[node] = t[1:-1].replace("''", "'") if t[0] == "'" else t
            fresh = False
        i += 1
    if len(parent) == 1:
        raise TreeSyntaxError("a tree needs brackets")
    tips = [n for n in range(len(parent)) if not kids[n]]
    number = {n: k for k, n in enumerate(tips + [n for n in range(len(parent)) if kids[n]], 1)}
    edges = [(number[parent[n]], number[n], length[n], label[n], not kids[n]) for n in range(len(parent)) if parent[n] is not None]
    return edges, text[end:]


def parse_nexus(text: str) -> list[tuple[str, list[tuple]]]:
    """[(name, edges)] of the trees of a Nexus text, its translate table applied to labels."""
    if not text.lstrip().upper().startswith("#NEXUS"):
        raise TreeSyntaxError("no Nexus file")
    blocks = re.findall(r"begin\s+trees\s*;(.*?)\bend(?:block)?\s*;", text, re.I | re.S)
    if not blocks:
        raise TreeSyntaxError("no block of trees")
    out = []
    for block in blocks:
        names: dict[str, str] = {}
        table = re.search(r"\btranslate\b(.*?);", block, re.I | re.S)
        if table:
            for entry in re.findall(r"\s*(\S+)\s+('(?:[^']|'')*'|[^\s,]+)\s*(?:,|$)", table.group(1)):
                names[entry[0]] = entry[1][1:-1].replace("''", "'") if entry[1][0] == "'" else entry[1]
        for m in re.finditer(r"\b[u]?tree\s+\*?\s*('(?:[^']|'')*'|[^\s=]+)\s*=\s*", block, re.I):
            edges, _ = parse_newick(block[m.end() :])
            out.append((m.group(1).strip("'"), [(p, c, n, names.get(lab, lab) if lab else lab, tip) for p, c, n, lab, tip in edges]))
    if not out:
        raise TreeSyntaxError("a block of trees without trees")
    return out


def parse_trees(text: str, nexus: bool | None = None) -> list[tuple[str, list[tuple]]]:
    """Trees of a text: Nexus if it must be (nexus=True), else Newick, and Nexus should that fail."""
    if nexus:
        return parse_nexus(text)
    try:
        out, rest = [], text
        while rest.strip():
            edges, rest = parse_newick(rest)
            out.append((f"tree{len(out) + 1}", edges))
        if not out:
            raise TreeSyntaxError("no tree")
        return out
    except TreeSyntaxError:
        if nexus is False:
            raise
        return parse_nexus(text)


def read_trees(spark: SparkSession, path: str, first_only: bool = True) -> DataFrame:
    """Edges of the tree files at a path or pattern, tree_id being the file's name, with `#name` behind it unless only the
    first tree of each file is taken. Files are parsed in parallel, each by one task."""
    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["value"]):
                stem = file.rsplit("/", 1)[-1]
                trees = parse_trees(text, True if stem.lower().endswith((".nex", ".nexus")) else None)
                for name, edges in trees[:1] if first_only else trees:
                    rows += [(stem if first_only else f"{stem}#{name}", *e) for e in edges]
            yield pd.DataFrame(rows, columns=TREE.fieldNames())

    return files.mapInPandas(parse, TREE)


def tree_from_text(spark: SparkSession, text: str, tree_id: str = "tree") -> DataFrame:
    return spark.createDataFrame([(tree_id, *e) for e in parse_trees(text)[0][1]], TREE)


def first_tree(edges: DataFrame) -> DataFrame:
    """Of a sample of trees that with the smallest id."""
    return edges.join(edges.agg(F.min("tree_id").alias("tree_id")), "tree_id", "left_semi")


def _quoted(label: str | None) -> str:
    if label is None:
        return ""
    return label if re.fullmatch(r"[^\s(),:;\[\]']+", label) else "'" + label.replace("'", "''") + "'"


def newick_text(edges: list[tuple]) -> str:
    """The Newick text of (parent, child, edge_length, label) rows, children in the order of their ids."""
    kids: dict[int, list[tuple]] = {}
    children = set()
    for p, c, n, label in edges:
        kids.setdefault(p, []).append((c, n, label))
        children.add(c)
    root = next(p for p in kids if p not in children)
    out: list[str] = []
    stack: list = [(root, None, None, False)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, n, label, _ = item
        tail = _quoted(label) + ("" if n is None or n != n else f":{n!r}")
        if node in kids:
            out.append("(")
            stack.append(")" + tail)
            for k, child in enumerate(sorted(kids[node], key=lambda x: -x[0])):
                if k:
                    stack.append(",")
                stack.append((*child, False))
        else:
            out.append(tail)
    return "".join(out) + ";"


def to_newick(edges: DataFrame) -> DataFrame:
    """(tree_id, newick): the text of each tree, which is as long as the tree and made in one task per tree."""
    ship(edges.sparkSession)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, c, None if pd.isna(n) else n, None if pd.isna(lab) else lab) for p, c, n, lab in zip(pdf["parent"], pdf["child"], pdf["edge_length"], pdf["label"])]
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "newick": [newick_text(rows)]})

    return edges.groupBy("tree_id").applyInPandas(write, "tree_id string, newick string")


def write_trees(edges: DataFrame, path: str, kind: str = "newick") -> None:
    """One text file per partition of trees: newick lines, or nexus blocks."""
    text = to_newick(edges)
    if kind == "nexus":
        line = F.concat(F.lit("#NEXUS\nBEGIN TREES;\n\tTREE "), F.regexp_replace("tree_id", r"[^\w.]+", "_"), F.lit(" = [&R] "), F.col("newick"), F.lit("\nEND;"))
        text.select(line.alias("value")).write.mode("overwrite").text(path)
    elif kind == "newick":
        text.select(F.col("newick").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError("kind must be newick or nexus")
