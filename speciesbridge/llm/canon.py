"""Typed values led to the entry of a reference list that was meant.

A trie of the entries and their alias paths is searched with a Levenshtein automaton whose states (trie node, slips so
far, letter still owed after an exchange) are advanced for a whole batch of values at once: sorted values share the
states of their common prefixes, and a prefix without states is dropped with all values behind it.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, salted_join, ship
from . import codepoints as C
from .consistent import consistent
from .layout import fold_table

#: Entries that a worker holds at a time, some 2 kB each with their alias paths; a longer list is searched in parts.
PART_ENTRIES = 50_000
#: Values searched at a time.
BATCH = 120_000
# Words after a name that are ranks or qualifiers, not authors.
NO_AUTHOR = {"subsp", "ssp", "var", "f", "forma", "cf", "aff", "sp", "spp", "nr", "x", "cv", "subg", "sect", "morph"}
#: Words (with apostrophes, hyphens and points inside) and numbers; no two ways to read a text, so it is read once.
TOKEN = re.compile(r"[^\W\d_]++(?:[’'´`.\-‐–][^\W\d_]++)*+|\d++")
#: Words of an author, and authors one after the other (the first one's year, then who moved the name).
AUTHOR_WORDS, AUTHORS = 8, 2


def slips_allowed(length: int) -> int:
    """Slips an entry of so many letters may have: two, but one below five letters and none below three."""
    return 2 if length >= 5 else 1 if length >= 3 else 0


@dataclass
class Trie:
    """Child edges sorted by (node, letter); node 0 is the root. Each node has the entries that end there, mostly none."""

    key: np.ndarray
    letter: np.ndarray
    child: np.ndarray
    first: np.ndarray
    count: np.ndarray
    budget: np.ndarray  # slips allowed to the entries that end at the node, -1 if none does
    entry: np.ndarray
    entry_first: np.ndarray
    entry_count: np.ndarray

    @staticmethod
    def of(paths: list[tuple[tuple[int, ...], int]]) -> Trie:
        """paths: (letters, entry). All entries of a path are kept; paths without letters are left out."""
        paths = sorted({(p, e) for p, e in paths if p})
        lengths = np.array([len(p) for p, _ in paths], np.int64)
        width = int(lengths.max(initial=0))
        letters = np.zeros((len(paths), width), np.uint32)
        letters[np.arange(width) < lengths[:, None]] = np.fromiter((c for p, _ in paths for c in p), np.uint32, int(lengths.sum()))
        same = letters[1:] == letters[:-1]
        shared = np.concatenate([[0], np.where(same.all(axis=1), width, same.argmin(axis=1))]) if len(paths) else lengths
        # a path makes the nodes beyond what it shares with the one before it; paths being sorted, all others are there
        made = (np.arange(width) >= shared[:, None]) & (np.arange(width) < lengths[:, None])
        nodes = np.zeros(made.shape, np.int32)
        nodes[made] = np.arange(1, int(made.sum()) + 1)
        nodes = np.maximum.accumulate(nodes, axis=0) if len(paths) else nodes
        parent = np.concatenate([np.zeros((len(paths), 1), np.int32), nodes[:, :-1]], axis=1)[made] if width else np.zeros(0, np.int32)
        child, letter = nodes[made], letters[made]
        order = np.lexsort((letter, parent))
        size = len(child) + 1
        count = np.bincount(parent, minlength=size).astype(np.int32)
        ends = nodes[np.arange(len(paths)), lengths - 1] if width else np.zeros(0, np.int32)
        by_node = np.argsort(ends, kind="stable")
        entry_count = np.bincount(ends, minlength=size).astype(np.int32)
        budget = np.full(size, -1, np.int8)
        budget[ends] = [slips_allowed(n) for n in lengths.tolist()]
        entry = np.array([e for _, e in paths], np.int64)[by_node]
        first = lambda n: (np.cumsum(n) - n).astype(np.int32)
        key = parent[order].astype(np.int64) << 21 | letter[order]
        return Trie(key, letter[order], child[order], first(count), count, budget, entry, first(entry_count), entry_count)

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child by that letter, -1 where there is none."""
        if not len(self.key):
            return np.full(len(nodes), -1, np.int64)
        key = nodes.astype(np.int64) << 21 | letters
        at = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
        return np.where(self.key[at] == key, self.child[at], -1)

    def fan(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All children of the nodes: (which of the nodes, child, letter)."""
        n = self.count[nodes]
        at = C.spread(self.first[nodes], n)
        return np.repeat(np.arange(len(nodes)), n), self.child[at], self.letter[at]


def _least(prefix: np.ndarray, node: np.ndarray, owed: np.ndarray, slips: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each state once, with its fewest slips."""
    key = (prefix * (node.max(initial=0) + 1) + node) * 2 + (owed > 0)
    # an owed letter belongs to its node: the state after it is the node itself, so the key need not hold it
    order = np.lexsort((slips, owed, key))
    key, o = key[order], owed[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (o[1:] != o[:-1])]) if len(key) else np.zeros(0, bool)
    order = order[new]
    return prefix[order], node[order], owed[order], slips[order]


def _finals(trie: Trie, node: np.ndarray, slips: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which state, node, slips) of nodes with entries, here or within the letters that may still be missing."""
    which, e, s = [], [], []
    at, idx, n = node, np.arange(len(node)), slips
    while len(at):
        ok = n <= trie.budget[at]
        which.append(idx[ok]), e.append(at[ok]), s.append(n[ok])
        go = n < most
        k, child, _ = trie.fan(at[go])
        at, idx, n = child, idx[go][k], n[go][k] + 1
    return np.concatenate(which or [np.zeros(0, int)]), np.concatenate(e or [np.zeros(0, int)]), np.concatenate(s or [np.zeros(0, int)])


def search(trie: Trie, letters: np.ndarray, lengths: np.ndarray, ends: np.ndarray, most: int = 2) -> tuple[np.ndarray, ...]:
    """(row, letters read, entry, slips) of all entries within their slips of an admissible prefix of each row.

    letters: matrix of rows sorted ascending, filled with 0; lengths: letters of each row; ends: matrix with one
    column more, whether the row may be taken to end after so many letters.
    """
    n, width = letters.shape
    out: list[tuple[np.ndarray, ...]] = []
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    differs = letters[1:] != letters[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width) if width else np.zeros(n - 1, int)
    shared = np.concatenate([[-1], shared])  # letters in common with the row before
    first = np.zeros(1, np.int64)  # first row of each prefix
    size = np.full(1, n, np.int64)
    prefix, node, owed, slips = (np.zeros(1, np.int64) for _ in range(4))
    for depth in range(width + 1):
        if not len(prefix):
            break
        done = owed == 0
        which, entry, used = _finals(trie, node[done], slips[done], most)
        if len(which):
            p = prefix[done][which]
            rows = C.spread(first[p], size[p])
            k = np.repeat(np.arange(len(p)), size[p])
            ok = ends[rows, depth]
            out.append((rows[ok], np.full(int(ok.sum()), depth), entry[k[ok]], used[k[ok]]))
        if depth == width:
            break
        # the prefixes one letter longer, of the prefixes that have states
        live = np.unique(prefix)
        rows = C.spread(first[live], size[live])
        rows = rows[lengths[rows] > depth]
        owner = np.searchsorted(first, rows, side="right") - 1
        new = (shared[rows] <= depth) | np.concatenate([[True], rows[1:] != rows[:-1] + 1]) if len(rows) else np.zeros(0, bool)
        new |= np.concatenate([[True], owner[1:] != owner[:-1]]) if len(rows) else new
        begin = np.flatnonzero(new)
        next_first, next_size = rows[begin], np.diff(np.concatenate([begin, [len(rows)]]))
        letter, parent = letters[next_first, depth].astype(np.int64), owner[begin]
        kids = np.bincount(parent, minlength=len(first)) if len(parent) else np.zeros(len(first), np.int64)
        kid_at = np.cumsum(kids) - kids
        # every state meets every next letter of its prefix
        k = np.repeat(np.arange(len(prefix)), kids[prefix])
        to = C.spread(kid_at[prefix], kids[prefix])
        c, at, o, s = letter[to], node[k], owed[k], slips[k]
        paid = (o > 0) & (c == o)
        parts = [(to[paid], at[paid], np.zeros(int(paid.sum()), np.int64), s[paid])]
        free = o == 0
        to, c, at, s = to[free], c[free], at[free], s[free]
        hit = trie.step(at, c)
        ok = hit >= 0
        parts.append((to[ok], hit[ok], np.zeros(int(ok.sum()), np.int64), s[ok]))
        more = s < most
        to, c, at, s = to[more], c[more], at[more], s[more] + 1
        parts.append((to, at, np.zeros(len(to), np.int64), s))  # a letter too many
        j, child, by = trie.fan(at)
        other = by != c[j]
        parts.append((to[j[other]], child[other], np.zeros(int(other.sum()), np.int64), s[j[other]]))  # another letter
        after = trie.step(child, c[j])
        ok = after >= 0
        parts.append((to[j[ok]], after[ok], np.zeros(int(ok.sum()), np.int64), s[j[ok]]))  # a letter missing
        swap = ok & other
        parts.append((to[j[swap]], after[swap], by[swap], s[j[swap]]))  # two neighbours exchanged
        two = s[j] < most
        j2, child2, _ = trie.fan(child[two])
        after = trie.step(child2, c[j[two]][j2])
        ok = after >= 0
        parts.append((to[j[two][j2[ok]]], after[ok], np.zeros(int(ok.sum()), np.int64), s[j[two][j2[ok]]] + 1))  # two missing
        prefix, node, owed, slips = _least(*(np.concatenate(x) for x in zip(*parts)))
        first, size = next_first, next_size
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rows, read, node, used = (np.concatenate(x) for x in zip(*out))
    n = trie.entry_count[node]
    every = np.repeat(np.arange(len(node)), n)
    return rows[every], read[every], trie.entry[C.spread(trie.entry_first[node], n)], used[every]


def alias_paths(entries: list[tuple[int, str]], words: bool) -> list[tuple[tuple[int, ...], int]]:
    """Letters of each entry; with words also first word cut to its first letter, and each with the words exchanged."""
    out, more = [], []
    for ref, text in entries:
        cps, at, _ = consistent(*C.decode(pa.array([text])))
        parts = ["".join(map(chr, cps.tolist())).split()] if words else []
        folded = fold_table()[cps]
        out.append((tuple((folded[folded > 0] - 1).tolist()), ref))
        if words and len(parts[0]) == 2:
            a, b = ([fold_table()[ord(ch)] - 1 for ch in w if fold_table()[ord(ch)]] for w in parts[0])
            if a and b:
                more += [(tuple(map(int, x)), ref) for x in (b + a, a[:1] + b, b + a[:1])]
    return [(tuple(map(int, x)), ref) for x, ref in out] + more


def author_like(rest: str) -> bool:
    """Whether what follows a name is nothing or an author, with or without year, or two of them.

    The text is read once from left to right as words and numbers; white space and punctuation don't count.
    """
    words, authors, dated = 0, 0, False
    ranked = False
    for token in TOKEN.finditer(rest):
        t = token.group()
        if t.isdigit():
            if len(t) != 4 or not words or dated:
                return False
            dated = True
            continue
        # a letter behind a year belongs to it, as in 1857b
        if dated and len(t) == 1 and t.islower() and token.start() and rest[token.start() - 1].isdigit():
            continue
        if not words or dated:
            authors, words, dated = authors + 1, 0, False
        words += 1
        ranked |= (len(t) > 1 or t.islower()) and t.lower() in NO_AUTHOR
        if authors > AUTHORS or words > AUTHOR_WORDS:
            return False
    return not ranked or dated


class Matcher:
    """The search for one kind of entry: values in, the entry's id or -1 out."""

    def __init__(self, entries: list[tuple[int, str]], words: bool) -> None:
        self.entries = sorted((t, r) for r, t in entries)
        self.exact = {t: r for t, r in reversed(self.entries)}
        self.words = words
        paths = alias_paths([(r, t) for t, r in self.entries], words)
        self.trie = Trie.of(paths)
        self.deepest = max((len(x) for x, _ in paths), default=0)

    def entries_of(self, values: pa.Array) -> list[tuple[int, int, int, int]]:
        """(value, slips, minus letters read, entry) of all entries within their slips of each value, best first."""
        cps, at, _ = consistent(*C.decode(values))
        folded = fold_table()[cps]
        kept = folded > 0
        before = np.concatenate([[0], np.cumsum(kept)])
        starts, lengths = before[at[:-1]], before[at[1:]] - before[at[:-1]]
        letters, place = (folded[kept] - 1), np.flatnonzero(kept)
        n = len(lengths)
        width = int(min(self.deepest + 2, lengths.max(initial=0)))
        if not width:
            return []
        lengths_cut = np.minimum(lengths, width)
        col = np.arange(width)
        inside = col < lengths_cut[:, None]
        matrix = np.zeros((n, width), np.uint32)
        index = (starts[:, None] + col)[inside]
        matrix[inside] = letters[index]
        # after which letters may a name end: after the last one, and with authors before any later word or capital
        ends = np.zeros((n, width + 1), bool)
        if self.words:
            nxt = np.append(place, len(cps))
            col1 = np.arange(1, width + 1)
            ok = col1 < lengths[:, None]  # a letter follows
            i = (starts[:, None] + col1)[ok]
            gap = nxt[i] != nxt[i - 1] + 1
            capital = ~gap & (folded[nxt[i].clip(max=len(cps) - 1)] - 1 != cps[nxt[i].clip(max=len(cps) - 1)])
            ends[:, 1:][ok] = gap | capital
            dated = C.per_row(((cps >= 48) & (cps <= 57)).astype(np.int64), at) >= 4
            ends[:, 1:] |= ok & dated[:, None]
        full = lengths <= width
        ends[np.flatnonzero(full), lengths[full]] = True
        view = np.ascontiguousarray(matrix.astype(">u4")).view(f"V{4 * width}").ravel() if width else matrix
        order = np.argsort(view, kind="stable")
        rows, read, entry, slips = search(self.trie, matrix[order], lengths_cut[order], ends[order])
        rows = order[rows]
        tails: dict[tuple[int, int], bool] = {}
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, k, e, n_slips in zip(rows.tolist(), read.tolist(), entry.tolist(), slips.tolist()):
            if best.get((r, e), (9, 0)) <= (n_slips, -k):
                continue
            if k != lengths[r]:
                good = tails.get((r, k))
                if good is None:
                    cut_ = int(place[starts[r] + k - 1]) + 1
                    good = tails[r, k] = author_like("".join(map(chr, cps[cut_ : at[r + 1]].tolist())))
                if not good:
                    continue
            best[r, e] = (n_slips, -k)
        return sorted((r, n_slips, k, e) for (r, e), (n_slips, k) in best.items())

    def match(self, values: pa.Array) -> np.ndarray:
        """The entry that each value means, -1 if none: of several the first as entries_of() has them."""
        out = np.full(len(values), -1, np.int64)
        for r, _, _, e in reversed(self.entries_of(values)):
            out[r] = e
        return out


_matchers: dict[str, dict[str, Matcher]] = {}


def _cells(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field_no, kind, value) of all values that hold more than white space."""
    cell = lambda i, c: F.struct(F.lit(i).alias("field_no"), F.lit(fields[c]).alias("kind"), F.col(f"`{c}`").alias("value"))
    cells = df.select(F.col(f"`{key}`").alias("key"), F.inline(F.array(*[cell(i, c) for i, c in enumerate(fields)])))
    return cells.where(F.col("value").rlike(r"[^\s\p{Z}\x{85}\x{1C}-\x{1F}]"))


def _searched(cells: DataFrame, listed: list[tuple], words: tuple[str, ...], keep: list[str], every: bool) -> DataFrame:
    """(*keep, ref_id, slips, read) of each cell: the entry meant, or all entries within their slips; -1 if none.

    Cells that equal one of the listed entries to the letter are left out. A map over Arrow batches, in which each
    distinct value is searched once.
    """
    spark = cells.sparkSession
    held = spark.sparkContext.broadcast(listed)
    name = uuid.uuid4().hex

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _matchers:
            _matchers.clear()
            kinds = sorted({k for _, k, _ in held.value})
            _matchers[name] = {k: Matcher([(r, t) for r, kk, t in held.value if kk == k], k in words) for k in kinds}
        matchers, waiting = _matchers[name], []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            cell, ref, slips, read = [], [], [], []
            kinds = C.flat(t["kind"]).dictionary_encode()
            for number, kind in enumerate(kinds.dictionary.to_pylist()):
                mine = np.flatnonzero(np.asarray(kinds.indices) == number)
                coded = C.flat(t["value"]).take(pa.array(mine)).dictionary_encode()
                matcher, distinct = matchers.get(kind), coded.dictionary
                hits = np.array(matcher.entries_of(distinct) if matcher else [], np.int64).reshape(-1, 4)
                if not every:
                    hits = hits[np.concatenate([[True], hits[1:, 0] != hits[:-1, 0]])[: len(hits)]]
                n = np.bincount(hits[:, 0], minlength=len(distinct))
                none = np.flatnonzero(n == 0)
                hits = np.concatenate([hits, np.stack([none, none * 0, none * 0, none * 0 - 1], axis=1)])
                hits, n = hits[np.argsort(hits[:, 0], kind="stable")], np.maximum(n, 1)
                exact = np.fromiter((matcher is not None and x in matcher.exact for x in distinct.to_pylist()), bool, len(distinct))
                codes = np.asarray(coded.indices)
                codes, mine = codes[~exact[codes]], mine[~exact[codes]]
                at = C.spread((np.cumsum(n) - n)[codes], n[codes])
                cell.append(np.repeat(mine, n[codes])), ref.append(hits[at, 3]), slips.append(hits[at, 1]), read.append(-hits[at, 2])
            taken = t.select(keep).take(pa.array(np.concatenate(cell)))
            columns = [C.flat(c) for c in taken.columns] + [pa.array(np.concatenate(x)) for x in (ref, slips, read)]
            return pa.RecordBatch.from_arrays(columns, [*keep, "ref_id", "slips", "read"])

        n = 0
        for b in batches:
            waiting.append(b)
            n += b.num_rows
            if n >= BATCH:
                yield flush()
                n = 0
        if n:
            yield flush()

    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keep)
    return cells.mapInArrow(lead, f"{schema}, ref_id bigint, slips bigint, read bigint")


def _matched(df: DataFrame, key: str, fields: dict[str, str], reference: DataFrame, words: tuple[str, ...], every: bool) -> DataFrame:
    ship(df.sparkSession)
    cells = _cells(df, key, fields)
    entries = reference.where(F.col("kind").isin(*set(fields.values())) & F.col("canonical").isNotNull()).select("ref_id", "kind", "canonical").distinct()
    n = entries.count()
    if n <= PART_ENTRIES:
        found = _searched(cells, sorted(map(tuple, entries.collect())), words, ["key", "field_no"], every)
    else:
        # part after part of the list is searched for each distinct value; what is found is put beside the cells
        parts = math.ceil(1.3 * n / PART_ENTRIES)
        entries = cut(entries.withColumn("part", F.pmod(F.xxhash64("ref_id", "kind", "canonical"), F.lit(parts))))
        values = cells.groupBy("kind", "value").agg(F.count("*").alias("n"))
        values = cut(values.join(entries.select("kind", F.col("canonical").alias("value")).distinct(), ["kind", "value"], "left_anti"))
        hits = None
        for i in range(parts):
            listed = [tuple(r) for r in entries.where(F.col("part") == i).select("ref_id", "kind", "canonical").collect()]
            some = cut(_searched(values, sorted(listed), words, ["kind", "value"], every).where("ref_id >= 0"))
            hits = some if hits is None else hits.unionByName(some)
        hit = F.struct("slips", (-F.col("read")).alias("less"), "ref_id", "read")
        if every:
            hits = hits.groupBy("kind", "value", "ref_id").agg(F.min(hit).alias("hit"))
        else:
            hits = hits.groupBy("kind", "value").agg(F.min(hit).alias("hit"))
        led = values.join(hits.select("kind", "value", "hit"), ["kind", "value"], "left")
        led = led.select("kind", "value", "n", F.coalesce("hit.ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("hit.slips", F.lit(0)).alias("slips"))
        found = salted_join(cells, led, ["kind", "value"], "n", F.col("key"))
    names = F.array(*[F.lit(f) for f in fields])
    return found.select(F.col("key").alias(key), names[F.col("field_no")].alias("field_name"), "ref_id", "slips")


def canonical_matches(
    df: DataFrame, key: str, fields: dict[str, str], reference: DataFrame, words: tuple[str, ...] = ("species",)
) -> DataFrame:
    """(key, field_name, ref_id): the entry each typed value means, -1 if none.

    fields: kind of entry for each field. reference: ref_id, kind, canonical. Values that are NULL, hold only white
    space or equal an entry to the letter are left out; every other value of every row gives one row, repeated rows
    and keys included. Case, white space, punctuation and characters that only look different don't count. For kinds
    in `words` an author may follow, the first word may be cut to its first letter and two words may be exchanged.
    Of several entries the one with fewest slips is taken, then that with most letters read, then the smallest id;
    canonical_entries has them all. A kind without entries gives -1 for all its values. Only key and fields are read;
    extra columns don't matter. Entries must have ids from 0 on.

    Of a reference list of up to PART_ENTRIES entries a trie is held in every worker; a longer one is searched in as
    many parts as that takes, over the distinct values. The search is a map over Arrow batches without a shuffle, so hot
    values and keys have no weight; within a batch each distinct value is searched once.
    """
    return _matched(df, key, fields, reference, words, False).drop("slips")


def canonical_entries(
    df: DataFrame, key: str, fields: dict[str, str], reference: DataFrame, words: tuple[str, ...] = ("species",)
) -> DataFrame:
    """(key, field_name, ref_id, slips): all entries within their slips of each typed value, one row with -1 if none.

    A value that could mean several entries so shows them; edge cases as in canonical_matches.
    """
    return _matched(df, key, fields, reference, words, True)
