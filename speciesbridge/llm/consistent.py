"""One consistent form for text that looks the same but is written with other characters.

Arrow text is copied to code-point arrays; lookup tables expand each code point, look-alike letters are decided per
word by gathers and counts, and marks are composed in whole-array rounds. There is no string call per row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import codepoints as C

# Letters of other scripts with the Latin letters that they look like.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТУХІЅЈԚԜҮүһ", "aeopcyxisjhdqwvlABEKMHOPCTYXISJQWYyh"))
GREEK = dict(zip("ονυιαρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovuiapABEZHIKMNOPTYXcj"))
# Latin letters that only stand in for others.
LATIN = dict(zip("ɑɡıȷⅼ", "agijl"))
# Letters in which a Latin letter is read when it stands in a word of the other script.
TO_CYRILLIC = dict(zip("aeopcyxisjABEKMHOPCTYXISJ", "аеорсухіѕјАВЕКМНОРСТУХІЅЈ"))
TO_GREEK = dict(zip("ovuiapABEZHIKMNOPTYX", "ονυιαρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"))
# Greek letters that, alone, are symbols rather than stand-ins.
SYMBOLS = "ανιρυ"
# Invisible code points that are not of category Cf, and the visible ones that are.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180F]
INVISIBLE += [*range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
VISIBLE_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
#: Compatibility decompositions that are variants in width, style or as a ligature; fractions are not among them.
VARIANT = ("<wide>", "<narrow>", "<font>", "<compat>", "<super>", "<sub>", "<circle>", "<square>", "<vertical>", "<small>")
VARIANT += ("<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
TOP = 0x110000
LETTER, LATIN_SCRIPT, CYRILLIC_SCRIPT, GREEK_SCRIPT, MARK = 1, 2, 3, 4, 5


def _expansion(cp: int) -> list[int] | None:
    """What stands for this code point before words and marks are looked at; None is itself."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in _SPECIAL:
        return _SPECIAL[cp]
    if kind == "Cf":
        return []
    if kind == "Cc":
        return None if cp in (9, 10, 11, 12, 13, 0x85) or 0x1C <= cp <= 0x1E else []
    if kind == "Zs":
        return [0x20]
    way = unicodedata.decomposition(ch)
    if not way:
        return None
    if way[0] == "<":
        tag, *parts = way.split(" ")
        if kind[0] not in "LNP" or tag not in VARIANT:
            return None
    else:
        parts = way.split(" ")
    out = []
    for p in parts:
        inner = _expansion(int(p, 16))
        out += [int(p, 16)] if inner is None else inner
    return out


_SPECIAL: dict[int, list[int] | None] = {cp: [] for cp in INVISIBLE} | dict.fromkeys(VISIBLE_FORMAT)


@cache
def tables() -> dict[str, np.ndarray]:
    """Built once per worker from the Unicode data of the interpreter."""
    lengths, starts, data = np.ones(TOP, np.uint8), np.arange(TOP, dtype=np.int32), [np.arange(TOP, dtype=np.uint32)]
    ccc, script = np.zeros(TOP, np.uint8), np.zeros(TOP, np.uint8)
    at, pairs = TOP, {}
    hangul = range(0xAC00, 0xAC00 + 11172)
    for cp in range(TOP):
        if 0x3400 <= cp < 0xA000 or cp in hangul or 0x17000 <= cp < 0x1B000 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000:
            continue
        if 0xD800 <= cp < 0xF900 or cp >= 0xE1000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        ccc[cp] = unicodedata.combining(ch)
        if kind[0] == "M":
            script[cp] = MARK
        elif kind[0] == "L":
            name = unicodedata.name(ch, "")
            script[cp] = next((s for n, s in (("LATIN", LATIN_SCRIPT), ("CYRILLIC", CYRILLIC_SCRIPT), ("GREEK", GREEK_SCRIPT)) if name.startswith(n)), LETTER)
        way = unicodedata.decomposition(ch)
        if way and way[0] != "<" and " " in way and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in way.split(" "))
            pairs[a << 21 | b] = cp
        new = _expansion(cp)
        if new is not None:
            lengths[cp], starts[cp] = len(new), at
            data.append(np.array(new, np.uint32))
            at += len(new)
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x17000, 0x1B000), (0x20000, 0x2F800), (0x30000, 0x33480)):
        script[lo:hi] = LETTER
    for cp in hangul:
        s = cp - 0xAC00
        lv = 0xAC00 + s // 28 * 28
        pairs[lv << 21 | 0x11A7 + s % 28 if s % 28 else 0x1100 + s // 588 << 21 | 0x1161 + s % 588 // 28] = cp
    keys = np.array(sorted(pairs), np.int64)
    same = np.arange(TOP, dtype=np.uint32)

    def looks(pairs: dict[str, str]) -> np.ndarray:
        out = same.copy()
        for a, b in pairs.items():
            out[ord(a)] = ord(b)
        return out

    fixed = same.copy()
    for a, b in LATIN.items():
        fixed[ord(a)] = ord(b)
    plain = (lengths == 1) & (starts == np.arange(TOP)) & (ccc == 0) & (fixed == same)
    second = np.zeros(TOP, bool)
    second[keys & 0x1FFFFF] = True  # what composes with something before it
    plain &= ~second
    return {
        "len": lengths, "start": starts, "data": np.concatenate(data), "ccc": ccc, "script": script, "fixed": fixed, "second": second,
        "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32), "quiet": plain & (script < CYRILLIC_SCRIPT),
        "to_latin": looks(CYRILLIC | GREEK), "to_cyrillic": looks(TO_CYRILLIC), "to_greek": looks(TO_GREEK),
    }


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composition of a with b, 0 where there is none."""
    t = tables()
    key = a.astype(np.int64) << 21 | b
    at = np.searchsorted(t["keys"], key).clip(max=len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, t["made"][at], 0)


def _words(cps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Letters that stand in for look-alikes, put right word by word."""
    t = tables()
    cps = t["fixed"][cps]
    script = t["script"][cps]
    other = (script == CYRILLIC_SCRIPT) | (script == GREEK_SCRIPT)
    if not other.any():
        return cps
    inside = script > 0
    begins = inside & ~np.concatenate([[False], inside[:-1] & (row[1:] == row[:-1])])
    word = np.cumsum(begins)
    n = int(word[-1]) + 1

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word[mask & inside], minlength=n)

    latin, cyrillic, greek = (count(script == s) for s in (LATIN_SCRIPT, CYRILLIC_SCRIPT, GREEK_SCRIPT))
    to_latin, to_cyrillic, to_greek = t["to_latin"][cps], t["to_cyrillic"][cps], t["to_greek"][cps]
    only_other = count(other & (to_latin == cps))  # letters of other scripts without a Latin double
    is_latin = script == LATIN_SCRIPT
    not_cyrillic, not_greek = count(is_latin & (to_cyrillic == cps)), count(is_latin & (to_greek == cps))
    mixed = (latin > 0).astype(int) + (cyrillic > 0) + (greek > 0) > 1
    goal = np.where(cyrillic > latin + greek, CYRILLIC_SCRIPT, np.where(greek > latin + cyrillic, GREEK_SCRIPT, 0))
    goal = np.where(latin > cyrillic + greek, LATIN_SCRIPT, goal)  # without a majority nothing is changed
    goal = np.where((greek > 0) & (cyrillic == 0) & (not_greek == 0), GREEK_SCRIPT, goal)
    goal = np.where((cyrillic > 0) & (greek == 0) & (not_cyrillic == 0), CYRILLIC_SCRIPT, goal)
    goal = np.where((only_other == 0) & (latin + cyrillic + greek > 0), LATIN_SCRIPT, goal)
    # a word all of doubles stands for a Latin one where the rest of the row is Latin
    rows = int(row[-1]) + 1
    row_latin, row_other = np.bincount(row[is_latin], minlength=rows), np.bincount(row[other & (to_latin == cps)], minlength=rows)
    word_row = np.zeros(n, np.int64)
    word_row[word[begins]] = row[begins]
    symbol = count(np.isin(cps, [ord(c) for c in SYMBOLS]))
    letters = latin + cyrillic + greek
    alone = (latin == 0) & (letters > 0) & (only_other == 0) & (row_latin[word_row] > 0) & (row_other[word_row] == 0) & ~((letters == 1) & (symbol == 1))
    goal = np.where(mixed | alone, goal, 0)[word] * inside
    out = np.where(goal == LATIN_SCRIPT, to_latin, cps)
    out = np.where((goal == CYRILLIC_SCRIPT) & is_latin, to_cyrillic, out)
    return np.where((goal == GREEK_SCRIPT) & is_latin, to_greek, out)


def _compose(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of the rows that have something to compose; the others stay."""
    t = tables()
    has = np.zeros(int(row[-1]) + 1, bool)
    has[row[t["second"][cps] | (t["ccc"][cps] > 0)]] = True
    mine = np.flatnonzero(has[row])
    if not len(mine):
        return cps, row
    made, left = _composed(cps[mine], row[mine])
    cps, keep = cps.copy(), np.ones(len(cps), bool)
    cps[mine], keep[mine] = made, left
    return cps[keep], row[keep]


def _composed(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of the marks, then composition; the rows stay apart. (code points, which of them stay)."""
    t = tables()
    ccc = t["ccc"][cps].astype(np.int64)
    apart = np.concatenate([[True], row[1:] != row[:-1]])
    if ccc.any():
        run = np.cumsum((ccc == 0) | apart)
        order = np.argsort(run * 256 + ccc, kind="stable")
        cps, ccc = cps[order], ccc[order]  # rows and runs keep their places
    cps, keep = cps.copy(), np.ones(len(cps), bool)
    changed = True
    while changed:
        changed = False
        left = np.flatnonzero(keep)
        c, k, r = cps[left], ccc[left], row[left]
        start = np.maximum.accumulate(np.where(k == 0, np.arange(len(left)), -1))
        place = np.arange(len(left)) - start
        has = (start >= 0) & (k > 0)
        has[has] = r[start[has]] == r[np.flatnonzero(has)]
        held = np.zeros(len(left), np.int64)  # class of the last mark that stayed behind each starter
        for j in range(1, int(place[has].max()) + 1 if has.any() else 0):
            at = np.flatnonzero(has & (place == j))
            s = start[at]
            made = np.where(held[s] < k[at], _pair(c[s], c[at]), 0)
            ok = made > 0
            c[s[ok]] = made[ok]
            keep[left[at[ok]]] = False
            held[s[~ok]] = k[at[~ok]]
            changed |= bool(ok.any())
        cps[left] = c
        left = np.flatnonzero(keep)
        c, k, r = cps[left], ccc[left], row[left]
        both = np.flatnonzero(t["second"][c[1:]] & (k[1:] == 0) & (k[:-1] == 0) & (r[1:] == r[:-1])) if len(left) > 1 else np.zeros(0, int)
        if len(both):
            made = _pair(c[both], c[both + 1])
            both, made = both[made > 0], made[made > 0]
            if len(both):
                first = np.concatenate([[True], both[1:] != both[:-1] + 1])  # of a chain the first pair
                cps[left[both[first]]] = made[first]
                keep[left[both[first] + 1]] = False
                changed = True
    return cps, keep


def consistent(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, rows that changed) of the consistent form of each row."""
    t = tables()
    n = len(offsets) - 1
    known = cps < TOP
    loud = C.per_row((~t["quiet"][np.where(known, cps, 0)]).astype(np.int64), offsets) > 0
    rows = np.flatnonzero(loud)
    if not len(rows):
        return cps, offsets, np.zeros(n, bool)
    own, own_at = C.take(cps, offsets, rows)
    row = np.repeat(np.arange(len(rows)), own_at[1:] - own_at[:-1])
    width = t["len"][own].astype(np.int64)
    new, new_row = t["data"][C.spread(t["start"][own].astype(np.int64), width)], np.repeat(row, width)
    new, new_row = _compose(_words(new, new_row), new_row) if len(new) else (new, new_row)
    lengths = np.bincount(new_row, minlength=len(rows))
    new_at = np.concatenate([[0], np.cumsum(lengths)])
    differs = lengths != own_at[1:] - own_at[:-1]
    same = np.flatnonzero(~differs)
    a, at = C.take(own, own_at, same)
    differs[same] = C.per_row((a != C.take(new, new_at, same)[0]).astype(np.int64), at) > 0
    changed = np.zeros(n, bool)
    changed[rows] = differs
    all_lengths = offsets[1:] - offsets[:-1]
    all_lengths[rows] = lengths
    both = np.concatenate([cps, new])
    starts = offsets[:-1].copy()
    starts[rows] = len(cps) + new_at[:-1]
    return both[C.spread(starts, all_lengths)], np.concatenate([[0], np.cumsum(all_lengths)]), changed


def consistent_array(values: pa.Array) -> pa.Array:
    null = np.asarray(values.is_null()) if values.null_count else None
    cps, at, changed = consistent(*C.decode(values))
    return C.encode(cps, at, null) if changed.any() else values


def consistent_form(col: Column) -> Column:
    """The consistent form of a text column; NULL stays NULL and '' stays ''.

    Accented letters are composed; invisible characters are dropped; blanks become U+0020 (tabs and line ends stay);
    width, style and ligature variants of letters, digits and punctuation become the plain ones; in a word of mixed
    scripts, letters that only look like those of the word's script become them: of Latin if all others have a Latin
    double, else of the other script if all Latin letters have a double there, else of the majority. Words wholly in
    another script stay, unless all their letters have Latin doubles and everything else in the value is Latin.
    """

    @F.arrow_udf("string")
    def form(values: pa.Array) -> pa.Array:
        return consistent_array(C.flat(values))

    # else a filter on the form would be pushed below it and the form made twice
    return form.asNondeterministic()(col)


#: Printable ASCII, tabs and line ends are consistent as they are; such values need not leave the JVM.
IRREGULAR = r"[^\t\n\x0B\f\r -~]"


def irregular_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, value, consistent) of each value that differs from its consistent form.

    One row per field and row of df; NULL and '' never differ; repeated rows give repeated results; an empty df gives
    none, and other columns are not read. No shuffle.
    """
    ship(df.sparkSession)
    cells = df.select(
        F.col(f"`{key}`").alias("_key"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").alias("value")) for c in fields])),
    ).where(F.col("value").rlike(IRREGULAR))
    formed = cells.withColumn("consistent", consistent_form(F.col("value")))
    return formed.where(F.col("value") != F.col("consistent")).withColumnRenamed("_key", key)
