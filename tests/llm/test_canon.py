import random
import time

import numpy as np
import pyarrow as pa
import pytest

from speciesbridge.llm import canon as K

ENTRIES = [(1, "species", "Histidra sinsekbudbig"), (2, "species", "Zanibates badgodpulpun"), (3, "species", "Parvastur dudpetsutbab"), (4, "species", "Parvidra ralpiggibmub"), (9, "match_type", "exact"), (10, "match_type", "override_unused")]


def osa(a, b):
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            if before and j > 1 and c == b[j - 2] and a[i - 2] == d:
                new[-1] = min(new[-1], before[j - 2] + 1)
        before, row = row, new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_search_by_brute_force(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = sorted({word(rng.randint(3, 9)) for _ in range(25)})
    matcher = K.Matcher(list(enumerate(entries)), False)
    values = sorted({word(rng.randint(0, 11)) for _ in range(300)} | set(entries))
    got = matcher.match(pa.array(values))
    for v, g in zip(values, got.tolist()):
        allowed = [(osa(v, e), i) for i, e in enumerate(entries) if osa(v, e) <= K.slips_allowed(len(e))]
        if not v:
            assert g == -1
        elif not allowed:
            assert g == -1, (v, entries[g])
        else:
            assert osa(v, entries[g]) == min(allowed)[0], (v, entries[g])


MEANT = {
    "histidra SINSEKBUDBIG": 1, "H. sinsekbudbig": 1, "Hsitidra sinsekbudbg": 1, "sinsekbudbig, Histidra": 1, "Histidrasinsekbudbig": 1, "\tHistidra--sinsekbudbig.": 1, "Histidra sinsekbudbig (Åbergson, 1866)": 1,
    "Histidra sinsekbudbig de Varnhal & O’Tarrick 1901": 1, "histidra sinsekbudbig dramondt, 1929": 1, "PARVIDRA-RALPIGGIBMUB DRAMONDT, 1857": 4, "Hіstіdrа sinsek​budbig": 1, "Z_badgodpulpun": 2,
    "Zanibates_badgodpulpunÅbergson 1993": 2, "dudpetsutbab Parvashtur": 3, "Histidra sinsekbxxxig": -1, "Velophex buselonirunus": -1, "Histidra": -1, "Histidra sinsekbudbig subsp. minor": -1, "--": -1, "Лесперк": -1,
    "Parvidra sinsekbudbig": -1,
}


AUTHORS = {
    "": True, " - . ": True, " (Wrexling, 1785)   Tavšekin": True, "--wrexling, . 1978": True, ",HALLOWDEN . 1888": True, " - (o’tarrick, 1775)": True, "--Lindqvær .  &  Brönnicke, 1816": True,
    "o’tarrick, . 1834": True, " L. f. 1753": True, " Smith 1857b": True, " subsp. minor": False, " 1834": False, " Smith 12": False, " Smith 1834 1835": False, " a b c d e f g h i": False, " A 1800 B 1801 C": False,
}


def test_meant_and_not_meant():
    matcher = K.Matcher([(r, t) for r, k, t in ENTRIES if k == "species"], True)
    assert dict(zip(MEANT, matcher.match(pa.array(list(MEANT))).tolist())) == MEANT


def test_rows(spark, rows):
    schema = "map_id bigint, name_x string, match_type string, field_name string"
    df = spark.createDataFrame([(1, "H. sinsekbudbig", "exat", ""), (1, "Histidra sinsekbudbig", "exact", ""), (2, None, " \t ", ""), (None, "​", "overide used", ""), (3, "x" * 100_000, "TBD", ""), (3, "", "Override-Unused", "")], schema)
    ref = spark.createDataFrame(ENTRIES + [(7, "species", None)], "ref_id bigint, kind string, canonical string")
    got = K.canonical_matches(df, "map_id", {"name_x": "species", "match_type": "match_type"}, ref)
    assert rows(got) == sorted([(1, "name_x", 1), (1, "match_type", 9), (None, "name_x", -1), (None, "match_type", -1), (3, "name_x", -1), (3, "match_type", -1), (3, "match_type", 10)], key=repr)
    assert rows(K.canonical_matches(df.limit(0), "map_id", {"name_x": "species"}, ref)) == []
    none = K.canonical_matches(df, "map_id", {"name_x": "nothing"}, ref)
    assert {r["ref_id"] for r in none.collect()} == {-1}


@pytest.mark.parametrize("every", [False, True])
def test_a_long_list_is_searched_in_parts(spark, rows, monkeypatch, every):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    ref = spark.createDataFrame([(i, "species", f"{word(5).title()} {word(6)}") for i in range(60)] * 2, "ref_id bigint, kind string, canonical string")
    some = [r["canonical"] for r in ref.limit(20).collect()]
    df = spark.createDataFrame([(i % 9, rng.choice([*some, word(11), some[0][0] + ". " + some[0][6:]])[: rng.randint(0, 13)], None) for i in range(200)], "id bigint, a string, b string")
    search = K.canonical_entries if every else K.canonical_matches
    whole = rows(search(df, "id", {"a": "species", "b": "species"}, ref))
    monkeypatch.setattr(K, "PART_ENTRIES", 25)
    monkeypatch.setattr("speciesbridge.runtime.HOT_ROWS", 5)
    assert rows(search(df, "id", {"a": "species", "b": "species"}, ref)) == whole
    assert len(whole) > 150


def test_all_entries_are_found():
    matcher = K.Matcher([(1, "Histidra minorbad"), (2, "Holabus minorbad"), (3, "Histidra minorbat"), (4, "Far away")], True)
    found = matcher.entries_of(pa.array(["H. minorbad", "Histidra minorbad", "nothing"]))
    assert [(r, s, e) for r, s, _, e in found] == [(0, 0, 1), (0, 0, 2), (0, 1, 3), (1, 0, 1), (1, 1, 3)]
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    entries = [(i, word(rng.randint(3, 8))) for i in range(60)]
    values = sorted({word(rng.randint(1, 9)) for _ in range(200)})
    got = K.Matcher(entries, False).entries_of(pa.array(values))
    want = sorted((i, osa(v, e), -len(v), r) for i, v in enumerate(values) for r, e in entries if osa(v, e) <= K.slips_allowed(len(e)))
    assert got == want


def test_authors_are_read_once():
    for rest, good in AUTHORS.items():
        assert K.author_like(rest) == good, rest
    for tail in (" A" + "b" * 10_000 + " 9y", " Ab" * 10_000, "-" * 10_000 + "9", " A.b" * 5000 + "!"):
        began = time.perf_counter()
        K.author_like(tail)
        assert time.perf_counter() - began < 0.1


def test_trie_is_small():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(n))
    entries = [(i, f"{word(8).title()} {word(12)}") for i in range(5000)]
    matcher = K.Matcher(entries, True)
    assert matcher.trie.nbytes < 2500 * len(entries)
    assert matcher.match(pa.array([t.upper() for _, t in entries])).tolist() == list(range(5000))
    assert matcher.match(pa.array([word(21) for _ in range(500)])).tolist() == [-1] * 500


def test_states_of_a_large_trie_stay_apart():
    far = 1 << 21
    prefix, node, owed, slips = (np.array(x) for x in ([0, 1, 1], [far, 0, 0], [0, 0, 0], [0, 1, 0]))
    found = K._least(prefix, node, owed, slips)
    assert sorted(zip(*(x.tolist() for x in found))) == [(0, far, 0, 0), (1, 0, 0, 0)]
