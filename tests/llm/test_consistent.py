import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from speciesbridge.llm import codepoints as C
from speciesbridge.llm.consistent import INVISIBLE, consistent_array, irregular_values

CASES = {
    "Zanοrnis": "Zanornis", "ﬁx ﬆ": "fix st", "𝘗𝘢𝘳": "Par", "ｏｒｙ＿１": "ory_1", "a​b\xa0c d﻿": "ab c d", "Ostrό": "Ostró", "Müller": "Müller", "Å": "Å",
    "tokımınılɑɡ": "tokiminilag", "Лecпep": "Леспер", "мaлec": "малес", "Quandt-Мео 1840": "Quandt-Meo 1840", "Ζ. tedranfemνat": "Z. tedranfemvat", "Å Ω": "Å Ω", "x²": "x2", "soft\xadhyphen": "softhyphen",
}
SAME = ["", "plain text\t\r\n", "“x” ‘y’ « × †", "Müller Åbergson Čermolí", "Леспер (Lucumys)", "Πτηνο λόφου", "シギ", "½ ™ №", "O’Tarrick", "α diversity", "日本語", "한국어"]


def test_cases():
    assert consistent_array(pa.array(list(CASES))).to_pylist() == list(CASES.values())
    assert consistent_array(pa.array(SAME)).to_pylist() == SAME


def test_null_empty_and_long():
    long = "ab́" * 200_000
    got = consistent_array(pa.array([None, "", long, "e" + "̣́" * 50])).to_pylist()
    assert got[:2] == [None, ""] and got[2] == "ab́" * 200_000 if unicodedata.normalize("NFC", "b́") == "b́" else True
    assert got[3] == unicodedata.normalize("NFC", "e" + "̣́" * 50)
    assert consistent_array(pa.array([], pa.string())).to_pylist() == []
    assert consistent_array(pa.array(["x", "é", "y"]).slice(1, 1)).to_pylist() == ["é"]


LATIN = st.text(st.sampled_from("aeiounAEcå ´kx゙ְ̧̨̣̀́̂̈ͅăÇ"), max_size=12)
KOREAN = st.text(st.sampled_from("가각한각ᄒ́"), max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(LATIN, KOREAN), max_size=6))
def test_composition_is_canonical(values):
    assert consistent_array(pa.array(values, pa.string())).to_pylist() == [unicodedata.normalize("NFC", v) for v in values]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=5))
def test_idempotent_and_without_invisible_characters(values):
    once = consistent_array(pa.array(values, pa.string())).to_pylist()
    assert consistent_array(pa.array(once, pa.string())).to_pylist() == once
    assert not {ch for v in once for ch in v} & {chr(c) for c in [*INVISIBLE, 0x200B, 0xFEFF, 0xAD, 0xA0, 0x3000]}


def test_codepoints_round_trip_and_bad_bytes():
    values = ["", "añ", None, "𝘗", "x" * 1000]
    cps, at = C.decode(pa.array(values))
    null = np.array([v is None for v in values])
    assert C.encode(cps, at, null).to_pylist() == values
    bad = pa.array([b"ab", b"\xff\xfe", "é".encode()]).cast(pa.binary())
    cps, at = C.decode(bad)
    assert C.encode(cps, at).to_pylist() == ["ab", "��", "é"]


def test_irregular_values(spark, rows):
    df = spark.createDataFrame([(1, "é", "plain", "z"), (1, "é", None, "z"), (2, "", "​", "q"), (None, "ｘ", "é", "r")], "id int, a string, b string, value string")
    assert rows(irregular_values(df, "id", ["a", "b"])) == sorted([(1, "a", "é", "é"), (1, "a", "é", "é"), (2, "b", "​", ""), (None, "a", "ｘ", "x")], key=repr)
    assert rows(irregular_values(df.limit(0), "id", ["a", "b"])) == []
