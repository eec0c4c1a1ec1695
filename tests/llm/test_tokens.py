import base64
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speciesbridge.llm import tokens as T

PATH = os.path.join(T.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
ODD = ["", "<|endoftext|>", "a" * 3000, " " * 2000 + "x", "\r\n\n \t ", "é中🙂‍", "don't we'll I'VE", "x²½ ⅷ", "\x00\x01", "ab" * 1500]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(values):
    ids, at = T.vocabulary(PATH).encode(pa.array(values, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_odd_texts(reference):
    assert encode(ODD + [None]) == [reference.encode_ordinary(t) for t in ODD] + [[]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_round_trips(values):
    words = {i: w for w, i in T.vocabulary(PATH).ranks.items()}
    for v, ids in zip(values, encode(values)):
        assert b"".join(words[i] for i in ids).decode() == v


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_heap_merges_as_one_by_one(word):
    ranks = T.vocabulary(PATH).ranks
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert T.vocabulary(PATH).merge(word) == [ranks[p] for p in parts]


def test_perfect_hash_is_minimal_and_exact():
    h = T.vocabulary(PATH).hash
    assert sorted(h.key_of.tolist()) == list(range(h.n))
    keys = [b"the", b" the", b"nokey-nokey", b""]
    raw, at = T.C.utf8(pa.array(keys, pa.binary()))
    found = h.find(raw, at).tolist()
    assert found[0] >= 0 and found[1] >= 0 and found[2:] == [-1, -1]


def test_column(spark, reference):
    df = spark.createDataFrame([(1, "The bird", "x"), (1, None, "x"), (None, "", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_corpus(df.where("text is not null"), "doc_id", "text").collect()}
    assert got == {1: reference.encode_ordinary("The bird"), None: []}
    assert T.encode_corpus(df, "doc_id", "text").count() == 3 and T.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
