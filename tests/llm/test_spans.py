import random

import numpy as np
import pytest

from speciesbridge.llm import spans as S

SCHEMA = "doc_id string, text string, span_start bigint"


def brute(docs, n):
    seen = {}
    for k, t in docs:
        if k is not None and t is not None:
            for i in range(len(t) - n + 1):
                seen.setdefault(t[i : i + n], set()).add(k)
    out = []
    for k, t in docs:
        if k is None or t is None:
            continue
        mark = [False] * len(t)
        for i in range(len(t) - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                mark[i : i + n] = [True] * n
        start = None
        for i, m in enumerate([*mark, False]):
            if m and start is None:
                start = i
            elif not m and start is not None:
                out.append((k, start, i))
                start = None
    return sorted(out, key=repr)


def make(seed, span):
    rng = random.Random(seed)
    letters = "abcdé𝘗\n "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.randint(span - 2, 3 * span)) for _ in range(6)] + ["ab" * span, "z" * (2 * span)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            cut = rng.randint(0, len(p) // 3)
            parts += [text(rng.randint(0, 30)), p[cut:] if rng.random() < 0.5 else p]
        docs.append((rng.choice([f"d{i}", f"d{i}", "d0", None]), "".join(parts)))
    return docs + [("e", ""), ("n", None), ("s", "q" * (span - 1)), ("l", pool[0] * 30), *docs[:3]]


@pytest.mark.parametrize("seed,span,batch", [(1, 20, 3_000_000), (2, 33, 700), (3, 60, 300), (4, 200, 2000)])
def test_spans_by_brute_force(spark, rows, seed, span, batch):
    docs = make(seed, span)
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], SCHEMA)
    assert rows(S.shared_spans(df, "doc_id", "text", span, batch)) == brute(docs, span)


def test_hot_copies(spark, rows):
    rng = random.Random(5)
    hot = "".join(rng.choice("abcdefgh") for _ in range(300))
    docs = [(f"d{i}", hot if i % 3 == 0 else "".join(rng.choice("abcdefgh") for _ in range(250))) for i in range(90)]
    got = rows(S.shared_spans(spark.createDataFrame([(k, t, 0) for k, t in docs], SCHEMA), "doc_id", "text", 200, 1000))
    assert got == sorted(((k, 0, 300) for k, t in docs if t is hot), key=repr)


def test_nothing_shared(spark, rows):
    assert rows(S.shared_spans(spark.createDataFrame([], SCHEMA), "doc_id", "text")) == []
    one = spark.createDataFrame([("a", "xy" * 300, 0), ("a", "xy" * 300, 0), (None, "xy" * 300, 0)], SCHEMA)
    assert rows(S.shared_spans(one, "doc_id", "text")) == []
    with pytest.raises(ValueError):
        S.shared_spans(one, "doc_id", "text", 10)


def test_share(spark, rows):
    df = spark.createDataFrame([("a", "p" + "q" * 250, 0), ("b", "q" * 250 + "r", 0), ("c", None, 0), ("d", "", 0), (None, "q" * 250, 0)], SCHEMA)
    assert rows(S.shared_share(df, "doc_id", "text")) == [("a", 251, 250, 1), ("b", 251, 250, 1), ("c", 0, 0, 0), ("d", 0, 0, 0)]


def test_covers_are_difference_covers():
    for v, cover in S.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("seed", range(3))
def test_squeezing_loses_nothing(seed):
    h = np.sort(np.random.default_rng(seed).integers(0, 2**64, [0, 1, 5000][seed], dtype=np.uint64))
    assert (S._unsqueeze(S._squeeze(h)) == h).all()


def thue_morse(a, b, n=128):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_texts_of_one_hash_are_told_apart(spark, rows):
    # polynomials modulo 2^64 can't tell these two texts apart, which differ at 128 positions
    a, b = "\U00012542", "\U0001f4b2"
    head, tail = "".join(chr(97 + i % 26) for i in range(56)), "the end of both."
    one, two = head + thue_morse(a, b) + tail, head + thue_morse(b, a) + tail
    assert len(one) == 200
    rolling = [S.Rolling(np.array([ord(c) for c in t], np.uint32)).windows(np.zeros(1, np.int64), 200) for t in (one, two)]
    assert rolling[0] == rolling[1]
    for batch in (3_000_000, 300):
        run = lambda docs: rows(S.shared_spans(spark.createDataFrame([(k, t, 0) for k, t in docs], SCHEMA), "doc_id", "text", 200, batch))  # noqa: B023, E731
        assert run([("x", one), ("y", two)]) == []
        docs = [("x", one), ("y", "+" + two + "?"), ("z", "--" + one + "!"), ("w", one[:150]), ("v", two * 2)]
        assert run(docs) == brute(docs, 200)


@pytest.mark.parametrize("fan", [2, 4])
def test_questions_in_several_hops(spark, rows, monkeypatch, fan):
    monkeypatch.setattr(S, "FAN", fan)
    monkeypatch.setattr(S, "BUCKET_HASHES", 150)
    docs = make(7, 30)
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], SCHEMA)
    assert len(S._hops(11)) > 1
    assert rows(S.shared_spans(df, "doc_id", "text", 30, 900)) == brute(docs, 30)


def test_equal_compares_stretches(monkeypatch):
    monkeypatch.setattr(S, "COMPARED", 7)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    b[40:120] = a[30:110]
    at = np.concatenate([np.arange(5, 150), rng.integers(0, 190, 60)])
    to = np.concatenate([np.arange(15, 160), rng.integers(0, 190, 60)])
    assert (S._equal(a, at, b, to, 5) == [(a[i : i + 5] == b[j : j + 5]).all() for i, j in zip(at, to)]).all()


@pytest.mark.parametrize("total", [1_300_000_000, 1_500_000_000, 5_700_000_000, 50_000_000_000, 900_000_000_000])
def test_no_hop_gives_a_task_more_hashes_than_a_batch_has(total):
    per_batch = S.BATCH_CHARS * len(S.COVERS[91]) / 91
    hops = S._hops(-(-int(total * len(S.COVERS[91]) / 91) // S.BUCKET_HASHES))
    for i, buckets in enumerate(hops[:-1]):
        block = min(S.FAN ** (i + 1), -(-total // S.BATCH_CHARS))
        assert block * per_batch / buckets <= 1.01 * per_batch
        assert hops[i + 1] % buckets == 0 and hops[i + 1] // buckets <= S.FAN
    assert total * len(S.COVERS[91]) / 91 / hops[-1] <= S.BUCKET_HASHES
