"""Long exact spans that records share, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, salted_join, ship
from . import codepoints as C

# Perfect difference sets by their modulus; every residue is the difference of two members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
#: Code points of the documents that are processed together, on average; a worker holds some 60 bytes for each.
BATCH_CHARS = 3_000_000
#: Hashes of a bucket on average, if every position of the cover gives one; a worker holds some 50 bytes for each.
BUCKET_HASHES = 600_000
#: Of code points one in so many is taken to start a span that may be shared; should all do, buckets are as much larger.
STARTS_SHARE = 4
#: Buckets that a batch sends to directly, and batches of a block; beyond, messages are sorted in more than one hop.
FAN = 256
#: Tasks of a stage are no more than this.
MOST_TASKS = 10_000
#: Code points compared at a time.
COMPARED = 4_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NONE = np.zeros(0, np.int64)


def cover_for(length: int) -> int:
    """The modulus used for spans of at least so many code points: a window of length - modulus + 1 is hashed."""
    return max((v for v in COVERS if v <= max(7, length * 0.46)), default=7)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Prefix sums of mixed code points times powers, from which any window's hash is one gather away."""

    def __init__(self, cps: np.ndarray) -> None:
        n = len(cps)
        size = 1 << max(10, n.bit_length())
        letters = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        letters ^= letters >> np.uint64(32)
        letters *= _powers(BASE, size)[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters, dtype=np.uint64)])
        self.inverse = _powers(INVERSE, size)

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        return _mix((self.sums[at + width] - self.sums[at]) * self.inverse[at])


class Batch:
    """The documents of one batch as one array of code points."""

    def __init__(self, table: pa.Table) -> None:
        # deterministic order, the same in each of the passes
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table
        self.ids = C.flat(table["id"])
        self.cps, self.at = C.decode(table["text"])
        code = np.asarray(self.ids.dictionary_encode().indices)
        lengths = self.at[1:] - self.at[:-1]
        self.doc = np.repeat(code, lengths)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(self.cps)) - np.repeat(self.at[:-1], lengths)
        self.left = np.repeat(self.at[1:], lengths) - np.arange(len(self.cps))

    def anchors(self, span: int) -> np.ndarray:
        """Positions in the cover whose window lies inside the document."""
        v = cover_for(span)
        in_cover = np.zeros(v, bool)
        in_cover[list(COVERS[v])] = True
        return np.flatnonzero(in_cover[self.place % v] & (self.left >= span - v + 1))

    def candidates(self, anchors: np.ndarray, span: int) -> np.ndarray:
        """Starts of spans whose first anchors, one modulus long, include one of these."""
        v = cover_for(span)
        near = np.zeros(len(self.cps) + 1, np.int32)
        np.add.at(near, np.maximum(anchors - v + 1, self.at[self.row[anchors]]), 1)
        np.add.at(near, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= span))


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, span: int) -> np.ndarray:
    """Whether the spans of a at a_at (ascending) and those of b at b_at are equal, code point for code point.

    Where both go on by one, a stretch is compared once for all its spans.
    """
    out = np.zeros(len(a_at), bool)
    if not len(a_at):
        return out
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a_at) != 1) | (np.diff(b_at) != 1)]))
    sizes = np.diff(np.append(new, len(a_at)))
    # stretches that are longer than is compared at a time are parted, so that memory is bounded
    parts = -(-sizes // COMPARED)
    begin = np.repeat(new, parts) + COMPARED * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sizes = np.diff(np.append(begin, len(a_at)))
    group = np.cumsum(sizes + span - 1) // COMPARED
    for lo, hi in zip(*(lambda e: (np.append(0, e), np.append(e, len(begin))))(np.flatnonzero(np.diff(group)) + 1)):
        s, n = begin[lo:hi], sizes[lo:hi]
        here = C.spread(a_at[s], n + span - 1)
        wrong = a[here] != b[C.spread(b_at[s], n + span - 1)]
        before = np.concatenate([[0], np.cumsum(wrong)])
        k = C.spread(np.cumsum(n + span - 1) - (n + span - 1), n)
        out[s[0] : s[-1] + n[-1]] = before[k + span] == before[k]
    return out


class Distinct:
    """Hashes of a batch, each once, with whether two documents of the batch have it."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        h, d = hashes[self.order], docs[self.order]
        self.new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        first = np.flatnonzero(self.new)
        self.group = np.cumsum(self.new) - 1
        self.hashes = h[first]
        self.first = self.order[first]  # the first of each, in the order given
        self.several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first) if len(h) else np.zeros(0, bool)

    def differing(self, cps: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
        """Of each hash, whether spans that have it differ: each is compared with the one before it."""
        out = np.zeros(len(self.hashes), bool)
        later = np.flatnonzero(~self.new)
        at, before, group = starts[self.order[later]], starts[self.order[later - 1]], self.group[later]
        by_place = np.argsort(at, kind="stable")
        out[group[by_place][~_equal(cps, at[by_place], cps, before[by_place], span)]] = True
        return out

    def back(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.order), bool)
        out[self.order] = flags[self.group]
        return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _squeeze(h: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the upper halves as differences in 16 bits if they fit, then the lower halves."""
    high, low = h >> np.uint64(32), h.astype(np.uint32)
    steps = np.diff(high, prepend=high[:1])
    fits = int(steps.max(initial=0)) < 1 << 16
    head = np.array([len(h), int(high[0]) if len(h) else 0, fits], np.uint64)
    return head.tobytes() + steps.astype(np.uint16 if fits else np.uint32).tobytes() + low.tobytes()


def _unsqueeze(data: bytes) -> np.ndarray:
    n, high, fits = np.frombuffer(data, np.uint64, 3).tolist()
    width = 2 if fits else 4
    steps = np.frombuffer(data, np.uint16 if fits else np.uint32, n, 24).astype(np.uint64)
    low = np.frombuffer(data, np.uint32, n, 24 + n * width)
    return (np.cumsum(steps, dtype=np.uint64) + np.uint64(high)) << np.uint64(32) | low


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """Numbers below 2^width in as many bits each."""
    return np.packbits((numbers[:, None] >> np.arange(width)).astype(np.uint8) & 1).tobytes()


def _unpacked(data: bytes, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width).astype(np.int64)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


#: Questions: hashes, whether several documents have each, and who of the sender has it last. Answers: how many, whether
#: several documents have each, and who had it before. Rows of buckets below 0 are a batch's own notes.
MESSAGE = "batch bigint, bucket bigint, a binary, b binary, c binary"


def _message(batch: list[int], bucket: list[int], a: list[bytes], b: list[bytes], c: list[bytes] | None = None) -> pa.Table:
    columns = [pa.array(batch, pa.int64()), pa.array(bucket, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.table([*columns, pa.array(c or [b""] * len(a), pa.binary())], ["batch", "bucket", "a", "b", "c"])


def _rows(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in ("batch", "bucket", "a", "b", "c"))))


def _asked(batch: int, hashes: np.ndarray, several: np.ndarray, buckets: int, last: np.ndarray | None = None, width: int = 0) -> pa.Table:
    """One row for each bucket into which some of the ascending hashes fall."""
    bounds = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1)) if buckets <= len(hashes) else None
    if bounds is None:  # fewer hashes than buckets
        own, first = np.unique(_bucket(hashes, buckets), return_index=True)
        full, parts = own.tolist(), [slice(i, j) for i, j in zip(first, np.append(first[1:], len(hashes)))]
    else:
        full = np.flatnonzero(np.diff(bounds)).tolist()
        parts = [slice(bounds[k], bounds[k + 1]) for k in full]
    c = None if last is None else [_packed(last[p], width) for p in parts]
    return _message([batch] * len(full), full, [_squeeze(hashes[p]) for p in parts], [_bits(several[p]) for p in parts], c)


class Asked:
    """The questions to one bucket, of some batches, sorted by hash and among equals by batch."""

    def __init__(self, rows: list[tuple], width: int) -> None:
        self.rows = rows
        parts = [_unsqueeze(r[2]) for r in rows]
        self.sizes = [len(p) for p in parts]
        h = np.concatenate(parts)
        who = [r[0] << width | (_unpacked(r[4], n, width) if width else np.zeros(n, np.int64)) for r, n in zip(rows, self.sizes)]
        self.order = np.argsort(h, kind="stable")
        self.h, self.who = h[self.order], np.concatenate(who)[self.order]
        several = np.concatenate([_unbits(r[3], n) for r, n in zip(rows, self.sizes)])[self.order]
        self.new = np.concatenate([[True], self.h[1:] != self.h[:-1]])
        self.first = np.flatnonzero(self.new)
        self.last = np.append(self.first[1:], len(self.h)) - 1
        self.shared = (self.last > self.first) | np.maximum.reduceat(several, self.first)
        self.before = np.where(self.new, -1, np.roll(self.who, 1))

    def answered(self, shared: np.ndarray, before: np.ndarray, chain: int) -> pa.Table:
        """The answers to all rows; before is left out where chain, the bits it may take, is 0."""
        flags, prior = np.zeros(len(self.h), bool), np.zeros(len(self.h), np.int64)
        flags[self.order] = shared[np.cumsum(self.new) - 1]
        prior[self.order] = before + 1
        ends = np.cumsum(self.sizes)
        parts = [slice(e - n, e) for e, n in zip(ends, self.sizes)]
        c = [_packed(prior[p][flags[p]], chain) if chain else b"" for p in parts]
        return _message([r[0] for r in self.rows], [r[1] for r in self.rows], [n.to_bytes(8, "little") for n in self.sizes], [_bits(flags[p]) for p in parts], c)


def _answered(rows: list[tuple], n: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether several documents have it, who had it before or -1) of all hashes of a sender, put together in order."""
    rows = [r for r in rows if r[1] >= 0]
    flags = [_unbits(r[3], int.from_bytes(r[2], "little")) for r in rows]
    before = []
    for r, f in zip(rows, flags):
        p = np.full(len(f), -1, np.int64)
        if chain:
            p[f] = _unpacked(r[4], int(f.sum()), chain) - 1
        before.append(p)
    if sum(map(len, flags)) != n:
        raise RuntimeError("a batch got other answers than it asked for")
    return (np.concatenate(flags), np.concatenate(before)) if flags else (np.zeros(0, bool), np.zeros(0, np.int64))


def _spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    return df.repartition(max(1, min(tasks, MOST_TASKS)), *keys)


def _hops(buckets: int) -> list[int]:
    """Buckets at each hop: FAN of the first and up to FAN times as many at each next one.

    The first hops are full, so that a block of FAN batches, FAN times as large at each hop, gives a bucket no more
    hashes than one batch has; only the last hop is as wide as the buckets need.
    """
    out = [min(buckets, FAN)]
    while out[-1] < buckets:
        out.append(out[-1] * min(FAN, -(-buckets // out[-1])))
    return out


def _judged(questions: DataFrame, batches: int, hops: list[int], chain: int, width: int = 0) -> DataFrame:
    """Answers to the questions of all batches; rows of buckets below 0 only pass.

    With more hops than one, a first task takes the questions of a block of FAN batches to one of few buckets, and asks
    about each of their hashes once, in the finer buckets of the next hop. So a message keeps some hundred hashes or
    more, however many batches there are, and a hash that all have is asked about once for each block.
    """

    def judge(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        asked = Asked(_rows(table), width)
        return asked.answered(asked.shared, asked.before, chain)

    if len(hops) == 1:
        return _spread(questions, 4 * hops[0], "bucket").groupBy("bucket").applyInArrow(judge, MESSAGE)
    bits = FAN.bit_length() - 1 + width
    blocks = questions.withColumn("block", F.shiftright("batch", bits - width))
    keyed = _spread(blocks, hops[0] * -(-batches // FAN), "block", "bucket").groupBy("block", "bucket")

    def ask_on(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.drop(["block"])
        asked = Asked(_rows(table), width)
        block = table["block"][0].as_py()
        return _asked(block, asked.h[asked.first], asked.shared, hops[1], asked.who[asked.last] & (1 << bits) - 1, bits)

    def answer(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _message([], [], [], [])
        if table["bucket"][0].as_py() < 0:
            return table.drop(["block"])
        asked = Asked(_rows(table), width)
        shared, before = _answered(_rows(answers), len(asked.first), chain)
        prior = asked.before.copy()
        prior[asked.first] = before
        return asked.answered(shared, prior, chain)

    upper = _judged(keyed.applyInArrow(ask_on, MESSAGE).where("bucket >= 0"), -(-batches // FAN), hops[1:], chain, bits)
    told = upper.withColumn("block", F.col("batch")).withColumn("fine", F.col("bucket"))
    ratio = hops[1] // hops[0]
    told = told.withColumn("bucket", F.floor(F.col("fine") / ratio)).select("block", "bucket", "batch", F.col("fine"), "a", "b", "c")
    told = _spread(told, hops[0] * -(-batches // FAN), "block", "bucket").groupBy("block", "bucket")
    return keyed.cogroup(told).applyInArrow(lambda t, u: answer(t, u.drop(["bucket"]).rename_columns(["block", "batch", "bucket", "a", "b", "c"])), MESSAGE)


def shared_spans(df: DataFrame, key: str, text: str, span: int = 200, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(key, span_start, span_end): each longest unbroken run of characters that lie in a span of at least `span` code
    points that occurs, code point for code point, under another key too.

    Offsets count code points from 0, span_end is after the last. Repeats under one key alone don't count. Rows with
    a NULL key, or a text that is NULL or shorter than span, share nothing; repeated rows of one key give their runs
    once per row; an empty table gives none; other columns are not read. span must be at least 20.

    Windows are hashed at the positions of a difference cover only: two copies of a span, however they lie, have one
    such position in common within its first period, so a span without an anchor that another key has is not
    shared. From anchors met twice, all spans they can belong to are extended to the full length. A hash only says
    what to compare: of the batches that have a span's hash, each sends the text to the one before it, in stretches,
    where it is compared code point by code point; inside a batch each span is compared with the one before it. So
    all that have a hash are known to be equal by as many comparisons, however many they are. Spans of a hash under
    which texts differ are grouped once more by their texts.

    Documents go in batches by a hash of the key; a batch asks about each hash once, which is what bounds a hot one: it
    costs a number and a text per batch, not per document, at another batch each, and no pairs are formed. Answers come
    back as bits in the order of the questions. Tasks follow the number of code points, which is counted first.
    """
    if span < 20:
        raise ValueError("spans below 20 code points are not supported")
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(
        F.col("id").isNotNull() & (F.length("text") >= span)
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, math.ceil(total / batch_chars))
    v = cover_for(span)
    width, chain = span - v + 1, (batches + 1).bit_length()
    few = min(12, math.ceil(total / 100_000))
    anchor_hops = _hops(max(few, math.ceil(total * len(COVERS[v]) / v / BUCKET_HASHES), 1))
    span_hops = _hops(max(few, math.ceil(total / STARTS_SHARE / BUCKET_HASHES), 1))
    docs = _spread(rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))), 2 * batches, "batch").groupBy("batch")
    kind = df.schema[key].dataType.simpleString()

    def own(rows_: list[tuple]) -> tuple:
        return next(r for r in rows_ if r[1] < 0)

    def spans_of(docs_: pa.Table, rows_: list[tuple]) -> tuple[Batch, np.ndarray, Distinct]:
        b = Batch(docs_)
        starts = np.flatnonzero(_unbits(own(rows_)[3], len(b.cps)))
        return b, starts, Distinct(Rolling(b.cps).windows(starts, span), b.doc[starts])

    def ask_anchors(table: pa.Table) -> pa.Table:
        b = Batch(table)
        at = b.anchors(span)
        d = Distinct(Rolling(b.cps).windows(at, width), b.doc[at])
        return _asked(table["batch"][0].as_py(), d.hashes, d.several, anchor_hops[0])

    def ask_spans(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return _message([], [], [], [])
        b, number = Batch(docs_), docs_["batch"][0].as_py()
        at, rolling = b.anchors(span), Rolling(b.cps)
        anchors = Distinct(rolling.windows(at, width), b.doc[at])
        met, _ = _answered(_rows(answers), len(anchors.hashes), 0)
        starts = b.candidates(at[anchors.back(met)], span)
        mask = np.zeros(len(b.cps), bool)
        mask[starts] = True
        spans = Distinct(rolling.windows(starts, span), b.doc[starts])
        note = _message([number], [-1 - number], [_bits(spans.differing(b.cps, starts, span))], [_bits(mask)])
        return pa.concat_tables([_asked(number, spans.hashes, spans.several, span_hops[0]), note])

    def send_text(docs_: pa.Table, known: pa.Table) -> pa.Table:
        """The spans of this batch, each once, to the batch that had their hash before."""
        if not docs_.num_rows:
            return _message([], [], [], [])
        number, rows_ = docs_["batch"][0].as_py(), _rows(known)
        b, starts, spans = spans_of(docs_, rows_)
        _, before = _answered(rows_, len(spans.hashes), chain)
        out = []
        for to, at in _by_receiver(starts[spans.first], before):
            new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            sizes = np.diff(np.append(new, len(at)))
            sent = b.cps[C.spread(at[new], sizes + span - 1)].astype("<u4").tobytes().decode("utf-32-le").encode()
            out.append((to, number, sizes.astype(np.int32).tobytes(), sent))
        return _message(*map(list, zip(*out))) if out else _message([], [], [], [])

    def compare(docs_: pa.Table, known: pa.Table) -> pa.Table:
        """Which of the spans received are equal to this batch's with the same hash; for this batch, which of its own."""
        if not docs_.num_rows:
            return _message([], [], [], [])
        number, rows_ = docs_["batch"][0].as_py(), _rows(known)
        texts = [r for r in rows_ if r[4] == b"text"]
        b, starts, spans = spans_of(docs_, [r for r in rows_ if r[4] != b"text"])
        equal, odd, out = np.zeros(len(spans.hashes), bool), [], []
        for _, sender, sizes, sent, _ in texts:
            sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
            cps = np.frombuffer(sent.decode().encode("utf-32-le"), np.uint32)
            at = C.spread(np.cumsum(sizes + span - 1) - (sizes + span - 1), sizes)
            hashes = Rolling(cps).windows(at, span)
            k = np.searchsorted(spans.hashes, hashes)
            good = _equal(cps, at, b.cps, starts[spans.first[k]], span)
            equal[k[good]] = True
            odd.append(hashes[~good])
            out.append((number, sender, b"", _bits(good)))
        odd.append(spans.hashes[_unbits(own(rows_)[2], len(spans.hashes))])
        differing = np.unique(np.concatenate(odd))
        answers = [(sender, number, b"", good) for _, sender, _, good in out] + [(number, -1, b"", _bits(equal))]
        told = _message(*map(list, zip(*answers)))
        return pa.concat_tables([told, _asked(-1, differing, np.zeros(len(differing), bool), span_hops[0])]) if len(differing) else told

    def join_spans(docs_: pa.Table, known: pa.Table) -> pa.Table:
        """The runs of spans known to be shared, and with their texts the spans whose hash is one of several texts."""
        if not docs_.num_rows:
            return _found(docs_["id"].type)
        number, rows_ = docs_["batch"][0].as_py(), _rows(known)
        kinds = {k: [r for r in rows_ if r[4] == k] for k in (b"verdict", b"odd")}
        rest = [r for r in rows_ if r[4] not in kinds]
        b, starts, spans = spans_of(docs_, rest)
        _, before = _answered(rest, len(spans.hashes), chain)
        local = spans.several & ~_unbits(own(rest)[2], len(spans.hashes))
        verdicts = {r[1]: r[3] for r in kinds[b"verdict"]}
        shared = local | _unbits(verdicts[-1], len(spans.hashes))
        place = np.full(len(b.cps) + 1, -1, np.int64)
        place[starts[spans.first]] = np.arange(len(spans.hashes))
        for to, at in _by_receiver(starts[spans.first], before):
            shared[place[at]] |= _unbits(verdicts[to], len(at))
        odd = np.concatenate([_unbits(r[3], int.from_bytes(r[2], "little")) for r in kinds[b"odd"]]) if kinds[b"odd"] else np.zeros(len(spans.hashes), bool)
        return _found(b.ids.type, b, starts[spans.back(shared & ~odd)], starts[spans.back(odd)])

    def _found(kind_: pa.DataType, b: Batch | None = None, sure: np.ndarray = NONE, odd: np.ndarray = NONE) -> pa.Table:
        apart = np.flatnonzero((np.diff(sure) > span) | (np.diff(b.row[sure]) > 0)) if b else NONE
        first, last = np.append(sure[:1], sure[apart + 1]), np.append(sure[apart], sure[-1:])
        at, size = np.append(first, odd), np.append(last - first, np.zeros(len(odd), np.int64)) + span
        row, place = (b.row[at], b.place[at]) if b else (NONE, NONE)
        ids = b.ids.take(pa.array(row)) if b else pa.array([], kind_)
        texts = [None] * len(first) + [b.cps[i : i + span].astype("<u4").tobytes().decode("utf-32-le") for i in odd.tolist()]
        return pa.table([ids, pa.array(row), pa.array(place), pa.array(place + size), pa.array(texts, pa.string())], ["id", "row", "s", "e", "span"])

    def together(*parts: DataFrame):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return docs.cogroup(_spread(out, 2 * batches, "batch").groupBy("batch"))

    marked = lambda df_, mark: df_.withColumn("c", F.lit(mark).cast("binary"))
    # a table of bits: with it the shuffles of all hops about anchors go before those about spans are written
    anchors = cut(_judged(docs.applyInArrow(ask_anchors, MESSAGE), batches, anchor_hops, 0))
    questions = together(anchors).applyInArrow(ask_spans, MESSAGE)
    known = cut(_judged(questions, batches, span_hops, chain))
    texts = marked(together(known).applyInArrow(send_text, MESSAGE), "text")
    verdicts = cut(together(known, texts).applyInArrow(compare, MESSAGE))
    parts = [known, marked(verdicts.where("batch >= 0"), "verdict")]
    odd = verdicts.where("batch < 0")
    if not odd.isEmpty():
        parts.append(marked(_marked(questions.where("bucket >= 0").unionByName(odd), span_hops), "odd"))
    found = together(*parts).applyInArrow(join_spans, f"id {kind}, row bigint, s bigint, e bigint, span string")
    if len(parts) > 2:
        found = _joined(cut(found))
    return found.select(F.col("id").alias(key), F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def _by_receiver(starts: np.ndarray, before: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(batch, starts in ascending order) of each batch that had a hash before."""
    mine = np.flatnonzero(before >= 0)
    order = mine[np.lexsort((starts[mine], before[mine]))]
    to, first = np.unique(before[order], return_index=True)
    return [(t, starts[order[i:j]]) for t, i, j in zip(to.tolist(), first, np.append(first[1:], len(order)))]


def _marked(questions: DataFrame, hops: list[int]) -> DataFrame:
    """Of the questions of each batch, which are about a hash that sender -1 names too."""

    def mark(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        odd = np.concatenate([_unsqueeze(r[2]) for r in rows if r[0] < 0] or [np.zeros(0, np.uint64)])
        rest = [r for r in rows if r[0] >= 0]
        flags = [np.isin(_unsqueeze(r[2]), odd) for r in rest]
        return _message([r[0] for r in rest], [r[1] for r in rest], [len(f).to_bytes(8, "little") for f in flags], [_bits(f) for f in flags])

    return _spread(questions, 4 * hops[0], "bucket").groupBy("bucket").applyInArrow(mark, MESSAGE)


def _joined(found: DataFrame) -> DataFrame:
    """The runs of each row, made of those known and of the single spans whose very text another key has too."""
    single = found.where("span is not null")
    texts = single.groupBy("span").agg(F.min("id").alias("_least"), F.max("id").alias("_most"), F.count("*").alias("n")).where("_least <> _most")
    shared = salted_join(single, texts.select("span", "n"), ["span"], "n", F.col("s"))
    runs = found.where("span is null").select("id", "row", "s", "e").unionByName(shared.select("id", "row", "s", "e"))
    w = Window.partitionBy("id", "row").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("_new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy("id", "row", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def shared_share(df: DataFrame, key: str, text: str, span: int = 200) -> DataFrame:
    """(key, n_chars, n_shared, n_runs) of every row with a key: how much of it is shared elsewhere; edge cases as above."""
    runs = shared_spans(df, key, text, span).groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"), F.count("*").alias("n_runs")
    )
    sizes = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.sum(F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("bigint")).alias("n_chars"))
    return sizes.join(runs, sizes[f"`{key}`"] == runs["_key"], "left").drop("_key").fillna(0, ["n_shared", "n_runs"])
