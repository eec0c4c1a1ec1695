"""Names that are spelled alike: blocking by first words within two edits, then weighted similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import GENUS_EDITS, WORD_WEIGHTS, normalise, part_similarity, word
from ..functions.relational import first_rows
from ..runtime import cut, ship


def binomials(df: DataFrame, rank: str) -> DataFrame:
    """df (name, pos, norm) with genus and epithet; names of one word are left out."""
    if "norm" not in df.columns:
        df = df.withColumn("norm", normalise(F.col("name"), rank))
    return df.withColumn("genus", word(F.col("norm"), 0)).withColumn("epithet", word(F.col("norm"), 1)).where("epithet is not null")


def _deletions(col: Column) -> Column:
    """The word with up to GENUS_EDITS letters left out, each variant once."""
    once = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
        lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
    )
    variants = F.array(col)
    for _ in range(GENUS_EDITS):
        variants = F.array_distinct(F.concat(variants, F.flatten(F.transform(variants, once))))
    return variants


def genus_pairs(gx: DataFrame, gy: DataFrame) -> DataFrame:
    """(genus_x, genus_y) within GENUS_EDITS edits, of two tables of distinct genera.

    Two words are that near only if they become one when at most as many letters are left out of each, so an equi-join
    on such variants finds all of them; edit distance confirms. There is no nested loop over all pairs.
    """
    a = gx.select(F.col("genus").alias("genus_x"), F.explode(_deletions(F.col("genus"))).alias("v"))
    b = gy.select(F.col("genus").alias("genus_y"), F.explode(_deletions(F.col("genus"))).alias("v"))
    near = F.levenshtein("genus_x", "genus_y", GENUS_EDITS)
    return a.join(b, "v").where((near >= 0) & (near <= GENUS_EDITS)).select("genus_x", "genus_y").distinct()


def _near(bx: DataFrame, by: DataFrame, threshold: float) -> DataFrame:
    """(genus_x, genus_y, g_sim): genera whose names may reach the threshold."""
    near = genus_pairs(bx.select("genus").distinct(), by.select("genus").distinct()).withColumn("g_sim", part_similarity(F.col("genus_x"), F.col("genus_y")))
    return near.where(WORD_WEIGHTS[0] * F.col("g_sim") + WORD_WEIGHTS[1] >= threshold - 1e-9)


#: So many rows of some 150 bytes may be broadcast, 30 MB in all.
MOST_SENT = 200_000
#: Genera with more names than this in y are blocked by parts of the second words, where the threshold allows it.
HOT_GENUS = 5_000
#: Share of a second word that must be right for that; below it, parts are too short to tell words apart.
LEAST_RIGHT = 0.5


def _parts(word_: str, right: float) -> str:
    """SQL: of a word of y, for each number k of edits that may occur, its k + 1 parts as structs (m, k, i, part).

    Whatever k edits do to a word, one of its k + 1 parts stays as it is and moves by at most k letters.
    """
    m = f"length({word_})"
    k0, k1 = (f"cast(floor({1 - right} * {m} / {d} + 1e-6) as int)" for d in ("1", right))
    base, long_from = f"cast({m} div (k + 1) as int)", f"(k + 1 - {m} % (k + 1))"
    part = f"substring({word_}, cast(i * {base} + greatest(0, i - {long_from}) + 1 as int), cast({base} + if(i >= {long_from}, 1, 0) as int))"
    return f"flatten(transform(sequence({k0}, {k1}), k -> transform(sequence(0, k), i -> struct({m} as m, k as k, i as i, {part} as part))))"


def _probes(word_: str, right: float) -> str:
    """SQL: of a word of x, the structs of all parts that words of y it may be an edited form of could have."""
    n = f"length({word_})"
    far = f"cast(floor({1 - right} * {n} / {right} + 1e-6) as int)"
    k = f"cast(floor({1 - right} * greatest({n}, m) + 1e-6) as int)"
    base, long_from = "cast(m div (k + 1) as int)", "(k + 1 - m % (k + 1))"
    start, size = f"cast(i * {base} + greatest(0, i - {long_from}) as int)", f"cast({base} + if(i >= {long_from}, 1, 0) as int)"
    lo, hi = f"greatest(0, {start} - k)", f"least({n} - {size}, {start} + k)"
    at = f"if({lo} <= {hi}, transform(sequence({lo}, greatest({lo}, {hi})), p -> struct(m as m, k as k, i as i, substring({word_}, p + 1, {size}) as part)), array())"
    per_k = f"flatten(transform(sequence(0, k), i -> {at}))"
    lengths = f"transform(sequence(greatest(0, {n} - {far}), {n} + {far}), m -> if(abs({n} - m) <= {k}, flatten(transform(array({k}), k -> {per_k})), array()))"
    return f"array_distinct(flatten({lengths}))"


def _pairs(left: DataFrame, near: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Names of near genera side by side; in large genera only those whose second words share a part where they may."""
    must = (threshold - WORD_WEIGHTS[0]) / WORD_WEIGHTS[1]
    if must <= LEAST_RIGHT:
        return left.join(near, "genus_x").join(right, "genus_y")
    large = right.groupBy("genus_y").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_GENUS).select("genus_y")
    small = left.join(near.join(large, "genus_y", "left_anti"), "genus_x").join(right, "genus_y")
    parts = right.join(large, "genus_y", "left_semi").select("*", F.expr(f"inline({_parts('ey', must)})"))
    probes = left.join(near.join(large, "genus_y", "left_semi"), "genus_x").select("*", F.expr(f"inline({_probes('ex', must)})"))
    met = probes.join(parts, ["genus_y", "m", "k", "i", "part"]).dropDuplicates(["name_x", "name_y"])
    return small.unionByName(met.select(*small.columns))


def similar_names(x: DataFrame, y: DataFrame, threshold: float, rank: str) -> DataFrame:
    """(name_x, pos_x, norm_x, name_y, pos_y, norm_y, genus_y, score): pairs with a similarity of threshold or more.

    x, y: (name, pos[, norm]), names distinct. What no epithet could lift to the threshold is dropped before epithets
    are compared, by the first words' similarity and then by the lengths of the second ones; edit distances are given up
    beyond what the threshold allows. These bounds lose nothing.
    """
    # normal forms are dear and read three times below; each name of x becomes many pairs, so that even names that would
    # fit one task are spread over as many as shuffles have
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bx, by = cut(binomials(x, rank).repartition(n, "name")), cut(binomials(y, rank))
    near = _near(bx, by, threshold)
    left = bx.select(F.col("name").alias("name_x"), F.col("pos").alias("pos_x"), F.col("norm").alias("norm_x"), F.col("genus").alias("genus_x"), F.col("epithet").alias("ex"))
    # names of y, and pairs of genera, are sent to the names of x if they are counted to be few; else all sides are shuffled
    near = cut(near)
    few = by.count() <= MOST_SENT and near.count() <= MOST_SENT
    near, by = (F.broadcast(near), F.broadcast(by)) if few else (near, by)
    right = by.select(F.col("name").alias("name_y"), F.col("pos").alias("pos_y"), F.col("norm").alias("norm_y"), F.col("genus").alias("genus_y"), F.col("epithet").alias("ey"))
    longest = F.greatest(F.length("ex"), F.length("ey"))
    # edits that an epithet may have and still reach the threshold, rounded so that none is lost
    spare = F.floor((1 - (threshold - WORD_WEIGHTS[0] * F.col("g_sim")) / WORD_WEIGHTS[1]) * longest + 1e-6).cast("int")
    paired = _pairs(left, near, right, threshold).withColumn("spare", spare).withColumn("longest", longest)
    edits = paired.where(F.abs(F.length("ex") - F.length("ey")) <= F.col("spare")).withColumn("d", F.expr("levenshtein(ex, ey, spare)"))
    e_sim = F.when(F.col("longest") == 0, F.lit(1.0)).otherwise(1 - F.col("d") / F.nullif(F.col("longest"), F.lit(0)))
    return (
        edits.where("d >= 0")
        .withColumn("score", WORD_WEIGHTS[0] * F.col("g_sim") + WORD_WEIGHTS[1] * e_sim)
        .where(F.col("score") >= threshold)
        .select("name_x", "pos_x", "norm_x", "name_y", "pos_y", "norm_y", "genus_y", "score")
    )


def best_matches(x: DataFrame, y: DataFrame, threshold: float = 0.9, rank: str = "species") -> DataFrame:
    """For each x its most similar y; of equals that with the smaller genus, then the earlier one."""
    found = first_rows(similar_names(x, y, threshold, rank), ["name_x"], [F.desc("score"), "genus_y", "pos_y", "name_y"])
    notes = F.concat(
        F.lit("Fuzzy match (score "), F.format_string("%.3f", "score"), F.lit("): '"), "norm_x", F.lit("' ~ '"), "norm_y", F.lit("'")
    )
    return found.select("name_x", "pos_x", "name_y", "pos_y", F.round("score", 4).alias("score"), notes.alias("notes"))


#: So many names of a genus of x, and of all near genera of y, are compared at once: some 70 bytes each, and 2 to 8 bytes
#: for each of y and letter.
MOST_ASKING, MOST_ASKED = 4_000, 32_768
#: Rows that a task should get; they are held at once.
TASK_ROWS = 200_000


def edit_distances(words: list[str], others: list[str]) -> Iterator[np.ndarray]:
    """For each of the words, best sorted, the edit distances from all others.

    The columns of the distance matrix are kept as bits of their vertical differences (Myers, Hyyro), of all others side
    by side; what words begin with in common is done once. Others of over 64 letters have whole columns.
    """
    lengths = np.array([len(o) for o in others], dtype=np.int32)
    short, long_ = np.flatnonzero(lengths <= 64), np.flatnonzero(lengths > 64)

    def letters(which: np.ndarray) -> np.ndarray:
        width = max(1, int(lengths[which].max(initial=0)))
        return np.array([others[i] for i in which], dtype=f"U{width}").view(np.uint32).reshape(len(which), width)

    codes, long_codes = letters(short), letters(long_)
    bits = next(b for b in (16, 32, 64) if codes.shape[1] <= b)
    kind = np.dtype(f"uint{bits}").type
    # of a length of 64, 2 ** 64 - 1 too
    mask = np.array([(1 << int(m)) - 1 for m in lengths[short]], dtype=kind)
    one, places, rows = kind(1), np.arange(long_codes.shape[1] + 1, dtype=np.int32), {}

    def row(letter: str) -> np.ndarray:
        """Bits where the others have the letter; what is beyond their ends is never looked at."""
        if letter not in rows:
            rows[letter] = np.zeros(len(short), kind)
            for i in range(codes.shape[1]):
                rows[letter] |= (codes[:, i] == ord(letter)).astype(kind) << kind(i)
        return rows[letter]

    states, before = [(np.full(len(short), ~kind(0), kind), np.zeros(len(short), kind))], ""
    for w in words:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        del states[same + 1 :]
        for letter in w[same:]:
            (up, down), eq = states[-1], row(letter)
            xv = eq | down
            xh = eq & up
            xh += up
            xh ^= up
            xh |= eq
            ph = xh | up
            np.invert(ph, out=ph)
            ph |= down
            xh &= up
            ph += ph
            ph |= one
            xh += xh
            new = xv | ph
            np.invert(new, out=new)
            new |= xh
            xv &= ph
            states.append((new, xv))
        before = w
        d = np.empty(len(others), np.int32)
        up, down = states[-1]
        d[short] = len(w) + np.bitwise_count(up & mask).astype(np.int32) - np.bitwise_count(down & mask)
        if len(long_):
            column = np.broadcast_to(places, (len(long_), len(places)))
            for j, letter in enumerate(w):
                new = np.empty(column.shape, np.int32)
                new[:, 0] = j + 1
                np.minimum(column[:, 1:] + 1, column[:, :-1] + (long_codes != ord(letter)), out=new[:, 1:])
                column = np.minimum.accumulate(new - places, axis=1) + places
            d[long_] = column[np.arange(len(long_)), lengths[long_]]
        yield d


def _best_of(asking: pa.Table, asked: pa.Table, n: int, threshold: float) -> pa.RecordBatch:
    """The n best of asked (name, word, pos, genus_y, g_sim) for each of asking (name, word)."""
    asked = asked.take(pc.sort_indices(asked, [("genus_y", "ascending"), ("pos", "ascending"), ("name", "ascending")], null_placement="at_start"))
    words, of = np.unique(np.array(asking["word"].to_pylist(), dtype=object), return_inverse=True)
    others = asked["word"].to_pylist()
    lengths, base = np.array([len(o) for o in others]), WORD_WEIGHTS[0] * asked["g_sim"].to_numpy()
    longest, found, scores = {}, [], []
    for w, d in zip(words, edit_distances(list(words), others)):
        if len(w) not in longest:
            longest[len(w)] = np.maximum(np.maximum(lengths, len(w)), 1).astype(float)
        score = base + WORD_WEIGHTS[1] * (1 - d / longest[len(w)])
        least = threshold if len(score) <= n else max(threshold, np.partition(score, len(score) - n)[len(score) - n])
        at = np.flatnonzero(score >= least)
        at = at[np.argsort(-score[at], kind="stable")[:n]]
        found.append(at)
        scores.append(score[at])
    took = np.array([len(f) for f in found])[of]
    who = np.repeat(np.arange(len(of)), took)
    places = pa.array(np.concatenate([found[i] for i in of]))
    name_x, them = asking["name"].take(pa.array(who)), asked.take(places)
    columns = [name_x, them["name"], them["pos"], them["genus_y"], pa.chunked_array([np.concatenate([scores[i] for i in of])])]
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["name_x", "name_y", "pos_y", "genus_y", "score"])


def most_similar(x: DataFrame, y: DataFrame, n: int, threshold: float, rank: str) -> DataFrame:
    """(name_x, name_y, pos_y, genus_y, score): for each x the n best of similar_names, in its order.

    Where most names of a genus reach the threshold there are too many pairs to be rows. Here a genus of x, in shares, meets
    the names of all near genera in arrays, and only the best become rows. Names of y that are alike in both words count
    only as far as there are places for them.
    """
    ship(x.sparkSession)
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bx = cut(binomials(x, rank).repartition(parts, "name").select("name", "genus", "epithet"))
    by = cut(first_rows(binomials(y, rank), ["genus", "epithet"], ["pos", "name"], n).select("name", "pos", "genus", "epithet"))
    near = cut(_near(bx, by, threshold))
    size = lambda df, side, as_: df.groupBy(F.col("genus").alias(side)).agg(F.count("*").alias(as_))
    asked = near.join(size(by, "genus_y", "k"), "genus_y").groupBy("genus_x").agg(F.sum("k").alias("k"))
    shares = cut(size(bx, "genus_x", "m").join(asked, "genus_x").select(
        "genus_x", "m", "k", F.expr(f"cast(ceil(m / {MOST_ASKING}) as int)").alias("nx"), F.expr(f"cast(ceil(k / {MOST_ASKED}) as int)").alias("ny")
    ))
    total, deals = shares.agg(F.sum(F.expr("m * ny + k * nx")), F.max("ny")).first()
    tasks = max(8 * x.sparkSession.sparkContext.defaultParallelism, (total or 0) // TASK_ROWS)
    dealt = lambda c: F.pmod(F.xxhash64("name"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["genus_x", "sx", "sy"]
    left = bx.withColumnRenamed("genus", "genus_x").join(shares, "genus_x").select("genus_x", dealt("nx").alias("sx"), each("ny").alias("sy"), "name", F.col("epithet").alias("word"))
    right = by.withColumnRenamed("genus", "genus_y").join(near.join(shares, "genus_x"), "genus_y").select(
        "genus_x", each("nx").alias("sx"), dealt("ny").alias("sy"), "name", F.col("epithet").alias("word"), "pos", "genus_y", "g_sim"
    )
    rows = right.unionByName(left, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in key])
        codes = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() if c == "genus_x" else table[c].to_numpy() for c in key]
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        for a, b in zip([0, *ends], [*ends, table.num_rows]):
            unit = table.slice(a, b - a)
            is_x = pc.is_null(unit["genus_y"])
            asking, asked = unit.filter(is_x), unit.filter(pc.invert(is_x))
            if asking.num_rows and asked.num_rows:
                yield _best_of(asking, asked, n, threshold)

    schema = f"name_x string, name_y string, pos_y {kinds['pos']}, genus_y string, score double"
    best = rows.withColumn("task", F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).drop("task").mapInArrow(run, schema)
    return best if (deals or 1) == 1 else first_rows(best, ["name_x"], [F.desc("score"), "genus_y", "pos_y", "name_y"], n)


def suggestions(x: DataFrame, y: DataFrame, n: int = 3, threshold: float = 0.7, rank: str = "species") -> DataFrame:
    """(unresolved, suggestion, score): for each x up to n of all y with that similarity, the best first.

    n is the feature; x without such a y gives no row.
    """
    if n < 1 or not 0 <= threshold <= 1:
        raise ValueError("n must be at least 1 and threshold between 0 and 1")
    top = most_similar(x, y, n, threshold, rank)
    return top.select(F.col("name_x").alias("unresolved"), F.col("name_y").alias("suggestion"), F.round("score", 4).alias("score"))
