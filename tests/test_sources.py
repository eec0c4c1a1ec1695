import pytest
from pyspark.sql import functions as F

from speciesbridge.functions.schema import MAPPING
from speciesbridge.operators.mapping import Reconciliation
from speciesbridge.sources.cache import TreeCache
from speciesbridge.sources import ingest, sinks
from speciesbridge.sources.treefiles import tree_from_text
from speciesbridge.streaming.names import frozen_lookup, resolve_stream, windowed_counts


def mapping(spark):
    rows = [("A <b>", "A b", None, "normalized", 1.0, "s", True, True, "&"), ("Q r", None, None, "unresolved", None, None, True, False, ""), (None, "S t", None, "unresolved", None, None, False, True, ""), ("A b", "A b", "R s", "synonym", 0.95, "s", True, True, "")]
    return spark.createDataFrame(rows, MAPPING)


def test_species_column(spark):
    make = lambda cols, rows: spark.createDataFrame(rows, cols)
    assert ingest.species_column(make("a string, SPECIES string", [("x", "y")])) == "SPECIES"
    assert ingest.species_column(make("id int, n string, m string", [(1, "Parus major", "x"), (2, "Corvus corax", None), (3, "Falco a", "")])) == "n"
    for bad in (make("a string", [("Parus major",)]), make("a string, b string", [("Parus major", "Parus major")] * 3), make("a int", [(1,)])):
        with pytest.raises(ValueError):
            ingest.species_column(bad)
    assert {r["column_name"]: (r["n_values"], r["n_binomial"]) for r in ingest.binomial_shares(make("a string, `b.c` string", [("Parus major", ""), (None, "x")])).collect()} == {"a": (1, 1), "b.c": (1, 0)}


def test_overrides_and_crosswalk_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("name_x,name_y\na,b\nc,d\n")
    o = ingest.read_overrides(spark, str(tmp_path / "o.csv"))
    assert [tuple(r) for r in o.orderBy("pos").select("name_x", "user_note").collect()] == [("a", "Pre-built override"), ("c", "Pre-built override")]
    (tmp_path / "c.tsv").write_text("f\tt\na\tb\n")
    assert ingest.read_crosswalk(spark, str(tmp_path / "c.tsv")).columns == ["f", "t"]
    with pytest.raises(ValueError):
        ingest.read_crosswalk(spark, str(tmp_path / "c.xlsx"))
    with pytest.raises(ValueError):
        ingest.read_overrides(spark, spark.createDataFrame([("a",)], "name_x string"))


def test_export_report_and_cache(spark, tmp_path):
    unused = spark.createDataFrame([("x", "y", "already_matched")], "name_x string, name_y string, reason string")
    rec = Reconciliation(mapping(spark), {"type": "data_data"}, unused_overrides=unused)
    tree = tree_from_text(spark, "((A_b:1,S_t:1):1,C:2);", "t")
    paths = sinks.export(rec, str(tmp_path), data=spark.createDataFrame([("A b",), ("Z",)], "species string"), tree=tree, drop_unresolved=True)
    assert set(paths) == {"mapping", "data", "tree", "unused"} and spark.read.csv(paths["data"], header=True).count() == 1
    page = sinks.html_report(rec, "a & b")
    assert "a &amp; b" in page and "<svg" in page and "A <b>" not in page
    text = sinks.summary_text(rec)
    assert "Unresolved" in text and "\n" not in sinks.summary_text(rec, "brief")
    cache = TreeCache(spark, str(tmp_path / "cache"))
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    key = cache.key(names("b", "a", None, "a"), "s", n=1)
    assert key == cache.key(names("a", "b"), "s", n=1) != cache.key(names("a", "b"), "s", n=2)
    assert cache.get("s", key) is None and cache.status() == []
    cache.put("s", key, tree)
    assert cache.get("s", key).count() == 4 and [e["source"] for e in cache.status()] == ["s"]
    for p in (tmp_path / "cache" / "s" / key).glob("*.parquet"):
        p.write_bytes(b"broken")
    assert cache.get("s", key) is None and cache.clear("other") == 0 and cache.clear() == 1 and cache.status() == []


def test_stream_through_frozen_mapping(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a_b", "2024-01-01 00:00:00"), ("A b", "2024-01-01 12:00:00"), ("nix", "2024-01-03 00:00:00"), (None, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "species string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(src))
    lookup = frozen_lookup(mapping(spark))
    stream = spark.readStream.schema("species string, t timestamp").parquet(str(src))
    q = windowed_counts(resolve_stream(stream, lookup, "species"), "t").writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["species_resolved"], r["n"]) for r in spark.table("seen").collect()} == {("R s", 2), (None, 2)}
