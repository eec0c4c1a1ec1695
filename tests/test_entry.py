from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["species_resolved", "n", "mass"] and df.count() > 0


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "cascade_normalised", "mapping_counts", "merge_left", "prune", "diff_summary"])
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = c.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    key = lambda r: tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r)
    df = entry.queries()[name](spark, str(SMALL)).select(*[f"`{x}`" for x in cols])
    assert sorted(key(r) for r in df.collect()) == sorted(key(r) for r in found.fetchall())
