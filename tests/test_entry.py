"""A few queries at the smallest scale against DuckDB; the driver compares all at the next one."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["node_bbox", "cmp_mixed_units", "relation_bbox", "two_subs", "or_sub", "per_cell_multiplicity", "tag_dictionary", "geojson_points", "geojson_lines", "geojson_polygons", "relations_open_depth", "saved_or_sub", "saved_nested_sub", "precedence", "nested_or_not"])
def test_against_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, str(DATA))
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns

    def rows(found, names):
        at = [names.index(c) for c in columns]
        return sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else str(r[i]) for i in at) for r in found)

    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
