"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tools.check_oracles import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


def _registered():
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import catalog

    catalog.load_all()
    return catalog


CATALOG = _registered()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


# These ask for more rows than the smallest tables hold; they are checked on the next size.
LARGER = {"sample_n_large", "split_by_range"}


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query(spark, con, name):
    sf_dir = SF_DIR
    if name in LARGER:
        sf_dir = "/root/testdata/sf0.01"
        for table in TABLES.split():
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    try:
        state, rows, _, note = compare(spark, con, sf_dir, name, CATALOG.QUERIES[name], CATALOG.ORACLES.get(name))
    finally:
        if name in LARGER:
            for table in TABLES.split():
                con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    assert state in ("ok", "rows-only"), f"{state}: {note}"
    assert rows >= 0


def test_every_oracle_has_a_query():
    assert set(CATALOG.ORACLES) <= set(CATALOG.QUERIES)
