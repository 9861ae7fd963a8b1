"""R21 over events whose texts are longer than a display shows."""

from __future__ import annotations

import duckdb
import pytest

from spanforge import catalog


@pytest.fixture(scope="module")
def long_props(tmp_path_factory):
    """Events of which some have long texts that differ in their last characters only."""
    folder = tmp_path_factory.mktemp("long")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 14 = 0 THEN repeat('p', 9000) || event_id % 3 WHEN event_id % 14 = 7 THEN repeat('q', 1500) ELSE props END AS props)
        FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < 200) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["r21_frame_table", "r21_event_frames"])
def test_whole_texts(spark, long_props, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{long_props}/events.parquet'")
    # the prelude names all tables
    for table in ("part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    df = catalog.QUERIES[name](spark, long_props)
    cursor = con.execute(catalog.SQL[name])
    want = sorted(map(repr, cursor.fetchall()))
    assert max(map(len, want)) > 70_000
    assert sorted(repr(tuple(r)) for r in df.select(*(c[0] for c in cursor.description)).collect()) == want
