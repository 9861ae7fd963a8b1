"""Spans of one track that begin at the same time: by the SQL of the queries a parent begins before its children."""

from __future__ import annotations

import random

import duckdb
import pytest

from spanforge import catalog
from spanforge.operators import intervals as iv


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """Events, and at the time of many of them another one without length, which leaves no tie open in the SQL."""
    folder = tmp_path_factory.mktemp("doubled")
    events = "'/root/testdata/sf0.001/events.parquet'"
    duckdb.sql(f"""COPY (FROM {events} UNION ALL SELECT event_id + 100000, ts, user_id, 'purchase', 0, props FROM {events} WHERE event_id % 3 = 0) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["j21_group_relations", "j21_group_spans", "j21_group_events", "j21_group_events_relations", "j6_nest"])
def test_like_sql(spark, doubled, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{doubled}/events.parquet'")
    for table in ("part", "lineitem", "orders"):  # the prelude names all tables
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    cursor = con.execute(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, doubled).select(*(c[0] for c in cursor.description))
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("seed", range(4))
def test_strict_nesting(spark, seed):
    """The parent is a span that begins last among those that begin before and end no earlier."""
    rng = random.Random(seed)
    spans = [(rng.randrange(2), seq, rng.randrange(25), rng.choice([0, 1, 3, 3, 9, 20])) for seq in range(90)]
    df = spark.createDataFrame(spans, "g int, seq int, begin int, dur int")
    at = {seq: (g, begin, begin + dur) for g, seq, begin, dur in spans}
    got = {r.seq: r for r in iv.nest(df, ["g"], strict=True).collect()}
    assert len(got) == len(spans)
    for seq, (g, begin, end) in at.items():
        around = [b for k, b, e in at.values() if k == g and b < begin and e >= end]
        parent = got[seq].parent_seq
        assert (parent is None) == (not around)
        if around:
            k, b, e = at[parent]
            assert k == g and b == max(around) and e >= end and got[seq].depth == got[parent].depth + 1
