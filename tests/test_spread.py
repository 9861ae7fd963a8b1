"""Steps that once held a whole device or op table in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanforge.operators import collectives as cl
from spanforge.operators import joins as jn
from spanforge.operators import metrics as mt


@pytest.fixture
def plain(spark):
    """Without AQE, which puts small partitions together."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def most(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_hide_tiny_spreads_a_device(plain):
    df = plain.range(4000).select(F.lit(0).alias("device_id"), (F.col("id") * 3).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 3).alias("dur"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    out = cl.hide_tiny(df, ["device_id"], 10, 2)
    expected, last = [], None
    for k in range(4000):
        tiny, cell = k % 3 < 2, k * 3 // 10
        if tiny and last == (True, cell):
            expected[-1] += f", n{k}"
        else:
            expected.append(f"n{k}")
        last = (tiny, cell)
    assert [r["name"] for r in out.orderBy("ts").collect()] == expected
    assert most(out) < 2000


def test_rank_cumulative_spreads(plain):
    df = plain.range(4000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1009).alias("v"))
    out = mt.rank_cumulative(df, "v", "k")
    assert most(out) < 2000
    rows, run = sorted(((r.v, r.k) for r in df.collect()), key=lambda x: (-x[0], x[1])), 0
    total, found = sum(v for v, _ in rows), {r["rank"]: r for r in out.collect()}
    for place, (v, k) in enumerate(rows, 1):
        run += v
        assert (found[place].k, found[place].fraction, found[place].cumulative) == (k, v / total, run / total)


def test_fan_out_groups_spreads(spark, monkeypatch):
    monkeypatch.setattr(jn, "ROWS", 500)
    df = spark.range(4000).select(F.col("id").alias("request_id"), (F.col("id") % 40).alias("group_id"))
    out = jn.fan_out_groups(df, spark.range(40).select(F.col("id").alias("child_group"), F.expr("id DIV 10").alias("parent_group")))
    assert most(out) < 1000
    assert {tuple(r) for r in out.collect()} == {(k, g) for k in range(4000) for g in (k % 40, k % 40 // 10)}
    assert out.count() == len({(k, g) for k in range(4000) for g in (k % 40, k % 40 // 10)})
