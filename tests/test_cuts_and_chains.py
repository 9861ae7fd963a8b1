"""T5 by counts of ranges, J18 through chains, S8 rows as JSON, R21 frames."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import intervals as iv
from spanforge.operators import joins as jn
from spanforge.operators import metrics as mt
from spanforge.sources import sinks
from spanforge.sources import spaces as sp


@pytest.mark.parametrize("spread", [1, 30, 10**15])
def test_first_events(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.randrange(-spread, spread), i) for i in range(700)]
    df = spark.createDataFrame(rows, "begin bigint, seq bigint").repartition(5)
    for n in (1, 7, 350, 699, 700, 900):
        out = mt.first_events(df, n)
        assert sorted(tuple(r) for r in out.collect()) == sorted(rows)[:n]
        assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    assert mt.first_events(df, 0).count() == 0 and mt.first_events(df.where("false"), 5).count() == 0
    assert mt.range_cut(df, "begin", 350, parts=3) == (sorted(rows)[349][0], sum(b < sorted(rows)[349][0] for b, _ in rows))


def test_adjacent(spark):
    """Every way between ops whose inner ops are passed through, over long chains and several operands."""
    rng = random.Random(7)
    name = lambda i: f"get-tuple-element.{i}" if i % 3 else f"op.{i}"
    edges = sorted({(i, j) for j in range(1, 60) for i in rng.sample(range(max(0, j - 6), j), min(j, rng.choice([1, 1, 2])))})
    edges += [(1000 + i, 1001 + i) for i in range(40)]
    chain = {1000: "op.first", 1040: "op.last"} | {1000 + i: f"get-tuple-element.{1000 + i}" for i in range(1, 40)}
    label = lambda i: chain.get(i, name(i))
    kids = {}
    for u, v in edges:
        kids.setdefault(label(u), []).append(label(v))
    want = []

    def walk(root, node):
        for v in kids.get(node, []):
            if v.startswith("get-"):
                walk(root, v)
            else:
                want.append((root, v))

    for u in {label(u) for u, _ in edges if not label(u).startswith("get-")}:
        walk(u, u)
    df = spark.createDataFrame([(label(u), label(v)) for u, v in edges], "src string, dst string")
    got = jn.adjacent(df, lambda x: x.startswith("get-tuple-element"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and ("op.first", "op.last") in want


def test_trace_lines(spark, tmp_path):
    rows = [
        (1, "p", 2, "l", 10, 4, "a", 7, 5, "start", "tf", False, 3), (1, "p", 2, "l", 12, 0, "b", 8, 5, "mid", None, True, None),
        (1, "p", 2, "l", 13, 1, "c", 9, 5, "end", None, True, None), (1, "p", 3, "m", 14, 0, "d", 10, None, None, None, False, None),
    ]
    df = spark.createDataFrame(rows, "plane_id bigint, plane string, line_id bigint, line string, begin bigint, dur bigint, name string, seq bigint, flow bigint, flow_entry string, category string, unbound boolean, group_id bigint")
    got = [json.loads(r.value) for r in sinks.trace_lines(sinks.trace_rows(df)).collect()]
    events = [e for e in got if e["ph"] != "M"]
    assert sorted(events, key=str) == sorted([
        {"ph": "X", "pid": 1, "tid": 2, "name": "a", "ts": 10.0, "dur": 4.0, "bind_id": 5, "cat": "tf", "flow_out": True, "args": {"uid": 7, "group_id": 3}},
        {"ph": "X", "pid": 1, "tid": 3, "name": "d", "ts": 14.0, "dur": 1.0, "args": {"uid": 10}},
        {"ph": "b", "pid": 1, "name": "b", "ts": 12.0, "id": 5, "cat": "", "args": {"uid": 8}}, {"ph": "e", "pid": 1, "name": "b", "ts": 12.0, "id": 5, "cat": "", "args": {}},
        {"ph": "e", "pid": 1, "name": "c", "ts": 13.0, "id": 5, "cat": "", "args": {"uid": 9}},
    ], key=str)
    assert sorted((e["name"], e.get("tid"), e["args"].get("name")) for e in got if e["ph"] == "M" and "name" in e["args"]) == [("process_name", None, "p"), ("thread_name", 2, "l"), ("thread_name", 3, "m")]


def test_frames(spark):
    value = f"map<string, {sp.VALUE}>"
    text = lambda x: {"int": None, "real": None, "text": x, "raw": None}
    long, other, huge = "stack of frames " * 3, "another stack of frames", "x" * 20_000
    rows = [(1, {"long_name": text(long)}, None), (2, {"hlo_text": text(other)}, {"long_name": text("short")}), (3, None, {"long_name": text(long)}), (4, {"other": text(long)}, None), (5, {"long_name": text(huge)}, None), (6, None, None)]
    df = spark.createDataFrame(rows, f"seq bigint, stats {value}, meta_stats {value}")
    frames = sp.frame_table(df)
    texts = {r.frame: r.text for r in frames.collect()}
    assert sorted(texts) == [1, 2, 3] and [r.frame for r in frames.orderBy("fingerprint").collect()] == [1, 2, 3]
    got = {r.seq: texts.get(r.frame) for r in sp.with_frame(df, frames).collect()}
    assert got == {1: long, 2: other, 3: long, 4: None, 5: "x" * 10_000 + "...<truncated>", 6: None}


def test_last_inside_without_pairs(spark):
    """Every inner span lies in every outer one: a row per span is worked on, not one per pair; the rest is compared with the definition."""
    rng = random.Random(5)
    spans = [(rng.choice([1, 2, None]), seq, rng.randrange(500), rng.choice([0, 3, 40, 400])) for seq in range(120)]
    cols = "plane_id int, seq bigint, begin bigint, dur bigint"
    outer, inner = spans[:60], spans[60:]
    want = {}
    for plane, seq, begin, dur in outer:
        ends = [(b + d, s) for p, s, b, d in inner if p is not None and p == plane and begin <= b + d <= begin + dur]
        if ends:
            want[seq] = max(ends)[1]
    got = iv.mark_last_inside(spark.createDataFrame(outer, cols), spark.createDataFrame(inner, cols), ["plane_id"], 16)
    assert {r.seq: r.last_seq for r in got.collect()} == want and want
    wide = spark.range(4_000).select(F.lit(1).alias("plane_id"), F.col("id").alias("seq"), F.col("id").alias("begin"), F.lit(10_000).cast("bigint").alias("dur"))
    out = iv.mark_last_inside(wide, wide.withColumn("dur", F.lit(0).cast("bigint")), ["plane_id"], 16)
    assert out.where("last_seq = 3999").count() == 4_000
    assert "explode" not in out._jdf.queryExecution().toString()
