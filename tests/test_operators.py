"""Small exact cases: known numbers, order-dependent operators against plain folds, plans."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from spanforge.functions import columns as c
from spanforge.operators import collectives as cl
from spanforge.operators import filters as fl
from spanforge.operators import grouping as gr
from spanforge.operators import intervals as iv
from spanforge.operators import memory as mm
from spanforge.operators import metrics as mt
from spanforge.operators import ranks
from spanforge.operators import serving as sv
from spanforge.operators import timeline as tl
from spanforge.sources import sinks, traces
from spanforge.streaming import ingest

SPAN = "g int, begin bigint, dur bigint, seq bigint"


def spans(spark, rows):
    return spark.createDataFrame([(0, b, d, i) for i, (b, d) in enumerate(rows)], SPAN)


@pytest.mark.parametrize(
    "rows, busy, idle",
    [
        ([(10, 20, 1), (30, 40, 1)], 20, 10),
        ([(10, 20, 1), (30, 40, 1), (20, 35, 1)], 30, 0),
        ([(10, 40, 1), (20, 30, 1)], 30, 0),
        ([(0, 10, 1), (20, 30, 1), (10, 20, 1), (30, 40, 1)], 40, 0),
        ([(10, 20, 1), (20, 30, 0)], 10, 10),
    ],
)
def test_duty_cycle(spark, rows, busy, idle):
    df = spark.createDataFrame([(0, b, e - b, i, on) for i, (b, e, on) in enumerate(rows)], SPAN + ", on int")
    assert tuple(iv.duty_cycle(df, ["g"], F.col("on") == 0).select("busy", "idle").first()) == (busy, idle)


def stack_parents(rows):
    """(begin, dur) in file order -> parent index by a stack that pops what ends too early."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], -rows[i][1], i))
    stack, parent = [], {}
    for i in order:
        end = sum(rows[i])
        while stack and sum(rows[stack[-1]]) < end:
            stack.pop()
        parent[i] = stack[-1] if stack else None
        stack.append(i)
    return parent


def test_nest_equals_the_stack(spark):
    rng = random.Random(1)
    tracks = {g: [(rng.randrange(60), rng.randrange(30)) for _ in range(25)] for g in range(40)}
    df = spark.createDataFrame([(g, b, d, 100 * g + i) for g, rows in tracks.items() for i, (b, d) in enumerate(rows)], SPAN)
    got = {(r.g, r.seq % 100): None if r.parent_seq is None else r.parent_seq % 100 for r in iv.nest(df, ["g"]).collect()}
    assert got == {(g, i): p for g, rows in tracks.items() for i, p in stack_parents(rows).items()}
    assert iv.nest(df.where("false"), ["g"]).count() == 0


def test_merge_runs_gap_equals_the_fold(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(500), rng.randrange(1, 9), rng.choice("ab")) for _ in range(120))
    df = spark.createDataFrame([(0, b, d, i, n) for i, (b, d, n) in enumerate(rows)], SPAN + ", name string")
    want = []
    for b, d, n in sorted(rows, key=lambda r: (r[0], -r[1])):
        if want and want[-1][2] == n and b - want[-1][0] - want[-1][1] <= 2 * want[-1][1]:
            want[-1][1] = max(want[-1][0] + want[-1][1], b + d) - want[-1][0]
        else:
            want.append([b, d, n])
    got = [[r.begin, r.dur, r.name] for r in iv.merge_runs_gap(df, ["g"], "name").orderBy("begin", F.col("dur").desc()).collect()]
    assert sorted(got) == sorted(want)


def test_priority_timeline_equals_ticks(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(80), rng.randrange(12)) for _ in range(40)]
    kinds = [rng.randrange(1, 4) for _ in rows]
    df = spark.createDataFrame([(0, b, d, k) for (b, d), k in zip(rows, kinds)], "g int, begin bigint, dur bigint, k int")
    live = [(b, b + d, k) for (b, d), k in zip(rows, kinds) if d]
    want = {}
    for t in range(min(b for b, _, _ in live), max(e for _, e, _ in live)):
        k = max((k for b, e, k in live if b <= t < e), default=0)
        want[k] = want.get(k, 0) + 1
    assert {r.kind: r.time for r in iv.priority_timeline(df, ["g"], F.col("k"), 3).collect()} == want


def test_align_hosts_shifted(spark):
    n, d = 10, 2_000_000_000
    rows = [(f"h{h}", i, (i + h) * d, d) for h in range(4) for i in range(n)]
    got = {r.host: r.offset for r in iv.align_hosts(spark.createDataFrame(rows, "host string, idx bigint, begin bigint, dur bigint")).collect()}
    assert got == {"h0": 0, "h1": 1, "h2": 2, "h3": 3}


def test_step_intersection(spark):
    n, d, schema = 10, 2_000_000_000, "host string, idx bigint, begin bigint, dur bigint"

    def run(rows, hosts=None):
        return {r.host: (r.first_step, r.n) for r in iv.step_intersection(spark.createDataFrame(rows, schema), hosts).collect()}

    shifted = run([(f"h{h}", i, (i + h) * d, d) for h in range(4) for i in range(n)])
    assert shifted["h0"] == (3, n - 3) and {x[1] for x in shifted.values()} == {n - 3}
    assert set(run([(f"h{h}", i, i * d + 100 * h, d) for h in range(4) for i in range(n)]).values()) == {(0, n)}
    assert {x[1] for x in run([(f"h{h}", i, i * d, d) for h in range(2) for i in range(5 if h else n)]).values()} == {5}
    assert {x[1] for x in run([(f"h{h}", i, (i + 100 * h) * d, d) for h in range(3) for i in range(n)]).values()} == {0}
    assert {x[1] for x in run([("h0", i, i * d, d) for i in range(n)], hosts=2).values()} == {0}


def test_slack(spark):
    us = 1_000_000
    rows = [(0, "rv", "send", 0, 1 * us, 2 * us), (0, "rv", "recv", 1, 4 * us, us), (0, "rv", "send-done", 2, 10 * us, us // 2), (0, "rv", "recv-done", 3, 20 * us, 3 * us)]
    r = cl.slack_overlap(spark.createDataFrame(rows, "device_id bigint, rendezvous string, opcode string, seq bigint, ts bigint, dur bigint")).first()
    assert (r.slack // us, r.stall // us, r.observed // us, r.send // us) == (15, 6, 22, 2)


def test_collective_functions(spark):
    kinds = ["ONE_TO_ONE", "ALL_GATHER", "ALL_REDUCE", "ALL_TO_ALL", "REDUCE_SCATTER", "OTHER"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(c.transmitted_bytes(F.lit(100), F.lit(4), F.col("k"))).collect()] == [400, 75, 150, 75, 300, 0]
    sizes = spark.createDataFrame([(512,), (3 << 20,), (1280,)], "n bigint")
    assert [r[0] for r in sizes.select(c.human_bytes(F.col("n"))).collect()] == ["512B", "3.00M", "1.2K"]
    parts = spark.createDataFrame([("r", 10, 0, 0, 0, 1), ("r", 40, 0, 0, 0, 3)], "rendezvous string, slack bigint, stall bigint, observed bigint, send bigint, occurrences bigint")
    assert cl.merge_collectives(parts).first()["slack"] == 32


def test_event_fraction(spark):
    steps = spark.createDataFrame([(0, s, 1000) for s in (1, 2, 3, 4)], "p int, step bigint, dur bigint")
    used = spark.createDataFrame([(0, s, s * 10) for s in (1, 2, 3, 4)], "p int, step bigint, dur bigint")
    assert [r.fraction for r in sv.event_fraction(used, steps, "p").orderBy("step").collect()] == [0.02, 0.03]
    steps = spark.createDataFrame([(0, 1, 100000), (0, 2, 900)], "p int, step bigint, dur bigint")
    used = spark.createDataFrame([(0, 1, 1000), (0, 2, 90)], "p int, step bigint, dur bigint")
    assert [r.fraction for r in sv.event_fraction(used, steps, "p").collect()] == [0.01]


def test_op_metrics(spark):
    events = spark.createDataFrame([(1, 1, 10_000, 2, 0)], "program_id bigint, symbol_id bigint, dur bigint, occurrences bigint, dma_stall bigint")
    ops = spark.createDataFrame([(1, 1, "MatMul", "c", 34, 1)], "program_id bigint, symbol_id bigint, name string, category string, flops bigint, bytes bigint")
    r = mt.op_metrics(events, ops, 2.0).first()
    assert (r.self_time, r.flops, r.normalized_time, r.occurrences) == (10_000, 68, 20_000.0, 2)


def test_visibility():
    assert tl.visible([950, 1050, 1055, 1355], [50, 50, 200, 50], 100) == [True, False, True, True]
    assert tl.visible([1000, 1200, 1250, 1270, 1290], [200, 190, 20, 20, 100], 100) == [True, True, True, False, True]


def test_timeline_levels(spark):
    rng = random.Random(4)
    rows = sorted((rng.randrange(10**6), rng.randrange(1, 10**5)) for _ in range(60))
    got = {r.seq: r.level for r in tl.timeline_levels(spans(spark, rows), ["g"]).collect()}
    b, d = [r[0] for r in rows], [r[1] for r in rows]
    order = sorted(range(60), key=lambda i: (b[i], -d[i], i))
    shown = [tl.visible([b[i] for i in order], [d[i] for i in order], r) for r in tl.LEVELS]
    for at, i in enumerate(order):  # the coarsest level from which on the span is always drawn
        level = 12
        while level and shown[level - 1][at]:
            level -= 1
        assert got[i] == level


def test_group_spans_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 4), (5, 6)], "u bigint, v bigint")
    roots = spark.createDataFrame([(1, 7), (9, 3)], "node bigint, rank bigint")
    got = {r.node: r.group_id for r in gr.group_spans(edges, roots).collect()}
    assert got == {1: 7, 2: 7, 3: 7, 4: 3, 9: 3}


def test_memory_profile(spark):
    rows = [(0, 1, 0, "alloc", 222333, 256, 3000, 2000, 95000, 1, "a"), (0, 2, 1, "free", 222333, 256, 2744, 2000, 95256, 1, "a"), (0, 3, 2, "alloc", 345678, 300, 5000, 2000, 93000, 1, "b")]
    df = spark.createDataFrame(rows, "allocator bigint, ts bigint, seq bigint, kind string, address bigint, bytes bigint, heap bigint, stack bigint, free bigint, step_id bigint, op string")
    assert mm.memory_summary(df).first()["peak"] == 7000
    live = {r.op: r.bytes for r in mm.live_at_peak(df).collect()}
    assert live == {"b": 300, "stack": 2000, "unmapped": 4700}


def test_shared_buffers(spark):
    rows = [(0, 1, "alloc", 1, None, 10), (0, 2, "share", 2, 1, 10), (0, 3, "share", 3, 2, 10), (0, 4, "free", 1, None, 10), (0, 5, "free", 3, None, 10), (0, 6, "alloc", 4, None, 5), (0, 7, "free", 2, None, 10)]
    df = spark.createDataFrame(rows, "program_id bigint, seq bigint, kind string, buffer_id bigint, canonical_id bigint, size bigint")
    assert [r.level for r in mm.buffer_timeline(df).orderBy("seq").collect()] == [10, 10, 10, 10, 10, 15, 5]


def test_unknown_host(spark):
    df = spark.createDataFrame([("h0",)], "host string")
    with pytest.raises(ValueError):
        fl.select_hosts(df, "nope")


def test_plans(spark):
    from spanforge.sources.adapters import Trace

    t = Trace(spark, "/root/testdata/sf0.001")
    for df in (iv.assign_step(t.spans, t.steps, ["plane_id"], 10**9), iv.contained_in(t.spans, t.steps, ["plane_id"], 10**9)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    plan = t.spans.where("seq > 10").select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,10)" in plan


# trace files


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def space():
    meta = b"".join(_field(4, _field(1, k) + _field(2, _field(1, k) + _field(2, n))) for k, n in ((1, "add"), (2, "mul")))
    line = _field(1, 7) + _field(2, "XLA Ops") + _field(3, 5) + b"".join(_field(4, _field(1, m) + _field(2, o) + _field(3, d)) for m, o, d in ((1, 10, 5), (2, 20, 6)))
    return _field(1, _field(1, 3) + _field(2, "/device:TPU:0") + meta + _field(3, line))


def test_ingest(spark, tmp_path):
    for session, host, content in (("s1", "a", space()), ("s1", "b", space()), ("s2", "a", b"\x0a\xff"), ("s2", "b", struct.pack("<Q", 2**63))):
        folder = tmp_path / "x" / "plugins" / "profile" / session
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{host}.xplane.pb").write_bytes(content)
    listed = {(r.session, r.host) for r in traces.list_sessions(spark, str(tmp_path)).collect()}
    assert listed == {("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "b")}
    got = traces.ingest_spaces(spark, str(tmp_path)).collect()
    good = sorted((r.session, r.host, r.plane, r.line, r.name, r.begin, r.dur) for r in got if r.error is None)
    assert good == [("s1", h, "/device:TPU:0", "XLA Ops", n, b, d) for h in "ab" for n, b, d in (("add", 10, 5), ("mul", 20, 6))]
    assert {(r.session, r.host) for r in got if r.error} == {("s2", "a"), ("s2", "b")}
    folder = tmp_path / "y" / "plugins" / "profile" / "s3"
    folder.mkdir(parents=True)
    (folder / "a.xplane.pb").write_bytes(space() + b"\x0a\xff")  # breaks after two good events
    (folder / "b.xplane.pb").write_bytes(space())
    broken = traces.ingest_spaces(spark, str(tmp_path / "y")).collect()
    assert sorted((r.host, r.error is None) for r in broken) == [("a", False), ("b", True), ("b", True)]
    small = traces.ingest_spaces(spark, str(tmp_path / "y"), limit=len(space())).collect()
    assert sorted((r.host, r.error) for r in small) == [("a", "file is too large"), ("b", None), ("b", None)]
    (folder / "a.xplane.pb").unlink()
    (folder / "b.xplane.pb").unlink()
    traces.convert(spark, str(tmp_path), str(tmp_path / "table"))
    table = traces.load_trace(spark, str(tmp_path / "table"), traces.SPANS + ", rejected boolean")
    assert table.where("not rejected").count() == 4 and table.where("rejected").count() == 2
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a second run finds nothing new
        ingest.stream_ingest(spark, str(tmp_path / "x"), out, state).awaitTermination()
    assert spark.read.parquet(out).where("error is null").count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', 2)], "x bigint, name string, y bigint")
    sinks.to_csv(df.coalesce(1), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ['"x","name","y"', '"1","a ""b""","2"']
    table, props = sinks.report_table(df, {"x": "X"}, {"title": "T"})
    assert table.schema["x"].metadata == {"label": "X"} and props.first()["title"] == "T"
    s = spark.createDataFrame([(0, 0, 5, 2, 0, "n", "p")], "plane_id bigint, line_id bigint, begin bigint, dur bigint, seq bigint, name string, plane string")
    sinks.to_chrome_trace(s, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    sinks.to_delta_series(s, ["plane_id"], str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).first()["delta"] == 5


def test_overlap_of_long_and_short_spans(spark):
    """Pairs of long and short spans are found once each, without a bin per tick of the long ones."""
    rng = random.Random(9)
    make = lambda n, k: [(rng.randrange(2), k + i, rng.randrange(5000), rng.choice([0, 3, 40, 900, 4000])) for i in range(n)]
    schema = "plane_id int, seq int, begin bigint, dur bigint"
    a, b = make(120, 0), make(120, 1000)
    got = sorted((r.seq, r.r_seq) for r in iv.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["plane_id"], 10).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[2] + y[3] and y[2] <= x[2] + x[3])
    day = spark.createDataFrame([(0, 1, 0, 10**13)], schema)  # ten million bins of the narrow width
    assert iv.overlap_join(day, spark.createDataFrame([(0, 2, 5, 1)], schema), ["plane_id"], 10**9).count() == 1


def test_ranks_over_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    want = {}
    for k in "ab":
        for n, (_, _, i) in enumerate(sorted(r for r in rows if r[0] == k)):
            want[i] = n
    assert {r.i: r["rank"] for r in ranks.ranked(df, ["v", "i"], ["k"]).collect()} == want
    assert [r.i for r in ranks.ranked(df, ["i"]).orderBy("rank").collect()] == list(range(2000))
    assert ranks.ranked(df.where("false"), ["i"]).count() == 0
