"""Trace files with typed stats: written, decoded, converted, and what uses them."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from spanforge.operators import joins as jn
from spanforge.sources import spaces as sp, traces

body, number = sp._body, sp._number


def entry(field, k, *parts):
    return body(field, number(1, k) + body(2, number(1, k) + b"".join(parts)))


def content():
    """One plane with every kind of stat, on the plane, on an entry and on an event; unknown fields and names."""
    names = ["i", "neg", "big", "real", "text", "raw", "ref", "shared text", "own", "correlation_id"]
    dictionary = b"".join(entry(5, k + 1, body(2, n.encode())) for k, n in enumerate(names))
    stat = lambda k, field, x: body(4, number(1, k) + (body(field, x) if isinstance(x, bytes) else number(field, x)))
    real = body(4, number(1, 4) + bytes([2 << 3 | 1]) + struct.pack("<d", -2.5))
    event = number(1, 1) + number(2, 10) + number(3, 5)
    event += stat(1, 4, 7) + stat(2, 4, -3) + stat(3, 3, 2**64 - 1) + real + stat(5, 5, "é".encode()) + stat(6, 6, b"\x00\xff") + stat(7, 7, 8) + stat(99, 3, 1) + stat(1, 4, 8)
    line = number(1, 7) + body(2, b"XLA Ops") + body(11, b"shown") + number(3, 10**18 + 5) + body(4, event) + body(4, number(1, 2))
    late = number(1, 8) + body(2, b"late") + number(3, 10**18 + 6) + body(4, number(1, 1) + number(2, 1) + number(5, 4))
    meta = entry(4, 1, body(2, b"add"), body(5, number(1, 9) + number(3, 5)), body(5, number(1, 1) + number(3, 1))) + entry(4, 2, body(2, b"long"), body(4, b"mul"))
    plane = number(1, 3) + body(2, b"/device:TPU:0") + meta + dictionary + body(3, line) + body(3, late) + body(6, number(1, 9) + body(5, b"plane's"))
    return body(1, plane) + body(4, b"hostname")


@pytest.fixture
def folder(tmp_path):
    def write(name, files):
        for (session, host), data in files.items():
            at = tmp_path / name / "plugins" / "profile" / session
            at.mkdir(parents=True, exist_ok=True)
            (at / f"{host}.xplane.pb").write_bytes(data)
        return str(tmp_path / name)

    return write


def test_every_kind_of_stat(spark, folder, tmp_path):
    root = folder("x", {("s1", "a"): content(), ("s1", "b"): content()[:-4], ("s2", "a"): b"", ("s2", "b"): b"\x0a\xff"})
    sp.convert_spaces(spark, root, str(tmp_path / "out"))
    t = sp.load_tables(spark, str(tmp_path / "out"))
    assert sorted((r.session, r.host) for r in t["rejected"].collect()) == [("s1", "b"), ("s2", "b")]
    (plane,) = t["planes"].collect()
    assert (plane.plane_id, plane.plane, plane.stats["own"].text) == (3, "/device:TPU:0", "plane's")
    assert sorted(tuple(r)[4:] for r in t["lines"].collect()) == [(7, "XLA Ops", "shown", 0, 0), (8, "late", "", 1000, 0)]
    assert sorted((r.meta_id, r.name, r.display, len(r.stats)) for r in t["event_meta"].collect()) == [(1, "add", "", 2), (2, "long", "mul", 0)]
    rows = sorted(t["spans"].collect(), key=lambda r: (r.line_id, r.seq))
    assert [(r.line, r.seq, r.name, r.begin, r.dur, r.occurrences) for r in rows] == [("shown", 0, "add", 10, 5, 1), ("shown", 1, "mul", 0, 0, 1), ("late", 0, "add", 1001, 0, 4)]
    got = {k: next(x for x in v if x is not None) for k, v in rows[0].stats.items()}
    assert got == {"i": 7, "neg": -3, "big": -1, "real": -2.5, "text": "é", "raw": bytearray(b"\x00\xff"), "ref": "shared text"}
    joined = sp.with_stats(t["spans"], t["event_meta"]).where("seq = 0").orderBy("line_id")
    assert [tuple(r) for r in joined.select(sp.stat_int("own"), sp.stat_int("i"), sp.stat_text("real"), sp.stat_text("raw"), sp.stat_int("text")).collect()] == [
        (5, 7, "-2.5", "00FF", None), (5, 1, None, None, None),
    ]


def test_large_and_empty_files(spark, folder):
    root = folder("y", {("s1", "a"): content(), ("s1", "b"): b""})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    got = sp.decode_tables(files, limit=10).collect()
    assert [(r.host, r.kind, r.error) for r in got] == [("a", "rejected", "file is too large")]
    assert sp.decode_tables(files.where("false")).count() == 0


def test_round_trip(spark, folder):
    """Encoded spans come back, with entries' stats; the reader that knows names only reads the same files."""
    value = f"map<string, {sp.VALUE}>"
    one = lambda **x: {k: {"int": None, "real": None, "text": None, "raw": None} | v for k, v in x.items()}
    rows = [("s", f"h{i % 2}", i % 3, f"p{i % 3}", 1, "l", i, f"n{i % 2}", 1000 * (40 - i), i, one(k={"int": i - 5}, t={"text": "same"}, u={"text": f"own {i}"}, r={"real": i / 4}, b={"raw": bytes([i])})) for i in range(12)]
    spans = spark.createDataFrame(rows, f"session string, host string, plane_id bigint, plane string, line_id bigint, line string, seq bigint, name string, begin bigint, dur bigint, stats {value}")
    meta = spark.createDataFrame([("n0", one(k={"int": 77}, z={"text": "same"}))], f"name string, stats {value}")
    files = sp.encode_spaces(spans, meta, origin_ns=10**18).collect()
    assert {bytes(f.content).count(b"same") for f in files} == {3}  # once in the dictionary of each plane
    root = folder("z", {(f.session, f.host): bytes(f.content) for f in files})
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    t = sp.tables(sp.decode_tables(read))
    least = {h: min(r[8] for r in rows if r[1] == h) for h in ("h0", "h1")}
    want = sorted((r[1], r[2], r[7], r[8] - least[r[1]], r[9], sorted(r[10])) for r in rows)
    got = sorted((r.host, r.plane_id, r.name, r.begin, r.dur, sorted(r.stats)) for r in t["spans"].collect())
    assert got == want
    values = {r.stats["u"].text: (r.stats["k"].int, r.stats["t"].text, r.stats["r"].real, bytes(r.stats["b"].raw)) for r in t["spans"].collect()}
    assert values == {f"own {i}": (i - 5, "same", i / 4, bytes([i])) for i in range(12)}
    assert {(r.name, r.stats.get("z") and r.stats["z"].text) for r in t["event_meta"].collect()} == {("n0", "same"), ("n1", None)}
    assert traces.ingest_spaces(spark, root).where("error is null").count() == 12


def test_links_by_name_and_by_stat(spark):
    """Named connections take precedence, launches have no process, a missing part of a key gives no link."""
    value = f"map<string, {sp.VALUE}>"
    one = lambda **x: {k: {"int": v, "real": None, "text": None, "raw": None} for k, v in x.items()}
    rows = [
        (1, "EnqueueRequestLocked", one(request_id=1, queue_addr=2, _p=5, _pt=3, _pid=9), None), (2, "CustomWait", one(request_id=1, _pid=9), one(queue_addr=2)),
        (3, "CustomWait", one(request_id=1, _c=5, _ct=3, _pid=9), None), (4, "any", one(_p=5, _pt=3, _pid=9), None),
        (5, "DoEnqueueProgram", one(device_ordinal=0, queue_id=1, run_id=(7 << 27) + 6, _pid=1), None), (6, "CompleteCallbacks", one(device_ordinal=0, queue_id=1, run_id=6, _pid=2), None),
        (7, "any", one(_c=5, _ct=3, _pid=8), None), (8, "any", None, None),
    ]
    df = spark.createDataFrame(rows, f"seq bigint, name string, stats {value}, meta_stats {value}").withColumns({"session": F.lit("s"), "host": F.lit("h")})
    got = sorted(tuple(r) for r in jn.connect_flows(sp.flow_links(df, F.col("seq"))).collect())
    assert got == [(1, 2), (4, 3), (5, 6)]
    other = df.withColumn("host", F.when(F.col("seq") == 2, "other").otherwise(F.col("host")))
    assert sorted(tuple(r) for r in jn.connect_flows(sp.flow_links(other, F.col("seq"))).collect()) == [(4, 3), (5, 6)]


def test_files_in_pieces(spark):
    """Rows of a file come in several batches, are kept packed and come back in order, with the texts that repeat across batches."""
    spans = spark.range(5_000).select(
        F.lit("s").alias("session"), F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("host"), F.lit(7).cast("bigint").alias("plane_id"), F.lit("p").alias("plane"), F.lit(1).cast("bigint").alias("line_id"),
        F.lit("l").alias("line"), F.col("id").alias("seq"), F.lit("n").alias("name"), (F.col("id") * 1000).alias("begin"), F.lit(5).cast("bigint").alias("dur"),
        F.expr("map('own', named_struct('int', NULL, 'real', NULL, 'text', concat('text ', id % 4000), 'raw', NULL))").cast(f"map<string, {sp.VALUE}>").alias("stats"),
    )
    files = sp.encode_spaces(spans)
    assert [bytes(f.content).count(b"text 999") for f in files.orderBy("host").collect()] == [0, 1]  # of 999 and 4999, once
    back = sp.tables(sp.decode_tables(files))["spans"].select("host", "seq", "begin", F.col("stats")["own"]["text"].alias("own"))
    assert sorted(tuple(r) for r in back.collect()) == sorted((f"h{i % 2}", i // 2, i * 1000, f"text {i % 4000}") for i in range(5_000))


def test_rows_kept_packed():
    """What is kept of a file until its end is smaller than its batches."""
    rows = sp._Rows("s", "h")
    for k in range(4_000):
        rows.add("span", 1, "plane", 2, "line", k, 3, "name", None, k, 1, 1, [("note", (None, None, "a text that many spans have", None))])
    batches = list(rows.all())
    assert [b.num_rows for b in batches] == [2_000, 2_000] and sum(len(b) for b in rows.batches) * 4 < sum(b.nbytes for b in batches)


def test_spans_without_frame_are_spread(spark):
    """Most spans have no frame; a join on that null key would send them to one task."""
    value = f"map<string, {sp.VALUE}>"
    spans = spark.range(1_000).select(F.lit("s").alias("session"), F.lit("h").alias("host"), F.col("id").alias("seq"), F.lit(None).cast(value).alias("stats"), F.lit(None).cast(value).alias("meta_stats"))
    frames = spark.createDataFrame([(1, 5, "a text")], "frame bigint, fingerprint bigint, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = sp.with_frame(spans, frames).groupBy(F.spark_partition_id().alias("p"), "frame").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.frame for r in got} == {None} and sum(r["count"] for r in got) == 1_000 and max(r["count"] for r in got) < 400
