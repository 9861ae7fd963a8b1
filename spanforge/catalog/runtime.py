"""Queries of counters, memory, serving, collectives and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import collectives as cl
from spanforge.operators import counters as ct
from spanforge.operators import memory as mm
from spanforge.operators import serving as sv
from spanforge.operators import timeline as tl

from .registry import query
from .tables import _BREAKDOWN, breakdown

# counters

_LAST = """last_values AS (SELECT device_id, line_id, counter_id, value FROM (SELECT *, row_number() OVER (PARTITION BY device_id, line_id, counter_id ORDER BY "offset" DESC, dur ASC, seq DESC, value DESC) AS r FROM counters) WHERE r = 1)"""
_FORMULAS = """formulas AS (SELECT metric, counter_id, weight, peak_counter, factor FROM (VALUES ('scalar', 1, 1, 3, 2), ('scalar', 2, 1, 3, 2), ('vector', 4, 2, 3, 4), ('memory', 5, 1, 6, 1), ('memory', 7, 3, 6, 1)) AS v(metric, counter_id, weight, peak_counter, factor))"""


def formulas(t):
    """Formula table of a made-up device, derived from rows of the trace's counters."""
    ids = t.counters.where("counter_id in (1, 2, 4, 5, 7)").select("counter_id").distinct()
    cid = F.col("counter_id")
    metric = F.when(cid <= 2, "scalar").when(cid == 4, "vector").otherwise("memory")
    return ids.select(
        metric.alias("metric"), "counter_id", F.when(cid == 4, 2).when(cid == 7, 3).otherwise(1).alias("weight"),
        F.when(cid <= 4, 3).otherwise(6).cast("bigint").alias("peak_counter"), F.when(cid <= 2, 2).when(cid == 4, 4).otherwise(1).alias("factor"),
    )


@query("a21_counter_values_last", "SELECT * FROM last_values", _LAST)
def counter_values_last(t):
    c = t.counters.withColumn("seq", F.struct("seq", "value"))
    return ct.counter_values(c)


@query("a21_counter_values_sum", "SELECT device_id, line_id, counter_id, CAST(sum(value) AS BIGINT) AS value FROM counters GROUP BY ALL")
def counter_values_sum(t):
    return ct.counter_values(t.counters, "sum")


_UTIL = """sums AS (SELECT device_id, counter_id, CAST(sum(value) AS BIGINT) AS value FROM counters GROUP BY ALL),
util AS (SELECT s.device_id, f.metric, CAST(sum(f.weight * s.value) AS BIGINT) AS achieved, CAST(any_value(p.value) * any_value(f.factor) AS BIGINT) AS peak FROM sums s JOIN formulas f USING (counter_id)
  JOIN sums p ON p.device_id = s.device_id AND p.counter_id = f.peak_counter GROUP BY ALL)"""


@query("a22_hw_utilization", "SELECT * FROM util", _FORMULAS + ", " + _UTIL)
def hw_utilization(t):
    return ct.hw_utilization(ct.counter_values(t.counters, "sum"), formulas(t))


@query(
    "a23_kernel_utilization",
    """SELECT s.device_id, s.line_id AS kernel, f.metric, round(100.0 * sum(f.weight * s.value) / (any_value(p.value) * any_value(f.factor)), 4) AS percent,
  f.metric = 'vector' AND 100.0 * sum(f.weight * s.value) / (any_value(p.value) * any_value(f.factor)) > 100 AS anomaly
  FROM (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters GROUP BY ALL) s JOIN formulas f USING (counter_id)
  JOIN (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters GROUP BY ALL) p ON p.device_id = s.device_id AND p.line_id = s.line_id AND p.counter_id = f.peak_counter GROUP BY s.device_id, s.line_id, f.metric""",
    _FORMULAS,
)
def kernel_utilization(t):
    return ct.kernel_utilization(t.counters, formulas(t), "vector").withColumn("percent", F.round("percent", 4))


@query("a24_utilization_summary", "SELECT metric, round(avg(achieved * 100.0 / peak), 4) AS percent FROM util WHERE peak > 0 GROUP BY metric", _FORMULAS + ", " + _UTIL)
def utilization_summary(t):
    return ct.utilization_summary(ct.hw_utilization(ct.counter_values(t.counters, "sum"), formulas(t))).withColumn("percent", F.round("percent", 4))


@query("r16_perf_counters", """SELECT device_id, line_id, counter_id, concat('counter ', counter_id) AS description, value, concat('0x', lower(hex(value))) AS hex, seq FROM counters WHERE value >= 10""")
def perf_counters(t):
    rows = t.counters.where("value >= 10")
    return ct.perf_counters(rows, F.concat(F.lit("counter "), "counter_id")).drop("offset", "dur")


# memory


@query(
    "w8_step_carry",
    """SELECT seq, coalesce(CASE WHEN step_id >= 0 THEN step_id END, last_value(CASE WHEN step_id >= 0 THEN step_id END IGNORE NULLS) OVER (PARTITION BY allocator ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) + 1, 0) AS step FROM alloc_events""",
)
def step_carry(t):
    return mm.step_carry(t.alloc_events).select("seq", "step")


@query(
    "w9_sample_buckets",
    """SELECT allocator, seq FROM (SELECT *, row_number() OVER (PARTITION BY allocator, b ORDER BY heap + stack DESC, i) AS r FROM (SELECT *, CASE WHEN n <= 100 THEN i
  WHEN i < (100 * (n // 100 + 1) - n) * (n // 100) THEN i // (n // 100) ELSE (100 * (n // 100 + 1) - n) + (i - (100 * (n // 100 + 1) - n) * (n // 100)) // (n // 100 + 1) END AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY allocator ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY allocator) AS n FROM alloc_events))) WHERE r = 1""",
)
def sample_buckets(t):
    return mm.sample_buckets(t.alloc_events, 100).select("allocator", "seq")


_PEAK = """peak AS (SELECT allocator, ts AS peak_ts, seq AS peak_seq, heap + stack AS peak, heap + stack + free AS capacity FROM (SELECT *, row_number() OVER (PARTITION BY allocator ORDER BY heap + stack DESC, ts DESC, seq DESC) AS r FROM alloc_events) WHERE r = 1)"""


@query("a34_memory_summary", "SELECT peak.*, (SELECT max(heap) FROM alloc_events a WHERE a.allocator = peak.allocator) AS lifetime_peak FROM peak", _PEAK)
def memory_summary(t):
    return mm.memory_summary(t.alloc_events)


_LIVE = _PEAK + """, last AS (SELECT allocator, address, arg_max(kind, (ts, seq)) AS kind, arg_max(bytes, (ts, seq)) AS bytes, arg_max(op, (ts, seq)) AS op FROM alloc_events JOIN peak USING (allocator)
  WHERE (ts, seq) <= (peak_ts, peak_seq) GROUP BY ALL), live AS (SELECT allocator, op, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM last WHERE kind = 'alloc' GROUP BY ALL),
at_peak AS (SELECT a.* FROM alloc_events a JOIN peak p ON a.allocator = p.allocator AND a.seq = p.peak_seq)"""


@query(
    "a36_live_at_peak",
    """SELECT * FROM live UNION ALL SELECT allocator, 'stack', 1, stack FROM at_peak UNION ALL
  SELECT allocator, 'unmapped', 1, CAST(greatest(heap - coalesce((SELECT sum(bytes) FROM live l WHERE l.allocator = at_peak.allocator), 0), 0) AS BIGINT) FROM at_peak""",
    _LIVE,
)
def live_at_peak(t):
    return mm.live_at_peak(t.alloc_events)


@query(
    "a35_peak_allocations",
    """SELECT module, name, unit, count, bytes FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY bytes DESC, name, unit) AS r FROM (SELECT program_id AS module,
  CASE WHEN bytes < 95000 THEN 'Others' ELSE concat('b', symbol_id % 9, '.*') END AS name, CASE WHEN bytes < 95000 THEN 0 ELSE bytes END AS unit, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM ops GROUP BY 1, 2, 3)) WHERE r <= 10""",
)
def peak_allocations(t):
    b = t.ops.select(F.col("program_id").alias("module"), F.concat(F.lit("b"), F.col("symbol_id") % 9, F.lit("."), "symbol_id").alias("name"), F.col("bytes").alias("size"))
    return mm.peak_allocations(b, 95_000, 10)


_BUFFERS = """buffers AS (SELECT CAST(allocator AS BIGINT) AS program_id, seq, kind, address AS buffer_id, bytes AS size FROM alloc_events),
levels AS (SELECT program_id, seq, kind, buffer_id, CAST(sum(d) OVER (PARTITION BY program_id, buffer_id ORDER BY seq) AS BIGINT) AS refs, d, max(CASE WHEN kind = 'alloc' THEN size END) OVER (PARTITION BY program_id, buffer_id) AS size
  FROM (SELECT *, CASE WHEN kind = 'free' THEN -1 ELSE 1 END AS d FROM buffers)),
timeline AS (SELECT program_id, seq, kind, buffer_id, refs, CAST(sum(coalesce(CASE WHEN d = 1 AND refs = 1 THEN size WHEN d = -1 AND refs = 0 THEN -size ELSE 0 END, 0)) OVER (PARTITION BY program_id ORDER BY seq) AS BIGINT) AS level FROM levels)"""


def buffers(t):
    return t.alloc_events.select(F.col("allocator").alias("program_id"), "seq", "kind", F.col("address").alias("buffer_id"), F.lit(None).cast("bigint").alias("canonical_id"), F.col("bytes").alias("size"))


@query("w14_buffer_timeline", "SELECT * FROM timeline", _BUFFERS)
def buffer_timeline(t):
    return mm.buffer_timeline(buffers(t))


@query("w14_heap_peak", "SELECT program_id, max(level) AS peak, (SELECT min(seq) FROM timeline x WHERE x.program_id = timeline.program_id AND x.level = max(timeline.level)) AS peak_seq FROM timeline GROUP BY program_id", _BUFFERS)
def heap_peak(t):
    return mm.heap_peak(mm.buffer_timeline(buffers(t)))


# serving


@query("a26_throughput_latency", "SELECT model, count(*) AS requests, round(count(*) / ((max(end_ts) - min(begin)) / 1e6), 8) AS per_second, round(avg(end_ts - begin), 2) AS latency FROM requests GROUP BY model")
def throughput_latency(t):
    return sv.throughput_latency(t.requests, ["model"]).withColumn("per_second", F.round("per_second", 8)).withColumn("latency", F.round("latency", 2))


@query(
    "a27_serving_stats",
    """SELECT model, r.requests, batches, latency, round(pairs / batches, 6) AS per_batch, round(r.requests / (SELECT count(*) FROM requests), 6) AS share FROM
  (SELECT model, count(*) AS requests, round(avg(end_ts - begin), 2) AS latency FROM requests GROUP BY model) r
  JOIN (SELECT model, count(DISTINCT batch_id) AS batches, count(*) AS pairs FROM requests JOIN request_batch USING (request_id) GROUP BY model) USING (model)""",
)
def serving_stats(t):
    out = sv.serving_stats(t.requests, t.request_batch)
    return out.withColumns({"latency": F.round("latency", 2), "per_batch": F.round("per_batch", 6), "share": F.round("share", 6)})


_PCT = ", ".join(f"max(CASE WHEN i = least(CAST(floor({p} * n / 100) AS BIGINT), n - 1) THEN v END) AS p{p:g}".replace(".9 ", ".9 ").replace("p99.9", "p99_9") for p in sv.PERCENTS)
_PCT_FROM = "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY v, request_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ({src}))"


@query("a28_pattern_percentiles", f"SELECT k AS model, count(*) AS count, {_PCT} FROM " + _PCT_FROM.format(src="SELECT model AS k, end_ts - begin AS v, request_id FROM requests") + " GROUP BY k")
def pattern_percentiles(t):
    r = t.requests.withColumn("latency", F.col("end_ts") - F.col("begin"))
    return sv.pattern_percentiles(r, "latency", ["request_id"], ["model"])


@query(
    "a29_sample_percentiles",
    "SELECT request_id FROM (SELECT *, row_number() OVER (ORDER BY end_ts - begin, request_id) - 1 AS i, count(*) OVER () AS n FROM requests) WHERE n <= 60 OR "
    + " OR ".join(f"i BETWEEN floor({p} * n / 100) - 5 AND floor({p} * n / 100) + 4" for p in (50, 75, 90, 99, 99.9, 99.99)),
)
def sample_percentiles(t):
    r = t.requests.withColumn("latency", F.col("end_ts") - F.col("begin"))
    return sv.sample_percentiles(r, "latency", ["request_id"]).select("request_id")


@query(
    "a30_latency_breakdown",
    f"SELECT k AS part, count(*) AS count, {_PCT}, round(avg(v), 2) AS avg FROM "
    + _PCT_FROM.format(src="SELECT 'total' AS k, end_ts - begin AS v, request_id FROM requests UNION ALL SELECT 'device', (end_ts - begin) // 3, request_id FROM requests")
    + " GROUP BY k",
)
def latency_breakdown(t):
    d = F.col("end_ts") - F.col("begin")
    r = t.requests.withColumn("total", d).withColumn("device", F.expr("(end_ts - begin) DIV 3"))
    return sv.latency_breakdown(r, ["total", "device"], ["request_id"]).withColumn("avg", F.round("avg", 2))


_FRACTION = """fraction AS (SELECT t.plane_id, t.step, coalesce(u.used, 0) / t.dur AS fraction FROM steps t LEFT JOIN (SELECT plane_id, begin // 86400000000 AS step, sum(dur) AS used FROM spans WHERE name = 'view' GROUP BY ALL) u USING (plane_id, step)
  WHERE t.step > (SELECT min(step) FROM steps) AND t.step < (SELECT max(step) FROM steps))"""


def fractions(t):
    views = t.spans.where("name = 'view'").withColumn("step", F.expr("begin DIV 86400000000"))
    return sv.event_fraction(views, t.steps, "plane_id")


@query("a31_event_fraction", "SELECT plane_id, step, round(fraction, 8) AS fraction FROM fraction", _FRACTION)
def event_fraction(t):
    return fractions(t).withColumn("fraction", F.round("fraction", 8))


@query(
    "a32_stragglers",
    """SELECT host, v FROM (SELECT *, (SELECT x.d FROM (SELECT d, row_number() OVER (ORDER BY d, host) AS r FROM dev) x WHERE x.r = (SELECT count(*) // 2 + 1 FROM dev)) AS mad FROM dev)
  WHERE CASE WHEN mad > 0 THEN abs(0.6745 * (v - m) / greatest(mad, 0.1)) > 3.5 ELSE d > 1e-10 END""",
    """hv AS (SELECT o_custkey AS host, max(o_totalprice) AS v FROM orders GROUP BY 1),
dev AS (SELECT host, v, m, abs(v - m) AS d FROM hv, (SELECT v AS m FROM (SELECT v, row_number() OVER (ORDER BY v, host) AS r FROM hv) WHERE r = (SELECT count(*) // 2 + 1 FROM hv)))""",
)
def stragglers(t):
    hosts = t.table("orders").groupBy(F.col("o_custkey").alias("host")).agg(F.max("o_totalprice").alias("v"))
    return sv.stragglers(hosts, "v")


@query("a33_category_share", "SELECT round(avg(m / t), 8) AS share FROM (SELECT step, sum(time) AS t, sum(CASE WHEN category IN ('view', 'click') THEN time ELSE 0 END) AS m FROM breakdown GROUP BY step) WHERE t > 0", _BREAKDOWN)
def category_share(t):
    return sv.category_share(breakdown(t), ["view", "click"]).withColumn("share", F.round("share", 8))


_STEPS = _BREAKDOWN + """, pod AS (SELECT plane_id, step, CAST(sum(time) AS BIGINT) AS dur, arg_max(category, (time, category)) AS bottleneck FROM breakdown GROUP BY ALL),
one AS (SELECT step, CAST(max(dur) AS BIGINT) AS dur, min(bottleneck) AS bottleneck FROM pod GROUP BY step)"""


def pod(t):
    top = F.max_by("category", F.struct("time", "category"))
    return breakdown(t).groupBy("plane_id", "step").agg(F.sum("time").alias("dur"), top.alias("bottleneck"))


@query("r8_pod_view", "SELECT * FROM pod", _STEPS)
def pod_view(t):
    """Step x core breakdown with its bottleneck."""
    return pod(t)


@query(
    "a40_step_summary",
    """SELECT count(*) AS steps, round(avg(dur), 2) AS avg, min(dur) AS min, max(dur) AS max, round(stddev_samp(dur) / 1000, 2) AS sd,
  (SELECT bottleneck FROM one GROUP BY bottleneck ORDER BY count(*) DESC, min(step) LIMIT 1) AS bottleneck FROM one""",
    _STEPS,
)
def step_summary(t):
    one = pod(t).groupBy("step").agg(F.max("dur").alias("dur"), F.min("bottleneck").alias("bottleneck"))
    return sv.step_summary(one).withColumn("avg", F.round("avg", 2)).withColumn("sd", F.round(F.col("sd") / 1000, 2))


# collectives

_SLACK = """tracked AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY device_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM visits WHERE opcode <> 'other'),
pairs AS (SELECT r.device_id, r.rendezvous, r.seq, r.ts, r.dur, r.before, max(s.ts) AS sts FROM tracked r JOIN tracked s ON s.device_id = r.device_id AND s.rendezvous = r.rendezvous AND s.opcode = 'send' AND s.ts < r.ts
  WHERE r.opcode = 'recv-done' GROUP BY ALL),
slack AS (SELECT p.device_id, p.rendezvous, p.seq, CAST(p.ts - p.sts - (p.before - s.before) AS BIGINT) AS slack, CAST((SELECT sum(o.dur) FROM tracked o WHERE o.device_id = p.device_id AND o.rendezvous = p.rendezvous AND o.ts BETWEEN p.sts AND p.ts) AS BIGINT) AS stall,
  p.ts + p.dur - p.sts AS observed, s.dur AS send FROM pairs p JOIN tracked s ON s.device_id = p.device_id AND s.rendezvous = p.rendezvous AND s.ts = p.sts)"""


@query("w11_slack_overlap", "SELECT * FROM slack", _SLACK)
def slack_overlap(t):
    return cl.slack_overlap(t.visits)


_CSUM = "(SELECT {d}rendezvous, count(*) AS occurrences, " + ", ".join(f"CAST(trunc(sum({c}) / count(*)) AS BIGINT) AS {c}" for c in ("slack", "stall", "observed", "send")) + " FROM slack GROUP BY {d}rendezvous)"
_CSUM = _CSUM.replace("trunc(sum(", "(sum(").replace(") / count(*))", ") // count(*))")


@query("a25_collective_summary", "SELECT * FROM " + _CSUM.format(d=""), _SLACK)
def collective_summary(t):
    return cl.collective_summary(cl.slack_overlap(t.visits))


@query(
    "a25_merge_collectives",
    "SELECT rendezvous, CAST(sum(occurrences) AS BIGINT) AS occurrences, " + ", ".join(f"CAST(sum({c} * occurrences) // sum(occurrences) AS BIGINT) AS {c}" for c in ("stall", "observed", "send")) + " FROM " + _CSUM.format(d="device_id, ") + " GROUP BY rendezvous",
    _SLACK,
)
def merge_collectives(t):
    o = cl.slack_overlap(t.visits)
    parts = [cl.collective_summary(o.where(f"device_id = {d}")) for d in (0, 1)]
    return cl.merge_collectives(parts[0].unionByName(parts[1])).drop("slack")


@query(
    "a42_counter_series",
    """SELECT device_id, t, CAST(sum(d) OVER (PARTITION BY device_id ORDER BY t) AS BIGINT) AS level FROM (SELECT device_id, t, sum(d) AS d FROM
  (SELECT device_id, ts AS t, 1 AS d FROM visits UNION ALL SELECT device_id, ts + dur, -1 FROM visits) GROUP BY ALL)""",
)
def counter_series(t):
    return cl.counter_series(t.visits, ["device_id"], F.lit(1))


@query(
    "w13_infer_run_ids",
    """SELECT seq, coalesce(CASE WHEN opcode = 'send' THEN seq END, sum(CASE WHEN opcode = 'send' THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY ts, seq)) AS run_id FROM visits""".replace(
        "ORDER BY ts, seq)) AS run_id", "ORDER BY ts, seq))::BIGINT AS run_id"
    ),
)
def infer_run_ids(t):
    v = t.visits.withColumn("run", F.expr("CASE WHEN opcode = 'send' THEN seq END"))
    return cl.infer_run_ids(v, ["device_id"], "run").select("seq", "run_id")


@query(
    "w4_hide_tiny",
    """SELECT device_id, min(seq) AS seq, min(ts) AS ts, max(ts + dur) - min(ts) AS dur, string_agg(opcode, ', ' ORDER BY ts, seq) AS name, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY device_id ORDER BY ts, seq) AS i FROM (
  SELECT *, CASE WHEN dur < 4000 AND lag(dur) OVER w < 4000 AND lag(ts // 3600000000) OVER w = ts // 3600000000 THEN 0 ELSE 1 END AS n FROM visits WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq))) GROUP BY device_id, i""",
)
def hide_tiny(t):
    return cl.hide_tiny(t.visits.withColumnRenamed("opcode", "name"), ["device_id"], 3_600_000_000, 4000)


# timelines


@query("w15_timeline_levels")
def timeline_levels(t):
    """Order-dependent levels of detail; compared with the plain definition in the tests."""
    return tl.timeline_levels(t.spans, ["plane_id"], 1_000_000).select("plane_id", "seq", "level")


@query("w15_timeline_levels_with_flows")
def timeline_levels_with_flows(t):
    """Users' spans as flows that a purchase ends, on the tracks of the planes; compared with a sequential version in the tests."""
    spans = t.spans.select("plane_id", "begin", "dur", "seq", F.when(F.col("seq") % 2 == 0, F.col("correlation_id")).alias("flow"), (F.col("name") == "purchase").alias("flow_end"), (F.col("name") == "error").alias("unbound"))
    return tl.timeline_levels_with_flows(spans, ["plane_id"], 1_000_000)


@query("w16_timeline_view", "SELECT seq FROM spans WHERE begin <= 900000000000 AND begin + dur >= 864000000000")
def timeline_view(t):
    leveled = t.spans.withColumn("level", F.lit(0))
    return tl.timeline_view(leveled, 864_000_000_000, 900_000_000_000, 6).select("seq")


@query(
    "w17_derive_scopes",
    """SELECT plane_id, CAST(depth AS INTEGER) AS depth, scope, begin, CAST(greatest(end_ts - begin - (row_number() OVER (PARTITION BY plane_id, begin, end_ts ORDER BY depth) - 1), 1) AS BIGINT) AS dur, events FROM (
  SELECT plane_id, depth, scope, min(begin) AS begin, max(begin + dur) AS end_ts, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY plane_id, depth ORDER BY begin, dur DESC, seq) AS i FROM (
  SELECT *, CASE WHEN scope = lag(scope) OVER (PARTITION BY plane_id, depth ORDER BY begin, dur DESC, seq) THEN 0 ELSE 1 END AS n FROM (
  SELECT plane_id, begin, dur, seq, 0 AS depth, host AS scope FROM spans UNION ALL SELECT plane_id, begin, dur, seq, 1, host || '/' || name FROM spans))) GROUP BY plane_id, depth, scope, i)""",
)
def derive_scopes(t):
    return tl.derive_scopes(t.spans.withColumn("path", F.concat_ws("/", "host", "name")), ["plane_id"], "path")
