"""Queries of the step reports, of the overview's tables and of the memory summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import counters as ct
from spanforge.operators import intervals as iv
from spanforge.operators import metrics as mt
from spanforge.plans import reports as rp
from spanforge.plans import steps as sp

from .registry import fitting, query
from .reports import _DUTY, _FRAMEWORK, PEAKS, off, rounded
from .runtime import _BUFFERS, _FORMULAS, _PEAK, _SLACK, _UTIL, buffers, formulas
from .tables import _BREAKDOWN, METRICS, breakdown, metrics

CLASSES = {"Compute": ["click", "purchase"], "Input": ["view"], "Output": ["error"], "Transfer": ["signup"]}
_CLASS = "CASE WHEN category IN ('click', 'purchase') THEN 'Compute' WHEN category = 'view' THEN 'Input' WHEN category = 'error' THEN 'Output' WHEN category = 'signup' THEN 'Transfer' ELSE 'All others' END"
_POD = _BREAKDOWN + f""", whole AS (SELECT plane_id, step, CAST(sum(time) AS BIGINT) AS dur FROM breakdown GROUP BY ALL),
classed AS (SELECT plane_id, step, class, CAST(sum(CASE WHEN {_CLASS} = class THEN time ELSE 0 END) AS BIGINT) AS time FROM breakdown, (VALUES ('Compute'), ('Input'), ('Output'), ('Transfer'), ('All others')) v(class) GROUP BY ALL),
podded AS (SELECT w.plane_id, w.step, any_value(w.dur) AS dur, arg_max(class, (time, class)) AS bottleneck FROM whole w JOIN classed c ON c.plane_id = w.plane_id AND c.step = w.step GROUP BY w.plane_id, w.step)"""


def classed(t):
    return sp.pod_view(breakdown(t), CLASSES)


@query("r8_pod_classes", "SELECT p.plane_id, p.step, p.dur, p.bottleneck, c.class, c.time FROM podded p JOIN classed c USING (plane_id, step)", _POD)
def pod_classes(t):
    return classed(t).select("plane_id", "step", "dur", "bottleneck", F.explode("parts").alias("class", "time"))


_REDUCE = """reduces AS (SELECT plane_id, step, seq // 8 AS id, dur FROM stepped WHERE name = 'purchase'),
split AS (SELECT step, arg_max(work, (work + sync, -plane_id)) AS work, arg_max(sync, (work + sync, -plane_id)) AS sync FROM (SELECT plane_id, step, sum(least) AS work, sum(dur - least) AS sync FROM reduces JOIN (
  SELECT step, id, min(dur) AS least FROM reduces GROUP BY ALL) USING (step, id) GROUP BY ALL) GROUP BY step)"""
_FIELDS = _BREAKDOWN + ", " + _REDUCE + """, core AS (SELECT plane_id, step, sum(time) AS dur, sum(CASE WHEN category = 'view' THEN time ELSE 0 END) AS i, sum(CASE WHEN category = 'error' THEN time ELSE 0 END) AS o,
  sum(CASE WHEN category = 'signup' THEN time ELSE 0 END) AS t, sum(CASE WHEN category = 'idle' THEN time ELSE 0 END) AS w FROM breakdown GROUP BY ALL),
base AS (SELECT step, count(*) AS cores, CASE WHEN max(i) > 0 THEN arg_max(plane_id, (i, -plane_id)) END AS core, max(i) / 1000.0 AS infeed, avg(o) / 1000.0 AS outfeed, min(dur - i - o - t - w) / 1000.0 AS compute, max(t) / 1000.0 AS transfer, min(dur) / 1000.0 AS least,
  avg(100.0 * i / dur) AS infeed_percent, min(100.0 * i / dur) AS infeed_percent_min, max(100.0 * i / dur) AS infeed_percent_max FROM core GROUP BY step),
fields AS (SELECT b.step, cores, core, infeed, outfeed, compute, transfer, greatest(least - infeed - outfeed - compute - transfer, 0) AS idle, infeed_percent, infeed_percent_min, infeed_percent_max,
  coalesce(work, 0) / 1000.0 AS all_reduce_compute, coalesce(sync, 0) / 1000.0 AS all_reduce_sync, infeed + outfeed + compute + transfer + greatest(least - infeed - outfeed - compute - transfer, 0) AS step_time FROM base b LEFT JOIN split USING (step))"""


def pipeline_steps(t):
    placed = iv.assign_step(t.spans, t.steps, ["plane_id"], 21_600_000_000).where("name = 'purchase' AND step IS NOT NULL")
    reduces = placed.select("plane_id", "step", F.expr("seq DIV 8").alias("id"), "dur")
    return sp.input_pipeline_steps(breakdown(t), ["view"], ["error"], ["signup"], reduces)


_SHOWN = ("infeed", "outfeed", "compute", "transfer", "idle", "infeed_percent", "infeed_percent_min", "infeed_percent_max", "all_reduce_compute", "all_reduce_sync", "step_time")


@query("r7_input_steps", "SELECT step, cores, core, " + ", ".join(f"round({x}, 3) AS {x}" for x in _SHOWN) + " FROM fields", _FIELDS)
def input_steps(t):
    return pipeline_steps(t).select("step", "cores", "core", *(F.round(x, 3).alias(x) for x in _SHOWN))


@query(
    "r7_input_summary",
    "SELECT field, round(avg(v), 2) AS avg, round(coalesce(CASE WHEN min(v) = max(v) THEN 0 ELSE stddev_samp(v) END, 0), 2) AS sd, round(min(v), 2) AS min, round(max(v), 2) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{x}' AS field, CAST({x} AS DOUBLE) AS v FROM fields" for x in (*sp.FIELDS, "step_time", "infeed_percent_max")) + ") GROUP BY field",
    _FIELDS,
)
def input_summary(t):
    return rounded(sp.input_pipeline_summary(pipeline_steps(t)), avg=2, sd=2, min=2, max=2)


_VERDICT = _FIELDS + """, shares AS (SELECT count(*) AS steps, 100.0 * sum(infeed) / sum(step_time) AS i, 100.0 * sum(outfeed) / sum(step_time) AS o FROM fields),
verdict AS (SELECT steps, i, o, CASE WHEN i >= 20 THEN 'highly' WHEN i >= 5 THEN 'moderately' ELSE 'not' END AS input_bound, CASE WHEN o >= 20 THEN 'highly' WHEN o >= 5 THEN 'moderately' ELSE 'not' END AS output_bound FROM shares),
worded AS (SELECT *, concat('The program is ', input_bound, ' input-bound: ', format('{:.1f}', i), ' % of the step time waits for input.') AS input_text,
  concat('The program is ', output_bound, ' output-bound: ', format('{:.1f}', o), ' % of the step time goes to output.') AS output_text FROM verdict)"""


@query("r7_input_verdict", "SELECT steps, round(i, 6) AS infeed_percent, round(o, 6) AS outfeed_percent, input_bound, output_bound, input_text, output_text FROM worded", _VERDICT)
def input_verdict(t):
    return rounded(sp.input_pipeline_verdict(pipeline_steps(t)))


@query(
    "r7_host_breakdown",
    "SELECT CASE WHEN name IN ('view') THEN 'reading' WHEN name IN ('click', 'signup') THEN 'preprocessing' ELSE 'other' END AS kind, CAST(sum(dur) AS BIGINT) AS time, round(100.0 * sum(dur) / (SELECT sum(dur) FROM spans), 6) AS percent FROM spans GROUP BY 1",
)
def host_breakdown(t):
    host = t.spans.groupBy(F.col("name").alias("op_name")).agg(F.sum("dur").alias("self_time"))
    return rounded(sp.host_breakdown(host, {"reading": ["view"], "preprocessing": ["click", "signup"]}))


@query(
    "r7_bottlenecks",
    """SELECT part, round(p, 6) AS percent, CASE WHEN p >= 15 THEN 'high' WHEN p >= 3 THEN 'moderate' ELSE 'no' END AS level FROM (SELECT v.part, 100.0 * sum(c.time) / (SELECT sum(dur) FROM whole) AS p
  FROM classed c JOIN (VALUES ('Transfer', 'Kernel launch'), ('Output', 'Output'), ('All others', 'All others')) v(class, part) USING (class) GROUP BY v.part)""",
    _POD,
)
def bottlenecks(t):
    return rounded(sp.bottleneck_assessment(classed(t), {"Transfer": "Kernel launch", "Output": "Output", "All others": "All others"}))


@query(
    "r9_step_rows",
    "SELECT p.step, p.plane_id, p.dur, p.bottleneck, c.class, round(100.0 * c.time / p.dur, 6) AS percent FROM (SELECT * FROM podded WHERE step >= 3 ORDER BY step, plane_id LIMIT 7) p JOIN classed c USING (plane_id, step)",
    _POD,
)
def step_rows(t):
    rows = sp.step_trace_view(classed(t).where("step >= 3"), limit=7)
    return rows.select("step", "plane_id", "dur", "bottleneck", F.explode("percent").alias("class", "percent")).withColumn("percent", F.round("percent", 6))


@query(
    "r9_step_summary",
    """SELECT count(*) AS steps, round(avg(dur), 2) AS avg, min(dur) AS min, max(dur) AS max, round(stddev_samp(dur) / 1000, 2) AS sd, (SELECT bottleneck FROM one GROUP BY bottleneck ORDER BY count(*) DESC, min(step) LIMIT 1) AS bottleneck,
  (SELECT round(100.0 * sum(CASE WHEN class = 'Input' THEN time ELSE 0 END) / sum(time), 6) FROM classed) AS input_percent FROM one""",
    _POD + ", one AS (SELECT step, max(dur) AS dur, arg_max(bottleneck, (dur, -plane_id)) AS bottleneck FROM podded GROUP BY step)",
)
def step_summary(t):
    out = sp.step_trace_summary(classed(t)).withColumn("input_percent", F.element_at("percent", "Input")).drop("percent")
    return out.withColumns({"avg": F.round("avg", 2), "sd": F.round(F.col("sd") / 1000, 2), "input_percent": F.round("input_percent", 6)})


@query("r9_step_fallback", "SELECT plane_id, step, dur, bottleneck, 'pod_view' AS source FROM podded", _POD)
def step_fallback(t):
    """An empty table is passed over for the next one."""
    pod = classed(t).select("plane_id", "step", "dur", "bottleneck")
    return sp.step_trace([("empty", pod.where("false")), ("pod_view", pod), ("overview", rp.run_environment(t.spans))])


@query(
    "r10_boundness",
    """SELECT idle_percent, barrier_percent, utilization_percent, status, len(reasons) AS reasons FROM (SELECT *, CASE WHEN idle_percent > 10 AND barrier_percent <= idle_percent / 2 THEN 'host_bound' WHEN barrier_percent > 3 THEN 'barrier_bound' ELSE 'device_bound' END AS status,
  list_filter([CASE WHEN idle_percent > 10 THEN 1 END, CASE WHEN barrier_percent > 3 THEN 2 END, CASE WHEN utilization_percent < 30 THEN 3 END], lambda x: x IS NOT NULL) AS reasons FROM (
  SELECT (SELECT round(100.0 * sum(CASE WHEN category = 'idle' THEN time ELSE 0 END) / sum(time), 4) FROM breakdown) AS idle_percent, (SELECT round(100.0 * sum(CASE WHEN category = 'purchase' THEN time ELSE 0 END) / sum(time), 4) FROM breakdown) AS barrier_percent,
  (SELECT round(avg(100.0 * achieved / peak), 4) FROM util) AS utilization_percent))""",
    _BREAKDOWN + ", " + _FORMULAS + ", " + _UTIL,
)
def boundness(t):
    share = lambda x: F.round(100 * F.sum(F.when(F.col("category") == x, F.col("time")).otherwise(0)) / F.sum("time"), 4)
    parts = breakdown(t).agg(share("idle").alias("idle"), share("purchase").alias("barrier"))
    used = ct.hw_utilization(ct.counter_values(t.counters, "sum"), formulas(t)).agg(F.round(F.avg(100 * F.col("achieved") / F.col("peak")), 4).alias("used"))
    one = sp.facts(parts=(parts, {"idle_percent": F.col("idle"), "barrier_percent": F.col("barrier")}), used=(used, {"utilization_percent": F.col("used")}))
    return sp.boundness(one).withColumn("reasons", F.size("reasons").cast("bigint"))


_MONTH = 2_592_000_000_000
_STEPMETRICS = f"""each AS (SELECT CAST(e.begin // {_MONTH} AS VARCHAR) AS step, e.symbol_id, o.name, o.category, CAST(sum(e.dur) AS DOUBLE) AS time, CAST(sum(o.flops * greatest(e.occurrences, 1)) AS DOUBLE) AS flops, CAST(sum(o.bytes * greatest(e.occurrences, 1)) AS DOUBLE) AS bytes
  FROM op_events e JOIN ops o USING (program_id, symbol_id) GROUP BY ALL), summed AS (SELECT symbol_id, name, category, sum(time) AS time, sum(flops) AS flops, sum(bytes) AS bytes FROM each GROUP BY ALL),
every AS (SELECT step, symbol_id, name, category, time, flops, bytes FROM each UNION ALL SELECT 'Total', * FROM summed UNION ALL SELECT 'Average', symbol_id, name, category, time / n, flops / n, bytes / n FROM summed, (SELECT count(DISTINCT step) AS n FROM each)),
placed AS (SELECT step, 0 AS rank, CAST(NULL AS BIGINT) AS symbol_id, 'Program' AS name, sum(time) AS time, sum(flops) AS flops, sum(bytes) AS bytes FROM every GROUP BY step UNION ALL
  SELECT step, rank, symbol_id, name, time, flops, bytes FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY time DESC, symbol_id) AS rank FROM every) WHERE rank <= 3),
rated AS (SELECT *, flops / (time / 1000.0) AS fr, bytes / (time / 1000.0) * (1000000000.0 / 1073741824) AS bw FROM placed)"""


@query(
    "r6_roofline_steps",
    """SELECT step, CAST(rank AS INTEGER) AS rank, symbol_id, name AS operation, round(time / 1e6, 4) AS total_time, round(fr, 3) AS measured_flop_rate, round(bw, 3) AS hbm_bw,
  CASE WHEN bw / (1000.0 * 1e9 / 1073741824) > fr / 300 THEN 'HBM' WHEN fr > 0 THEN 'Compute' ELSE 'Unknown' END AS bound_by FROM rated""",
    _STEPMETRICS,
)
def roofline_steps(t):
    e = t.op_events.withColumn("step", F.expr(f"begin DIV {_MONTH}")).join(t.ops, ["program_id", "symbol_id"])
    n = F.greatest("occurrences", F.lit(1))
    each = e.select("step", "symbol_id", "name", "category", F.col("dur").alias("time"), F.col("dur").alias("self_time"), (F.col("flops") * n).alias("flops"), (F.col("bytes") * n).alias("bytes"), n.alias("occurrences"))
    out = sp.roofline_steps(each, PEAKS, top=3)
    return out.select("step", "rank", "symbol_id", "operation", F.round("total_time", 4).alias("total_time"), F.round("measured_flop_rate", 3).alias("measured_flop_rate"), F.round("hbm_bw", 3).alias("hbm_bw"), "bound_by")


@query(
    "r1_top_ops",
    "SELECT CAST(rank AS INTEGER) AS rank, op_name, occurrences, self_time, round(f, 8) AS fraction, round(cf, 8) AS cumulative FROM placed WHERE side = 'Device' AND rank <= 10",
    METRICS + ", " + _FRAMEWORK,
)
def top_ops(t):
    device = mt.framework_ops(metrics(t).withColumn("provenance", F.translate("provenance", " #", "__")))
    return rounded(rp.overview_top_ops(device).drop("op_type"), fraction=8, cumulative=8)


@query(
    "r1_recommendation",
    """SELECT CASE WHEN input_bound <> 'not' THEN 'input' WHEN output_bound <> 'not' THEN 'output' ELSE 'device' END AS bottleneck, CASE WHEN output_bound <> 'not' AND input_bound <> 'highly' THEN output_text ELSE input_text END AS statement,
  CASE WHEN input_bound <> 'not' THEN 'input_pipeline,trace_viewer' WHEN output_bound <> 'not' THEN 'trace_viewer,memory_profile' ELSE 'op_profile,roofline_model' END AS tools FROM worded""",
    _VERDICT,
)
def recommendation(t):
    return rp.overview_recommendation(sp.input_pipeline_verdict(pipeline_steps(t))).withColumn("tools", F.array_join("tools", ","))


@query(
    "r1_diagnostics",
    """SELECT 'warning' AS level, concat(n - k, ' of ', n, ' steps are not on every device.') AS text FROM (SELECT (SELECT count(DISTINCT step) FROM steps) AS n, (SELECT count(*) FROM (SELECT step FROM steps GROUP BY step HAVING count(DISTINCT plane_id) = (SELECT count(DISTINCT plane_id) FROM steps))) AS k)
  WHERE k > 0 AND k < n UNION ALL SELECT 'warning', concat(n, ' events end before they begin.') FROM (SELECT count(*) AS n FROM spans WHERE dur < 0) WHERE n > 0""",
)
def diagnostics(t):
    return rp.overview_diagnostics(t.spans, t.steps)


@query(
    "r11_memory_capacity",
    """SELECT (SELECT max(capacity) FROM peak) AS capacity, p.allocator, p.peak, a.stack, a.heap, a.free, CAST(-1 AS DOUBLE) AS fragmentation, round(100.0 * p.peak / (SELECT max(capacity) FROM peak), 6) AS utilization_percent
  FROM peak p JOIN alloc_events a ON a.allocator = p.allocator AND a.seq = p.peak_seq WHERE p.allocator = (SELECT arg_max(allocator, (peak, -allocator)) FROM peak)""",
    _PEAK,
)
def memory_capacity(t):
    return rounded(rp.memory_capacity(t.alloc_events))


_RUNS = "SELECT CAST(a AS BIGINT) AS allocator, CAST(k AS BIGINT) AS seq, concat('module', {k}) AS name, lo + k * ((hi - lo) {div} 12) AS begin, (hi - lo) {div} 12 AS dur FROM {src}"


@query(
    "r11_memory_modules",
    """SELECT r.allocator, r.seq, r.name, count(*) AS events, CAST(sum(CASE WHEN kind = 'alloc' THEN bytes ELSE 0 END) AS BIGINT) AS allocated, CAST(sum(CASE WHEN kind = 'free' THEN bytes ELSE 0 END) AS BIGINT) AS freed, max(heap + stack) AS peak
  FROM runs r JOIN alloc_events e ON e.allocator = r.allocator AND e.ts BETWEEN r.begin AND r.begin + r.dur GROUP BY ALL""",
    "extent AS (SELECT min(ts) AS lo, max(ts) AS hi FROM alloc_events), runs AS (" + _RUNS.format(k="CAST(k AS VARCHAR)", div="//", src="extent, (SELECT unnest(range(0, 12)) AS k), (SELECT unnest(range(0, 4)) AS a)") + ")",
)
def memory_modules(t):
    extent = t.alloc_events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = extent.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a"))
    runs = t.spark.sql(_RUNS.format(k="CAST(k AS STRING)", div="DIV", src="{grid}"), grid=grid)
    return rp.memory_modules(t.alloc_events, runs)


_BLOCKS = _BUFFERS + """, blocks AS (SELECT program_id, buffer_id, size, seq AS begin_seq, (SELECT min(f.seq) FROM buffers f WHERE f.program_id = b.program_id AND f.buffer_id = b.buffer_id AND f.kind = 'free' AND f.seq > b.seq) AS end_seq FROM buffers b WHERE kind = 'alloc')"""


@query("r12_memory_blocks", "SELECT *, end_seq IS NULL AS indefinite FROM blocks", _BLOCKS)
def memory_blocks(t):
    return rp.memory_blocks(buffers(t))


@query("r12_memory_indefinite", "SELECT program_id, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM blocks WHERE end_seq IS NULL GROUP BY program_id", _BLOCKS)
def memory_indefinite(t):
    return rp.memory_indefinite(buffers(t))


_FACTS = METRICS + ", " + _DUTY + ", " + _PEAK + ", " + _FORMULAS + ", " + _UTIL + ", " + _BREAKDOWN + """, shared AS (SELECT {parts} FROM breakdown),
classes AS (SELECT 100.0 * sum(CASE WHEN category LIKE '%BRASS%' THEN self_time ELSE 0 END) / sum(self_time) AS shuffle_percent, 100.0 * sum(CASE WHEN category LIKE '%TIN%' THEN self_time ELSE 0 END) / sum(self_time) AS debug_percent,
  100.0 * sum(CASE WHEN category LIKE '%STEEL%' THEN self_time ELSE 0 END) / sum(self_time) AS sparse_percent, 100.0 * sum(CASE WHEN category LIKE '%COPPER%' THEN self_time ELSE 0 END) / sum(self_time) AS hbm_percent FROM metrics),
facts AS (SELECT *, (SELECT 100.0 * busy / (busy + idle) FROM duty) AS duty_percent, (SELECT 100.0 * sum(peak) / sum(capacity) FROM peak) AS memory_percent, (SELECT avg(100.0 * achieved / peak) FROM util) AS mxu_percent,
  (SELECT count(*) FROM (SELECT allocator FROM peak WHERE peak > 2 * (SELECT avg(peak) FROM peak))) AS straggler_hosts FROM shared, classes)"""
_PARTS = {"input_percent": "view", "other_percent": "error", "collective_percent": "purchase", "idle_percent": "idle", "barrier_percent": "signup"}
_FACTS = _FACTS.replace("{parts}", ", ".join(f"100.0 * sum(CASE WHEN category = '{v}' THEN time ELSE 0 END) / sum(time) AS {k}" for k, v in _PARTS.items()))
_RULES = (
    ("input_bound", "input_percent > 10"), ("memory_bound", "hbm_percent > 70"), ("compute_bound", "mxu_percent > 70"), ("collective_bound", "collective_percent > 20"), ("data_shuffle_bound", "shuffle_percent > 20"), ("idle", "idle_percent > 20"),
    ("memory_capacity", "memory_percent > 90"), ("debug_print", "debug_percent > 5"), ("sparse_core_bound", "sparse_percent > 30"), ("barrier_cores", "barrier_percent > 3"), ("low_duty", "duty_percent < 50"), ("stragglers", "straggler_hosts > 0"),
)


@query("r19_all_rules", "SELECT rule FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, {x} AS f FROM facts" for n, x in _RULES) + ") WHERE f", _FACTS)
def all_rules(t):
    """All twelve rules over facts that the other reports supply."""
    parts, ops = breakdown(t), metrics(t)
    of = lambda df, value, hit: 100 * F.sum(F.when(hit, F.col(value)).otherwise(0)) / F.sum(value)
    shares = parts.agg(*(of(parts, "time", F.col("category") == v).alias(k) for k, v in _PARTS.items()))
    kinds = {"shuffle_percent": "BRASS", "debug_percent": "TIN", "sparse_percent": "STEEL", "hbm_percent": "COPPER"}
    classes = ops.agg(*(of(ops, "self_time", F.col("category").contains(v)).alias(k) for k, v in kinds.items()))
    kpi = rp.kpi_metrics(t.spans, ops, t.alloc_events, off())
    units = ct.hw_utilization(ct.counter_values(t.counters, "sum"), formulas(t)).agg(F.avg(100 * F.col("achieved") / F.col("peak")).alias("u"))
    peaks = rp.mm.memory_summary(t.alloc_events).select("peak")
    late = peaks.crossJoin(F.broadcast(peaks.agg(F.avg("peak").alias("mean")))).agg(F.count_if(F.col("peak") > 2 * F.col("mean")).alias("n"))
    facts = sp.facts(
        shares=(shares, {k: F.col(k) for k in _PARTS}), classes=(classes, {k: F.col(k) for k in kinds}), kpi=(kpi, {k: F.col(k) for k in ("duty_percent", "memory_percent")}),
        units=(units, {"mxu_percent": F.col("u")}), late=(late, {"straggler_hosts": F.col("n")}),
    )
    return rp.suggestions(facts).select("rule")


# collectives and serving

_SIZES = "SELECT concat('rv', CAST(s_suppkey % 20 AS {text})) AS rendezvous, CAST(s_nationkey * 1000 AS BIGINT) AS size, CAST(4 AS BIGINT) AS \"group\", CASE WHEN s_suppkey % 2 = 0 THEN 'ALL_REDUCE' ELSE 'ALL_GATHER' END AS type FROM {src}"


@query(
    "r13_moved_bytes",
    """SELECT rendezvous, occurrences, observed, bytes, round(bytes / observed, 6) AS bytes_per_tick FROM (SELECT rendezvous, count(*) AS occurrences, CAST(sum(observed) // count(*) AS BIGINT) AS observed FROM slack GROUP BY rendezvous)
  LEFT JOIN (SELECT rendezvous, CAST(sum(CASE WHEN type = 'ALL_REDUCE' THEN size * 3 // 2 ELSE size * 3 // 4 END) AS BIGINT) AS bytes FROM sizes GROUP BY rendezvous) USING (rendezvous)""",
    _SLACK + ", sizes AS (" + _SIZES.format(text="VARCHAR", src="supplier") + ")",
)
def moved_bytes(t):
    sizes = t.spark.sql(_SIZES.format(text="STRING", src="{s}").replace('"', "`"), s=t.table("supplier"))
    out = rp.megascale_sizes(t.visits, sizes).select("rendezvous", "occurrences", "observed", F.col("bytes").cast("bigint").alias("bytes"), "bytes_per_tick")
    return rounded(out)


@query(
    "r13_by_step",
    """SELECT v.device_id, s.step, v.rendezvous, v.opcode, count(*) AS visits, CAST(sum(v.dur) AS BIGINT) AS time FROM visits v JOIN (SELECT DISTINCT plane_id % 2 AS device_id, step, begin, dur FROM steps WHERE plane_id < 2) s
  ON s.device_id = v.device_id AND v.ts >= s.begin AND v.ts + v.dur <= s.begin + s.dur GROUP BY ALL""",
)
def by_step(t):
    steps = t.steps.where("plane_id < 2").select((F.col("plane_id") % 2).alias("device_id"), "step", "begin", "dur")
    return rp.megascale_by_step(t.visits, steps, 21_600_000_000)


@query(
    "r14_tracks",
    """SELECT v.device_id, concat('Megascale: ', v.rendezvous) AS track, v.ts, v.dur, v.opcode AS name, v.seq, CAST(coalesce(CASE WHEN v.opcode = 'send' THEN v.seq END, r.n) AS BIGINT) AS run_id, a.last_run, f.flow_to, l.last_send, NULL AS value FROM visits v
  JOIN (SELECT seq, sum(CASE WHEN opcode = 'send' THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY ts, seq) AS n FROM visits) r USING (seq)
  LEFT JOIN (SELECT e.seq, max(s.seq) AS last_run FROM (SELECT v.seq, v.device_id, max(s.ts) AS ts FROM visits v JOIN visits s ON s.device_id = v.device_id AND s.opcode = 'send' AND s.ts <= v.ts GROUP BY v.seq, v.device_id) e JOIN visits s ON s.device_id = e.device_id AND s.opcode = 'send' AND s.ts = e.ts GROUP BY e.seq) a USING (seq)
  LEFT JOIN (SELECT p.seq, q.seq AS flow_to FROM (SELECT *, row_number() OVER (PARTITION BY device_id, rendezvous ORDER BY ts, seq) AS k FROM visits WHERE opcode = 'send') p
    JOIN (SELECT *, row_number() OVER (PARTITION BY device_id, rendezvous ORDER BY ts, seq) AS k FROM visits WHERE opcode = 'recv-done') q USING (device_id, rendezvous, k)) f USING (seq)
  LEFT JOIN (SELECT o.seq, arg_max(i.seq, (i.ts + i.dur, i.seq)) AS last_send FROM visits o JOIN visits i ON o.device_id = i.device_id AND o.opcode = 'recv-done' AND i.opcode = 'send' AND i.ts + i.dur BETWEEN o.ts AND o.ts + o.dur GROUP BY o.seq) l USING (seq)
  UNION ALL SELECT device_id, 'Under way', t, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(sum(d) OVER (PARTITION BY device_id ORDER BY t) AS BIGINT) FROM (SELECT device_id, t, sum(d) AS d FROM (SELECT device_id, ts AS t, 1 AS d FROM visits UNION ALL SELECT device_id, ts + dur, -1 FROM visits) GROUP BY ALL)""",
)
def tracks(t):
    return rp.megascale_tracks(t.visits, 3_600_000_000).withColumn("value", F.col("value").cast("bigint"))


_EVENTS = "SELECT l_orderkey AS request_id, {us} AS begin, CAST(round(l_extendedprice * 100) AS BIGINT) * 100000 AS dur, CAST(l_linenumber % 4 + 1 AS INTEGER) AS phase FROM {src}"


@query(
    "r15_request_phases",
    """SELECT model, CAST(kind AS INTEGER) AS phase, count(*) AS requests, CAST(sum(time) AS BIGINT) AS time, round(avg(time), 2) AS mean, round(100.0 * sum(time) / sum(sum(time)) OVER (PARTITION BY model), 6) AS percent FROM (
  SELECT request_id, kind, sum(u - t) AS time FROM best GROUP BY ALL) JOIN requests USING (request_id) GROUP BY model, kind""",
    "ev AS (" + _EVENTS.format(us="epoch_us(l_shipdate)", src="lineitem") + """), points AS (SELECT DISTINCT request_id, t FROM (SELECT request_id, begin AS t FROM ev WHERE dur > 0 UNION ALL SELECT request_id, begin + dur FROM ev WHERE dur > 0)),
segments AS (SELECT request_id, t, lead(t) OVER (PARTITION BY request_id ORDER BY t) AS u FROM points),
best AS (SELECT s.request_id, s.t, s.u, coalesce(max(e.phase), 0) AS kind FROM segments s LEFT JOIN ev e ON e.request_id = s.request_id AND e.begin <= s.t AND e.begin + e.dur >= s.u AND e.dur > 0 WHERE u IS NOT NULL GROUP BY ALL)""",
)
def request_phases(t):
    events = t.spark.sql(_EVENTS.format(us="unix_micros(CAST(l_shipdate AS TIMESTAMP))", src="{li}"), li=t.table("lineitem"))
    return fitting(rp.request_phases(events, t.requests, 4), "time").withColumns({"mean": F.round("mean", 2), "percent": F.round("percent", 6)})


_NAMED = "CASE symbol_id % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' ELSE 'none' END"
_KERNELS = "plane_id, begin, dur, seq, name, plane_id % 3 AS program_id, line_id AS group_id, dur % 1000 AS flops, dur % 100 AS bytes"


@query(
    "a9_gpu_op_costs",
    """SELECT r.program_id, r.name, coalesce(o.category, 'unknown') AS category, runs, occurrences, time, CAST(CASE WHEN o.flops > 0 THEN o.flops * occurrences ELSE own_flops END AS BIGINT) AS flops, CAST(CASE WHEN o.bytes > 0 THEN o.bytes * occurrences ELSE own_bytes END AS BIGINT) AS bytes
  FROM (SELECT program_id, name, count(*) AS runs, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(e - b) AS BIGINT) AS time, CAST(sum(f) AS BIGINT) AS own_flops, CAST(sum(m) AS BIGINT) AS own_bytes FROM (
    SELECT plane_id, program_id, name, group_id, min(begin) AS b, max(begin + dur) AS e, count(*) AS n, sum(flops) AS f, sum(bytes) AS m FROM (SELECT *, row_number() OVER (PARTITION BY plane_id ORDER BY begin, dur DESC, seq) - row_number() OVER (PARTITION BY plane_id, program_id, name, group_id ORDER BY begin, dur DESC, seq) AS g FROM kernels)
    GROUP BY plane_id, program_id, name, group_id, g) GROUP BY program_id, name) r LEFT JOIN costs o ON o.program_id = r.program_id AND o.name = r.name""",
    f"kernels AS (SELECT {_KERNELS} FROM spans), costs AS (SELECT program_id, {_NAMED} AS name, min(category) AS category, max(flops) AS flops, max(bytes) AS bytes FROM ops WHERE program_id < 2 GROUP BY 1, 2)",
)
def gpu_op_costs(t):
    costs = t.ops.where("program_id < 2").groupBy("program_id", F.expr(_NAMED).alias("name")).agg(F.min("category").alias("category"), F.max("flops").alias("flops"), F.max("bytes").alias("bytes"))
    return mt.gpu_op_metrics(t.spans.selectExpr(*_KERNELS.split(", ")), costs, ["plane_id"])


_SHORT = "(SELECT * FROM spans WHERE dur > 0 ORDER BY dur, seq LIMIT 1)"


@query(
    "r21_event_stack",
    f"""SELECT h.seq, coalesce(string_agg(o.name, '/' ORDER BY o.begin, o.dur DESC, o.seq), '') AS stack FROM (SELECT s.* FROM spans s, {_SHORT} e WHERE s.name = e.name AND s.begin = e.begin AND s.dur = e.dur) h
  LEFT JOIN spans o ON o.plane_id = h.plane_id AND o.begin <= h.begin AND o.begin + o.dur >= h.begin + h.dur AND o.seq <> h.seq GROUP BY h.seq""",
)
def event_stack(t):
    e = t.spans.where("dur > 0").orderBy("dur", "seq").first()
    return rp.event_stack(t.spans, e["name"], e["begin"], e["dur"], ["plane_id"]).withColumn("stack", F.array_join("stack", "/"))
