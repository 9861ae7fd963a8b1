"""Queries of scalar functions, sources, sinks, reports and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanforge.functions import columns as c
from spanforge.operators import intervals as iv
from spanforge.operators import metrics as mt
from spanforge.operators import roofline as rl
from spanforge.plans import reports as rp
from spanforge.plans.work import shared_folder
from spanforge.sources import sinks as sk
from spanforge.sources import traces as tr
from spanforge.streaming import ingest as st

from .intervals import islands
from .registry import query
from .runtime import _BUFFERS, _FORMULAS, _PCT, _PCT_FROM, _PEAK, _SLACK, _STEPS, _UTIL, buffers, formulas
from .tables import _BREAKDOWN, METRICS, breakdown, metrics

OFF = "name IN ('error', 'view')"


def off():
    return F.col("name").isin("error", "view")


# scalar functions over the driver's texts and ops


@query(
    "x1_parse_op",
    """SELECT symbol_id, CASE symbol_id % 5 WHEN 0 THEN 'TensorFlow' WHEN 1 THEN 'TfData' WHEN 2 THEN 'Memcpy' WHEN 3 THEN 'Jax' ELSE 'Unknown' END AS category,
  CASE symbol_id % 5 WHEN 0 THEN concat('model/layer_', symbol_id, '/MatMul') WHEN 1 THEN 'Iterator:Prefetch' WHEN 2 THEN concat('MemcpyHToD_', symbol_id) WHEN 3 THEN concat('jit(f)/dot_', symbol_id) ELSE concat('plain ', symbol_id, ' ') END AS name,
  CASE symbol_id % 5 WHEN 0 THEN 'MatMul' WHEN 1 THEN 'Dataset' WHEN 2 THEN 'MemcpyHToD' WHEN 3 THEN 'dot' ELSE '' END AS type,
  CASE symbol_id % 5 WHEN 0 THEN 'MatMul' WHEN 1 THEN 'Iterator::Iterator:Prefetch' WHEN 2 THEN 'MemcpyHToD' WHEN 3 THEN 'dot' ELSE concat('plain ', symbol_id) END AS shown FROM ops""",
)
def parse_op(t):
    s = F.col("symbol_id").cast("string")
    k = F.col("symbol_id") % 5
    full = (
        F.when(k == 0, F.concat(F.lit("model/layer_"), s, F.lit("/MatMul:MatMul"))).when(k == 1, F.lit("Iterator:Prefetch")).when(k == 2, F.concat(F.lit("MemcpyHToD_"), s))
        .when(k == 3, F.concat(F.lit("jit(f)/dot_"), s, F.lit(":"))).otherwise(F.concat(F.lit("plain "), s, F.lit(" ")))
    )
    op = c.parse_op(full)
    return t.ops.select("symbol_id", op["category"].alias("category"), op["name"].alias("name"), op["type"].alias("type"), c.event_name(op).alias("shown"))


@query("x2_scopes", "SELECT symbol_id, 2 AS depth, concat('model/layer_', symbol_id) AS scope FROM ops")
def scopes(t):
    op = c.parse_op(F.concat(F.lit("model/layer_"), F.col("symbol_id").cast("string"), F.lit("/Add:Add")))
    return t.ops.select("symbol_id", F.size(c.scopes(op)).alias("depth"), F.array_join(c.scopes(op), "/").alias("scope"))


@query("x3_names", "SELECT symbol_id, concat('add.', symbol_id) AS hlo, string_split(name, ' ')[1] AS kernel, concat('add', '.*') AS base FROM ops")
def names(t):
    e = F.concat(F.lit("%add."), F.col("symbol_id").cast("string"), F.lit(" = f32[8] add(%a, %b)"))
    return t.ops.select("symbol_id", c.hlo_op_name(e).alias("hlo"), c.canonical_kernel(F.col("name")).alias("kernel"), c.numbered_base(c.hlo_op_name(e)).alias("base"))


@query(
    "x4_x5_units",
    "SELECT symbol_id, CASE WHEN symbol_id % 3 = 0 THEN 0 ELSE round(bytes / CAST(symbol_id % 3 AS DOUBLE), 4) END AS ratio, round(bytes / 1e6, 6) AS us, round(bytes / 1048576.0, 6) AS mib FROM ops",
)
def units(t):
    return t.ops.select("symbol_id", F.round(c.safe_divide(F.col("bytes"), F.col("symbol_id") % 3), 4).alias("ratio"), F.round(c.pico_to("us", F.col("bytes")), 6).alias("us"), F.round(c.mebibytes(F.col("bytes")), 6).alias("mib"))


@query("x8_launch_params", "SELECT symbol_id, symbol_id % 64 AS grid_x, CAST(128 AS BIGINT) AS block_x, symbol_id % 7 AS regs, CAST(50 AS DOUBLE) AS occupancy FROM ops")
def launch_params(t):
    s = F.col("symbol_id")
    text = F.concat(F.lit("grid:"), (s % 64).cast("string"), F.lit(",1,1 block:128,2,1 regs:"), (s % 7).cast("string"), F.lit(" occ_pct:50"))
    p = c.launch_params(text)
    return t.ops.select("symbol_id", p["grid"][0].alias("grid_x"), p["block"][0].alias("block_x"), p["regs"].alias("regs"), p["occupancy"].alias("occupancy"))


@query("x9_tensor_core", "SELECT symbol_id, symbol_id % 3 < 2 AS eligible, symbol_id % 2 = 0 AS kernel FROM ops")
def tensor_core(t):
    s = F.col("symbol_id")
    op = F.when(s % 3 == 0, "net/Conv2D").otherwise("net/Add")
    return t.ops.select("symbol_id", c.tensor_core_eligible(op, F.when(s % 3 == 1, "ab,bc->ac").otherwise("ab->a")).alias("eligible"), c.tensor_core_kernel(F.when(s % 2 == 0, "volta_h884gemm").otherwise("eltwise")).alias("kernel"))


@query("x10_r3_device_information", "SELECT DISTINCT plane_id, m.metric, CAST(CASE WHEN m.metric = 'peak_flop_rate' THEN (CASE WHEN plane_id >= 6 THEN 600 WHEN plane_id >= 3 THEN 300 ELSE 100 END) ELSE (CASE WHEN plane_id >= 6 THEN 900 WHEN plane_id >= 3 THEN 500 ELSE 200 END) END AS DOUBLE) AS value, m.unit FROM spans, (VALUES ('peak_flop_rate', 'GFLOP/s'), ('peak_bandwidth', 'GiB/s')) m(metric, unit)")
def device_information(t):
    """Peaks by device class, with the classes taken from the planes of the trace."""
    level = F.col("plane_id")
    peaks = t.spans.select("plane_id").distinct().where("plane_id in (0, 3, 6)").select(
        level.alias("capability"), F.when(level == 0, 100.0).when(level == 3, 300.0).otherwise(600.0).alias("gflops"), F.when(level == 0, 200.0).when(level == 3, 500.0).otherwise(900.0).alias("gibps")
    )
    return rp.device_information(t.spans, peaks)


@query(
    "x10_device_peaks",
    """SELECT plane_id, CAST(20 * (CASE WHEN plane_id >= 7 THEN 1024.0 WHEN plane_id = 6 THEN 256.0 WHEN plane_id = 5 THEN 256.0 WHEN plane_id >= 3 THEN 384.0 ELSE 64.0 END) * 1.5 AS DOUBLE) AS peak_gflops, 900.0::DOUBLE AS hbm_gbps,
  CAST(20 * (CASE WHEN plane_id <= 2 THEN 64.0 ELSE 256.0 END) * 1.5 AS DOUBLE) AS shared_gbps FROM (SELECT DISTINCT plane_id FROM spans)""",
)
def device_peaks(t):
    """Capabilities by plane: the plane number stands for the compute capability."""
    pairs = {"clock_rate": "1500000", "core_count": "20", "memory_bandwidth": "900000000000", "compute_cap_minor": "0", "device_vendor": "Nvidia"}
    props = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv), F.lit("compute_cap_major"), F.col("plane_id").cast("string"))
    out = rl.device_peaks(t.spans.select("plane_id").distinct().withColumn("props", props))
    return out.select("plane_id", F.round("peak_gflops", 4).alias("peak_gflops"), "hbm_gbps", F.round("shared_gbps", 4).alias("shared_gbps"))


@query("x11_human_bytes", "SELECT symbol_id, CASE WHEN bytes < 102400 THEN printf('%.1fK', round_even(bytes / 1024.0, 1)) ELSE printf('%.1fK', round_even(bytes / 1024.0, 1)) END AS text FROM ops WHERE bytes < 1048576")
def human_bytes(t):
    return t.ops.where("bytes < 1048576").select("symbol_id", c.human_bytes(F.col("bytes")).alias("text"))


@query(
    "x12_transmitted_bytes",
    """SELECT symbol_id, CASE symbol_id % 6 WHEN 0 THEN bytes * 4 WHEN 1 THEN bytes * 3 // 4 WHEN 2 THEN bytes * 3 // 2 WHEN 3 THEN bytes * 3 // 4 WHEN 4 THEN bytes * 3 ELSE 0 END AS sent FROM ops""",
)
def transmitted_bytes(t):
    kinds = F.array(*(F.lit(x) for x in ("ONE_TO_ONE", "ALL_GATHER", "ALL_REDUCE", "ALL_TO_ALL", "REDUCE_SCATTER", "NONE")))
    return t.ops.select("symbol_id", c.transmitted_bytes(F.col("bytes"), F.lit(4), F.get(kinds, (F.col("symbol_id") % 6).cast("int"))).alias("sent"))


@query("x13_graph_key", "SELECT symbol_id, program_id AS device, concat('rv.', symbol_id) AS rendezvous, bytes + program_id AS size FROM ops")
def graph_key(t):
    key = c.graph_key(F.concat(F.lit("x device_"), F.col("program_id").cast("string"), F.lit("_gid_rv."), F.col("symbol_id").cast("string"), F.lit(" y")))
    sizes = c.buffer_sizes(F.concat(F.lit("(0,1):"), F.col("bytes").cast("string"), F.lit(" (1,0):"), F.col("program_id").cast("string")))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    return t.ops.select("symbol_id", key["device"].alias("device"), key["rendezvous"].alias("rendezvous"), total.alias("size"))


@query("x14_dtype_name", f"SELECT symbol_id, CASE WHEN symbol_id % 131 > 100 THEN (CASE WHEN symbol_id % 131 - 100 < {len(c.DATA_TYPES)} THEN list_extract({list(c.DATA_TYPES)}, CAST(symbol_id % 131 - 99 AS INTEGER)) || '_ref' END) WHEN symbol_id % 131 < {len(c.DATA_TYPES)} THEN list_extract({list(c.DATA_TYPES)}, CAST(symbol_id % 131 + 1 AS INTEGER)) ELSE 'unknown dtype enum (' || symbol_id % 131 || ')' END AS dtype FROM ops")
def dtype_name(t):
    return t.ops.select("symbol_id", c.dtype_name(F.col("symbol_id") % 131).alias("dtype"))


@query("x15_kernel_metadata", "SELECT event_id, CAST(props->>'k' AS VARCHAR) AS k FROM events")
def kernel_metadata(t):
    return t.table("events").select("event_id", c.kernel_metadata(F.concat(F.lit("custom-call, config="), "props", F.lit(" end")), "$.k").alias("k"))


@query("x16_percent_text", "SELECT symbol_id, printf('%.1f%%', flops / 1000.0) AS text FROM ops")
def percent_text(t):
    return t.ops.select("symbol_id", c.percent_text(F.col("flops") / 1000.0).alias("text"))


@query("x17_is_training_op", "SELECT symbol_id, symbol_id % 4 < 3 AND symbol_id % 4 <> 1 AS training FROM ops")
def is_training_op(t):
    k = F.col("symbol_id") % 4
    name = F.when(k == 0, "gradient_tape/net/MatMul").when(k == 1, "net/MatMul").when(k == 2, "jit/transpose(jvp)/dot").otherwise("jit/dot")
    return t.ops.select("symbol_id", c.is_training_op(name, F.when(k < 2, "MatMul").otherwise("dot")).alias("training"))


@query("x18_link_id", "SELECT count(DISTINCT (program_id, symbol_id)) AS keys FROM ops")
def link_id(t):
    return t.ops.select(c.link_id(F.lit("flow"), F.col("program_id"), F.col("symbol_id")).alias("k")).agg(F.count_distinct("k").alias("keys"))


@query("x19_source_text", "SELECT symbol_id, concat(name, '<&>:', symbol_id) AS plain, CASE WHEN symbol_id % 3 = 0 THEN '' ELSE concat(name, ':', symbol_id) END AS cell FROM ops")
def source_text(t):
    s = F.col("symbol_id").cast("string")
    html = F.concat(F.lit("<div title='x'>"), "name", F.lit("&lt;&amp;&gt;:"), s, F.lit("</div>"))
    return t.ops.select("symbol_id", c.strip_html(html).alias("plain"), c.source_text(F.when(F.col("symbol_id") % 3 == 0, "").otherwise(F.col("name")), F.col("symbol_id")).alias("cell"))


@query("x22_op_category", "SELECT symbol_id, CASE symbol_id % 5 WHEN 0 THEN 'loop fusion' WHEN 1 THEN 'convolution window-dilated' WHEN 2 THEN 'data formatting' WHEN 3 THEN 'non-fusion elementwise' ELSE 'all-reduce' END AS kind FROM ops")
def op_category(t):
    k = F.col("symbol_id") % 5
    opcode = F.when(k == 0, "fusion").when(k == 1, "convolution").when(k == 2, "reshape").when(k == 3, "tanh").otherwise("all-reduce")
    return t.ops.select("symbol_id", c.op_category(opcode, F.lit("kLoop"), F.lit(False), F.lit(True)).alias("kind"))


@query("x23_event_kinds", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'host_to_device' WHEN 1 THEN 'host_wait_input' ELSE 'host_compute' END AS host, CASE seq % 4 WHEN 0 THEN 'host_to_device' WHEN 2 THEN 'device_collectives' WHEN 3 THEN 'device_compute_16' ELSE 'device_compute_32' END AS device FROM spans")
def event_kinds(t):
    k = F.col("seq") % 4
    name = F.when(k == 0, "MemcpyHToD").when(k == 1, "IteratorGetNext:x y").when(k == 2, "ncclAllReduce").otherwise("gemm_half")
    return t.spans.select("seq", c.host_event_kind(name).alias("host"), c.device_event_kind(name, F.lit("")).alias("device"))


@query("x24_input_category", "SELECT seq, CASE seq % 4 WHEN 0 THEN 'Enqueue' WHEN 1 THEN 'Advanced file read' WHEN 2 THEN 'Preprocessing' ELSE 'Unknown' END AS kind FROM spans")
def input_category(t):
    k = F.col("seq") % 4
    name = F.when(k == 1, "Iterator::Batch::Prefetch").when(k == 2, "Iterator::Map").otherwise("op")
    return t.spans.select("seq", c.input_category(name, F.when(k == 0, "InfeedEnqueueTuple").otherwise("")).alias("kind"))


@query("x25_parse_number", "SELECT event_id, coalesce(TRY_CAST(props->>'k' AS DOUBLE), -1) AS k, CAST(7 AS BIGINT) AS other FROM events")
def parse_number(t):
    return t.table("events").select("event_id", c.parse_number(F.get_json_object("props", "$.k"), default=-1).alias("k"), c.parse_number(F.lit(" nan "), "bigint", 7).alias("other"))


@query("x26_memory_sum", "SELECT symbol_id, bytes * 3 AS hbm, bytes AS reads FROM ops")
def memory_sum(t):
    m = F.array(*(F.struct(F.lit(op).alias("op"), F.lit(space).cast("bigint").alias("space"), (F.col("bytes") * k).alias("bytes")) for op, space, k in ((1, 1, 1), (2, 1, 2), (1, 3, 9))))
    return t.ops.select("symbol_id", c.memory_sum(m, None, 1).alias("hbm"), c.memory_sum(m, 1, 1).alias("reads"))


@query("x27_bottleneck", "SELECT symbol_id, CASE WHEN flops > bytes THEN 'Compute' ELSE 'Memory' END AS part, CASE WHEN symbol_id % 30 >= 20 THEN 'highly' WHEN symbol_id % 30 >= 5 THEN 'moderately' ELSE 'other' END AS bound FROM ops")
def bottleneck(t):
    p = c.step_bottleneck({"Compute": F.col("flops"), "Memory": F.col("bytes")})
    return t.ops.select("symbol_id", p.alias("part"), c.input_bound_class(F.col("symbol_id") % 30, F.lit(4)).alias("bound"))


@query("x28_flags", "SELECT symbol_id, CASE WHEN symbol_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS remat, CASE WHEN symbol_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS outside FROM ops")
def flags(t):
    s = F.col("symbol_id")
    long_name = F.when(s % 2 == 0, "add.remat.1 = f32[]").otherwise("add.1 = .remat")
    return t.ops.select("symbol_id", c.is_rematerialized(long_name, F.lit("")).alias("remat"), c.is_outside_compilation(long_name, F.when(s % 3 == 0, "x:XlaSendToHost").otherwise("x")).alias("outside"))


# sources and sinks


@query("s6_capabilities", "SELECT DISTINCT session, host, tool FROM spans, (VALUES ('trace_viewer'), ('op_profile')) v(tool)")
def capabilities(t):
    return tr.capabilities(t.spans)


@query("s7_capture_window", "SELECT host, CAST(min(begin) AS BIGINT) AS start_ns, CAST(max(begin) AS BIGINT) AS stop_ns FROM spans GROUP BY host")
def capture_window(t):
    env = t.spans.groupBy("host").agg(F.create_map(F.lit("profile_start_time"), F.min("begin").cast("string"), F.lit("profile_stop_time"), F.max("begin").cast("string")).alias("props"))
    return tr.capture_window(env.withColumn("plane", F.lit("Task Environment")))


@query("s12_list_hosts", "SELECT DISTINCT host FROM spans")
def list_hosts(t):
    return tr.list_hosts(t.spans)


@query("s12_list_modules", "SELECT concat('jit_f(', program_id, ')') AS name, program_id FROM ops GROUP BY program_id")
def list_modules(t):
    return tr.list_modules(t.ops.select(F.concat(F.lit("jit_f("), F.col("program_id").cast("string"), F.lit(")")).alias("name")))


@query("s4_load_trace", "SELECT seq, name, begin, dur FROM spans")
def load_trace(t):
    """Spans written as a converted table and read with its schema."""
    path = f"{shared_folder(t.spark)}/trace-{uuid.uuid4().hex}"
    s = t.spans.withColumn("meta_id", F.lit(0).cast("bigint")).withColumn("error", F.lit(None).cast("string"))
    s.select(*(x.split()[0] for x in tr.SPANS.split(", "))).write.parquet(path)
    return tr.load_trace(t.spark, path).select("seq", "name", "begin", "dur")


@query("s8_chrome_events", """SELECT CAST(name AS VARCHAR) AS name, CAST(tid AS BIGINT) AS tid, count(*) AS n FROM (SELECT name, line_id AS tid FROM spans) GROUP BY ALL""")
def chrome(t):
    rows = sk.chrome_events(t.spans).select(F.from_json("value", "ph string, tid bigint, name string").alias("e")).where("e.ph = 'X'")
    return rows.groupBy(F.col("e.name").alias("name"), F.col("e.tid").alias("tid")).agg(F.count("*").alias("n"))


@query(
    "s8_chrome_all",
    """SELECT 'X' AS ph, plane_id AS pid, line_id AS tid, name, CAST(begin AS DOUBLE) AS ts, CAST(greatest(dur, 1) AS DOUBLE) AS dur, NULL AS process FROM spans UNION ALL SELECT DISTINCT 'M', plane_id, NULL, 'process_name', NULL, NULL, plane FROM spans""",
)
def chrome_all(t):
    """Every field of every event, and the rows that name the processes."""
    e = sk.chrome_events(t.spans).select(F.from_json("value", "ph string, pid bigint, tid bigint, name string, ts double, dur double, args struct<name: string>").alias("e"))
    return e.select("e.ph", "e.pid", "e.tid", "e.name", "e.ts", "e.dur", F.col("e.args.name").alias("process"))


@query("s9_delta_series", "SELECT plane_id, seq, begin - lag(begin, 1, 0) OVER (PARTITION BY plane_id ORDER BY begin, dur DESC, seq) AS delta, dur, CAST(dense_rank() OVER (PARTITION BY plane_id ORDER BY name) - 1 AS INTEGER) AS name_ref FROM spans")
def delta_series(t):
    return sk.delta_series(t.spans, ["plane_id"])


@query("s10_csv_rows", """SELECT concat('"', seq, '","', name, '","', dur, '"') AS value FROM spans""")
def csv_rows(t):
    return sk.csv_rows(t.spans.select("seq", "name", "dur"))


@query("s11_report_table", "SELECT name, count(*) AS n FROM spans GROUP BY name")
def report_table(t):
    return sk.report_table(t.spans.groupBy("name").agg(F.count("*").alias("n")), {"n": "Events"}, {"title": "Events"})[0]


# reports


@query("a38_run_environment", "SELECT count(DISTINCT host) AS hosts, count(DISTINCT plane_id) AS planes, count(DISTINCT (plane_id, line_id)) AS tracks, count(*) AS events, count(DISTINCT name) AS names, max(begin + dur) - min(begin) AS extent FROM spans")
def run_environment(t):
    return rp.run_environment(t.spans)


_DUTY = islands(src=f"(SELECT * FROM spans WHERE NOT ({OFF}))") + """, duty AS (SELECT CAST(sum(busy) AS BIGINT) AS busy, CAST(sum(hi - lo - busy) AS BIGINT) AS idle FROM (SELECT plane_id, min(begin) AS lo, max(begin + dur) AS hi FROM spans GROUP BY plane_id)
  JOIN (SELECT plane_id, sum(end_ts - begin) AS busy FROM islands GROUP BY plane_id) USING (plane_id))"""


@query(
    "r1_overview",
    """SELECT (SELECT count(DISTINCT host) FROM spans) AS hosts, (SELECT count(*) FROM spans) AS events, busy, idle, round(100.0 * busy / (busy + idle), 6) AS duty_percent, CAST((SELECT sum(self_time) FROM metrics) AS BIGINT) AS op_time FROM duty""",
    METRICS + ", " + _DUTY,
)
def overview(t):
    return rp.overview(t.spans, metrics(t), off()).select("hosts", "events", "busy", "idle", F.round("duty_percent", 6).alias("duty_percent"), "op_time")


@query(
    "r2_kpi_metrics",
    """SELECT (SELECT count(DISTINCT host) FROM spans) AS hosts, round(100.0 * busy / (busy + idle), 6) AS duty_percent, CAST((SELECT sum(self_time) FROM metrics) AS BIGINT) AS op_time,
  (SELECT round(100.0 * sum(peak) / sum(capacity), 6) FROM peak) AS memory_percent FROM duty""",
    METRICS + ", " + _DUTY + ", " + _PEAK,
)
def kpi_metrics(t):
    out = rp.kpi_metrics(t.spans, metrics(t), t.alloc_events, off())
    return out.withColumn("duty_percent", F.round("duty_percent", 6)).withColumn("memory_percent", F.round("memory_percent", 6))


PEAKS = {"gflops": 300.0, "hbm": 1000.0}
_RATES = """rated AS (SELECT *, time / 1e6 AS us, flops / (time / 1000.0) AS fr, bytes / (time / 1000.0) * (1000000000.0 / 1073741824) AS bw FROM metrics)"""
_BOUND = "CASE WHEN bw / (1000.0 * 1e9 / 1073741824) > fr / 300 THEN 'HBM' WHEN fr > 0 THEN 'Compute' ELSE 'Unknown' END"


@query(
    "r4_hlo_stats",
    f"""SELECT CAST(row_number() OVER (ORDER BY self_time DESC, symbol_id) AS INTEGER) AS rank, CAST(program_id AS VARCHAR) AS program_id, category, name AS hlo_op_name, '' AS hlo_op_expression, provenance AS tf_op_name, occurrences,
  round(us, 6) AS total_time, round(us / occurrences, 6) AS avg_time, round(us, 6) AS total_self_time, round(us / occurrences, 6) AS avg_self_time, round(self_time / sum(self_time) OVER (), 8) AS total_self_time_percent,
  round(sum(self_time) OVER (ORDER BY self_time DESC, symbol_id ROWS UNBOUNDED PRECEDING) / sum(self_time) OVER (), 8) AS cumulative_total_self_time_percent, round(dma_stall / time, 8) AS dma_stall_percent,
  round(fr, 4) AS model_flop_rate, round(fr, 4) AS normalized_flop_rate, round(bw, 4) AS measured_memory_bw, round(bw, 4) AS hbm_bw, 0.0::DOUBLE AS cmem_read_bw, 0.0::DOUBLE AS cmem_write_bw, round(flops / bytes, 6) AS operational_intensity, {_BOUND} AS bound_by,
  'No' AS hlo_rematerialization, 'No' AS outside_compilation, 'No' AS autotuned, '' AS source_info, '' AS core_type, '' AS parent_op_name, 0.0::DOUBLE AS vdd_energy, symbol_id FROM rated""",
    METRICS + ", " + _RATES,
)
def hlo_stats(t):
    return rounded(rp.hlo_stats(metrics(t), PEAKS), total_self_time_percent=8, cumulative_total_self_time_percent=8, dma_stall_percent=8, model_flop_rate=4, normalized_flop_rate=4, measured_memory_bw=4, hbm_bw=4)


def rounded(df, **digits):
    """Doubles rounded: to the digits named, else to 6."""
    return df.select(*(F.round(n, digits.get(n, 6)).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes))


_FRAMEWORK = """framework AS (SELECT substr(p, 1, length(p) - 3) AS op_name, CAST(max(occurrences) AS BIGINT) AS occurrences, CAST(sum(self_time) AS BIGINT) AS self_time, CAST(sum(flops) AS BIGINT) AS flops, CAST(sum(bytes) AS BIGINT) AS bytes
  FROM (SELECT *, replace(replace(provenance, ' ', '_'), '#', '_') AS p FROM metrics) GROUP BY 1),
sides AS (SELECT 'Device' AS side, op_name, occurrences, self_time, flops, bytes FROM framework UNION ALL SELECT 'Host', name, count(*), CAST(sum(dur) AS BIGINT), 0, 0 FROM spans GROUP BY name),
placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY self_time DESC, op_name) AS rank, self_time / sum(self_time) OVER (PARTITION BY side) AS f, sum(self_time) OVER (PARTITION BY side ORDER BY self_time DESC, op_name ROWS UNBOUNDED PRECEDING) / sum(self_time) OVER (PARTITION BY side) AS cf FROM sides)"""


@query(
    "r5_framework_op_stats",
    """SELECT CAST(rank AS INTEGER) AS rank, side AS host_or_device, op_name AS operation, occurrences, round(self_time / 1e6, 6) AS total_self_time, round(self_time / 1e6 / occurrences, 6) AS avg_self_time,
  round(CASE WHEN side = 'Device' THEN f ELSE 0 END, 8) AS device_total_self_time_percent, round(CASE WHEN side = 'Host' THEN cf ELSE 0 END, 8) AS host_cumulative_total_self_time_percent, round(flops / (self_time / 1000.0), 4) AS measured_flop_rate, 'Function' AS eager FROM placed WHERE rank <= 500""",
    METRICS + ", " + _FRAMEWORK,
)
def framework_op_stats(t):
    device = mt.framework_ops(metrics(t).withColumn("provenance", F.translate("provenance", " #", "__")))
    host = t.spans.groupBy(F.col("name").alias("op_name")).agg(F.count("*").alias("occurrences"), F.sum("dur").alias("time")).withColumns({"self_time": F.col("time"), "op_type": F.lit("Host"), "flops": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast("bigint")})
    out = rounded(rp.framework_op_stats(device, host, PEAKS), device_total_self_time_percent=8, host_cumulative_total_self_time_percent=8, measured_flop_rate=4)
    return out.select("rank", "host_or_device", "operation", "occurrences", "total_self_time", "avg_self_time", "device_total_self_time_percent", "host_cumulative_total_self_time_percent", "measured_flop_rate", "eager")


@query(
    "r6_roofline_model",
    f"""SELECT infeed AS include_infeed_outfeed, CAST(rank AS INTEGER) AS rank, name AS operation, symbol_id, round(us, 6) AS total_time, round(fr, 4) AS measured_flop_rate, round(bw, 4) AS hbm_bw, round(flops / bytes, 6) AS operational_intensity, {_BOUND} AS bound_by,
  round(fr / 300, 6) AS compute_efficiency, round(time / sum(CASE WHEN rank = 0 THEN time END) OVER (), 8) AS total_time_in_percentage FROM (SELECT *, time / 1e6 AS us, flops / (time / 1000.0) AS fr, bytes / (time / 1000.0) * (1000000000.0 / 1073741824) AS bw FROM (
  SELECT 0 AS rank, 'Program' AS name, NULL AS symbol_id, CAST(sum(time) AS BIGINT) AS time, CAST(sum(flops) AS BIGINT) AS flops, CAST(sum(bytes) AS BIGINT) AS bytes FROM metrics
  UNION ALL SELECT row_number() OVER (ORDER BY self_time DESC, symbol_id), name, symbol_id, time, flops, bytes FROM metrics)), (VALUES (true), (false)) v(infeed)""".replace("OVER ()", "OVER (PARTITION BY infeed)"),
    METRICS,
)
def roofline_model(t):
    out = rounded(rp.roofline_model(metrics(t), PEAKS), measured_flop_rate=4, hbm_bw=4, total_time_in_percentage=8)
    return out.select("include_infeed_outfeed", "rank", "operation", "symbol_id", "total_time", "measured_flop_rate", "hbm_bw", "operational_intensity", "bound_by", "compute_efficiency", "total_time_in_percentage")


@query(
    "r7_input_pipeline",
    """SELECT round(100.0 * sum(i) / sum(t), 6) AS input_percent, round(100.0 * sum(o) / sum(t), 6) AS other_percent, count(*) AS steps, CASE WHEN 100.0 * sum(i) / sum(t) >= 20 THEN 'highly' WHEN 100.0 * sum(i) / sum(t) >= 5 THEN 'moderately' WHEN 100.0 * sum(o) / sum(t) >= 3 THEN 'other' ELSE 'not' END AS bound
  FROM (SELECT plane_id, step, sum(time) AS t, sum(CASE WHEN category = 'view' THEN time ELSE 0 END) AS i, sum(CASE WHEN category = 'error' THEN time ELSE 0 END) AS o FROM breakdown GROUP BY ALL)""",
    _BREAKDOWN,
)
def input_pipeline(t):
    out = rp.input_pipeline(breakdown(t), ["view"], ["error"])
    return out.withColumn("input_percent", F.round("input_percent", 6)).withColumn("other_percent", F.round("other_percent", 6))


@query("r9_step_trace", "SELECT plane_id, step, CAST(sum(time) AS BIGINT) AS dur, arg_max(category, (time, category)) AS bottleneck, count(*) AS parts FROM breakdown WHERE step = 5 GROUP BY ALL", _BREAKDOWN)
def step_trace(t):
    return rp.step_trace(breakdown(t), 5)


@query("r10_host_boundness", "SELECT CAST(sum(self_time) AS BIGINT) AS busy, CAST(sum(self_time) AS BIGINT) AS compute, CAST(0 AS BIGINT) AS hbm, CAST(0 AS BIGINT) AS ici, round(100.0 * 1000000 / (sum(self_time) + 1000000), 6) AS idle_percent, 'device_bound' AS status FROM metrics", METRICS)
def host_boundness(t):
    return rp.host_boundness(metrics(t), 1_000_000).withColumn("idle_percent", F.round("idle_percent", 6))


@query(
    "r11_memory_profile",
    """SELECT allocator, seq, kind, heap FROM (SELECT *, row_number() OVER (PARTITION BY allocator, b ORDER BY heap + stack DESC, i) AS r FROM (SELECT *, CASE WHEN n <= 1000 THEN i
  WHEN i < (1000 * (n // 1000 + 1) - n) * (n // 1000) THEN i // (n // 1000) ELSE (1000 * (n // 1000 + 1) - n) + (i - (1000 * (n // 1000 + 1) - n) * (n // 1000)) // (n // 1000 + 1) END AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY allocator ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY allocator) AS n FROM alloc_events))) WHERE r = 1""",
)
def memory_profile(t):
    return rp.memory_profile(t.alloc_events).select("allocator", "seq", "kind", "heap")


@query("r12_memory_view", "SELECT program_id, seq, round(level / 1048576.0, 6) AS level_mib, max(level) OVER (PARTITION BY program_id) AS peak FROM timeline", _BUFFERS)
def memory_view(t):
    return rp.memory_view(buffers(t)).select("program_id", "seq", F.round("level_mib", 6).alias("level_mib"), "peak")


@query("r13_megascale_stats", "SELECT rendezvous, count(*) AS occurrences, CAST(sum(slack) // count(*) AS BIGINT) AS slack, CAST(sum(stall) // count(*) AS BIGINT) AS stall, CAST((sum(observed) // count(*)) * 3 // 2 AS BIGINT) AS bytes FROM slack GROUP BY rendezvous", _SLACK)
def megascale_stats(t):
    return rp.megascale_stats(t.visits).select("rendezvous", "occurrences", "slack", "stall", "bytes")


@query(
    "r14_megascale_timeline",
    """SELECT v.seq, f.consumer AS flow_to FROM visits v LEFT JOIN (SELECT p.seq AS producer, c.seq AS consumer FROM (SELECT *, row_number() OVER (PARTITION BY device_id, rendezvous ORDER BY ts, seq) AS k FROM visits WHERE opcode = 'send') p
  JOIN (SELECT *, row_number() OVER (PARTITION BY device_id, rendezvous ORDER BY ts, seq) AS k FROM visits WHERE opcode = 'recv-done') c USING (device_id, rendezvous, k)) f ON f.producer = v.seq""",
)
def megascale_timeline(t):
    return rp.megascale_timeline(t.visits, 1, 1).select("seq", "flow_to")


@query(
    "r15_inference_profile",
    f"SELECT k AS model, count(*) AS requests, {_PCT}, round(count(*) / ((max(e) - min(b)) / 1e6), 8) AS per_second FROM "
    + _PCT_FROM.format(src="SELECT model AS k, end_ts - begin AS v, request_id, begin AS b, end_ts AS e FROM requests") + " GROUP BY k",
)
def inference_profile(t):
    out = rp.inference_profile(t.requests, t.request_batch).withColumn("per_second", F.round("per_second", 8))
    return out.drop("batches", "latency", "per_batch", "share")


@query("r17_utilization_viewer", "SELECT device_id, metric, achieved, peak, round(100.0 * achieved / peak, 4) AS percent FROM util", _FORMULAS + ", " + _UTIL)
def utilization_viewer(t):
    return rp.utilization_viewer(t.counters, formulas(t)).withColumn("percent", F.round("percent", 4))


@query(
    "r18_kernel_utilization",
    """SELECT s.device_id, s.line_id AS kernel, f.metric, round(100.0 * sum(f.weight * s.value) / (any_value(p.value) * any_value(f.factor)), 4) AS percent
  FROM (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters WHERE line_id = 3 GROUP BY ALL) s JOIN formulas f USING (counter_id)
  JOIN (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters GROUP BY ALL) p ON p.device_id = s.device_id AND p.line_id = s.line_id AND p.counter_id = f.peak_counter GROUP BY s.device_id, s.line_id, f.metric""",
    _FORMULAS,
)
def kernel_utilization(t):
    return rp.kernel_utilization(t.counters, formulas(t), "vector", 3).drop("anomaly").withColumn("percent", F.round("percent", 4))


@query(
    "r18_kernel_anomaly",
    """SELECT device_id, kernel, metric, percent, metric = 'vector' AND percent > 100 AS anomaly FROM (SELECT s.device_id, s.line_id AS kernel, f.metric, round(100.0 * sum(f.weight * s.value) / (any_value(p.value) * any_value(f.factor)), 4) AS percent
  FROM (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters GROUP BY ALL) s JOIN formulas f USING (counter_id)
  JOIN (SELECT device_id, line_id, counter_id, sum(value) AS value FROM counters GROUP BY ALL) p ON p.device_id = s.device_id AND p.line_id = s.line_id AND p.counter_id = f.peak_counter GROUP BY s.device_id, s.line_id, f.metric)""",
    _FORMULAS,
)
def kernel_anomaly(t):
    return rp.kernel_utilization(t.counters, formulas(t), "vector").where("percent IS NOT NULL AND percent <> 0").withColumn("percent", F.round("percent", 4))


@query("r19_suggestions", "SELECT rule FROM (SELECT 'low_duty' AS rule, 100.0 * busy / (busy + idle) < 50 AS f FROM duty UNION ALL SELECT 'memory_capacity', (SELECT 100.0 * sum(peak) / sum(capacity) FROM peak) > 90) WHERE f", METRICS + ", " + _DUTY + ", " + _PEAK)
def suggestions(t):
    return rp.suggestions(rp.kpi_metrics(t.spans, metrics(t), t.alloc_events, off())).select("rule")


@query("r20_module_info", "SELECT program_id, count(*) AS ops, count(DISTINCT category) AS categories, CAST(sum(flops) AS BIGINT) AS flops FROM ops GROUP BY program_id")
def module_info(t):
    return rp.module_info(t.ops)


@query("r20_find_instruction", "SELECT symbol_id FROM ops WHERE name = (SELECT min(name) FROM ops)")
def find_instruction(t):
    first = t.ops.agg(F.min("name").alias("n")).first()["n"]
    return rp.find_instruction(t.ops, first).select("symbol_id")


@query("r21_event_details", "SELECT seq, name FROM spans WHERE seq = 77")
def event_details(t):
    e = t.spans.where("seq = 77").first()
    return rp.event_details(t.spans, e["name"], e["begin"], e["dur"]).select("seq", F.get_json_object("args", "$.name").alias("name"))


# streaming


@query("st2_stream_event_totals", "SELECT date_trunc('hour', ts) AS start, event_type AS name, count(*) AS count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_event_totals(t):
    """The stream runs over the events table to its end; the totals are those of the batch."""
    source = f"{t.sf_dir}/events.parquet"
    schema = t.table("events").schema
    folder, name = source.rsplit("/", 1)
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    spans = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.expr("CAST(round(value * 100) AS BIGINT)").alias("dur"))
    out = f"{shared_folder(t.spark)}/totals-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    totals = st.stream_event_totals(spans, "ts", "1 hour", "1 day")
    run = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = t.spark.read.parquet(out)
    last = done.agg(F.max("batch").alias("m"))
    return done.join(F.broadcast(last), F.col("batch") == F.col("m")).select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "count", "total")
