"""Queries of filters, joins, grouping and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import columns as c
from spanforge.operators import filters as fl
from spanforge.operators import grouping as gr
from spanforge.operators import intervals as iv
from spanforge.operators import joins as jn
from spanforge.operators import metrics as mt
from spanforge.sources.adapters import DAY

from .intervals import PARENTS, islands
from .registry import query

FULL = ["l_orderkey", "l_linenumber"]
METRICS = """metrics AS (SELECT e.program_id, e.symbol_id, o.name, o.category, o.provenance, CAST(occ AS BIGINT) AS occurrences, CAST(time AS BIGINT) AS time,
  CAST(time AS BIGINT) AS self_time, min_time, CAST(stall AS BIGINT) AS dma_stall, CAST(o.flops * occ AS BIGINT) AS flops, CAST(o.bytes * occ AS BIGINT) AS bytes
  FROM (SELECT program_id, symbol_id, sum(greatest(occurrences, 1)) AS occ, sum(dur) AS time, min(dur) AS min_time, sum(dma_stall) AS stall
        FROM op_events WHERE symbol_id <> 0 GROUP BY program_id, symbol_id) e JOIN ops o USING (program_id, symbol_id))"""


def metrics(t):
    return mt.op_metrics(t.op_events, t.ops)


# filters


@query("s2_select_hosts", "SELECT host, seq FROM spans WHERE host IN ('h1', 'h3')")
def select_hosts(t):
    return fl.select_hosts(t.spans, ["h1.xplane.pb", "h3"]).select("host", "seq")


@query("f1_filter_planes", "SELECT plane, seq FROM spans WHERE regexp_matches(plane, 'TPU:[1-3]$')")
def filter_planes(t):
    return fl.filter_planes(t.spans, "TPU:[1-3]$").select("plane", "seq")


@query("f2_filter_events", "SELECT name, seq FROM spans WHERE regexp_matches(name, '^(cl|pu).*c')")
def filter_events(t):
    return fl.filter_events(t.spans, t.spans.select("name").distinct(), "^(cl|pu).*c", ["name"]).select("name", "seq")


@query("f3_filter_contained", "SELECT seq FROM spans WHERE begin >= 86400000000 AND begin + dur <= 864000000000")
def filter_contained(t):
    return fl.filter_contained(t.spans, 86_400_000_000, 864_000_000_000).select("seq")


@query("f4_filter_overlapping", "SELECT seq FROM spans WHERE begin + dur >= 864000000000")
def filter_overlapping(t):
    return fl.filter_overlapping(t.spans, 864_000_000_000).select("seq")


@query("w7_serial", "SELECT host, seq, CAST(least(row_number() OVER (PARTITION BY host, begin // 3600000000 ORDER BY dur DESC, seq) - 1, 256) AS INTEGER) AS serial FROM spans")
def serial(t):
    hourly = t.spans.withColumn("begin", F.expr("begin DIV 3600000000"))
    return fl.serial(hourly, ["host"]).select("host", "seq", "serial")


@query("f5_search_prefix", "SELECT name, seq FROM spans WHERE name LIKE 'pur%'")
def search_prefix(t):
    return fl.search_prefix(t.spans, "pur", ["plane_id"]).select("name", "seq")


@query("f6_drop_internal", "SELECT name, count(*) AS n FROM spans WHERE name NOT IN ('error', 'signup') GROUP BY name")
def drop_internal(t):
    return fl.drop_internal(t.spans, ["error", "signup"]).groupBy("name").agg(F.count("*").alias("n"))


@query("f7_filter_category", "SELECT symbol_id, category FROM ops WHERE lower(trim(category)) LIKE '%steel%'")
def filter_category(t):
    return fl.filter_category(t.ops, " STEEL ", "contains").select("symbol_id", "category")


@query(
    "f8_flag_truncated",
    """SELECT seq, s.begin < w.start OR s.begin + s.dur > w.stop AS cut FROM spans s
  JOIN (SELECT host, min(begin) + 3600000000 AS start, max(begin) AS stop FROM spans GROUP BY host) w USING (host)""",
)
def flag_truncated(t):
    window = t.spans.groupBy("host").agg((F.min("begin") + 3_600_000_000).alias("start"), F.max("begin").alias("stop"))
    return fl.flag_truncated(t.spans, window).select("seq", "cut")


@query("f9_pick_indices", "SELECT seq FROM spans WHERE host = 'h2' AND plane_id = 6")
def pick_indices(t):
    return fl.pick_indices(t.spans, host="h2", plane_id=6, node_id=1)[0].select("seq")


@query("f10_classify_line", "SELECT seq, regexp_matches(upper(line), '^(XLA OPS|PALLAS|LLO OPS)') AS device_line FROM spans")
def classify_line(t):
    return fl.classify_line(t.spans).select("seq", "device_line")


@query(
    "f11_drop_containers",
    "SELECT symbol_id FROM ops WHERE lower(category) NOT IN ('call', 'conditional', 'while', 'megacore fusion', 'infeed', 'outfeed') AND name NOT LIKE 'region%' AND name <> 'IDLE'",
)
def drop_containers(t):
    return fl.drop_region(fl.drop_idle(fl.drop_containers(t.ops, False))).select("symbol_id")


@query(
    "f12_stat",
    "SELECT event_id, coalesce(TRY_CAST(props->>'k' AS BIGINT), user_id) AS k FROM events",
)
def stat(t):
    own = F.from_json("props", "map<string,string>")
    df = t.table("events").select("event_id", own.alias("stats"), F.create_map(F.lit("k"), F.col("user_id").cast("string")).alias("meta_stats"))
    return df.select("event_id", fl.stat("k").try_cast("bigint").alias("k"))


@query("f13_display_name", "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'msg' || seq ELSE name END AS shown FROM spans")
def display_name(t):
    number = F.when(F.col("seq") % 3 == 0, F.col("seq").cast("string")).otherwise(F.col("name"))
    return t.spans.select("seq", fl.display_name(number, F.lit(""), F.concat(F.lit("msg"), "seq")).alias("shown"))


@query("f14_plane_kinds", "SELECT DISTINCT plane, true AS tensor, false AS sparse, false AS host, false AS gpu FROM spans")
def plane_kinds(t):
    p = F.col("plane")
    return t.spans.select("plane", fl.is_tensor_core(p).alias("tensor"), fl.is_sparse_core(p).alias("sparse"), fl.is_host(p).alias("host"), fl.is_gpu(p).alias("gpu")).distinct()


@query("f15_drop_dma_flow", "SELECT seq FROM spans WHERE NOT (plane_id % 2 = 1 AND name = 'view')")
def drop_dma_flow(t):
    df = t.spans.withColumn("dma_device", F.col("plane_id") % 2 == 1).withColumn("flow_role", F.when(F.col("name") == "view", "mid").otherwise("start"))
    return fl.drop_dma_flow(df).select("seq")


# joins


@query("j1_with_meta", "SELECT l_orderkey, l_linenumber, symbol_id, o.name FROM op_events e JOIN ops o USING (program_id, symbol_id)")
def with_meta(t):
    return jn.with_meta(t.op_events, t.ops, ["program_id", "symbol_id"]).select(*FULL, "symbol_id", "name")


@query(
    "j2_with_op_template",
    "SELECT program_id, count(*) AS n, CAST(sum(e.dur) AS BIGINT) AS time, CAST(sum(o.flops) AS BIGINT) AS flops FROM op_events e JOIN ops o USING (program_id, symbol_id) WHERE symbol_id <> 0 GROUP BY program_id",
)
def with_op_template(t):
    return jn.with_op_template(t.op_events, t.ops).groupBy("program_id").agg(F.count("*").alias("n"), F.sum("dur").alias("time"), F.sum("flops").alias("flops"))


@query(
    "j3_with_program_info",
    """SELECT e.program_id, e.category, f.symbol_id AS first_symbol, count(*) AS n FROM
  (SELECT program_id, category FROM op_events JOIN ops USING (program_id, symbol_id) WHERE symbol_id <> 0) e
  LEFT JOIN (SELECT program_id, category, min(symbol_id) AS symbol_id FROM ops GROUP BY ALL) f USING (program_id, category) GROUP BY ALL""",
)
def with_program_info(t):
    e = jn.with_op_template(t.op_events, t.ops).select("program_id", "category")
    out = jn.with_program_info(e, t.ops.select("program_id", "category", "symbol_id"), ["program_id", "category"])
    return out.groupBy("program_id", "category", F.col("symbol_id").alias("first_symbol")).agg(F.count("*").alias("n"))


_LINKS = """links AS (SELECT CASE WHEN name IN ('signup', 'purchase') THEN 'producer' ELSE 'consumer' END AS role, 1 AS kind, correlation_id AS ctx_id,
  plane_id AS pid, seq AS span FROM spans WHERE name <> 'error')"""


def links(t):
    role = F.when(F.col("name").isin("signup", "purchase"), "producer").otherwise("consumer")
    return t.spans.where("name <> 'error'").select(role.alias("role"), F.lit(1).alias("kind"), F.col("correlation_id").alias("ctx_id"), F.col("plane_id").alias("pid"), F.col("seq").alias("span"))


@query(
    "j4_connect_flows",
    """SELECT p.span AS producer, c.span AS consumer FROM links p JOIN links c USING (kind, ctx_id, pid)
  JOIN (SELECT ctx_id, pid FROM links GROUP BY ALL HAVING count(*) FILTER (role = 'producer') < 4 OR count(*) FILTER (role = 'consumer') < 4) k USING (ctx_id, pid)
  WHERE p.role = 'producer' AND c.role = 'consumer'""",
    _LINKS,
)
def connect_flows(t):
    return jn.connect_flows(links(t), 4)


@query(
    "j5_connect_launches",
    """SELECT l.launch, e.seq AS execute FROM spans e JOIN (SELECT correlation_id, arg_max(seq, begin) AS launch FROM spans WHERE name = 'signup' GROUP BY ALL) l
  USING (correlation_id) WHERE name = 'purchase'""",
)
def connect_launches(t):
    return jn.connect_launches(t.spans.where("name = 'signup'"), t.spans.where("name = 'purchase'"))


@query(
    "j11_pair_start_end",
    """SELECT correlation_id, s.begin, e.begin + e.dur - s.begin AS dur FROM
  (SELECT correlation_id, max(begin) AS begin FROM spans WHERE name = 'signup' GROUP BY ALL) s JOIN
  (SELECT correlation_id, max(begin) AS begin, arg_max(dur, begin) AS dur FROM spans WHERE name = 'purchase' GROUP BY ALL) e USING (correlation_id) WHERE s.begin < e.begin""",
)
def pair_start_end(t):
    return jn.pair_start_end(t.spans, F.col("name") == "signup", F.col("name") == "purchase", ["correlation_id"])


@query(
    "j12_fan_out_groups",
    """SELECT request_id, group_id FROM (SELECT request_id, batch_id AS group_id FROM request_batch UNION
  SELECT request_id, batch_id // 10 FROM request_batch)""",
)
def fan_out_groups(t):
    df = t.request_batch.withColumnRenamed("batch_id", "group_id")
    edges = df.select(F.col("group_id").alias("child_group"), F.expr("group_id DIV 10").alias("parent_group")).distinct()
    return jn.fan_out_groups(df, edges)


@query(
    "j14_pair_allocations",
    """SELECT seq, CASE WHEN kind = 'free' THEN first_op ELSE op END AS paired_op FROM (SELECT *, first_value(CASE WHEN kind = 'alloc' THEN op END IGNORE NULLS)
  OVER (PARTITION BY allocator, address, epoch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS first_op FROM (SELECT *, coalesce(sum(CASE WHEN kind = 'free' THEN 1 ELSE 0 END)
  OVER (PARTITION BY allocator, address ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM alloc_events))""",
)
def pair_allocations(t):
    return jn.pair_allocations(t.alloc_events).select("seq", "paired_op")


_FIFO = "row_number() OVER (PARTITION BY device_id, rendezvous ORDER BY ts, seq) AS k"


@query(
    "j15_pair_fifo",
    f"""SELECT device_id, rendezvous, p.seq AS producer, c.seq AS consumer FROM (SELECT *, {_FIFO} FROM visits WHERE opcode = 'send') p
  JOIN (SELECT *, {_FIFO} FROM visits WHERE opcode = 'recv-done') c USING (device_id, rendezvous, k)""",
)
def pair_fifo(t):
    return jn.pair_fifo(t.visits.where("opcode = 'send'"), t.visits.where("opcode = 'recv-done'"), ["device_id", "rendezvous"])


@query("j16_semi_joins", """SELECT seq FROM spans WHERE name = 'purchase' AND correlation_id IN (SELECT correlation_id FROM spans WHERE name = 'signup')
  AND correlation_id NOT IN (SELECT correlation_id FROM spans WHERE name = 'error')""")
def semi_joins(t):
    out = jn.has_async_parent(t.spans.where("name = 'purchase'"), t.spans.where("name = 'signup'"), ["correlation_id"])
    return jn.drop_batch_groups(out, t.spans.where("name = 'error'"), ["correlation_id"]).select("seq")


@query("j16_keep_steps_with_ops", "SELECT plane_id, step FROM steps WHERE EXISTS (SELECT 1 FROM spans s WHERE s.plane_id = steps.plane_id AND s.name = 'error' AND s.begin // 86400000000 = steps.step)")
def keep_steps(t):
    return jn.keep_steps_with_ops(t.steps, t.spans.where("name = 'error'").withColumn("step", F.expr("begin DIV 86400000000")), ["plane_id", "step"]).select("plane_id", "step")


_MEMBERS = "members AS (SELECT concat('p', symbol_id % 50) AS fusion, concat('p', symbol_id) AS op, CASE WHEN symbol_id % 5 = 0 THEN 'parameter' ELSE 'add' END AS opcode FROM ops WHERE symbol_id >= 50)"


@query(
    "j17_with_fused_children",
    """SELECT name, child, CAST(1 AS INTEGER) AS level FROM (SELECT fusion AS name, op AS child, row_number() OVER (PARTITION BY fusion ORDER BY op) AS r FROM members WHERE opcode <> 'parameter') WHERE r <= 10""",
    _MEMBERS,
)
def with_fused_children(t):
    sym = F.col("symbol_id")
    m = t.ops.where("symbol_id >= 50").select(F.concat(F.lit("p"), sym % 50).alias("fusion"), F.concat(F.lit("p"), sym).alias("op"), F.when(sym % 5 == 0, "parameter").otherwise("add").alias("opcode"))
    return jn.with_fused_children(m.select(F.col("fusion").alias("name")), m, depth=2, budget=10)


@query(
    "j18_neighborhood",
    """SELECT op, CAST(min(dist) AS INTEGER) AS dist FROM (SELECT 'p1' AS op, 0 AS dist UNION ALL SELECT dst, 1 FROM hlo_edges WHERE src = 'p1'
  UNION ALL SELECT b.src, 2 FROM hlo_edges a JOIN hlo_edges b ON a.dst = b.dst WHERE a.src = 'p1') GROUP BY op""",
)
def neighborhood(t):
    return jn.neighborhood(t.hlo_edges, "p1", 2)


_CHAIN = """chain AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_size > 40),
named AS (SELECT CASE WHEN src % 3 = 0 THEN 'get-tuple-element.' ELSE 'op.' END || src AS src, CASE WHEN dst % 3 = 0 THEN 'get-tuple-element.' ELSE 'op.' END || dst AS dst FROM chain),
ways AS (SELECT src AS a, dst AS b FROM named WHERE src LIKE 'op.%' UNION ALL SELECT a, dst FROM ways JOIN named ON src = b WHERE b LIKE 'get-%')"""


@query("j18_adjacent", "SELECT a AS src, b AS dst FROM ways WHERE b LIKE 'op.%'", _CHAIN)
def adjacent(t):
    """Parts as a binary tree of ops, every third one only passed through."""
    k = F.col("p_partkey")
    part = t.table("part")
    chain = part.where("p_partkey > 1").select(F.floor(k / 2).alias("src"), k.alias("dst")).unionByName(part.where("p_size > 40").select(k.alias("src"), (k + 1_000_000).alias("dst")))
    name = lambda x: F.concat(F.when(F.col(x) % 3 == 0, "get-tuple-element.").otherwise("op."), F.col(x).cast("string"))
    return jn.adjacent(chain.select(name("src").alias("src"), name("dst").alias("dst")), lambda x: x.startswith("get-tuple-element"))


@query(
    "j20_with_batching_params",
    """SELECT request_id, p.value FROM requests r JOIN (SELECT DISTINCT o_orderpriority AS model_name, length(o_orderpriority) AS value FROM orders) p ON r.model = p.model_name""",
)
def with_batching_params(t):
    models = t.requests.withColumn("model", F.concat("model", F.lit(":"), F.col("request_id") % 3))
    params = t.requests.select("model").distinct().select(F.concat(F.lit("{model_name="), "model", F.lit("}")).alias("label"), F.length("model").cast("bigint").alias("value"))
    return jn.with_batching_params(models, params).select("request_id", "value")


_GRAPH = """edges AS (SELECT DISTINCT parent_seq AS u, seq AS v FROM parents WHERE parent_seq IS NOT NULL UNION
  SELECT l.launch, e.seq FROM spans e JOIN (SELECT correlation_id, arg_max(seq, begin) AS launch FROM spans WHERE name = 'signup' GROUP BY ALL) l USING (correlation_id) WHERE name = 'purchase' AND l.launch < e.seq),
reach AS (SELECT seq AS node, seq AS root FROM spans WHERE name = 'signup' UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
groups AS (SELECT node, min(root) AS group_id FROM reach GROUP BY node)"""


def graph(t):
    tree = iv.nest(t.spans, ["plane_id"], strict=True).where("parent_seq is not null").select(F.col("parent_seq").alias("u"), F.col("seq").alias("v"))
    flow = jn.connect_launches(t.spans.where("name = 'signup'"), t.spans.where("name = 'purchase'")).where("launch < execute")
    edges = gr.checkpointed(tree.unionByName(flow.select(F.col("launch").alias("u"), F.col("execute").alias("v"))).distinct())
    return edges, t.spans.where("name = 'signup'").select(F.col("seq").alias("node"), F.col("seq").alias("rank"))


@query("j21_group_spans", "SELECT node, group_id FROM groups", PARENTS + ", " + _GRAPH)
def group_spans(t):
    return gr.group_spans(*graph(t))


@query(
    "j21_group_relations",
    """SELECT DISTINCT a.group_id AS parent_group, b.group_id AS child_group FROM edges JOIN groups a ON a.node = u JOIN groups b ON b.node = v WHERE a.group_id <> b.group_id""",
    PARENTS + ", " + _GRAPH,
)
def group_relations(t):
    edges, roots = graph(t)
    return gr.group_relations(gr.group_spans(edges, roots), edges)


_EVENTS = (
    PARENTS
    + ", "
    + """linked AS (SELECT DISTINCT parent_seq AS u, seq AS v FROM parents WHERE parent_seq IS NOT NULL UNION
  SELECT l.launch, e.seq FROM spans e JOIN (SELECT correlation_id, arg_max(seq, begin) AS launch FROM spans WHERE name = 'signup' GROUP BY ALL) l USING (correlation_id) WHERE name = 'purchase' AND l.launch <> e.seq),
leveled AS (SELECT seq AS node, begin, CASE name WHEN 'signup' THEN 2 ELSE 1 END AS level FROM spans WHERE name IN ('signup', 'click')),
below AS (SELECT l.node AS root, l.level, e.v AS node FROM leveled l JOIN linked e ON e.u = l.node UNION SELECT b.root, b.level, e.v FROM below b JOIN linked e ON e.u = b.node),
free AS (SELECT *, row_number() OVER (ORDER BY level DESC, begin, node) AS place FROM leveled l WHERE NOT EXISTS (FROM below b WHERE b.node = l.node AND b.level = l.level AND b.root <> l.node)),
reached AS (SELECT node, place FROM free UNION ALL SELECT b.node, f.place FROM below b JOIN free f ON f.node = b.root),
placed AS (SELECT node, min(place) AS place FROM reached GROUP BY node),
opened AS (SELECT f.node, place, row_number() OVER (ORDER BY place) - 1 AS group_id FROM free f JOIN placed USING (node, place)),
grouped AS (SELECT p.node, o.group_id FROM placed p JOIN opened o USING (place))"""
)


def events(t):
    """Groups of the spans: signups are roots above clicks; a purchase hangs below the last signup of its user."""
    level = F.when(F.col("name") == "signup", 2).when(F.col("name") == "click", 1)
    none = {c: F.lit(None).cast(k) for c, k in (("step", "bigint"), ("iteration", "bigint"), ("iter_num", "bigint"), ("graph_type", "string"))}
    step = F.when(F.col("seq") % 5 == 0, F.col("seq") % 100)
    spans = t.spans.select(F.col("seq").alias("node"), "plane_id", "begin", "dur", "name", level.alias("level"), step.alias("step_num"), (F.col("name") == "click").alias("implicit"), *(v.alias(k) for k, v in none.items()))
    flow = jn.connect_launches(t.spans.where("name = 'signup'"), t.spans.where("name = 'purchase'"))
    return gr.group_events(spans, ["plane_id"], [flow], strict=True)


@query("j21_group_events", "SELECT node, group_id FROM grouped", _EVENTS)
def group_events(t):
    return events(t)["groups"]


@query(
    "j21_group_events_relations",
    "SELECT DISTINCT a.group_id AS parent_group, b.group_id AS child_group FROM linked JOIN grouped a ON a.node = u JOIN grouped b ON b.node = v WHERE a.group_id <> b.group_id",
    _EVENTS,
)
def group_events_relations(t):
    return events(t)["relations"]


@query(
    "j21_group_events_names",
    """SELECT group_id, CASE WHEN name = 'click' THEN '' ELSE name || ' ' END || coalesce(step, group_id) AS name FROM
  (SELECT o.group_id, s.name, (SELECT arg_min(v, (d, v)) FROM (SELECT d, seq % 100 AS v FROM above JOIN spans ON seq = top WHERE above.node = o.node AND seq % 5 = 0)) AS step
   FROM opened o JOIN spans s ON s.seq = o.node)""",
    _EVENTS + """, above AS (SELECT node, node AS top, 0 AS d FROM opened UNION SELECT a.node, e.u, a.d + 1 FROM above a JOIN linked e ON e.v = a.top WHERE a.d < 30)""",
)
def group_events_names(t):
    return events(t)["names"]


@query(
    "j22_is_eager",
    """SELECT node, min(is_func) = 0 AS eager FROM (SELECT *, min(d) OVER (PARTITION BY node) AS m FROM dist) WHERE d = m GROUP BY node""",
    PARENTS
    + """, dist AS (SELECT seq AS node, CAST(seq % 2 AS INTEGER) AS is_func, 0 AS d FROM spans WHERE name = 'signup'
  UNION SELECT p.seq, r.is_func, r.d + 1 FROM dist r JOIN parents p ON p.parent_seq = r.node)""",
)
def is_eager(t):
    tree = iv.nest(t.spans, ["plane_id"], strict=True).where("parent_seq is not null").select(F.col("parent_seq").alias("u"), F.col("seq").alias("v"))
    return gr.is_eager(gr.checkpointed(tree), t.spans.where("name = 'signup'").select(F.col("seq").alias("node"), (F.col("seq") % 2).alias("is_func")))


@query("u1_union_hosts", "SELECT CAST(substr(host, 2) AS BIGINT) * 1000 + plane_id AS core, count(*) AS n FROM spans GROUP BY 1")
def union_hosts(t):
    parts = [t.spans.where(f"host = 'h{k}'").withColumnRenamed("plane_id", "core") for k in range(4)]
    return jn.union_hosts(parts).groupBy("core").agg(F.count("*").alias("n"))


@query("u2_intersect", "SELECT correlation_id FROM spans WHERE name = 'signup' INTERSECT SELECT correlation_id FROM spans WHERE name = 'error'")
def intersect(t):
    return t.spans.where("name = 'signup'").select("correlation_id").intersect(t.spans.where("name = 'error'").select("correlation_id"))


@query("u3_except", "SELECT correlation_id FROM spans WHERE name = 'signup' EXCEPT ALL SELECT correlation_id FROM spans WHERE name = 'error'")
def except_all(t):
    return t.spans.where("name = 'signup'").select("correlation_id").exceptAll(t.spans.where("name = 'error'").select("correlation_id"))


# aggregations


@query(
    "a1_aggregate_events",
    """SELECT name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total, round(sum(dur) / count(*), 2) AS avg, min(dur) AS min, max(dur) AS max,
  round(stddev_samp(dur) / 1000, 2) AS std_dev, CAST(count(*) FILTER (begin < 86400000000) AS BIGINT) AS truncated FROM spans WHERE regexp_matches(plane, 'TPU') AND regexp_matches(name, 'i|e') GROUP BY name""",
)
def aggregate_events(t):
    out = mt.aggregate_events(t.spans, "TPU", "i|e", F.col("begin") < 86_400_000_000)
    return out.withColumn("avg", F.round(F.col("total") / F.col("count"), 2)).withColumn("std_dev", F.round(F.col("std_dev") / 1000, 2))


@query("a2_kernel_stats", "SELECT name AS kernel, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total, round(sum(dur) / count(*), 2) AS avg FROM spans GROUP BY name ORDER BY total DESC, kernel LIMIT 3")
def kernel_stats(t):
    return mt.kernel_stats(t.spans, c.canonical_kernel(F.col("name")), 3).withColumn("avg", F.round("avg", 2))


@query(
    "a2_kernel_summary",
    """SELECT plane_id, b.busy, b.islands, round(m.avg, 2) AS avg, round(m.sd / 1000, 2) AS sd, m.min, m.max, m.steps FROM
  (SELECT plane_id, CAST(sum(end_ts - begin) AS BIGINT) AS busy, count(*) AS islands FROM islands GROUP BY plane_id) b LEFT JOIN
  (SELECT plane_id, avg(dur) AS avg, stddev_samp(dur) AS sd, min(dur) AS min, max(dur) AS max, count(*) AS steps FROM spans WHERE name = 'signup' GROUP BY plane_id) m USING (plane_id)""",
    islands(src="(SELECT * FROM spans WHERE name <> 'signup')"),
)
def kernel_summary(t):
    out = mt.kernel_summary(t.spans.where("name <> 'signup'"), t.spans.where("name = 'signup'"), ["plane_id"])
    return out.withColumn("avg", F.round("avg", 2)).withColumn("sd", F.round(F.col("sd") / 1000, 2))


@query("a3_avg_step_time", "SELECT count(*) AS count, round(avg(dur), 2) AS avg FROM spans WHERE name = 'view'")
def avg_step_time(t):
    return mt.avg_step_time(t.spans, "^view$").withColumn("avg", F.round("avg", 2))


@query("a4_op_metrics", "SELECT program_id, symbol_id, name, occurrences, time, self_time, min_time, dma_stall, flops, bytes FROM metrics", METRICS)
def op_metrics(t):
    return metrics(t).select("program_id", "symbol_id", "name", "occurrences", "time", "self_time", "min_time", "dma_stall", "flops", "bytes")


@query(
    "a5_merge_op_metrics",
    """SELECT program_id, category, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(time) AS BIGINT) AS time, CAST(sum(self_time) AS BIGINT) AS self_time,
  min(min_time) AS min_time, CAST(sum(flops) AS BIGINT) AS flops, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS parts FROM metrics GROUP BY ALL""",
    METRICS,
)
def merge_op_metrics(t):
    return mt.merge_op_metrics(metrics(t).withColumn("group", F.col("category")), ["program_id", "group"]).drop("group")


@query("a6_with_idle", "SELECT name, CAST(self_time AS BIGINT) AS self_time FROM metrics UNION ALL SELECT 'IDLE', CAST(sum(time) * 2 - sum(self_time) AS BIGINT) FROM metrics", METRICS)
def with_idle(t):
    return mt.with_idle(metrics(t), F.sum("time") * 2).select("name", "self_time")


@query(
    "a7_framework_ops",
    """SELECT substr(provenance, 1, length(provenance) - 3) AS op_name, max(occurrences) AS occurrences, CAST(sum(time) AS BIGINT) AS time, CAST(sum(flops) AS BIGINT) AS flops
  FROM (SELECT *, replace(provenance, ' ', '_') AS p FROM metrics) GROUP BY ALL""".replace("FROM (SELECT *, replace(provenance, ' ', '_') AS p FROM metrics)", "FROM (SELECT * REPLACE (replace(replace(provenance, ' ', '_'), '#', '_') AS provenance) FROM metrics)"),
    METRICS,
)
def framework_ops(t):
    return mt.framework_ops(metrics(t).withColumn("provenance", F.translate("provenance", " #", "__"))).select("op_name", "occurrences", "time", "flops")


@query(
    "a8_host_ops",
    """SELECT 'Unknown' AS category, name AS op_name, count(*) AS occurrences, CAST(sum(dur) AS BIGINT) AS time, CAST(sum(greatest(p.dur - coalesce(i.inner_dur, 0), 0)) AS BIGINT) AS self_time
  FROM (SELECT p.*, s.name FROM parents p JOIN spans s USING (seq)) p LEFT JOIN (SELECT parent_seq, sum(dur) AS inner_dur FROM parents GROUP BY parent_seq) i ON i.parent_seq = p.seq GROUP BY name""".replace("sum(dur)", "sum(p.dur)", 1),
    PARENTS,
)
def host_ops(t):
    return mt.host_ops(iv.self_time(t.spans, ["plane_id"], strict=True))


@query(
    "a9_gpu_op_metrics",
    """SELECT name, count(*) AS runs, CAST(sum(e - b) AS BIGINT) AS time, CAST(sum(n) AS BIGINT) AS kernels FROM (SELECT plane_id, name, min(begin) AS b, max(begin + dur) AS e, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY plane_id ORDER BY begin, dur DESC, seq) - row_number() OVER (PARTITION BY plane_id, name ORDER BY begin, dur DESC, seq) AS g FROM spans)
  GROUP BY plane_id, name, g) GROUP BY name""",
)
def gpu_op_metrics(t):
    runs = iv.merge_runs(t.spans, ["plane_id"], ["name"])
    return runs.groupBy("name").agg(F.count("*").alias("runs"), F.sum("dur").alias("time"), F.sum("events").alias("kernels"))


@query("a10_gpu_kernel_stats", "SELECT name, plane_id, CAST(sum(dur) AS BIGINT) AS total, min(dur) AS min, max(dur) AS max, count(*) AS count FROM spans WHERE dur > 0 GROUP BY name, plane_id ORDER BY total DESC, name, plane_id LIMIT 12")
def gpu_kernel_stats(t):
    return mt.gpu_kernel_stats(t.spans, ["name", "plane_id"], 12)


@query("a11_kernels_by_op", "SELECT name, CAST(sum(dur) AS BIGINT) AS total, CAST(sum(CASE WHEN plane_id = 3 THEN dur ELSE 0 END) AS BIGINT) AS tensor_core FROM spans GROUP BY name")
def kernels_by_op(t):
    return mt.kernels_by_op(mt.gpu_kernel_stats(t.spans, ["name", "plane_id"]), "name", F.col("plane_id") == 3)


@query("a12_merge_memory", "SELECT program_id, CAST(symbol_id % 2 AS INTEGER) AS op, CAST(symbol_id % 3 AS BIGINT) AS space, CAST(sum(bytes) AS BIGINT) AS bytes FROM ops GROUP BY ALL")
def merge_memory(t):
    item = F.struct((F.col("symbol_id") % 2).cast("int").alias("op"), (F.col("symbol_id") % 3).alias("space"), "bytes")
    return mt.merge_memory(t.ops.select("program_id", F.array(item).alias("memory")), ["program_id"])


_STEPPED = """stepped AS (SELECT s.plane_id, s.seq, s.name, s.dur, min(t.step) AS step FROM spans s JOIN steps t ON s.plane_id = t.plane_id
  AND s.begin <= t.begin + t.dur AND t.begin <= s.begin + s.dur GROUP BY ALL)"""
_BREAKDOWN = _STEPPED + """, breakdown AS (SELECT plane_id, step, name AS category, CAST(sum(dur) AS BIGINT) AS time FROM stepped GROUP BY ALL UNION ALL
  SELECT plane_id, step, 'idle', CAST(greatest(t.dur - coalesce(u.used, 0), 0) AS BIGINT) FROM steps t LEFT JOIN (SELECT plane_id, step, sum(dur) AS used FROM stepped GROUP BY ALL) u USING (plane_id, step))"""


def breakdown(t):
    e = iv.assign_step(t.spans, t.steps, ["plane_id"], 21_600_000_000).withColumn("self_dur", F.col("dur"))
    return mt.step_breakdown(e, t.steps, ["plane_id"], "name")


@query("a13_step_breakdown", "SELECT * FROM breakdown", _BREAKDOWN)
def step_breakdown(t):
    return breakdown(t)


@query("a14_program_totals", "SELECT CAST(sum(self_time) AS BIGINT) AS self_time, CAST(sum(flops) AS BIGINT) AS flops, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS ops FROM metrics", METRICS)
def program_totals(t):
    return mt.program_totals(metrics(t), False)


_PROFILE = METRICS + """, profile AS (SELECT program_id, category, name, CAST(sum(self_time) AS BIGINT) AS self_time, CAST(sum(flops) AS BIGINT) AS flops, CAST(sum(occurrences) AS BIGINT) AS occurrences,
  CAST(3 - (CASE grouping(program_id, category, name) WHEN 7 THEN 3 WHEN 3 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS INTEGER) AS level FROM metrics GROUP BY ROLLUP (program_id, category, name))"""


@query("a15_op_profile", "SELECT * FROM profile", _PROFILE)
def op_profile(t):
    return mt.op_profile(metrics(t))


@query(
    "a15_op_profile_by_scope",
    """SELECT CAST(depth AS INTEGER) AS depth, scope, CAST(sum(self_time) AS BIGINT) AS self_time, count(*) AS ops FROM (SELECT self_time, depth, array_to_string(list_slice(string_split(provenance, '/'), 1, depth + 1), '/') AS scope
  FROM (SELECT *, unnest(range(len(string_split(provenance, '/')))) AS depth FROM metrics)) GROUP BY ALL""",
    METRICS,
)
def op_profile_by_scope(t):
    return mt.op_profile_by_scope(metrics(t))


_TREE = """tm AS (SELECT *, concat(CAST(program_id AS VARCHAR), '/', CAST(symbol_id AS VARCHAR), '/', name) AS op, split_part(name, ' ', 1) AS dedup FROM metrics),
raw AS (SELECT 0 AS depth, '' AS p, '' AS c, '' AS d, '' AS o, 'by_program' AS name, CAST(sum(self_time) AS BIGINT) AS time, 0 AS occurrences, NULL AS category, 'root' AS kind, sum(flops) AS flops FROM tm
  UNION ALL SELECT 1, CAST(program_id AS VARCHAR), '', '', '', concat('p(', CAST(program_id AS VARCHAR), ')'), sum(self_time), 0, NULL, 'program', sum(flops) FROM tm GROUP BY program_id
  UNION ALL SELECT 2, CAST(program_id AS VARCHAR), category, '', '', category, sum(time), sum(occurrences), category, 'category', sum(flops) FROM tm GROUP BY program_id, category
  UNION ALL SELECT 3, CAST(program_id AS VARCHAR), category, dedup, '', dedup, sum(time), sum(occurrences), category, 'duplicates', sum(flops) FROM tm GROUP BY program_id, category, dedup
  UNION ALL SELECT 4, CAST(program_id AS VARCHAR), category, dedup, op, name, sum(time), sum(occurrences), category, 'op', sum(flops) FROM tm GROUP BY program_id, category, dedup, op, name),
parented AS (SELECT *, CASE depth WHEN 0 THEN [] WHEN 1 THEN ['r'] WHEN 2 THEN ['r', p] WHEN 3 THEN ['r', p, c] ELSE ['r', p, c, d] END AS parent,
  CASE depth WHEN 0 THEN ['r'] WHEN 1 THEN ['r', p] WHEN 2 THEN ['r', p, c] WHEN 3 THEN ['r', p, c, d] ELSE ['r', p, c, d, o] END AS own FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY depth, parent ORDER BY time DESC, name, o) AS rank, count(*) OVER (PARTITION BY depth, parent) AS siblings FROM parented),
kept AS (SELECT * FROM placed WHERE depth <= 2 OR rank <= 3),
counted AS (SELECT k.*, coalesce(n.n_children, 0) AS n_children, n.top FROM kept k LEFT JOIN (SELECT depth - 1 AS depth, parent AS own, max(siblings) AS n_children, arg_min(name, rank) AS top FROM placed GROUP BY depth, parent) n USING (depth, own)
  WHERE depth < 4 OR EXISTS (FROM kept u WHERE u.depth = 3 AND u.own = k.parent)),
tree AS (SELECT CASE WHEN kind = 'op' AND siblings = 1 THEN 3 ELSE depth END AS depth, kind, category, CAST(time AS BIGINT) AS time, CAST(occurrences AS BIGINT) AS occurrences, CAST(flops AS BIGINT) AS flops, n_children,
  CASE WHEN kind = 'duplicates' THEN top || ' and its duplicate(s)' ELSE name END AS name FROM counted WHERE NOT (kind = 'duplicates' AND n_children = 1))"""


def tree(t, by="program", k=3):
    from spanforge.operators.optree import op_tree

    x = metrics(t).withColumns({"program": F.lit("p"), "dedup_name": F.substring_index("name", " ", 1)})
    return op_tree(x, by, k)


@query("a15_op_tree", "SELECT depth, name, kind, category, time, flops, occurrences, n_children FROM tree", METRICS + ", " + _TREE)
def op_tree_by_program(t):
    """The three largest nodes below each node from the third level on, duplicates folded, lone ones raised."""
    return tree(t).select("depth", "name", "kind", "category", "time", "flops", "occurrences", "n_children")


_FLAT = """leaves AS (SELECT concat_ws('/', 'by_program', concat('p(', p, ')'), category, CASE WHEN siblings > 1 THEN (SELECT top FROM counted u WHERE u.depth = 3 AND u.own = k.parent) || ' and its duplicate(s)' END, name) AS name,
  category, CAST(time AS BIGINT) AS time, greatest(CAST(occurrences AS BIGINT), 1) AS occurrences, CAST(flops AS BIGINT) AS flops FROM counted k WHERE kind = 'op' AND time > 0)"""


@query("t6_flat", "SELECT * FROM leaves ORDER BY time DESC, name LIMIT 40", ", ".join((METRICS, _TREE, _FLAT)))
def flat_view(t):
    from spanforge.operators.optree import op_profile_views

    return op_profile_views(tree(t), "flat", top_n=40).drop("bytes")


@query(
    "t6_category",
    """SELECT category, CAST(sum(time) AS BIGINT) AS time, CAST(sum(flops) AS BIGINT) AS flops, count(*) AS ops, string_split(arg_min(name, row(-time, name)), '/')[-1] AS top_op,
  round(sum(time) / (SELECT max(time) FROM tree WHERE depth = 0), 4) AS fraction FROM leaves GROUP BY category""",
    ", ".join((METRICS, _TREE, _FLAT)),
)
def category_view(t):
    from spanforge.operators.optree import op_profile_views

    return op_profile_views(tree(t), "category").drop("bytes")


@query(
    "t6_tree",
    "SELECT depth, name, time FROM tree t WHERE depth <= 2 AND time > 0",
    METRICS + ", " + _TREE,
)
def tree_view(t):
    from spanforge.operators.optree import op_profile_views

    return op_profile_views(tree(t), "tree", path="by_program", depth=3).select("depth", "name", "time")


@query(
    "a15_op_tree_provenance",
    """SELECT depth, names, CAST(sum(self_time) AS BIGINT) AS time FROM (SELECT self_time, unnest(range(2, 2 + len(parts))) AS depth, ['by_provenance', concat('p(', CAST(program_id AS VARCHAR), ')')] || parts AS parts FROM
  (SELECT *, string_split(replace(provenance, ':Op', ''), '/') AS parts FROM metrics)) JOIN LATERAL (SELECT parts[:depth + 1] AS names) ON true GROUP BY ALL""",
    METRICS,
)
def op_tree_by_provenance(t):
    """Scopes of the provenance below their program, all levels."""
    return tree(t, "provenance", 100).where("kind = 'scope'").select("depth", "names", "time")


@query(
    "a16_time_by_class",
    "SELECT CASE WHEN regexp_matches(lower(name) || ' ' || lower(category), 'copy') THEN 'HBM' ELSE 'compute' END AS class, CAST(sum(self_time) AS BIGINT) AS time FROM metrics GROUP BY 1",
    METRICS,
)
def time_by_class(t):
    return mt.time_by_class(metrics(t))


@query("a20_summary_stats", "SELECT plane_id, round(avg(dur), 2) AS avg, round(stddev_samp(dur) / 1000, 2) AS sd, min(dur) AS min, max(dur) AS max FROM spans GROUP BY plane_id")
def summary_stats(t):
    return mt.summary_stats(t.spans, "dur", ["plane_id"]).withColumn("avg", F.round("avg", 2)).withColumn("sd", F.round(F.col("sd") / 1000, 2))


@query("a37_launch_stats", "SELECT plane_id, name, min(begin) AS first, max(begin) AS last, count(*) AS count, max(dur) AS max, round(avg(dur), 2) AS avg FROM spans GROUP BY ALL")
def launch_stats(t):
    return mt.launch_stats(t.spans, ["plane_id", "name"]).withColumn("avg", F.round("avg", 2))


@query("a39_mode_first", "SELECT plane_id, name, count FROM (SELECT *, row_number() OVER (PARTITION BY plane_id ORDER BY count DESC, o) AS r FROM (SELECT plane_id, name, count(*) AS count, min(seq) AS o FROM spans GROUP BY plane_id, name)) WHERE r = 1")
def mode_first(t):
    return mt.mode_first(t.spans, "name", "seq", ["plane_id"])


@query(
    "a41_infeed_ratio",
    """SELECT plane_id, CAST(sum(dur) AS BIGINT) AS enqueue, CAST(sum(nxt - begin) AS BIGINT) AS gaps, round(sum(dur) / sum(nxt - begin), 6) AS ratio FROM
  (SELECT *, lead(begin) OVER (PARTITION BY plane_id ORDER BY begin, seq) AS nxt FROM spans WHERE name = 'view') WHERE nxt IS NOT NULL GROUP BY plane_id""",
)
def infeed_ratio(t):
    return mt.infeed_ratio(t.spans.where("name = 'view'"), ["plane_id"]).withColumn("ratio", F.round("ratio", 6))


@query("a43_assign_ids", "SELECT correlation_id, CAST(row_number() OVER (ORDER BY min(seq)) - 1 AS INTEGER) AS id FROM spans GROUP BY correlation_id")
def assign_ids(t):
    return mt.assign_ids(t.spans, "correlation_id", "seq")


@query("a45_distinct_values", "SELECT DISTINCT category FROM ops")
def distinct_values(t):
    return mt.distinct_values(t.ops, "category")


@query(
    "w1_rank_cumulative",
    """SELECT symbol_id, CAST(row_number() OVER o AS INTEGER) AS rank, round(self_time / sum(self_time) OVER (), 8) AS fraction, round(sum(self_time) OVER (o ROWS UNBOUNDED PRECEDING) / sum(self_time) OVER (), 8) AS cumulative
  FROM metrics WINDOW o AS (ORDER BY self_time DESC, symbol_id)""",
    METRICS,
)
def rank_cumulative(t):
    out = mt.rank_cumulative(metrics(t), "self_time", "symbol_id")
    return out.select("symbol_id", "rank", F.round("fraction", 8).alias("fraction"), F.round("cumulative", 8).alias("cumulative"))


_ROOF = """roof AS (SELECT *, flops / (time / 1000.0) AS rate, bytes / (time / 1000.0) * (1000000000.0 / 1073741824) AS bw FROM metrics)"""


@query(
    "x6_roofline",
    """SELECT symbol_id, round(rate, 4) AS flop_rate, round(bw, 4) AS bandwidth, round(flops / bytes, 6) AS intensity, CASE WHEN bw / 900 > rate / 300 THEN 'HBM' WHEN rate > 0 THEN 'Compute' ELSE 'Unknown' END AS bound_by,
  round(greatest(rate / 300, bw / 900), 6) AS efficiency FROM roof""",
    METRICS + ", " + _ROOF,
)
def roofline(t):
    out = mt.roofline(metrics(t), 300.0, 900.0)
    return out.select("symbol_id", F.round("flop_rate", 4).alias("flop_rate"), F.round("bandwidth", 4).alias("bandwidth"), F.round("intensity", 6).alias("intensity"), "bound_by", F.round("efficiency", 6).alias("efficiency"))


# sorts, limits, top-k

_TOP = "(SELECT '{c}' AS list, name, symbol_id, CAST({c} AS BIGINT) AS value FROM metrics ORDER BY {c} DESC, name, symbol_id LIMIT 10)"


@query("t1_top_ops", " UNION ALL ".join(_TOP.format(c=x) for x in ("self_time", "flops", "bytes")), METRICS)
def top_ops(t):
    return mt.top_ops(metrics(t), 10)


@query("t2_list_events", "SELECT seq, name FROM spans ORDER BY seq LIMIT 50 OFFSET 200")
def list_events(t):
    return mt.list_events(t.spans, 50, 200).select("seq", "name")


@query(
    "t2_list_summary",
    """SELECT CAST(least(greatest(n - 40, 0), 100) AS BIGINT) AS returned, n AS total_matched, n > least(greatest(n - 40, 0), 100) + 40 AS truncated FROM
  (SELECT count(*) AS n FROM spans WHERE regexp_matches(plane, 'TPU:[0-3]$') AND regexp_matches(name, 'click|view') AND begin >= 86400000000 AND begin + dur <= 1728000000000)""",
)
def list_summary(t):
    return mt.list_summary(mt.matched_events(t.spans, "TPU:[0-3]$", "click|view", DAY, 20 * DAY), 100, 40)


@query("t3_op_stats_table", "SELECT symbol_id, name, flops FROM metrics ORDER BY flops DESC, name, symbol_id LIMIT 20", METRICS)
def op_stats_table(t):
    return mt.op_stats_table(metrics(t), "flops").select("symbol_id", "name", "flops")


@query("t4_top_per_group", "SELECT category, symbol_id, self_time FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY self_time DESC, symbol_id) AS r FROM metrics) WHERE r <= 5", METRICS)
def top_per_group(t):
    return mt.top_per_group(metrics(t), ["category"], "self_time", 5, ["symbol_id"]).select("category", "symbol_id", "self_time")


@query("t5_first_events", "SELECT seq FROM spans ORDER BY begin, seq LIMIT 1000")
def first_events(t):
    return mt.first_events(t.spans, 1000).select("seq")


@query("t5_first_events_at_one_time", f"SELECT seq, begin FROM (SELECT seq, begin // {DAY} AS begin FROM spans) ORDER BY begin, seq LIMIT 4321")
def first_events_at_one_time(t):
    """Times of whole days, so that the quota at the last one matters."""
    return mt.first_events(t.spans.withColumn("begin", F.expr(f"begin DIV {DAY}")), 4321).select("seq", "begin")


_KIND = "CASE name WHEN 'signup' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 END"
_CLIPPED = f"""marks AS (SELECT plane_id, step, true AS device, begin, dur FROM steps WHERE step % 3 <> 0 UNION ALL SELECT plane_id, step, true, begin, dur // 2 FROM steps WHERE step % 3 = 1
  UNION ALL SELECT plane_id, step, false, begin + 1000000 * (step % 2), dur + 5000000 * (step % 2) FROM steps),
longest AS (SELECT plane_id, step, device, arg_max(begin, row(dur, -begin)) AS begin, max(dur) AS dur FROM marks GROUP BY ALL),
times AS (SELECT h.plane_id, h.step, CASE WHEN d.begin IS NULL OR h.begin <= d.begin AND d.begin + d.dur <= h.begin + h.dur THEN h.begin ELSE d.begin END AS begin,
  CASE WHEN d.begin IS NULL OR h.begin <= d.begin AND d.begin + d.dur <= h.begin + h.dur THEN h.dur ELSE d.dur END AS dur
  FROM (FROM longest WHERE NOT device) h LEFT JOIN (FROM longest WHERE device) d ON d.plane_id = h.plane_id AND d.step = h.step),
cut AS (SELECT t.plane_id, t.step, {_KIND} AS kind, greatest(s.begin, t.begin) AS b, least(s.begin + s.dur, t.begin + t.dur) AS e FROM spans s JOIN times t ON t.plane_id = s.plane_id
  AND s.begin < t.begin + t.dur AND t.begin < s.begin + s.dur WHERE s.name <> 'error'),
moments AS (SELECT plane_id, step, t, lead(t) OVER (PARTITION BY plane_id, step ORDER BY t) AS u FROM (SELECT plane_id, step, b AS t FROM cut WHERE b < e UNION SELECT plane_id, step, e FROM cut WHERE b < e)),
top AS (SELECT m.plane_id, m.step, u - t AS len, max(kind) AS kind FROM moments m JOIN cut c ON c.plane_id = m.plane_id AND c.step = m.step AND b <= t AND u <= e GROUP BY ALL, t, u),
known AS (SELECT plane_id, step, kind, CAST(sum(len) AS BIGINT) AS time FROM top GROUP BY ALL),
good AS (SELECT plane_id, step, CAST(sum(time) AS BIGINT) AS covered FROM known GROUP BY ALL HAVING bool_or(kind IN (1, 4)))"""


@query(
    "a13_step_kinds",
    """SELECT plane_id, step, CAST(kind AS INTEGER) AS kind, time FROM known JOIN good USING (plane_id, step) UNION ALL SELECT plane_id, step, 0, dur - covered FROM times JOIN good USING (plane_id, step) WHERE dur > covered""",
    _CLIPPED.replace("GROUP BY ALL, t, u", "GROUP BY m.plane_id, m.step, t, u"),
)
def step_kinds(t):
    """Spans cut at the times of steps, by the longest markers of device and host."""
    s = t.steps.withColumns({"odd": F.col("step") % 2, "third": F.col("step") % 3})
    some = lambda df, device, begin, dur: df.select("plane_id", "step", F.lit(device).alias("device"), begin.alias("begin"), dur.alias("dur"))
    begin, dur = F.col("begin"), F.col("dur")
    marks = some(s.where("third <> 0"), True, begin, dur).unionByName(some(s.where("third = 1"), True, begin, F.expr("dur DIV 2")))
    marks = marks.unionByName(some(s, False, begin + 1_000_000 * F.col("odd"), dur + 5_000_000 * F.col("odd")))
    times = mt.step_times(marks, ["plane_id"])
    kind = F.when(F.col("name") == "signup", 4).when(F.col("name") == "purchase", 3).when(F.col("name") == "view", 2).when(F.col("name") == "click", 1)
    cut = mt.clip_to_steps(t.spans.select("plane_id", "begin", "dur", kind.alias("kind")).where("kind is not null"), times, ["plane_id"], DAY)
    return mt.step_kinds(cut, times, ["plane_id"], 4, [1, 4])


@query("t6_op_profile_view", "SELECT program_id, category, self_time FROM profile WHERE level = 2 ORDER BY self_time DESC, program_id, category LIMIT 25", _PROFILE)
def op_profile_view(t):
    return mt.op_profile_view(mt.op_profile(metrics(t)), 2, 25).select("program_id", "category", "self_time")


@query(
    "t7_profile_summary",
    """SELECT program_id, category, name, self_time, level FROM (SELECT *, max(CASE WHEN level = 1 THEN self_time END) OVER (PARTITION BY program_id) AS t1,
  max(CASE WHEN level = 2 THEN self_time END) OVER (PARTITION BY program_id, category) AS t2 FROM profile)
  ORDER BY CASE WHEN level = 0 THEN 0 ELSE 1 END, t1 DESC, program_id, CASE WHEN level <= 1 THEN 0 ELSE 1 END, t2 DESC, category, level, self_time DESC, name LIMIT 10""",
    _PROFILE,
)
def profile_summary(t):
    return mt.profile_summary(mt.op_profile(metrics(t))).select("program_id", "category", "name", "self_time", "level")


@query("t8_capped_scan", "SELECT count(*) AS n, count(*) > 5000 AS truncated FROM (SELECT * FROM spans LIMIT 5001)".replace("count(*) AS n", "least(count(*), 5000) AS n"))
def capped_scan(t):
    df, more = mt.capped_scan(t.spans, 5000)
    return df.agg(F.count("*").alias("n"), F.lit(more).alias("truncated"))


_FLOWS = """f AS (SELECT *, CASE WHEN seq % 2 = 0 THEN correlation_id END AS flow, CASE name WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'mid' END AS entry, name = 'view' AS unbound,
  CASE WHEN seq % 4 = 0 THEN 'tf' END AS cat, CASE WHEN seq % 5 = 0 THEN seq % 100 END AS g FROM spans)"""


@query(
    "s8_trace_rows",
    """SELECT 'M' AS ph, plane_id AS pid, NULL AS tid, 'process_name' AS name, plane AS arg_name, NULL AS arg_sort_index, NULL AS arg_uid, NULL AS arg_group_id, NULL AS ts, NULL AS dur, NULL AS bind_id, NULL AS cat, NULL AS flow_in, NULL AS flow_out, NULL AS id FROM f GROUP BY plane_id, plane
  UNION ALL SELECT 'M', plane_id, NULL, 'process_sort_index', NULL, plane_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY plane_id
  UNION ALL SELECT 'M', plane_id, line_id, 'thread_name', line, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY plane_id, line_id, line
  UNION ALL SELECT 'M', plane_id, line_id, 'thread_sort_index', NULL, line_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY plane_id, line_id
  UNION ALL SELECT 'X', plane_id, line_id, name, NULL, NULL, seq, g, begin / 2.0, greatest(dur, 1) / 2.0, flow, CASE WHEN flow IS NOT NULL THEN cat END, CASE WHEN flow IS NOT NULL AND entry <> 'start' THEN true END, CASE WHEN flow IS NOT NULL AND entry <> 'end' THEN true END, NULL FROM f WHERE NOT unbound
  UNION ALL SELECT CASE WHEN entry = 'end' THEN 'e' ELSE 'b' END, plane_id, NULL, name, NULL, NULL, seq, g, begin / 2.0, NULL, NULL, coalesce(cat, ''), NULL, NULL, flow FROM f WHERE unbound AND flow IS NOT NULL
  UNION ALL SELECT 'e', plane_id, NULL, name, NULL, NULL, NULL, g, (begin + dur) / 2.0, NULL, NULL, coalesce(cat, ''), NULL, NULL, flow FROM f WHERE unbound AND flow IS NOT NULL AND entry = 'mid'""",
    _FLOWS,
)
def trace_rows(t):
    """All row kinds and fields of a trace: names of tracks, spans with flows, asynchronous pairs."""
    from spanforge.sources.sinks import trace_rows

    seq = F.col("seq")
    entry = F.when(F.col("name") == "signup", "start").when(F.col("name") == "purchase", "end").otherwise("mid")
    spans = t.spans.withColumns({
        "flow": F.when(seq % 2 == 0, F.col("correlation_id")), "flow_entry": entry, "unbound": F.col("name") == "view", "category": F.when(seq % 4 == 0, "tf"), "group_id": F.when(seq % 5 == 0, seq % 100),
    })
    return trace_rows(spans, 2.0)
