"""Queries over trace files: the given events are written as the contents of trace files with stats of every kind, one
file per day and host, and what comes back is compared with the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.catalog.registry import fitting, query
from spanforge.operators import joins as jn
from spanforge.plans.work import checkpointed
from spanforge.sources import spaces as sp
from spanforge.sources.adapters import DAY, ORIGIN_US

_HOST = "CASE WHEN name = 'signup' THEN"
#: The spans as they go into the files.
FILED = f"""filed AS (SELECT concat('d', CAST(begin // {DAY} AS VARCHAR)) AS session, host, {_HOST} plane_id + 100 ELSE plane_id END AS plane_id,
  {_HOST} '/host:CPU' ELSE plane END AS plane, line_id, line, seq, name, begin % {DAY} AS started, dur, correlation_id, e.value, e.props
  FROM spans JOIN events e ON e.event_id = seq)"""
_ORDER = "ORDER BY started, dur DESC, seq"


def _value(kind: str, x):
    parts = {"int": "bigint", "real": "double", "text": "string", "raw": "binary"}
    return F.struct(*((x if k == kind else F.lit(None)).cast(t).alias(k) for k, t in parts.items()))


def _stats(**values):
    entries = F.array(*(F.struct(F.lit(name).alias("k"), F.when(x.isNotNull(), _value(kind, x)).alias("v")) for name, (kind, x) in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def filed(t):
    """Spans with stats, and the dictionary entries' own stats."""
    name, host = F.col("name"), F.col("name") == "signup"
    flow = lambda *names: F.when(name.isin(*names), F.col("correlation_id"))
    one = lambda x: F.when(x.isNotNull(), F.lit(1))
    p, c = flow("signup", "purchase"), flow("view", "click")
    df = t.spans.join(t.table("events").select(F.col("event_id").alias("seq"), "value", "props"), "seq")
    stats = _stats(
        correlation_id=("int", F.when(name.isin("signup", "purchase"), F.col("correlation_id"))), delta=("int", -F.col("seq")), value=("real", F.col("value")),
        type=("text", name), note=("text", F.col("props")), raw=("raw", F.concat(F.lit("e"), F.col("seq").cast("string"))),
        symbol_id=("int", F.when(F.col("seq") % 3 == 0, F.col("seq") % 50)), _p=("int", p), _pt=("int", one(p)), _c=("int", c), _ct=("int", one(c)),
    )
    spans = df.select(
        F.concat(F.lit("d"), F.expr(f"begin DIV {DAY}")).alias("session"), "host", F.when(host, F.col("plane_id") + 100).otherwise(F.col("plane_id")).alias("plane_id"),
        F.when(host, "/host:CPU").otherwise(F.col("plane")).alias("plane"), "line_id", "line", "seq", "name",
        (F.col("begin") % DAY * 1_000_000).alias("begin"), (F.col("dur") * 1_000_000).alias("dur"), stats.alias("stats"),
    )
    meta = t.spans.select("name").distinct().select("name", _stats(symbol_id=("int", F.length("name") + 1), program_id=("int", F.length("name") % 7)).alias("stats"))
    return spans, meta


def decoded(t) -> dict:
    """The tables of the files, decoded once."""
    files = sp.encode_spaces(*filed(t), origin_ns=ORIGIN_US * 1000)
    return sp.tables(checkpointed(sp.decode_tables(files)))


def spans_with_stats(t):
    found = decoded(t)
    return sp.with_stats(found["spans"], found["event_meta"])


@query(
    "s3_spans",
    f"""SELECT session, host, plane_id, plane, line_id, line, name, row_number() OVER (PARTITION BY session, host, plane_id, line_id {_ORDER}) - 1 AS seq,
  (started - min(started) OVER (PARTITION BY session, host)) * 1000000 AS begin, dur * 1000000 AS dur, CASE WHEN name IN ('signup', 'purchase') THEN correlation_id END AS correlation_id,
  -seq AS delta, value, name AS type, props AS note, 'e' || seq AS raw FROM filed""",
    FILED,
)
def spans(t):
    """Every stat kind comes back with its type: positive and negative integers, numbers, texts by value and by reference, bytes."""
    x = decoded(t)["spans"]
    of = lambda name, kind: F.col("stats")[name][kind]
    return x.select(
        "session", "host", "plane_id", "plane", "line_id", "line", "name", "seq", "begin", "dur", of("correlation_id", "int").alias("correlation_id"),
        of("delta", "int").alias("delta"), of("value", "real").alias("value"), of("type", "text").alias("type"), of("note", "text").alias("note"), of("raw", "raw").cast("string").alias("raw"),
    )


@query(
    "s3_lines",
    "SELECT session, host, plane_id, plane, line_id, line, (min(started) - least) * 1000000 AS begin FROM filed JOIN (SELECT session, host, min(started) AS least FROM filed GROUP BY ALL) USING (session, host) GROUP BY session, host, plane_id, plane, line_id, line, least",
    FILED,
)
def lines(t):
    return decoded(t)["lines"].select("session", "host", "plane_id", "plane", "line_id", "line", "begin")


@query("s3_event_meta", "SELECT DISTINCT session, host, plane_id, name, length(name) + 1 AS symbol_id, length(name) % 7 AS program_id FROM filed", FILED)
def event_meta(t):
    x = decoded(t)["event_meta"]
    return x.select("session", "host", "plane_id", "name", F.col("stats")["symbol_id"]["int"].alias("symbol_id"), F.col("stats")["program_id"]["int"].alias("program_id"))


@query("s3_planes", "SELECT session, host, plane_id, plane FROM filed GROUP BY ALL", FILED)
def planes(t):
    return decoded(t)["planes"].select("session", "host", "plane_id", "plane")


@query("s3_f12_stat", "SELECT seq, CASE WHEN seq % 3 = 0 THEN seq % 50 ELSE length(name) + 1 END AS symbol_id, CAST(length(name) % 7 AS VARCHAR) AS program FROM filed", FILED)
def stat(t):
    """F12 over decoded files: a span's own stat comes before that of its dictionary entry."""
    return spans_with_stats(t).select((-sp.stat_int("delta")).alias("seq"), sp.stat_int("symbol_id").alias("symbol_id"), sp.stat_text("program_id").alias("program"))


@query(
    "s3_j2_with_op_template",
    """SELECT o.name AS op, count(*) AS n, CAST(sum(e.dur) AS BIGINT) * 1000000 AS time FROM
  (SELECT dur, length(name) % 7 AS program_id, CASE WHEN seq % 3 = 0 THEN seq % 50 ELSE length(name) + 1 END AS symbol_id FROM filed) e
  JOIN ops o USING (program_id, symbol_id) WHERE symbol_id <> 0 GROUP BY ALL""",
    FILED,
)
def with_op_template(t):
    x = spans_with_stats(t).select("dur", sp.stat_int("program_id").alias("program_id"), sp.stat_int("symbol_id").alias("symbol_id"))
    return fitting(op_times(jn.with_op_template(x, t.ops)), "time")


def op_times(events):
    """(op, n, time) of events with their op; time is a decimal, as picoseconds of some thousand half-hours pass 64 bits."""
    return events.groupBy(F.col("name").alias("op")).agg(F.count("*").alias("n"), F.sum(F.col("dur").cast("decimal(38,0)")).alias("time"))


@query(
    "s3_j4_connect_flows",
    """SELECT p.seq AS producer, c.seq AS consumer FROM filed p JOIN filed c USING (session, host, correlation_id)
  JOIN (SELECT session, host, correlation_id FROM filed GROUP BY ALL HAVING count(*) FILTER (name IN ('signup', 'purchase')) < 4 OR count(*) FILTER (name IN ('view', 'click')) < 4) k
  USING (session, host, correlation_id) WHERE p.name IN ('signup', 'purchase') AND c.name IN ('view', 'click')""",
    FILED,
)
def connect_flows(t):
    return jn.connect_flows(sp.flow_links(spans_with_stats(t), -sp.stat_int("delta")), 4)


@query(
    "s3_j5_connect_launches",
    """SELECT l.launch, e.seq AS execute FROM filed e JOIN (SELECT session, host, correlation_id, arg_max(seq, row(started, seq)) AS launch FROM filed WHERE name = 'signup' GROUP BY ALL) l
  USING (session, host, correlation_id) WHERE name = 'purchase'""",
    FILED,
)
def connect_launches(t):
    launches, executes = sp.launches(spans_with_stats(t).withColumn("seq", -sp.stat_int("delta")))
    return jn.connect_launches(launches, executes)


_NOTE = "CASE WHEN seq % 7 = 0 THEN repeat(props, 8) END"


def noted(t):
    """Spans whose long_name is a long text, or their name only."""
    spans, meta = filed(t)
    note = F.when(F.col("seq") % 7 == 0, F.repeat(F.col("stats")["note"]["text"], 8)).otherwise(F.col("name"))
    spans = spans.withColumn("stats", F.map_concat("stats", F.create_map(F.lit("long_name"), _value("text", note))))
    found = sp.tables(checkpointed(sp.decode_tables(sp.encode_spaces(spans, meta, origin_ns=ORIGIN_US * 1000))))
    return sp.with_stats(found["spans"], found["event_meta"])


@query("r21_frame_table", f"SELECT DISTINCT {_NOTE} AS text FROM filed WHERE length({_NOTE}) > 16", FILED)
def frame_table(t):
    """Each long text once and whole; numbers follow an order of hashes."""
    return sp.frame_table(noted(t), limit=None).select("text")


@query("r21_event_frames", f"SELECT seq, CASE WHEN length({_NOTE}) > 16 THEN {_NOTE} END AS text FROM filed", FILED)
def event_frames(t):
    """The recorded frame of each event, whole."""
    spans = checkpointed(noted(t))
    frames = checkpointed(sp.frame_table(spans, limit=None))
    found = sp.with_frame(spans, frames, limit=None).select((-sp.stat_int("delta")).alias("seq"), "frame")
    key = F.coalesce("frame", -1 - F.col("seq"))  # events without a frame, which match none, are spread
    return found.withColumn("frame", key).join(frames.select("frame", "text"), "frame", "left").select("seq", "text")


@query(
    "s6_tools_of_files",
    """SELECT DISTINCT session, host, t.tool FROM filed, (VALUES ('trace_viewer@'), ('overview_page'), ('input_pipeline_analyzer'), ('framework_op_stats'), ('memory_profile'), ('op_profile'), ('hlo_stats'), ('roofline_model')) t(tool)
  UNION SELECT session, host, t.tool FROM filed, (VALUES ('perf_counters'), ('utilization_viewer'), ('kernel_utilization')) t(tool) WHERE name = 'error' AND seq % 200 = 3 AND plane LIKE '/device:TPU:%'
  UNION SELECT session, host, 'megascale_stats' FROM filed WHERE name = 'signup' AND seq % 100 = 7
  UNION SELECT session, host, t.tool FROM filed, (VALUES ('memory_viewer'), ('graph_viewer')) t(tool) WHERE name = 'signup' AND seq % 100 = 8""",
    FILED,
)
def tools_of_files(t):
    """Some devices' errors carry counters, some of the hosts' sign-ups are transfers or programs."""
    spans, meta = filed(t)
    seq, host = F.col("seq"), F.col("name") == "signup"
    counter = F.when((F.col("name") == "error") & (seq % 200 == 3), F.create_map(F.lit("counter_value"), _value("int", seq)))
    spans = spans.withColumn("stats", F.map_concat("stats", F.coalesce(counter, F.create_map().cast(f"map<string, {sp.VALUE}>"))))
    program, transfer = host & (seq % 100 == 8), host & (seq % 100 == 7)
    spans = spans.withColumns({
        "plane": F.when(program, "/host:metadata").otherwise(F.col("plane")), "plane_id": F.when(program, 500).otherwise(F.col("plane_id")),
        "name": F.when(program, "module").when(transfer, F.concat(F.lit("MegaScale:"), "name")).otherwise(F.col("name")),
    })
    proto = t.spark.range(1).select(F.lit("module").alias("name"), _stats(**{"Hlo Proto": ("raw", F.lit("x"))}).alias("stats"))
    found = sp.tables(checkpointed(sp.decode_tables(sp.encode_spaces(spans, meta.unionByName(proto), origin_ns=ORIGIN_US * 1000))))
    return sp.tools_of(found).select("session", "host", "tool")
