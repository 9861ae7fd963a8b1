"""Queries of the overview as one report."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import metrics as mt
from spanforge.plans import overview as ov
from spanforge.plans import steps as sp

from .registry import query
from .reports import _DUTY, _FRAMEWORK, off
from .steps import _VERDICT, pipeline_steps
from .tables import METRICS, metrics


def requests(t):
    k = F.col("request_id")
    return t.requests.select(k, (F.col("end_ts") - F.col("begin")).alias("total"), (k % 1000).alias("device"), (k % 77).alias("communication"))


_REQUESTS = "rq AS (SELECT request_id, end_ts - begin AS total, request_id % 1000 AS device, request_id % 77 AS communication FROM requests)"
_LATENCY = (
    _REQUESTS
    + """, ordered AS (SELECT *, row_number() OVER (ORDER BY total, request_id) - 1 AS i, count(*) OVER () AS n FROM rq),
latency AS (SELECT 0 AS place, 'Avg' AS label, avg(total - device - communication) AS host, avg(device) AS device, avg(communication) AS communication, avg(total) AS total FROM rq UNION ALL
  SELECT p.place, p.label, total - device - communication, device, communication, total FROM ordered JOIN (VALUES (1, '50.0%', 50.0), (2, '75.0%', 75.0), (3, '90.0%', 90.0), (4, '99.0%', 99.0), (5, '99.9%', 99.9)) p(place, label, pct)
  ON i = least(CAST(floor(pct * n / 100) AS BIGINT), n - 1))"""
)


@query("a30_latency_table", "SELECT place, label, round(host, 4) AS host, round(device, 4) AS device, round(communication, 4) AS communication, round(total, 4) AS total FROM latency", _LATENCY)
def latency_table(t):
    return ov.latency_table(requests(t)).withColumns({x: F.round(x, 4) for x in ov.LATENCIES})


_SHARES = """hostops AS (SELECT name, count(*) AS occurrences, CAST(sum(dur) AS BIGINT) AS self_time, name = 'click' AS eager FROM spans GROUP BY name),
opshares AS (SELECT 100.0 * h.n / (h.n + d.n) AS a, 100.0 * d.n / (h.n + d.n) AS b, 100.0 * h.e / h.t AS c, 100.0 * d.e / d.t AS d FROM
  (SELECT sum(occurrences) AS n, sum(self_time) AS t, sum(CASE WHEN eager THEN self_time ELSE 0 END) AS e FROM hostops) h, (SELECT sum(occurrences) AS n, sum(self_time) AS t, sum(CASE WHEN symbol_id % 3 = 0 THEN self_time ELSE 0 END) AS e FROM metrics) d)"""


def sides(t):
    host = t.spans.groupBy("name").agg(F.count("*").alias("occurrences"), F.sum("dur").alias("self_time")).select("occurrences", "self_time", F.lit("Unknown").alias("category"), (F.col("name") == "click").alias("eager"))
    return host, metrics(t).select("occurrences", "self_time", "category", (F.col("symbol_id") % 3 == 0).alias("eager"))


@query("a38_op_shares", "SELECT round(a, 6) AS host_tf_op_percent, round(b, 6) AS device_tf_op_percent, round(c, 6) AS host_op_time_eager_percent, round(d, 6) AS device_op_time_eager_percent FROM opshares", METRICS + ", " + _SHARES)
def op_shares(t):
    out = ov.op_shares(*sides(t))
    return out.select(*(F.round(x, 6).alias(x) for x in out.columns))


_SECTIONS = """env AS (SELECT count(DISTINCT host) AS hosts, count(DISTINCT plane_id) AS planes, count(DISTINCT (plane_id, line_id)) AS tracks, count(*) AS events, count(DISTINCT name) AS names, max(begin + dur) - min(begin) AS extent FROM spans),
half AS (SELECT sum(CASE WHEN symbol_id % 50 = 0 THEN self_time ELSE 0 END) AS p16, sum(CASE WHEN symbol_id % 50 <> 0 THEN self_time ELSE 0 END) AS p32 FROM metrics),
percents AS (SELECT a, b, c, d, 100.0 * busy / (busy + idle) AS e, 100.0 * p16 / (p16 + p32) AS f, 100.0 * p32 / (p16 + p32) AS g FROM opshares, duty, half)"""


@query(
    "r1_overview_report",
    """SELECT 'environment' AS section, v.place, v.name, CAST(v.value AS DOUBLE) AS value, NULL AS text FROM env, LATERAL (VALUES (0, 'hosts', hosts), (1, 'planes', planes), (2, 'tracks', tracks), (3, 'events', events), (4, 'names', names), (5, 'extent', extent)) v(place, name, value)
  UNION ALL SELECT 'properties', v.place, v.name, round(v.value, 6), concat(printf('%.1f', round(v.value, 1)), '%') FROM percents, LATERAL (VALUES (0, 'host_tf_op_percent', a), (1, 'device_tf_op_percent', b), (2, 'host_op_time_eager_percent', c), (3, 'device_op_time_eager_percent', d),
    (4, 'device_duty_cycle_percent', e), (5, 'device_compute_16bit_percent', f), (6, 'device_compute_32bit_percent', g)) v(place, name, value)
  UNION ALL SELECT 'top_ops', rank, op_name, round(f, 6), 'Op' FROM placed WHERE side = 'Device' AND rank <= 10
  UNION ALL SELECT 'recommendation', v.place, v.name, NULL, v.text FROM (SELECT CASE WHEN input_bound <> 'not' THEN 'input' WHEN output_bound <> 'not' THEN 'output' ELSE 'device' END AS bottleneck, CASE WHEN output_bound <> 'not' AND input_bound <> 'highly' THEN output_text ELSE input_text END AS statement,
    CASE WHEN input_bound <> 'not' THEN 'input_pipeline, trace_viewer' WHEN output_bound <> 'not' THEN 'trace_viewer, memory_profile' ELSE 'op_profile, roofline_model' END AS tools FROM worded), LATERAL (VALUES (0, 'bottleneck', bottleneck), (1, 'statement', statement), (2, 'tools', tools)) v(place, name, text)
  UNION ALL SELECT 'recommendation', 3, 'precision', round(f, 6), concat('Only ', printf('%.1f', round(f, 1)), '% of the device''s compute time is in 16 bits; more ops in 16 bits would be faster where the accuracy allows.') FROM percents WHERE f < 10
  UNION ALL SELECT 'latency', 4 * place + v.k, concat(v.name, ' ', label), round(v.value / 1000, 6), NULL FROM latency, LATERAL (VALUES (0, 'host', host), (1, 'device', device), (2, 'communication', communication), (3, 'total', total)) v(k, name, value)
  UNION ALL SELECT 'diagnostics', 1, 'warning', NULL, concat(n - k, ' of ', n, ' steps are not on every device.') FROM (SELECT (SELECT count(DISTINCT step) FROM steps) AS n, (SELECT count(*) FROM (SELECT step FROM steps GROUP BY step HAVING count(DISTINCT plane_id) = (SELECT count(DISTINCT plane_id) FROM steps))) AS k) WHERE k > 0 AND k < n""",
    ", ".join((METRICS, _DUTY, _FRAMEWORK, _VERDICT, _SHARES, _SECTIONS, _LATENCY)),
)
def overview_report(t):
    host, device = sides(t)
    framework = mt.framework_ops(metrics(t).withColumn("provenance", F.translate("provenance", " #", "__")))
    half = F.col("symbol_id") % 50 == 0
    precision = metrics(t).agg(F.sum(F.when(half, F.col("self_time")).otherwise(0)).alias("compute_16"), F.sum(F.when(half, 0).otherwise(F.col("self_time"))).alias("compute_32"))
    verdict = sp.input_pipeline_verdict(pipeline_steps(t))
    out = ov.overview_report(t.spans, t.steps, off(), framework, host, device, verdict, precision, requests(t))
    return out.withColumn("value", F.round("value", 6))
